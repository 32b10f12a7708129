"""Posting pages: labelled fields out of stored HTML, and the links worth following.

A page is cut at its tags once, without scripts, styles and comments, and one pass over the tags finds the tag that
closes every element. Fields, list members, linked names and
labelled rows are then intervals of tags: always whole, whatever is nested in them. An element that is never closed ends
where the element around it ends; a closing tag that nothing opened is passed over.

The pass is plain Python over Arrow batches, without a shuffle. As array expressions, which Spark
interprets, it copied its stack at every tag.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacansight.functions import parsing, skills
from vacansight.functions.text import BLOCK_TAGS, ENTITIES, WHITE_SPACE
from vacansight.vocab import MISSING, SKILL_PATTERNS

# what runs on the executors is sent there whole: like all other jobs of this part, it does not need the package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _any_case(name: str) -> str:
    """A pattern for upper and lower case of ASCII letters only, as in Spark's patterns."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


# the patterns of ``visible_html``, ``decoded`` and ``shown_text`` in ``functions.text``
_BLANK = r" \t\n\x0b\f\r"
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_HIDDEN = re.compile("(?s)<!--.*?(?:-->|\\Z)" + "".join(rf"|<{n}\b[^>]*>.*?(?:</{n}[{_BLANK}]*>|\Z)" for n in map(_any_case, ("script", "style", "template", "noscript"))))
_RUN = re.compile(rf"[{_BLANK}]{{2,}}|[\t\n\x0b\f\r]")  # a single blank stays as it is
_BLOCK = re.compile(rf"</?(?:{'|'.join(map(_any_case, BLOCK_TAGS))})(?=[{_BLANK}/>])[^>]*>")
_INLINE = re.compile("</?[A-Za-z!][^>]*>")
_BREAK = re.compile(" *\n[ \n]*")
_REFERENCE = re.compile("&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);")


def _character(found: re.Match) -> str:
    name = found[1]
    if name[0] != "#":
        return ENTITIES.get(name, found[0])
    number = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(number) if 1 <= number <= 0xD7FF or 0xE000 <= number <= 0x10FFFF else found[0]


def shown(html: str) -> str:
    """``shown_text`` of one text."""
    text = _RUN.sub(" ", html)
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub("\n", text))
        if "\n" in text:
            text = _BREAK.sub("\n", text)
    if "&" in text:
        text = _REFERENCE.sub(_character, text)
    return text.strip(WHITE_SPACE)


@dataclass(frozen=True)
class Element:
    """Elements of a name, all or those that carry a class."""

    tag: str
    css_class: str | None = None

    @cached_property
    def marked(self) -> re.Pattern:
        """Finds the class in an opening tag."""
        return re.compile(rf"""\b{_any_case("class")}=["'][^"']*\b{self.css_class}\b[^"']*["']""")


@dataclass(frozen=True)
class LabelledRow:
    """The value cell that follows exactly this label."""

    label: str


def element(tag: str, css_class: str | None = None) -> Element:
    return Element(tag, css_class)


def row_of(label: str) -> LabelledRow:
    return LabelledRow(label)


Place = Element | LabelledRow


@dataclass(frozen=True)
class PageRules:
    """Places of one site. ``texts`` give one value, ``lists`` all elements, ``linked`` the link texts inside a value
    joined with commas; ``education`` is the block of labelled rows; ``starred`` marks a preferred skill inside a skill chip."""

    texts: dict[str, Place] = field(default_factory=dict)
    lists: dict[str, Element] = field(default_factory=dict)
    linked: dict[str, Place] = field(default_factory=dict)
    education: Element | None = None
    skill_chips: Element | None = None
    starred: str | None = None


POSTING_PAGE = PageRules(
    texts={
        "title": element("h1", "title"),
        "company": element("div", "company"),
        "experience": element("div", "experience"),
        "location": element("div", "location"),
        "salary": element("div", "salary"),
        "working_type": element("div", "work-mode"),
        "description": element("div", "description"),
        "company_rating": element("span", "rating"),
        "company_reviews_raw": element("span", "reviews"),
        "posted_raw": row_of("Posted:"),
        "openings_raw": row_of("Openings:"),
        "applicants_raw": row_of("Applicants:"),
        "employment_type": row_of("Employment Type:"),
        "role_category": row_of("Role Category:"),
        "listed_role": row_of("Role:"),
    },
    lists={"company_badges": element("span", "badge")},
    linked={"industry_type": row_of("Industry Type:"), "department": row_of("Department:")},
    education=element("section", "education"),
    skill_chips=element("a", "chip"),
    starred=r"<i[^>]*star",
)


class Page:
    """One page, cut at its tags. Elements are known by the place of their opening tag among all tags; ``close`` has the place of
    the tag that closes them, the number of tags if none does."""

    def __init__(self, html: str):
        self.html = html = _HIDDEN.sub("", html)
        self.starts: list[int] = []
        self.names: list[str] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the elements of a name, in page order
        self._marked: dict[str, list[tuple[int, str]]] = {}
        starts, names, places, close = self.starts, self.names, self.places, {}
        at: list[int] = []
        around: list[str] = []
        for place, tag in enumerate(_TAG.finditer(html)):
            closing, name = tag.groups()
            name = name.lower()
            starts.append(tag.start())
            names.append(name)
            if name in VOID:
                continue
            if not closing:
                at.append(place)
                around.append(name)
                places[name].append(place)
            elif around and around[-1] == name:
                around.pop()
                close[at.pop()] = place
            elif name in around:  # closes what is still open inside it, too
                while around[-1] != name:
                    around.pop()
                    close[at.pop()] = place
                around.pop()
                close[at.pop()] = place
        close.update(dict.fromkeys(at, len(starts)))
        self.close: dict[int, int] = close
        starts.append(len(html))

    def after(self, place: int) -> int:
        """Where the text right after a tag begins; a tag without end is such a text itself."""
        start = self.starts[place]
        return self.html.find(">", start, self.starts[place + 1]) + 1 or start

    def marked(self, name: str) -> list[tuple[int, str]]:
        """Elements of a name that have attributes, each with its opening tag."""
        if name not in self._marked:
            tags = ((e, self.html[self.starts[e] : self.starts[e + 1]].partition(">")[0]) for e in self.places.get(name, ()))
            self._marked[name] = [(e, tag) for e, tag in tags if "=" in tag]
        return self._marked[name]

    def inner(self, e: int) -> str:
        """HTML between the tags of an element."""
        return self.html[self.after(e) : self.starts[self.close[e]]]

    def text(self, e: int) -> str:
        return shown(self.inner(e))

    def all_of(self, place: Element, within: int | None = None) -> Iterator[int]:
        """Elements of a place in page order, or those of them inside an element."""
        if place.css_class:
            fits = place.marked.search
            named = (e for e, tag in self.marked(place.tag) if fits(tag))
            return named if within is None else (e for e in named if within < e < self.close[within])
        named = self.places.get(place.tag, [])
        return iter(named if within is None else named[bisect_right(named, within) : bisect_left(named, self.close[within])])

    def texts_of(self, place: Element, within: int | None = None) -> list[str]:
        return [t for t in map(self.text, self.all_of(place, within)) if t]

    def labelled_values(self, within: int | None = None) -> Iterator[tuple[int, int]]:
        """Labels and the value cells right after them."""
        for label in self.all_of(Element("label"), within):
            end = self.close[label]
            value = end + 1
            if value in self.close and self.names[value] == "span" and not self.html[self.after(end) : self.starts[value]].strip(WHITE_SPACE):
                yield label, value

    @cached_property
    def rows(self) -> dict[str, int]:
        """The first value of each label of the page."""
        out: dict[str, int] = {}
        for label, value in self.labelled_values():
            out.setdefault(self.text(label), value)
        return out

    def first(self, place: Place) -> int | None:
        """The first element of a place, None if there is none."""
        return next(self.all_of(place), None) if isinstance(place, Element) else self.rows.get(place.label)

    def education(self, block: int | None) -> dict[str, str]:
        """Label and value of the rows of the block; of labels that are stated twice the last row counts."""
        out: dict[str, str] = {}
        for label, value in () if block is None else self.labelled_values(block):
            name, text = self.text(label).rstrip(":").strip(WHITE_SPACE), self.text(value)
            if name and text:
                out.pop(name, None)
                out[name] = text
        return out


def _readers(rules: PageRules, record: bool) -> dict[str, tuple[str, pa.DataType, Callable[[Page], object]]]:
    """For each field its type and how it is read; with ``record`` also the skill chips and the education."""

    def text(place: Place):
        return lambda page: None if (e := page.first(place)) is None else page.text(e) or None

    def linked(place: Place):
        return lambda page: None if (e := page.first(place)) is None else ", ".join(page.texts_of(Element("a"), e)) or None

    def chips(page: Page) -> list[dict]:
        inner = map(page.inner, page.all_of(rules.skill_chips))
        return [{"name": name, "starred": starred is not None and starred.search(html) is not None} for html in inner if (name := shown(html))]

    starred = re.compile(rules.starred) if rules.starred else None
    some = pa.list_(pa.string())
    out = {name: ("string", pa.string(), text(place)) for name, place in rules.texts.items()}
    out |= {name: ("array<string>", some, lambda page, place=place: page.texts_of(place)) for name, place in rules.lists.items()}
    out |= {name: ("string", pa.string(), linked(place)) for name, place in rules.linked.items()}
    if record:
        chip = pa.struct([("name", pa.string()), ("starred", pa.bool_())])
        out["_chips"] = ("array<struct<name:string,starred:boolean>>", pa.list_(chip), chips)
        out["education"] = ("map<string,string>", pa.map_(pa.string(), pa.string()), lambda page: list(page.education(page.first(rules.education)).items()))
    return out


def _read(pages: DataFrame, rules: PageRules, html_col: str, record: bool = False) -> DataFrame:
    """``pages`` with ``_record``, a struct of the fields, computed once per page."""
    fields = _readers(rules, record)
    kind = T.StructType([T.StructField(name, T._parse_datatype_string(f[0])) for name, f in fields.items()])
    schema = T.StructType([*pages.schema.fields, T.StructField("_record", kind)])
    # as bytes: what is no UTF-8 is replaced and not refused
    source = pages.select("*", F.col(html_col).cast("binary").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = _readers(rules, record)
        for batch in batches:
            columns: list[list] = [[] for _ in readers]
            for html in batch.column(batch.num_columns - 1).to_pylist():
                # a page that is NULL has what an empty one has
                page = Page("" if html is None else html.decode("utf-8", "replace"))
                for column, (_, _, read) in zip(columns, readers.values()):
                    column.append(read(page))
            made = [pa.array(column, arrow) for column, (_, arrow, _) in zip(columns, readers.values())]
            whole = pa.StructArray.from_arrays(made, fields=[pa.field(name, a.type) for name, a in zip(readers, made)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], whole], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def extract_fields(pages: DataFrame, rules: PageRules, html_col: str = "html") -> DataFrame:
    """Adds one column per rule; what is not on the page is NULL or empty."""
    found = _read(pages, rules, html_col)
    return found.withColumns({name: F.col("_record")[name] for name in found.schema["_record"].dataType.names}).drop("_record")


def page_fields(pages: DataFrame, as_of: Column, rules: PageRules = POSTING_PAGE) -> DataFrame:
    """Raw posting records of the pages; pages without a description give no record."""
    c = F.col
    kept = pages.select(*[n for n in pages.columns if n in ("url", "html", "source_search")])
    found = _read(kept, rules, "html", record=True)
    found = found.select(*[c(f"`{n}`") for n in kept.columns if n != "html"], "_record.*").filter(c("description").isNotNull()).withColumns(
        {
            "key_skills": F.transform("_chips", lambda chip: chip["name"]),
            "preferred_key_skills": F.transform(F.filter("_chips", lambda chip: chip["starred"]), lambda chip: chip["name"]),
        }
    )
    found = skills.mine_terms(found, "description", SKILL_PATTERNS, "_mined")
    counted = parsing.applicants(c("applicants_raw"))
    return found.select(
        "url", "title", "company", "experience", "location", "salary", "key_skills",
        skills.not_already_tagged(c("_mined"), c("key_skills")).alias("tech_in_description"),
        "preferred_key_skills", "company_badges", "employment_type", "working_type", "role_category",
        "listed_role", "industry_type", "department",
        parsing.posted_date(c("posted_raw"), as_of).cast("string").alias("posted_date"),
        "posted_raw",
        parsing.first_whole_number(c("openings_raw")).alias("openings"),
        counted["count"].alias("applicant_count"),
        counted["qualifier"].alias("applicant_count_qualifier"),
        "company_rating",
        parsing.suffixed_count(c("company_reviews_raw")).alias("company_reviews"),
        "education", "description",
        F.lit(MISSING).alias("source_search") if "source_search" not in pages.columns else c("source_search"),
    )


def page_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, pos, url`` of every link, in page order."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return pages.select("page_id", F.posexplode_outer(hrefs).alias("pos", "url")).filter(F.col("url").isNotNull())


def discover_urls(links: DataFrame, site: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Distinct URLs whose host part contains ``site``, by first occurrence.

    A link without a host is off-site. The first occurrence is a minimum per URL, so
    a link on every page is one row per task in the shuffle.
    """
    onsite = links.filter(F.try_parse_url("url", F.lit("AUTHORITY")).contains(site))
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = onsite.groupBy("url").agg(F.min(place).alias("_first"))
    shown = [F.col("_first").alias(order[0])] if len(order) == 1 else [F.col(f"_first.{o}").alias(o) for o in order]
    ordered = first.orderBy("_first").select("url", *shown)
    return ordered if limit is None else ordered.limit(limit)
