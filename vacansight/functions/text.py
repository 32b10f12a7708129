"""Text steps: missing values, canonical form, hashes, word casing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansight.vocab import MISSING


FEW = 32  # keys of a map that is looked up as it is

# The characters that count as white space.
NOT_PLAIN = "[^ -~]"  # any character but blanks and visible ASCII
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def literal_map(pairs: dict[str, str]) -> Column:
    """A fixed map; Spark folds it to a constant once per query."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def look_up(pairs: dict[str, str], key: Column) -> Column:
    """The value of ``key``, a cheap column. Spark compares with one key of a map after the other, so a
    long one is an array of maps by the number of bytes."""
    if len(pairs) <= FEW:
        return F.try_element_at(literal_map(pairs), key)
    by_size: dict[int, dict[str, str]] = {}
    for k, v in pairs.items():
        by_size.setdefault(len(k.encode()), {})[k] = v
    maps = F.from_json(F.lit(json.dumps([by_size.get(n, {}) for n in range(max(by_size) + 1)])), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, F.octet_length(key)), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside array functions,
    where Spark would otherwise compute it anew at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_blanks(c: Column) -> Column:
    """Trim blanks only: much cheaper, and the same for text of blanks and visible ASCII."""
    return F.trim(c)


def strip_each(pieces: Column, whole: Column) -> Column:
    """Every text of an array trimmed as by ``strip``. ``whole`` has all their characters: it is looked at once,
    and where it is plain, ``strip_blanks`` does."""
    return F.when(whole.rlike(NOT_PLAIN), F.transform(pieces, strip)).otherwise(F.transform(pieces, strip_blanks))


def list_parts(c: Column) -> Column:
    """The parts between commas, trimmed."""
    return strip_each(F.split(c, ","), c)


def present(c: Column) -> Column:
    """NULL for the missing-value mark and for text without a single letter or digit."""
    return F.when((c != MISSING) & c.rlike("[A-Za-z0-9]"), c)


def canonical(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " "))


def fingerprint(company: Column, title: Column, location: Column, experience: Column) -> Column:
    parts = [F.coalesce(canonical(c), F.lit("")) for c in (company, title, location, experience)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def description_hash(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.sha2(canonical(c), 256))


def initcap_runs(c: Column) -> Column:
    """Upper-case the first character of each run of letters and digits: ``ci/cd`` -> ``Ci/Cd``."""
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    cased = F.transform(
        runs,
        lambda run: F.when(
            run.rlike("^[A-Za-z0-9]"),
            F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.right(run, F.length(run) - 1))),
        ).otherwise(run),
    )
    return F.array_join(cased, "")


# Elements that stand on lines of their own, elements that are never shown, and the usual named characters.
BLOCK_TAGS = """address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul""".split()
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122",
    "middot": "\u00b7", "bull": "\u2022", "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019",
    "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "times": "\u00d7", "deg": "\u00b0", "euro": "\u20ac", "pound": "\u00a3",
}


def visible_html(c: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(c, HIDDEN, "")


def decoded(c: Column) -> Column:
    """Character references resolved once: numbers, and the names in ``ENTITIES``. What names no character stays as it is."""

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        legal = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(legal, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        char = F.when(name.startswith("#"), char).otherwise(look_up(ENTITIES, name))
        rest = F.concat(char, F.substr(part, F.char_length(name) + 2))
        return F.when(i == 0, part).otherwise(F.coalesce(rest, F.concat(F.lit("&"), part)))

    return let(c, lambda x: F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "&"), piece), "")).otherwise(x))


def strip_tags(c: Column) -> Column:
    """Text of an HTML fragment as a reader sees it: scripts, styles and comments left out, then as ``shown_text``."""
    return shown_text(visible_html(c))


def shown_text(c: Column) -> Column:
    """Text of HTML that has no scripts, styles and comments: a line break at every block, inline tags dropped, white
    space run together, character references resolved."""
    text = F.regexp_replace(c, r"[ \t\n\x0b\f\r]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?=[\s/>])[^>]*>", "\n")
    text = F.regexp_replace(text, "</?[A-Za-z!][^>]*>", "")
    return strip(decoded(F.regexp_replace(text, " *\n[ \n]*", "\n")))
