"""Responsibilities and requirements parts of a description, by heading lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansight.functions.text import let, strip
from vacansight.vocab import HEADING_LINE, REQUIREMENT_HEADINGS, RESPONSIBILITY_HEADINGS

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _has_any(text: Column, phrases: list[str]) -> Column:
    hit = text.contains(phrases[0])
    for phrase in phrases[1:]:
        hit = hit | text.contains(phrase)
    return hit


def _heading(line: Column, at: Column) -> Column:
    wording = F.lower(strip(F.regexp_replace(line, ":+$", "")))
    kind = (
        F.when(~line.rlike(HEADING_LINE), F.lit(None).cast("string"))
        .when(_has_any(wording, RESPONSIBILITY_HEADINGS), "responsibilities")
        .when(_has_any(wording, REQUIREMENT_HEADINGS), "requirements")
        .otherwise("other")
    )
    return F.struct(at.alias("at"), kind.alias("kind"))


def _section(lines: Column, headings: Column, kind: str) -> Column:
    parts = F.transform(
        headings,
        lambda h, number: F.when(
            h["kind"] == kind,
            F.slice(
                lines, h["at"] + 2, F.coalesce(F.get(headings, number + 1)["at"], F.size(lines)) - h["at"] - 1
            ),
        ),
    )
    body = F.filter(F.flatten(F.array_compact(parts)), lambda line: line != "")
    return F.nullif(F.array_join(body, "\n"), F.lit(""))


def description_sections(description: Column) -> Column:
    """``struct(responsibilities, requirements)``.

    Every heading-shaped line ends the section before it; only a recognised one
    starts a new section, which runs to the next heading.
    """

    def split(lines: Column) -> Column:
        return let(
            F.filter(F.transform(lines, _heading), lambda h: h["kind"].isNotNull()),
            lambda headings: F.struct(
                _section(lines, headings, "responsibilities").alias("responsibilities"),
                _section(lines, headings, "requirements").alias("requirements"),
            ),
        )

    return let(F.transform(F.split(description, LINE_BREAK), strip), split)
