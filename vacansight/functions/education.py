"""Education block: requirement levels, and the degrees named in each level's text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansight.functions.text import NOT_PLAIN, let, look_up, strip, strip_blanks
from vacansight.vocab import DEGREES, LEVEL_ALIASES, SPECIALIZATION_ALIASES

NO_LEVELS = "array<struct<level:string,field_of_study:string>>"
NO_DEGREES = "array<struct<degree:string,level:string,specializations:array<string>>>"


Trim = Callable[[Column], Column]


def _trimmed(education: Column, read: Callable[[Trim], Column]) -> Column:
    """``read`` with the trimming step that the block needs: one look at the whole block tells where trimming blanks is enough."""
    whole = F.concat_ws("", F.map_keys(education), F.map_values(education))
    return F.when(whole.rlike(NOT_PLAIN), read(strip)).otherwise(read(strip_blanks))


def level_of(label: Column, trim: Trim = strip) -> Column:
    return F.coalesce(look_up(LEVEL_ALIASES, F.lower(trim(label))), trim(label))


def qualification_levels(education: Column) -> Column:
    """``array<struct<level, field_of_study>>`` of the block's filled rows."""
    rows = _trimmed(
        education,
        lambda trim: F.transform(
            F.map_entries(education),
            lambda e: F.struct(
                level_of(e["key"], trim).alias("level"),
                trim(F.coalesce(e["value"], F.lit(""))).alias("field_of_study"),
            ),
        ),
    )
    filled = F.filter(rows, lambda r: (r["level"] != "") & (r["field_of_study"] != ""))
    return F.coalesce(filled, F.array().cast(NO_LEVELS))


def specialization(c: Column) -> Column:
    return let(strip(c), _agreed)


def _agreed(text: Column) -> Column:
    worded = F.when(text.contains("And"), F.regexp_replace(text, r"\bAnd\b", "and")).otherwise(text)
    return F.coalesce(look_up(SPECIALIZATION_ALIASES, F.lower(text)), worded)


def degree_names(wording: Column, trim: Trim = strip) -> Column:
    """Slashes separate alternative degrees; a spelled-out expansion after a dash is dropped."""
    return (
        F.when(wording.contains("/"), F.transform(F.split(wording, "/"), trim))
        .when(wording.contains(" - "), F.array(trim(F.substring_index(wording, " - ", 1))))
        .otherwise(F.array(wording))
    )


# The degree wording a part starts with, longest first.
KNOWN_DEGREE = (
    "^(" + "|".join(re.escape(wording) for wording, _ in sorted(DEGREES, key=lambda row: -len(row[0]))) + ")(?= in |$)"
)


def _read_part(part: Column, at: Column) -> Column:
    """``known`` is empty where the part does not start with a known degree."""
    return F.struct(part.alias("part"), at.alias("at"), F.regexp_extract(part, KNOWN_DEGREE, 1).alias("known"))


def _group(opening: Column, following: Column, block_level: Column, trim: Trim) -> Column:
    """One opening part and the further specializations behind it, trimmed already."""
    part, known = opening["part"], opening["known"]
    unknown_name = F.substring_index(part, " in ", 1)
    named = F.length(F.when(known != "", known).otherwise(unknown_name))
    own = F.array(trim(F.substr(part, named + 5)))
    every = F.when(F.length(part) > named, F.concat(own, following)).otherwise(following)
    return F.struct(
        degree_names(F.when(known != "", known).otherwise(trim(unknown_name)), trim).alias("names"),
        F.coalesce(look_up(dict(DEGREES), known), block_level).alias("level"),
        F.transform(every, _agreed).alias("specializations"),
    )


def degrees_in(text: Column, block_level: Column, trim: Trim = strip) -> Column:
    """Degrees of one level's text with the specializations that belong to each.

    Commas separate degrees as well as specializations. A part that starts with a
    known degree opens a group (so does an unknown first part, at the block's own
    level); the parts up to the next opening are further specializations.
    """
    leads = F.coalesce(block_level, F.lit("")) != ""

    def grouped(read: Column) -> Column:
        opened = F.filter(read, lambda r: (r["known"] != "") | ((r["at"] == 0) & leads))
        return let(
            opened,
            lambda openings: F.transform(
                openings,
                lambda opening, number: _group(
                    opening,
                    F.transform(
                        F.slice(
                            read,
                            opening["at"] + 2,
                            F.coalesce(F.get(openings, number + 1)["at"], F.size(read)) - opening["at"] - 1,
                        ),
                        lambda r: r["part"],
                    ),
                    block_level,
                    trim,
                ),
            ),
        )

    parts = F.filter(F.transform(F.split(text, ","), trim), lambda p: p != "")
    groups = let(F.transform(parts, _read_part), grouped)
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                g["names"],
                lambda name: F.struct(
                    name.alias("degree"), g["level"].alias("level"), g["specializations"].alias("specializations")
                ),
            ),
        )
    )


def degree_breakdown(education: Column) -> Column:
    """All degrees of the whole education block."""
    per_level = _trimmed(
        education,
        lambda trim: F.transform(
            F.map_entries(education),
            lambda e: let(level_of(e["key"], trim), lambda level: degrees_in(F.coalesce(e["value"], F.lit("")), level, trim)),
        ),
    )
    return F.coalesce(F.flatten(per_level), F.array().cast(NO_DEGREES))
