"""Skill names: tag normalisation, categories and mining of description text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansight.functions.text import initcap_runs, let, look_up, strip, strip_each
from vacansight.vocab import ALTERNATIVE_GROUPS, SKILL_CATEGORIES, tag_lookup

_TEXT_ARRAY = "array<string>"


def normalise_skill(c: Column) -> Column:
    return let(strip(c), _agreed)


def _agreed(tag: Column) -> Column:
    return let(F.lower(tag), lambda low: F.coalesce(look_up(tag_lookup(), low), initcap_runs(tag)))


def normalise_skills(tags: Column) -> Column:
    """Agreed names, distinct and sorted; NULL and blank tags drop out."""
    stripped = strip_each(F.coalesce(tags, F.array().cast(_TEXT_ARRAY)), F.array_join(tags, ""))
    return F.sort_array(F.array_distinct(F.transform(F.filter(stripped, lambda t: t != ""), _agreed)))


def merge_skills(tags: Column, mined: Column) -> Column:
    none = F.array().cast(_TEXT_ARRAY)
    return normalise_skills(F.concat(F.coalesce(tags, none), F.coalesce(mined, none)))


def preferred_skills(skills: Column, starred: Column) -> Column:
    """Starred tags, kept only where they are skills of the posting."""
    return F.array_intersect(skills, normalise_skills(starred))


def skill_category(name: Column) -> Column:
    return look_up(SKILL_CATEGORIES, name)


def not_already_tagged(mined: Column, tags: Column) -> Column:
    """Mined names that no tag spells, whatever the case."""
    tagged = F.transform(F.coalesce(tags, F.array().cast(_TEXT_ARRAY)), F.lower)
    return F.filter(mined, lambda m: ~F.array_contains(tagged, F.lower(m)))


def _anchor(pattern: str) -> str:
    """The longest piece of plain text that every match of ``pattern`` contains.

    The pattern is cut at character classes, optional characters and wildcards;
    escaped punctuation stands for itself. Alternatives are separate patterns.
    """
    pieces = re.split(r"\\[a-z][+*?]?|\\\W\?|\[[^\]]*\]|(?<!\\)\.", pattern)
    return max((re.sub(r"\\(\W)", r"\1", piece) for piece in pieces), key=len).lower()


def mine_terms(df: DataFrame, text_col: str, vocabulary: dict[str, list[str]], out_col: str) -> DataFrame:
    """Adds the vocabulary entries that occur in ``text_col`` as whole words, in vocabulary order.

    Each pattern is tried only where a plain substring test, much cheaper than the
    pattern, already succeeded. The lower-cased text is made once per row.
    """
    lowered = f"_{text_col}_lower"
    text = F.col(text_col)

    def found(pattern: str) -> Column:
        bounded = f"(?i)(?<![a-zA-Z0-9])(?:{pattern})(?![a-zA-Z0-9])"
        return F.col(lowered).contains(_anchor(pattern)) & text.rlike(bounded)

    def any_of(patterns: list[str]) -> Column:
        hit = found(patterns[0])
        for pattern in patterns[1:]:
            hit = hit | found(pattern)
        return hit

    hits = [F.when(any_of(patterns), name) for name, patterns in vocabulary.items()]
    return (
        df.withColumn(lowered, F.lower(text))
        .withColumn(out_col, F.array_compact(F.array(*hits)))
        .drop(lowered)
    )


def _members(skills: Column, group: list[str]) -> Column:
    return F.filter(skills, lambda s: s.isin(group))


def _others(skills: Column, group: list[str]) -> Column:
    return F.filter(skills, lambda s: ~s.isin(group))


def group_alternatives(skills: Column, groups: list[list[str]] | None = None) -> Column:
    """Two or more skills of one group become a single ``A/B`` entry, placed first."""
    merged, rest = [], skills
    for group in groups or ALTERNATIVE_GROUPS:
        matched = _members(rest, group)
        collapse = F.size(matched) > 1
        merged.append(F.when(collapse, F.array_join(matched, "/")))
        rest = F.when(collapse, _others(rest, group)).otherwise(rest)
    return F.concat(F.array_compact(F.array(*merged)), rest)
