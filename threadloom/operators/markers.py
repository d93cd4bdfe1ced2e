"""Marker lexicons: loading, building sets, and matching texts against them as unrolled expressions."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.textfns import strip

Lexicon = dict[str, dict[str, list[str]]]


def load_lexicon(path: str | None) -> Lexicon:
    """A lexicon file (JSON: section, key, list of markers), names and markers stripped and in lower case.

    A missing or unreadable file, or one that holds no object, is an empty lexicon; markers that aren't text or are blank are left out.
    """
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError):
        return {}
    if not isinstance(raw, dict):
        return {}
    clean = lambda x: [m.strip().lower() for m in x if isinstance(m, str) and m.strip()] if isinstance(x, list) else []
    return {
        str(s).strip().lower(): {str(k).strip().lower(): clean(v) for k, v in keys.items()} for s, keys in raw.items() if isinstance(keys, dict)
    }


def marker_set(language: str, lexicon: Lexicon, keys: list[str]) -> dict[str, list[str]]:
    """Markers by key for a language (``multi``: every section), common ones first, each once, in their order."""
    sections = ["common", *([s for s in lexicon if s != "common"] if language == "multi" else [language])]
    return {k: list(dict.fromkeys(m for s in sections for m in lexicon.get(s, {}).get(k, []))) for k in keys}


def contains_any(text: Column, markers: list[str]) -> Column:
    """Whether a text contains any marker, in any case and anywhere in a word; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, m: a | low.contains(m), markers, F.lit(False))


def distinct_hits(text: Column, markers: list[str]) -> Column:
    """How many of the markers a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda n, m: n + low.contains(m).cast("int"), markers, F.lit(0))


def strength(text: Column, markers: list[str], extra: str = r"\p{Nd}") -> Column:
    """Marker hits, one more for a match of ``extra`` (digits by default) and one more for a colon of either width; 0 for blank."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = distinct_hits(text, markers) + low.rlike(extra).cast("int") + low.rlike("[:：]").cast("int")
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.lit(0)).otherwise(score)


def mixed(text: Column, positive: list[str], negative: list[str]) -> Column:
    """Whether a text has markers of both sets."""
    return contains_any(text, positive) & contains_any(text, negative)


def is_no_action(step: Column, markers: list[str]) -> Column:
    """Whether a step says that nothing is to be done: it holds one of the markers, in any case; a null step says nothing."""
    return F.coalesce(contains_any(strip(step), markers), F.lit(False))


def has_actions(steps: Column, markers: list[str]) -> Column:
    """Whether any step of a list is an action; false for an empty or null list. Null steps count as none."""
    return F.coalesce(F.exists(steps, lambda x: F.coalesce(~is_no_action(x, markers) & x.isNotNull(), F.lit(False))), F.lit(False))


def clean_list(items: Column, most: int) -> Column:
    """Stripped texts of a list without blanks and nulls, the first ``most``; null gives an empty list."""
    stripped = F.filter(F.transform(items, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.coalesce(stripped, F.array().cast("array<string>")), 1, most)


def script_language(text: Column) -> Column:
    """``zh`` for a text with a Han character, else ``en``; null for null."""
    return F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), F.lit("zh")).when(text.isNotNull(), F.lit("en"))


def record_fault(record: dict[str, Column]) -> Column:
    """The first structural fault of an analysis record, or ``ok``. Semantics of routes are not judged here."""
    r = record
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    bad_items = lambda c: F.exists(c, lambda x: x.isNull() | (strip(x) == ""))
    default = (
        F.when(blank(r["summary"]), "invalid_summary")
        .when(F.coalesce(F.size(r["tags"]), F.lit(0)) <= 0, "invalid_tags")
        .when(blank(r["language"]), "invalid_language")
        .when(r["quality_score"].isNull() | F.isnan(r["quality_score"]), "invalid_quality_score")
        .otherwise("ok")
    )
    salvage = (
        F.when(blank(r["topic"]), "invalid_topic")
        .when(r["valuable_residuals"].isNull(), "invalid_valuable_residuals")
        .when(F.size(r["valuable_residuals"]) > 3, "too_many_valuable_residuals")
        .when(bad_items(r["valuable_residuals"]), "invalid_valuable_residuals_item")
        .when(blank(r["drift_point"]), "invalid_drift_point")
        .when(r["next_steps"].isNull(), "invalid_next_steps")
        .when(F.size(r["next_steps"]) > 2, "too_many_next_steps")
        .when(bad_items(r["next_steps"]), "invalid_next_steps_item")
        .when(~F.upper(strip(F.coalesce(r["route_recommendation"], F.lit("")))).isin("A", "B", "C", "D"), "invalid_route_recommendation")
        .when(blank(r["verdict"]), "invalid_verdict")
        .otherwise("ok")
    )
    return F.when(r["analysis_schema"] == "salvage", salvage).when(r["analysis_schema"] == "default", default).otherwise("unknown_schema")
