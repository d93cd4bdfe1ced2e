"""Text renderers: Markdown of conversations, bounded transcripts, merged reports, file-safe ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.textfns import strip

FIRST_PASS_CHARS, SECOND_PASS_CHARS = 18_000, 3_500


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def safe_id(value: Column, most: int = 80) -> Column:
    """A file name's part: everything but ASCII letters, digits, ``_``, ``.`` and ``-`` becomes ``_``; at most ``most`` characters."""
    return F.substring(F.regexp_replace(value, r"[^a-zA-Z0-9_.\-]", "_"), 1, most)


def markdown(id_: Column, source: Column, title: Column, created: Column, updated: Column, messages: Column) -> Column:
    """A conversation as Markdown: a header with its fields, then each message under its number.

    Null fields are empty, a null role reads ``None``; null messages are none. The text ends in one line break.
    """
    plain = F.transform(messages, lambda m: F.struct(*[m[c].cast("string").alias(c) for c in ("role", "content", "timestamp")]))
    many = F.coalesce(plain, F.expr("array()").cast("array<struct<role:string,content:string,timestamp:string>>"))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), _shown(title)),
        F.lit(""),
        F.concat(F.lit("- id: "), _shown(id_)),
        F.concat(F.lit("- source: "), _shown(source)),
        F.concat(F.lit("- created_at: "), _shown(created)),
        F.concat(F.lit("- updated_at: "), _shown(updated)),
        F.concat(F.lit("- message_count: "), F.size(many).cast("string")),
        F.lit(""),
        F.lit("---"),
        F.lit(""),
    )
    body = F.transform(
        many,
        lambda m, i: F.concat_ws(
            "\n",
            F.concat(F.lit("## Message "), (i + 1).cast("string")),
            F.lit(""),
            F.concat(F.lit("**"), F.coalesce(m["role"], F.lit("None")), F.lit(":**")),
            F.concat(F.lit("**time:** "), _shown(m["timestamp"])),
            F.lit(""),
            _shown(m["content"]),
            F.lit(""),
        ),
    )
    return F.concat(strip(F.concat_ws("\n", head, F.array_join(body, "\n"))), F.lit("\n"))


def transcript(messages: Column, most: int = FIRST_PASS_CHARS) -> Column:
    """``[role] content`` of the messages, a blank line between, cut at ``most`` code points; a null role reads ``None``."""
    lines = F.transform(messages, lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("None")), F.lit("] "), _shown(m["content"])))
    return F.substring(F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n\n"), 1, most)


def numbered_list(items: Column, empty: str = "（無）") -> Column:
    """``1. item`` lines; ``empty`` where there are none."""
    lines = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), _shown(x))), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, lines).otherwise(F.lit(empty))


def merged_report(
    title: Column, route: Column, verdict: Column, drift: Column, residuals: Column, steps: Column, body: Column, initial: Column | None = None, final: Column | None = None,
    calibrated: Column | None = None, confidence: Column | None = None, reason: Column | None = None,
) -> Column:
    """A record's fields as a table and lists in front of the conversation's text; blank fields have no line.

    The initial and the final route show where they differ from the route; confidence and reason of a second look where it was applied.
    """
    nothing = F.lit(None).cast("string")
    initial, final, confidence, reason = (nothing if c is None else c for c in (initial, final, confidence, reason))
    applied = F.lit(False) if calibrated is None else F.coalesce(F.lower(strip(calibrated.cast("string"))).isin("true", "1", "yes"), F.lit(False))

    def row(name: str, value: Column) -> Column:
        return F.when(strip(_shown(value)) != "", F.concat(F.lit(f"| {name} | "), _shown(value), F.lit(" |")))

    drifted = F.when(strip(_shown(drift)) != "", F.concat(F.lit("## Drift point\n\n"), drift, F.lit("\n")))
    parts = F.array(
        F.concat(F.lit("# "), _shown(title), F.lit("\n")),
        F.lit("| field | value |\n|---|---|"),
        row("route", route),
        F.when(F.coalesce(initial != F.coalesce(route, F.lit("")), F.lit(False)), row("initial route", initial)),
        F.when(F.coalesce(final != F.coalesce(route, F.lit("")), F.lit(False)), row("final route", final)),
        row("verdict", verdict),
        F.when(applied, F.concat(F.lit("| second look | applied, confidence "), _shown(confidence), F.lit(" |"))),
        F.when(applied, row("reason", reason)),
        F.lit(""),
        drifted,
        F.lit("## Residuals\n"),
        numbered_list(residuals),
        F.lit("\n## Next steps\n"),
        numbered_list(steps),
        F.lit("\n---\n"),
        F.regexp_replace(_shown(body), r"(?U)[\s\x1c-\x1f]+$", ""),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")


#: What an analysis is asked for, by schema: our own words for the fields that a record must have.
INSTRUCTIONS = {
    "salvage": "You look for what is worth keeping of a conversation, not for a summary. Answer with one JSON object with exactly these keys: topic, valuable_residuals (0 to 3 items), drift_point, next_steps (0 to 2 items), route_recommendation (A, B, C or D; C or D unless the evidence is clear), verdict.",
    "default": "You describe a conversation. Answer with one JSON object with exactly these keys: summary, tags (a list), language, quality_score (a number from 0 to 1).",
}


def prompts(title: Column, messages: Column, schema: str = "default") -> Column:
    """A struct (system, user): the instructions of a schema, and the title above the bounded transcript. A null title is empty."""
    user = F.concat(F.lit("Title: "), _shown(title), F.lit("\n\n"), transcript(messages))
    return F.struct(F.lit(INSTRUCTIONS[schema]).alias("system"), user.alias("user"))


def without_fences(text: Column) -> Column:
    """A reply without the code fence around it: the first line where it opens one, the last where it closes one."""
    inner = F.regexp_replace(strip(text), r"^```[^\n]*(?:\n|$)", "")
    return strip(F.regexp_replace(inner, r"(?:^|\n)```[ \t]*$", ""))
