"""Queries of the llm operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.chunking import conversation_pieces, message_pieces
from threadloom.llm.conversations import conversations, outcomes
from threadloom.llm.langid import fitted, language_cases
from threadloom.llm.lookalike import look_alike_classes, look_alike_pairs
from threadloom.llm.mixing import mix_report, mixed_copies
from threadloom.llm.pairs import defective_pairs
from threadloom.llm.pii import personal_data, redacted_texts
from threadloom.llm.tokens import decoded_texts, token_ids
from threadloom.session import table, written


BUDGET = 1.0  # as many tokens as the sources hold: more than some of them can give


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(conversations(spark, sf_dir), table(spark, sf_dir, "chats"))


def p4_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective reply with its first defect and every rule that fired."""
    model = fitted(table(spark, sf_dir, "documents"))
    messages, chats = table(spark, sf_dir, "message_rows"), table(spark, sf_dir, "chats")
    return defective_pairs(conversations(spark, sf_dir, batches=1), messages, chats, model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_defects(spark, sf_dir).drop("defects")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text that holds personal data, with placeholders."""
    return redacted_texts(table(spark, sf_dir, "message_rows"), table(spark, sf_dir, "chats"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["place", "record_key", "kind", "found_text"]
    return personal_data(table(spark, sf_dir, "message_rows"), table(spark, sf_dir, "chats")).where("first").select(columns)


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and segments with their confidence."""
    return language_cases(*(table(spark, sf_dir, t) for t in ("documents", "message_rows", "analysis_records")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_languages(spark, sf_dir).drop("confidence")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits")
    messages = message_pieces(table(spark, sf_dir, "message_rows"), limits)
    return messages.unionByName(conversation_pieces(table(spark, sf_dir, "archived_chats"), limits))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that were cut: each has one first piece."""
    return p7_pieces(spark, sf_dir).where("piece_no = 0").select("item_kind", "item_key")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids."""
    return decoded_texts(written(p8_ids(spark, sf_dir), "ids"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report for a total that some sources can't fill: they are used up to their cap and miss their target."""
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens=BUDGET)


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as classes: one row a document."""
    return look_alike_classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p4_defects": p4_defects,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_ids": p8_ids,
    "p8_texts": p8_texts,
    "p9_report": p9_report,
    "p9_budget": p9_budget,
    "p9_copies": p9_copies,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
}
SQL: dict[str, str] = {
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": """
        SELECT 'message' AS item_kind, CAST(m.row_id AS VARCHAR) AS item_key
        FROM message_rows m JOIN size_limits s ON s.item_kind = 'message'
        WHERE length(m.content) > s.max_chars
        UNION ALL
        SELECT 'conversation', a.id
        FROM archived_chats a JOIN size_limits s ON s.item_kind = 'conversation'
        WHERE list_sum(list_transform(a.messages, lambda x: coalesce(length(x.content), 0))) > s.max_chars
    """,
}
