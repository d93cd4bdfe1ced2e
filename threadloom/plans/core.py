"""Queries of the core, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.textfns import strip
from threadloom.operators import index, markers, render
from threadloom.operators.nested import flatten_exports
from threadloom.operators.normalize import normalize_exports, rejected_exports
from threadloom.operators.times import stated_times, zone_transitions
from threadloom.plans import export_sql
from threadloom.session import table

#: A lexicon in the words of the test tables; any other can be loaded from a file.
LEXICON: markers.Lexicon = {
    "common": {"asset": ["table", "plan", "index", "checklist"], "positive": ["useful", "better", "easier"], "negative": ["slow", "fails", "no longer"]},
    "en": {"asset": ["archive", "schedule"], "positive": ["fine"], "negative": ["mixed", "wrong"]},
    "zh": {"asset": ["清單", "計畫"], "positive": ["有用"], "negative": ["重複"]},
}
KEYS = ["asset", "positive", "negative"]
#: What a step says where nothing is to be done.
NO_ACTION = ["暫不行動", "不需行動", "no action", "none", "n/a"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = table(spark, sf_dir, "accounts")
    messages, chats = table(spark, sf_dir, "message_rows"), table(spark, sf_dir, "chats")
    said = stated_times(messages, accounts, {"message": (F.col("row_id"), F.col("timestamp"))})
    loads = stated_times(chats, accounts, {p: (F.col("load_id"), F.col(p)) for p in ("created_at", "updated_at")})
    return said.unionByName(loads)


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versioned transition tables that ``p2_found`` converts with."""
    return zone_transitions(table(spark, sf_dir, "accounts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_exports(table(spark, sf_dir, "export_records"))


def export_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_exports(table(spark, sf_dir, "export_records"))


def export_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_exports(table(spark, sf_dir, "export_records"))


def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the conversations of the exports, a row each."""
    return export_conversations(spark, sf_dir).select("export_id", "position", F.explode("messages").alias("m")).select("export_id", "position", "m.*")


def export_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of the exports without their messages."""
    return export_conversations(spark, sf_dir).select("export_id", "position", "format", "id", "title", "created_at", "updated_at")


def analysis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "archived_chats")
    both = [c.select("id", F.lit(s).alias("analysis_schema"), render.prompts(F.col("title"), F.col("messages"), s).alias("p")) for s in render.INSTRUCTIONS]
    return both[0].unionByName(both[1]).select("id", "analysis_schema", "p.*")


def unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", render.without_fences(F.col("text")).alias("inner_text"))


def actionable_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers_ = NO_ACTION
    return table(spark, sf_dir, "analysis_records").select("analysis_no", markers.has_actions(F.col("next_steps"), markers_).alias("actionable"))


def conv_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "archived_chats")
    text = render.markdown(*(F.col(x) for x in ("id", "source", "title", "created_at", "updated_at", "messages")))
    return c.select("id", F.concat(F.lit("conv_"), render.safe_id(F.col("id")), F.lit(".md")).alias("md_file"), text.alias("content"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "archived_chats")
    return c.select(
        "id",
        render.transcript(F.col("messages")).alias("first_pass"),
        render.transcript(F.col("messages"), render.SECOND_PASS_CHARS).alias("second_pass"),
    )


def conversation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "archived_chats").select("id", F.explode_outer("messages").alias("m"))
    return c.groupBy("id").agg(
        F.count("m").alias("messages"),
        F.count_if(strip(F.coalesce(F.col("m.content"), F.lit(""))) == "").alias("blank"),
        F.coalesce(F.sum(F.length("m.content")), F.lit(0)).cast("bigint").alias("chars"),
    )


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.lower(F.trim(F.coalesce("role", F.lit("unknown"))))
    return table(spark, sf_dir, "message_rows").groupBy(role.alias("role")).agg(F.count("*").alias("messages"))


def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chats").select("id").distinct().select("id", render.safe_id(F.col("id")).alias("safe_id"))


def index_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upsert(table(spark, sf_dir, "archive_index"), "line_no")


def pending_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pending(table(spark, sf_dir, "chats").select("id").distinct(), table(spark, sf_dir, "archive_index"))


def finished_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.finished(table(spark, sf_dir, "chats").select("id").distinct(), table(spark, sf_dir, "archive_index"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.run_stats(table(spark, sf_dir, "analysis_records"))


def stats_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, done = table(spark, sf_dir, "chats").select("id").distinct(), table(spark, sf_dir, "archive_index")
    return index.stats_line(index.conversion_stats(jobs, done), run_stats(spark, sf_dir))


def clean_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "analysis_records")
    return r.select(
        "analysis_no",
        F.array_join(markers.clean_list(F.col("valuable_residuals"), 3), " | ").alias("residuals"),
        F.array_join(markers.clean_list(F.col("next_steps"), 2), " | ").alias("steps"),
    )


def residual_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = markers.marker_set("multi", LEXICON, KEYS)["asset"]
    r = table(spark, sf_dir, "analysis_records").select("analysis_no", F.posexplode("valuable_residuals").alias("pos", "residual"))
    return r.select("analysis_no", F.col("pos").cast("bigint").alias("pos"), markers.strength(F.col("residual"), asset).cast("bigint").alias("strength"))


def verdict_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers.marker_set("multi", LEXICON, KEYS)
    v = F.col("verdict")
    return table(spark, sf_dir, "analysis_records").select(
        "analysis_no",
        markers.contains_any(v, m["positive"]).alias("positive"),
        markers.contains_any(v, m["negative"]).alias("negative"),
        markers.mixed(v, m["positive"], m["negative"]).alias("mixed"),
        markers.distinct_hits(v, m["asset"]).cast("bigint").alias("assets"),
    )


def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "analysis_records")
    return r.select("analysis_no", markers.record_fault({c: F.col(c) for c in r.columns}).alias("fault"))


def script_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", markers.script_language(F.col("text")).alias("script"))


def _top_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analysis_records").where(index.route_is(F.col("route_recommendation"), "A"))


def grade_a_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = index_current(spark, sf_dir).select("id", "title", "primary_text", "initial_route_recommendation", "final_route_recommendation", "calibration_applied", "calibration_confidence")
    top = _top_records(spark, sf_dir).join(known, "id")
    report = render.merged_report(*(F.col(c) for c in ("title", "route_recommendation", "verdict", "drift_point", "valuable_residuals", "next_steps", "primary_text", "initial_route_recommendation", "final_route_recommendation", "calibration_applied", "calibration_confidence")))
    return top.select("analysis_no", "id", report.alias("report"))


def grade_a_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pending(_top_records(spark, sf_dir), index_current(spark, sf_dir)).agg(F.count("*").alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_zones, p3_found, export_conversations, export_rejects, export_heads, export_messages, analysis_prompts, unfenced, actionable_steps, conv_markdown, transcripts, conversation_sizes, role_counts, safe_ids, index_current, pending_chats,
        finished_chats, run_stats, stats_line, clean_lists, residual_strength, verdict_markers, record_faults, script_languages, grade_a_reports, grade_a_missing,
    )
}

_SPACE, _strip = export_sql._SPACE, export_sql.strip


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{w}')" for w in words) + ")"


def _hits(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce({x}, '')), '{w}') AS BIGINT)" for w in words) + ")"


def _clean(x: str, most: int) -> str:
    return f"array_to_string(list_slice(list_filter(list_transform(coalesce({x}, []), lambda x: {_strip('x')}), lambda x: x IS NOT NULL AND x <> ''), 1, {most}), ' | ')"


def _unfenced(x: str) -> str:
    inner = f"regexp_replace({_strip(x)}, '^```[^\\n]*(\\n|$)', '')"
    return f"regexp_replace({_strip(inner)}, '(^|\\n)```[ \\t]*$', '')"


_M = markers.marker_set("multi", LEXICON, KEYS)
_UPSERT = (
    "SELECT min(line_no) AS position, sid AS id, "
    + ", ".join(f"arg_max(coalesce({c}, ''), line_no) AS {c}" for c in index.COLUMNS if c != "id")
    + f" FROM (SELECT *, {_strip('coalesce(id, {})'.format(chr(39) * 2))} AS sid FROM archive_index) WHERE sid <> '' GROUP BY sid"
)
_NUMBERED = "CASE WHEN coalesce(len({0}), 0) > 0 THEN array_to_string(list_transform({0}, lambda x, i: CAST(i AS VARCHAR) || '. ' || coalesce(x, '')), chr(10)) ELSE '（無）' END"
_TRANSCRIPT = "array_to_string(list_transform(messages, lambda m: '[' || coalesce(m.role, 'None') || '] ' || coalesce(m.content, '')), chr(10) || chr(10))"
_ROUTE_A = f"upper({_strip('route_recommendation')}) = 'A'"

SQL: dict[str, str] = {
    "p3_found": export_sql.P3_FOUND,
    "export_heads": export_sql.EXPORT_HEADS,
    "export_messages": export_sql.EXPORT_MESSAGES,
    "export_rejects": export_sql.EXPORT_REJECTS,
    "conv_markdown": f"""
        SELECT id, 'conv_' || left(regexp_replace(id, '[^a-zA-Z0-9_.\\-]', '_', 'g'), 80) || '.md' AS md_file,
          {_strip('''concat_ws(chr(10), '# ' || coalesce(title, ''), '', '- id: ' || coalesce(id, ''), '- source: ' || coalesce(source, ''), '- created_at: ' || coalesce(created_at, ''),
            '- updated_at: ' || coalesce(updated_at, ''), '- message_count: ' || CAST(coalesce(len(messages), 0) AS VARCHAR), '', '---', '',
            array_to_string(list_transform(coalesce(messages, []), lambda m, i: concat_ws(chr(10), '## Message ' || CAST(i AS VARCHAR), '', '**' || coalesce(m.role, 'None') || ':**',
              '**time:** ' || coalesce(m."timestamp", ''), '', coalesce(m.content, ''), '')), chr(10)))''')} || chr(10) AS content
        FROM archived_chats""",
    "transcripts": f"SELECT id, coalesce(left({_TRANSCRIPT}, 18000), '') AS first_pass, coalesce(left({_TRANSCRIPT}, 3500), '') AS second_pass FROM archived_chats",
    "conversation_sizes": f"""
        SELECT id, CAST(coalesce(len(messages), 0) AS BIGINT) AS messages,
          CAST(coalesce(len(list_filter(messages, lambda m: {_strip("coalesce(m.content, '')")} = '')), 0) AS BIGINT) AS blank,
          CAST(coalesce(list_sum(list_transform(messages, lambda m: length(m.content))), 0) AS BIGINT) AS chars
        FROM archived_chats""",
    "role_counts": "SELECT lower(trim(coalesce(role, 'unknown'))) AS role, count(*) AS messages FROM message_rows GROUP BY 1",
    "safe_ids": "SELECT DISTINCT id, left(regexp_replace(id, '[^a-zA-Z0-9_.\\-]', '_', 'g'), 80) AS safe_id FROM chats",
    "index_current": _UPSERT,
    "analysis_prompts": " UNION ALL ".join(
        f"SELECT id, '{k}' AS analysis_schema, '{text}' AS system, 'Title: ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(left({_TRANSCRIPT}, 18000), '') AS user FROM archived_chats" for k, text in render.INSTRUCTIONS.items()
    ),
    "unfenced": f"SELECT doc_id, {_strip(_unfenced('text'))} AS inner_text FROM documents",
    "actionable_steps": f"SELECT analysis_no, len(list_filter(coalesce(next_steps, []), lambda x: x IS NOT NULL AND NOT {_any(_strip('x'), NO_ACTION)})) > 0 AS actionable FROM analysis_records",
    "pending_chats": "SELECT DISTINCT id FROM chats c WHERE NOT EXISTS (SELECT 1 FROM archive_index a WHERE " + f"{_strip('a.id')} = {_strip('c.id')})",
    "finished_chats": "SELECT DISTINCT id FROM chats c WHERE EXISTS (SELECT 1 FROM archive_index a WHERE " + f"{_strip('a.id')} = {_strip('c.id')})",
    "run_stats": "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS analyzed, count(*) FILTER (status = 'failed') AS failed, "
    + ", ".join(f"count(*) FILTER (status = 'ok' AND upper({_strip('route_recommendation')}) = '{x}') AS route_{x.lower()}" for x in "ABCD")
    + " FROM analysis_records",
    "stats_line": f"WITH j AS (SELECT DISTINCT id, EXISTS (SELECT 1 FROM archive_index a WHERE {_strip('a.id')} = {_strip('c.id')}) AS done FROM chats c), s AS (SELECT count(*) AS total, count(*) FILTER (NOT done) AS converted, count(*) FILTER (done) AS skipped FROM j), "
    "r AS (SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, "
    + ", ".join(f"count(*) FILTER (status = 'ok' AND upper({_strip('route_recommendation')}) = '{x}') AS {x.lower()}" for x in "ABCD")
    + " FROM analysis_records) SELECT format('Run stats: total={} converted={} skipped={} analysis_ok={} analysis_failed={} routes[A={}, B={}, C={}, D={}]', total, converted, skipped, ok, failed, a, b, c, d) AS line FROM s, r",
    "clean_lists": f"SELECT analysis_no, {_clean('valuable_residuals', 3)} AS residuals, {_clean('next_steps', 2)} AS steps FROM analysis_records",
    "residual_strength": f"""
        SELECT analysis_no, CAST(pos - 1 AS BIGINT) AS pos,
          CASE WHEN {_strip("coalesce(residual, '')")} = '' THEN 0
            ELSE {_hits('residual', _M['asset'])} + CAST(regexp_matches(lower(residual), '\\p{{Nd}}') AS BIGINT) + CAST(regexp_matches(residual, '[:：]') AS BIGINT) END AS strength
        FROM (SELECT analysis_no, unnest(valuable_residuals) AS residual, generate_subscripts(valuable_residuals, 1) AS pos FROM analysis_records)""",
    "verdict_markers": f"""
        SELECT analysis_no, {_any('verdict', _M['positive'])} AS positive, {_any('verdict', _M['negative'])} AS negative,
          {_any('verdict', _M['positive'])} AND {_any('verdict', _M['negative'])} AS mixed, {_hits('verdict', _M['asset'])} AS assets
        FROM analysis_records""",
    "record_faults": f"""
        SELECT analysis_no, CASE
          WHEN analysis_schema = 'salvage' THEN CASE
            WHEN {_strip("coalesce(topic, '')")} = '' THEN 'invalid_topic' WHEN valuable_residuals IS NULL THEN 'invalid_valuable_residuals'
            WHEN len(valuable_residuals) > 3 THEN 'too_many_valuable_residuals'
            WHEN len(list_filter(valuable_residuals, lambda x: x IS NULL OR {_strip('x')} = '')) > 0 THEN 'invalid_valuable_residuals_item'
            WHEN {_strip("coalesce(drift_point, '')")} = '' THEN 'invalid_drift_point' WHEN next_steps IS NULL THEN 'invalid_next_steps'
            WHEN len(next_steps) > 2 THEN 'too_many_next_steps' WHEN len(list_filter(next_steps, lambda x: x IS NULL OR {_strip('x')} = '')) > 0 THEN 'invalid_next_steps_item'
            WHEN upper({_strip("coalesce(route_recommendation, '')")}) NOT IN ('A', 'B', 'C', 'D') THEN 'invalid_route_recommendation'
            WHEN {_strip("coalesce(verdict, '')")} = '' THEN 'invalid_verdict' ELSE 'ok' END
          WHEN analysis_schema = 'default' THEN CASE
            WHEN {_strip("coalesce(summary, '')")} = '' THEN 'invalid_summary' WHEN coalesce(len(tags), 0) = 0 THEN 'invalid_tags'
            WHEN {_strip("coalesce(language, '')")} = '' THEN 'invalid_language' WHEN quality_score IS NULL OR isnan(quality_score) THEN 'invalid_quality_score' ELSE 'ok' END
          ELSE 'unknown_schema' END AS fault
        FROM analysis_records""",
    "script_languages": "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN text IS NOT NULL THEN 'en' END AS script FROM documents",
    "grade_a_reports": f"""
        SELECT analysis_no, r.id, concat_ws(chr(10), '# ' || coalesce(i.title, '') || chr(10), '| field | value |' || chr(10) || '|---|---|',
            CASE WHEN {_strip("coalesce(r.route_recommendation, '')")} <> '' THEN '| route | ' || r.route_recommendation || ' |' END,
            CASE WHEN {_strip("coalesce(i.initial_route_recommendation, '')")} <> '' AND i.initial_route_recommendation <> coalesce(r.route_recommendation, '') THEN '| initial route | ' || i.initial_route_recommendation || ' |' END,
            CASE WHEN {_strip("coalesce(i.final_route_recommendation, '')")} <> '' AND i.final_route_recommendation <> coalesce(r.route_recommendation, '') THEN '| final route | ' || i.final_route_recommendation || ' |' END,
            CASE WHEN {_strip("coalesce(r.verdict, '')")} <> '' THEN '| verdict | ' || r.verdict || ' |' END,
            CASE WHEN lower({_strip("i.calibration_applied")}) IN ('true', '1', 'yes') THEN '| second look | applied, confidence ' || coalesce(i.calibration_confidence, '') || ' |' END, '',
            CASE WHEN {_strip("coalesce(r.drift_point, '')")} <> '' THEN '## Drift point' || chr(10) || chr(10) || r.drift_point || chr(10) END,
            '## Residuals' || chr(10), {_NUMBERED.format('r.valuable_residuals')}, chr(10) || '## Next steps' || chr(10), {_NUMBERED.format('r.next_steps')},
            chr(10) || '---' || chr(10), regexp_replace(coalesce(i.primary_text, ''), '{_SPACE}+$', '')) AS report
        FROM analysis_records r JOIN ({_UPSERT}) i ON i.id = r.id WHERE {_ROUTE_A.replace('route_recommendation', 'r.route_recommendation')}""",
    "grade_a_missing": f"SELECT count(*) AS missing FROM analysis_records r WHERE {_ROUTE_A} AND NOT EXISTS (SELECT 1 FROM ({_UPSERT}) i WHERE i.id = r.id)",
}
