"""The archive index as relational operators: upsert, pending and finished work, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.textfns import strip

#: The columns of the index in their order.
COLUMNS = (
    "id", "title", "source", "md_file", "analysis_file", "route_recommendation", "initial_route_recommendation", "final_route_recommendation", "calibration_applied",
    "calibration_confidence", "verdict", "valuable_residual_count", "next_steps_count", "primary_text", "summary", "tags", "status", "error",
)


def upsert(rows: DataFrame, order: str) -> DataFrame:
    """One row per stripped id: the values of its last line, the position of its first.

    Blank ids are left out, blanks and nulls in other columns are empty text; ties of ``order`` don't occur as it is unique. Only an aggregate by id, with
    partial results before the shuffle, so that an id with many lines is no hot key.
    """
    known = rows.withColumn("id", strip(F.coalesce(F.col("id"), F.lit("")))).where("id <> ''")
    values = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS if c != "id"])
    merged = known.groupBy("id").agg(F.max_by(values, order).alias("v"), F.min(order).cast("bigint").alias("position"))
    return merged.select("position", "id", *[F.col("v")[c].alias(c) for c in COLUMNS if c != "id"])


def _among(jobs: DataFrame, done: DataFrame, key: str, how: str) -> DataFrame:
    """Keys are compared without outer white space, as the index keeps them; a null key is never finished."""
    keys = done.select(strip(F.col(key)).alias("_done")).distinct()
    return jobs.join(keys, strip(jobs[key]) == F.col("_done"), how)


def pending(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Jobs without a finished row."""
    return _among(jobs, done, key, "left_anti")


def finished(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Jobs with a finished row."""
    return _among(jobs, done, key, "left_semi")


def route_is(route: Column, name: str) -> Column:
    """Whether a route is ``name``, whatever its case and outer white space."""
    return F.coalesce(F.upper(strip(route)) == name, F.lit(False))


def conversion_stats(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """One row: jobs in all, those without a finished row (``converted`` by a run that resumes) and those with one (``skipped``)."""
    keys = done.select(strip(F.col(key)).alias("_done")).distinct()
    marked = jobs.select(strip(F.col(key)).alias("_job")).join(keys, F.col("_job") == F.col("_done"), "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("_done").isNull()).alias("converted"), F.count_if(F.col("_done").isNotNull()).alias("skipped"))


def run_stats(records: DataFrame) -> DataFrame:
    """One row: records by status, and finished ones by route, zero where there are none."""
    ok = F.col("status") == "ok"
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(ok, F.lit(False))).alias("analyzed"),
        F.count_if(F.coalesce(F.col("status") == "failed", F.lit(False))).alias("failed"),
        *[F.count_if(F.coalesce(ok, F.lit(False)) & route_is(F.col("route_recommendation"), x)).alias(f"route_{x.lower()}") for x in "ABCD"],
    )


def stats_line(conversions: DataFrame, analyses: DataFrame) -> DataFrame:
    """The statistics of a run as one line of text: both tables have one row."""
    both = conversions.join(F.broadcast(analyses.drop("total")))
    return both.select(
        F.format_string(
            "Run stats: total=%d converted=%d skipped=%d analysis_ok=%d analysis_failed=%d routes[A=%d, B=%d, C=%d, D=%d]",
            "total", "converted", "skipped", "analyzed", "failed", "route_a", "route_b", "route_c", "route_d",
        ).alias("line")
    )
