"""Command line: ``convert`` exports to Markdown with an index, ``collect`` the records of one route with their texts."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import index, render
from threadloom.operators.normalize import normalize_exports, rejected_exports
from threadloom.session import written
from threadloom.sources import files

RECORD = "id string, title string, route_recommendation string, initial_route_recommendation string, final_route_recommendation string, calibration_applied string, calibration_confidence string, calibration_reason string, verdict string, drift_point string, valuable_residuals array<string>, next_steps array<string>"


def converted(exports: DataFrame, kind: str = "auto", sample: int | None = None) -> DataFrame:
    """Index rows of the conversations of exports, with ``content`` (their Markdown) and ``seq`` (their order); with ``sample`` the first so many of all, 0 for no limit."""
    talks = normalize_exports(exports, kind)
    if sample:
        talks = talks.orderBy("export_id", "position").limit(sample)
    name = render.safe_id(F.col("id"))
    known = {
        "id": F.col("id"), "title": F.col("title"), "source": F.col("source"), "md_file": F.concat(F.lit("conv_"), name, F.lit(".md")),
        "analysis_file": F.concat(F.lit("conv_"), name, F.lit(".analysis.json")), "status": F.lit("converted"),
    }
    content = render.markdown(*(F.col(c) for c in ("id", "source", "title", "created_at", "updated_at", "messages")))
    columns = [known.get(c, F.lit("")).alias(c) for c in index.COLUMNS]
    return talks.select(F.struct("export_id", "position").alias("seq"), *columns, content.alias("content"))


def convert(spark: SparkSession, source: str, root: str, kind: str = "auto", sample: int | None = None, resume: bool = False, force: bool = False) -> tuple[int, int, int]:
    """Write ``root/markdown`` and ``root/index``; returns how many conversations were written and skipped, and how many records hold none.

    ``resume`` skips ids that the index has, unless ``force`` is given.
    """
    exports = files.read_exports(spark, source)
    every_row = rows = written(converted(exports, kind, sample), "converted")
    rejected = rejected_exports(exports).count() if kind == "auto" else 0
    place = os.path.join(root, "index")
    old = written(files.read_index(spark, place), "index") if os.path.isdir(place) else None
    if resume and not force and old is not None:
        rows = index.pending(rows, old).select(rows.columns)
    files.write_named_texts(rows.select(F.col("md_file").alias("file_name"), "content"), os.path.join(root, "markdown"))
    fresh = rows.select(F.struct(F.lit(1).alias("new"), F.col("seq.export_id").alias("a"), F.col("seq.position").cast("bigint").alias("b")).alias("line"), *index.COLUMNS)
    every = fresh
    if old is not None:
        every = fresh.unionByName(old.select(F.struct(F.lit(0).alias("new"), F.col("line_no").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("line"), *index.COLUMNS))
    ordered = every.groupBy("id").agg(F.max_by(F.struct(*index.COLUMNS[1:]), "line").alias("v"), F.min("line").alias("position"))
    files.write_index(ordered.where("trim(id) <> ''").select("position", "id", "v.*"), place)
    done = rows.count()
    return done, every_row.count() - done, rejected


def collect(spark: SparkSession, source: str, target: str, route: str = "A") -> tuple[int, int]:
    """Write a merged report for each analysis of ``route`` that has its Markdown; returns how many, and how many have none."""
    records = files.parsed_records(files.read_named_texts(spark, source, "*.analysis.json"), RECORD)
    chosen = records.where(index.route_is(F.col("record.route_recommendation"), route)).select(
        F.regexp_replace("file_name", r"\.analysis\.json$", ".md").alias("file_name"), "record"
    )
    texts = files.read_named_texts(spark, source, "*.md").select("file_name", F.col("content").alias("body"))
    r = {c: F.col(f"record.{c}") for c in ("title", "route_recommendation", "verdict", "drift_point", "valuable_residuals", "next_steps")}
    more = (F.col(f"record.{c}") for c in ("initial_route_recommendation", "final_route_recommendation", "calibration_applied", "calibration_confidence", "calibration_reason"))
    merged = chosen.join(texts, "file_name").select("file_name", render.merged_report(*r.values(), F.col("body"), *more).alias("content"))
    done = written(files.in_name_order(merged), "merged")
    files.write_named_texts(done, target)
    return done.count(), chosen.join(texts, "file_name", "left_anti").count()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("--input", required=True)
    one.add_argument("--output-root", default=".")
    one.add_argument("--format", choices=("auto", "chatgpt", "claude"), default="auto")
    one.add_argument("--sample", type=int)
    one.add_argument("--resume", action="store_true")
    one.add_argument("--force", action="store_true")
    two = commands.add_parser("collect")
    two.add_argument("--input-root", required=True)
    two.add_argument("--output-dir", required=True)
    two.add_argument("--route", default="A")
    said = parser.parse_args(arguments)
    if said.command == "convert" and said.sample is not None and said.sample < 0:
        parser.error("--sample must not be negative")
    spark = SparkSession.builder.appName("threadloom").getOrCreate()
    if said.command == "convert":
        done, skipped, rejected = convert(spark, said.input, said.output_root, said.format, said.sample, said.resume, said.force)
        print(f"converted={done} skipped={skipped} rejected={rejected}")
        return 2 if rejected and not done + skipped else 0
    found, missing = collect(spark, said.input_root, said.output_dir, said.route)
    print(f"collected={found} missing={missing}")
    return 0 if found + missing else 1


if __name__ == "__main__":
    sys.exit(main())
