"""File sources and sinks: whole JSON exports, Markdown and analysis files, the index as CSV."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.index import COLUMNS
from threadloom.operators.render import safe_id


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(export_id, path, record): one row a JSON file; ids follow the path's digest, so they are the same in every run."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))
    return texts.select(F.xxhash64("path").alias("export_id"), "path", "record")


def read_named_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file_name, content) of the files of a folder whose name fits ``pattern`` (``*.md``, ``*.analysis.json``)."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def in_name_order(files: DataFrame) -> DataFrame:
    """Files by name, spread by ranges of it."""
    return files.orderBy("file_name")


def parsed_records(texts: DataFrame, schema: str) -> DataFrame:
    """``texts`` with ``record``; files that don't hold valid JSON are left out."""
    valid = texts.where(F.try_parse_json("content").isNotNull())
    return valid.withColumn("record", F.from_json("content", schema))


def rejected_records(texts: DataFrame) -> DataFrame:
    """(file_name) of the files that ``parsed_records`` leaves out."""
    return texts.where(F.try_parse_json("content").isNull()).select("file_name")


def analysis_files(records: DataFrame, key: str = "id") -> DataFrame:
    """(file_name, content) of an analysis each: its fields but ``key`` as indented JSON, nulls kept; characters stay as they are."""
    fields = F.struct(*[c for c in records.columns if c != key])
    name = F.concat(F.lit("conv_"), safe_id(F.col(key)), F.lit(".analysis.json"))
    return records.select(name.alias("file_name"), F.to_json(fields, {"ignoreNullFields": "false", "pretty": "true"}).alias("content"))


def write_named_texts(files: DataFrame, folder: str) -> None:
    """Write (file_name, content), a file each, from the executors into a folder that they share: a URI of any file system that Arrow knows, or a path on one
    machine. A retried task writes the same files again; null contents are empty files."""
    if "://" not in folder and not files.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a path of one machine; name a shared folder by its URI (file:// for a mount that all machines have)")

    def write(rows: Iterator[Row]) -> None:
        system, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        system.create_dir(place)
        for row in rows:
            temporary = f"{place}/.{row['file_name']}.part"
            with system.open_output_stream(temporary) as out:
                out.write((row["content"] or "").encode())
            system.move(temporary, f"{place}/{row['file_name']}")

    files.select("file_name", "content").foreachPartition(write)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index from CSV: its known columns as text, absent ones and nulls empty, unknown ones left out; with ``line_no`` in the file's order."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    parts = sorted(raw.inputFiles())  # a file is read whole, by one task, so its rows have rising numbers
    number = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("_metadata.file_path")) if parts else F.lit(0)
    line = F.shiftleft(number.cast("bigint"), 40) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    values = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in COLUMNS]
    return raw.select(line.alias("line_no"), *values)


def write_index(index: DataFrame, path: str) -> None:
    """The index as CSV files with headers, by ranges of ``position`` where there is one: the order of their names is the order of the index."""
    ordered = index.orderBy("position") if "position" in index.columns else index
    ordered.select(*COLUMNS).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
