"""Problem 8: encode a corpus with a public tokenizer through a table of distinct words.

The tokenizer splits text into words before it merges bytes, so the ids of a word don't depend on its
neighbours. Texts are split once, in the JVM, with the tokenizer's own pattern, and the words written; each distinct word is
encoded once in Python, and the ids come back to their positions by joins: with the most frequent words, a table of bounded
number and bytes that every worker holds, as one Arrow lookup and gather a batch, without a shuffle; with all other words by a shuffle of their places
alone, in which words used very often go to several tasks.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.session import written

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.json"
#: Fixed value: the splitting pattern of the byte-level vocabulary; ``(?U)`` makes ``\s`` Unicode white space.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The table that every worker holds: the most used words, at most so many and of so many bytes with their ids.
BROADCAST_WORDS, BROADCAST_BYTES = 200_000, 16_000_000
#: Of the other words, those used more than this share of all uses (so at most one over it words) are joined in so many parts.
HOT_SHARE, HOT_PARTS = 1e-4, 32


@functools.lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(os.path.join(folder, file))
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    return model


def _encoded(words: DataFrame, folder: str) -> DataFrame:
    """``words`` (word, uses) with the ids of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tokenizer(folder)
        for frame in frames:
            frame["ids"] = [e.ids for e in model.encode_batch(frame["word"].tolist(), add_special_tokens=False)]
            yield frame

    return words.mapInPandas(run, "word string, uses bigint, ids array<int>")


def split_words(documents: DataFrame) -> DataFrame:
    """(doc_id, words) of each document, written; a repeated ``doc_id`` once. Null and empty texts have no words."""
    rows = documents.select("doc_id", "text")
    if documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id"])
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0), F.array().cast("array<string>"))
    return written(rows.select("doc_id", words.alias("words")), "split")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pc.value_counts(pc.list_flatten(batch.column(0)))
        yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], ["word", "uses"])


def word_table(split: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(word, uses, ids) of each distinct word, written to the shared folder. Words are counted by batch before they are shuffled."""
    counts = split.select("words").mapInArrow(_counted, "word string, uses bigint").groupBy("word").agg(F.sum("uses").alias("uses"))
    return written(_encoded(counts, folder), "words")


def _frequent(table: DataFrame) -> DataFrame:
    """(word, ids) of the most used words within ``BROADCAST_WORDS`` and ``BROADCAST_BYTES``, of any length."""
    top = table.orderBy(F.desc("uses"), "word").limit(BROADCAST_WORDS).select("word", "uses", "ids")
    size = F.octet_length("word") + 4 * F.size("ids") + 12
    cut = top.withColumn("_sum", F.sum(size).over(Window.orderBy(F.desc("uses"), "word").rowsBetween(Window.unboundedPreceding, 0)))
    return written(cut.where(F.col("_sum") <= BROADCAST_BYTES).select("word", "ids"), "frequent-words")


_PLACED = "doc_id bigint, ids array<int>, gaps array<struct<at:int,word:string>>"


def _placed(split: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, ids, gaps): the ids of the frequent words of each document in order, and where among them each other word belongs."""
    known = frequent.toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    shipped = split.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shipped.value).read_all()
        vocabulary = table.column("word").combine_chunks().cast(pa.string()) if len(table) else pa.array([], pa.string())
        pieces = table.column("ids").combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
        lengths = np.append(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        for batch in batches:
            lists = batch.column("words")
            words, starts = pc.list_flatten(lists).cast(pa.string()), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
            spot = pc.index_in(words, value_set=vocabulary)
            missing = spot.is_null().to_numpy(zero_copy_only=False)
            slot = spot.fill_null(len(vocabulary)).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(lengths[slot]))  # ids before each word
            ids = pc.list_flatten(pieces.take(pa.array(slot[~missing]))).cast(pa.int32())
            offsets = ends[starts]
            at = np.flatnonzero(missing)
            document = np.searchsorted(starts, at, side="right") - 1
            gaps = pa.StructArray.from_arrays([pa.array((ends[at] - offsets[document]).astype(np.int32)), words.take(pa.array(at))], ["at", "word"])
            bounds = np.searchsorted(at, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), gaps)], ["doc_id", "ids", "gaps"]
            )

    return split.select(F.col("doc_id").cast("bigint").alias("doc_id"), "words").mapInArrow(run, _PLACED)


def _filled(placed: DataFrame, table: DataFrame, frequent: DataFrame, value: Column) -> DataFrame:
    """(doc_id, no, at, value) of each gap of ``placed``, joined by word; ``value`` is of ``ids``. Words used very often are joined in ``HOT_PARTS`` parts."""
    gaps = placed.where(F.size("gaps") > 0).select("doc_id", F.posexplode("gaps").alias("no", "g")).select("doc_id", "no", F.col("g.at").alias("at"), F.col("g.word").alias("word"))
    rest = table.join(F.broadcast(frequent.select("word")), "word", "left_anti")
    total = table.agg(F.sum("uses")).first()[0] or 0
    hot = rest.where(F.col("uses") > total * HOT_SHARE)  # at most 1 / HOT_SHARE words
    marks = F.broadcast(hot.select(F.xxhash64("word").alias("_mark")).distinct())
    part = F.when(F.col("_mark").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS))).otherwise(0)
    spread = gaps.join(marks, F.xxhash64("word") == F.col("_mark"), "left").withColumn("part", part.cast("int"))
    parts = F.when(F.col("_mark").isNotNull(), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    known = rest.join(marks, F.xxhash64("word") == F.col("_mark"), "left").select("word", value.alias("value"), F.explode(parts).alias("part"))
    return spread.join(known, ["word", "part"]).select("doc_id", "no", "at", "value")


def token_ids(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of each document.

    Null and empty texts give an empty array. White space and control characters are encoded like
    any text, special tokens' strings too. Repeated rows of one ``doc_id`` come once, other columns are ignored, an empty table
    gives no rows. ``doc_id`` must name one text.
    """
    split = split_words(documents)
    table = word_table(split, folder)
    frequent = _frequent(table)
    placed = written(_placed(split, frequent), "placed")
    done = placed.where(F.size("gaps") == 0).select("doc_id", "ids")
    more = _filled(placed, table, frequent, F.col("ids")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "at", "value"))).alias("more"))
    open_rows = placed.where(F.size("gaps") > 0).select("doc_id", "ids").join(more, "doc_id")
    before = F.transform("more", lambda g, i: F.slice("ids", F.when(i == 0, 1).otherwise(F.element_at("more", i)["at"] + 1), g["at"] - F.when(i == 0, 0).otherwise(F.element_at("more", i)["at"])))
    woven = F.flatten(F.transform(F.arrays_zip(before.alias("before"), F.col("more")), lambda x: F.concat(x["before"], x["more"]["value"])))
    last = F.element_at("more", -1)["at"]
    return done.unionByName(open_rows.select("doc_id", F.concat(woven, F.slice("ids", last + 1, F.size("ids") - last)).alias("ids")))


def token_counts(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n_tokens) of each document: the same table of words, but only sums are shuffled by document."""
    split = split_words(documents)
    table = word_table(split, folder)
    frequent = _frequent(table)
    placed = written(_placed(split, frequent), "placed")
    known = placed.select("doc_id", F.size("ids").cast("bigint").alias("n"))
    rare = _filled(placed, table, frequent, F.size("ids").cast("bigint")).groupBy("doc_id").agg(F.sum("value").alias("n"))
    return known.unionByName(rare).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))


def piece_table(spark: SparkSession, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, piece) of the vocabulary: one row per id, 50,257 in all; ``piece`` holds the bytes."""
    model = tokenizer(folder)
    # byte-level vocabularies write each byte as a printable character: the printable ones stand for themselves
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    rows = [
        (i, bytearray(t.encode() if any(c not in byte_of for c in t) else bytes(byte_of[c] for c in t)))
        for t, i in model.get_vocab(with_added_tokens=True).items()
    ]
    return spark.createDataFrame(rows, "id int, piece binary")


def decoded_texts(encoded: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by a join with the vocabulary, of fixed size and broadcast; no ids give an empty text."""
    pieces = F.broadcast(piece_table(encoded.sparkSession, folder))
    rows = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(pieces, "id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece")))), lambda p: F.hex(p["piece"]))
    return rows.groupBy("doc_id").agg(F.decode(F.unhex(F.array_join(ordered, "")), "UTF-8").alias("text"))
