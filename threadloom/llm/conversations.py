"""Problem 1: conversations rebuilt from message rows with keyed streaming state.

Message rows are a stream with their arrival as event time. Before any shuffle each row is cut down to what
order and validity need: speaker, a digest of the text, the instant. Conversations are hashed to
buckets; a bucket's state buffers the rows of its conversations, so that one call handles many
conversations with array operations. A conversation closes once the watermark has passed its last arrival by
the idle time; it is then validated and emitted. Rows that come later, within ``keep_days``,
reopen it, and it is emitted again with a higher revision: the highest revision holds. After ``keep_days`` its rows leave the state, so that what a batch
rewrites is bounded by what arrived in that time.

Rows that the watermark turns away, or that come after that time, are not lost: a revision counts the rows it has seen, and a finite table is audited
against these counts. Conversations that miss rows are listed in a side table and recomputed from the table by windows (``recomputed``).

A finite table is read in several micro-batches; it ends with a closing row far in the future, which moves the watermark past every timer.
"""

from __future__ import annotations

import datetime as dt
import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.instants import instant_micros
from threadloom.functions.textfns import has_visible, strip
from threadloom.operators.times import with_account_rules
from threadloom.session import scratch_path, table, written

BUCKETS, BUCKET_BYTES = 192, 2_000_000  # a finite table gets a bucket for each so many bytes of its files, this many at least
IDLE_HOURS, KEEP_DAYS, DELAY = 72, 60, "1 day"
GIANT_ROWS, GIANT_SHARE = 200_000, 1e-4  # conversations of more rows, and of more than this share of all (so at most one over it), never enter the state
MICRO_BATCHES = 3  # in which the registered query reads its table, where that has so many files
NONE, USER, ASSISTANT, SYSTEM, TOOL = 0, 1, 2, 3, 4
#: Spellings of the speakers, in lower case and without outer white space.
SPEAKERS = {
    "user": USER, "human": USER, "me": USER, "customer": USER, "prompter": USER,
    "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "chatbot": ASSISTANT, "gpt": ASSISTANT, "chatgpt": ASSISTANT, "claude": ASSISTANT,
    "system": SYSTEM, "developer": SYSTEM,
    "tool": TOOL, "function": TOOL,
}
RESULT = "conversation_id string, revision bigint, outcome string, turn_rows string, prompts array<bigint>, replies array<bigint>"
_ROWS = ["conversation_id", "row_id", "speaker", "blank", "digest", "micros", "timed", "arrived"]


def slim_rows(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """What order and validity need of each message row; works on streams. Rows without a conversation are left out."""
    own = messages.where(F.col("conversation_id").isNotNull())
    ruled = with_account_rules(own.select("row_id", "conversation_id", "account_key", "role", "content", "timestamp", "ingested_at"), accounts)
    speakers = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    visible = has_visible(F.col("content"))
    micros = instant_micros(F.col("timestamp"), F.col("_zone"), F.col("_date_order"))
    return ruled.select(
        "conversation_id",
        "row_id",
        F.coalesce(F.try_element_at(speakers, F.lower(strip(F.col("role")))), F.lit(NONE)).alias("speaker"),
        (~visible).alias("blank"),
        F.when(visible, F.xxhash64(strip(F.col("content")))).otherwise(F.lit(0).cast("bigint")).alias("digest"),
        micros.alias("micros"),
        "ingested_at",
    )


def validated(rows: pd.DataFrame) -> pd.DataFrame:
    """Outcome, turns and pairs of each conversation whose rows are all in ``rows``.

    Repeats go by their lowest ``row_id``; equal instants are ordered by ``row_id``.
    """
    rows = rows.sort_values("row_id", kind="stable").drop_duplicates(["conversation_id", "speaker", "digest", "micros", "timed"])
    rows = rows.sort_values(["conversation_id", "micros", "row_id"], kind="stable").reset_index(drop=True)
    conv, names = pd.factorize(rows["conversation_id"])
    n = len(names)

    def any_of(flags: np.ndarray) -> np.ndarray:
        return np.bincount(conv[flags], minlength=n) > 0

    speaker, counts, timed = rows["speaker"].to_numpy(), ~rows["blank"].to_numpy(), rows["timed"].to_numpy()
    row_id = rows["row_id"].to_numpy()
    broken = any_of(counts & ((speaker == NONE) | ~timed))
    main = np.flatnonzero(counts & ((speaker == USER) | (speaker == ASSISTANT)))
    c, s = conv[main], speaker[main]
    first = np.append(True, c[1:] != c[:-1])[: len(c)]
    last = np.append(c[1:] != c[:-1], True)[: len(c)]
    before = np.append(NONE, s[:-1])[: len(s)]
    after = np.append(s[1:], NONE)[: len(s)]
    bad = (s == ASSISTANT) & (first | (before == ASSISTANT))
    broken |= np.bincount(c[bad], minlength=n) > 0
    lonely = np.bincount(c[(s == USER) & (last | (after != ASSISTANT))], minlength=n) > 0
    empty = ~any_of(counts & (speaker != SYSTEM) & (speaker != TOOL))
    outcome = np.select([empty, broken, lonely], ["empty", "broken", "missing_reply"], "kept")

    turns = np.full(n, "", dtype=object)
    kept = counts & (outcome == "kept")[conv]
    shown = pd.Series(row_id[kept].astype(str)).groupby(conv[kept]).agg(",".join)
    turns[shown.index.to_numpy()] = shown.to_numpy()

    said = np.flatnonzero(timed & ((counts & (speaker == USER)) | (speaker == ASSISTANT)) & np.isin(outcome, ("kept", "missing_reply"))[conv])
    c, s = conv[said], speaker[said]
    follows = np.flatnonzero((c[1:] == c[:-1]) & (s[1:] == ASSISTANT) & (s[:-1] == USER))
    prompts = [[] for _ in range(n)]
    replies = [[] for _ in range(n)]
    for i in follows:
        prompts[c[i]].append(int(row_id[said[i]]))
        replies[c[i]].append(int(row_id[said[i + 1]]))
    return pd.DataFrame({"conversation_id": names, "outcome": outcome, "turn_rows": turns, "prompts": prompts, "replies": replies})


def _packed(rows: pd.DataFrame) -> bytes:
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_pandas(rows[_ROWS + ["sent"]], preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def _keeper(idle_ms: int, keep_ms: int):
    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [_unpacked(state.get[0])] if state.exists else []
        for frame in frames:
            new = frame[frame["conversation_id"].notna()].copy()
            if len(new):
                new["timed"] = new["micros"].notna()
                new["micros"] = new["micros"].fillna(0).astype(np.int64)
                new["arrived"] = new["ingested_at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
                new["sent"] = False
                held.append(new[_ROWS + ["sent"]])
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if not len(rows):
            return
        now = state.getCurrentWatermarkMs()
        ends = rows.groupby("conversation_id", sort=False)["arrived"].transform("max") + idle_ms
        fresh = ~rows.groupby("conversation_id", sort=False)["sent"].transform("all")  # something not yet emitted
        due = (ends <= now) & fresh
        if due.any():
            out = validated(rows[due])
            out["revision"] = rows[due].groupby("conversation_id")["row_id"].size().reindex(out["conversation_id"]).to_numpy()
            yield out[[c.split()[0] for c in RESULT.split(", ")]]
            rows.loc[due, "sent"] = True
            fresh &= ~due
        rows, ends, fresh = (x[ends + keep_ms > now] for x in (rows, ends, fresh))
        if not len(rows):
            state.remove()
            return
        state.update((_packed(rows),))
        next_time = int(ends[fresh].min()) if fresh.any() else int(ends.min()) + keep_ms
        state.setTimeoutTimestamp(max(next_time, now + 1))

    return keep


def rebuilt(rows: DataFrame, buckets: int = BUCKETS, idle_hours: float = IDLE_HOURS, keep_days: float = KEEP_DAYS, delay: str = DELAY) -> DataFrame:
    """The stream of conversations (``RESULT``) from a stream of slim rows."""
    bucket = F.when(F.col("conversation_id").isNotNull(), F.pmod(F.xxhash64("conversation_id"), F.lit(buckets))).otherwise(F.lit(-1))
    return (
        rows.withWatermark("ingested_at", delay)
        .withColumn("bucket", bucket.cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(
            _keeper(int(idle_hours * 3_600_000), int(keep_days * 86_400_000)), RESULT, "rows binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def recomputed(rows: DataFrame) -> DataFrame:
    """Outcome, turns and pairs of each conversation of a finite table of slim rows, as ``validated`` has them, by windows: rows are sorted and spill, so no conversation is too long."""
    micros = F.coalesce("micros", F.lit(0))
    keys = ["conversation_id", "speaker", "digest", micros.alias("at"), F.col("micros").isNotNull().alias("timed"), "blank"]
    once = rows.groupBy(*keys).agg(F.min("row_id").alias("row_id"))
    counts, user, assistant = ~F.col("blank"), F.col("speaker") == USER, F.col("speaker") == ASSISTANT
    order = Window.partitionBy("conversation_id").orderBy("at", "row_id")

    def beside(some: DataFrame) -> DataFrame:
        return some.withColumns({"before": F.lag("speaker").over(order), "after": F.lead("speaker").over(order), "prompt": F.lag("row_id").over(order)})

    main = beside(once.where(counts & (user | assistant)))
    flow = main.groupBy("conversation_id").agg(
        F.max(assistant & (F.col("before").isNull() | (F.col("before") == ASSISTANT))).alias("bad"), F.max(user & (F.coalesce("after", F.lit(NONE)) != ASSISTANT)).alias("lonely")
    )
    said = beside(once.where("timed").where((counts & user) | assistant)).where(assistant & (F.col("before") == USER))
    pairs = said.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("at", "row_id", "prompt"))).alias("pairs"))
    whole = once.groupBy("conversation_id").agg(
        F.max(counts & ((F.col("speaker") == NONE) | ~F.col("timed"))).alias("unclear"),
        F.max(counts & ~F.col("speaker").isin(SYSTEM, TOOL)).alias("full"),
        F.array_sort(F.collect_list(F.when(counts, F.struct("at", "row_id")))).alias("turns"),
    )
    every = whole.join(flow, "conversation_id", "left").join(pairs, "conversation_id", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = F.when(~true("full"), "empty").when(true("unclear") | true("bad"), "broken").when(true("lonely"), "missing_reply").otherwise("kept")
    kept = every.withColumn("outcome", outcome)
    paired = F.when(F.col("outcome").isin("kept", "missing_reply"), F.col("pairs"))
    ids = lambda c: F.coalesce(F.transform(paired, lambda p: p[c]), F.array().cast("array<bigint>"))
    turns = F.when(F.col("outcome") == "kept", F.array_join(F.transform("turns", lambda t: t["row_id"].cast("string")), ",")).otherwise("")
    return kept.select("conversation_id", "outcome", turns.alias("turn_rows"), ids("prompt").alias("prompts"), ids("row_id").alias("replies"))


def rebuild_all(spark: SparkSession, path: str, accounts: DataFrame, max_files: int | None = None, audit: bool = True, **settings: float) -> DataFrame:
    """Run the stream over the finite table of message rows at ``path``, ``max_files`` files a micro-batch (all in one by default); its conversations, one row each.

    State, checkpoints and results lie in the shared folder, so a lost executor costs only its tasks. With ``audit``, conversations whose newest revision
    has not seen all their rows are recomputed, so the result doesn't depend on the order of files or on any time limit. Giant conversations are left to
    the audit from the start, so that none has to fit into a state.
    """
    home = scratch_path(spark, "conversations")
    closing, result = f"{home}/closing", f"{home}/result"
    whole = spark.read.parquet(path)
    schema, size = whole.schema, int(str(whole._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    settings.setdefault("buckets", max(BUCKETS, size // BUCKET_BYTES))
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(closing)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream_in = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the table may be a file or a folder
    counts = None
    if audit:
        counts = written(whole.where(F.col("conversation_id").isNotNull()).groupBy("conversation_id").agg(F.count("*").alias("rows")), "row-counts")
        total = counts.agg(F.sum("rows")).first()[0] or 0
        giants = [r[0] for r in counts.where((F.col("rows") > GIANT_ROWS) & (F.col("rows") > total * GIANT_SHARE)).select("conversation_id").collect()]
        if giants:
            stream_in = stream_in.where(~F.col("conversation_id").isin(giants))
    rows = slim_rows(stream_in, accounts)
    end = spark.readStream.schema(schema).parquet(closing)
    ends = end.select(*[F.col(c).cast(rows.schema[c].dataType) if c in schema.names else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])

    def run() -> None:
        stream = rebuilt(rows.unionByName(ends), **settings)
        query = (
            stream.writeStream.format("parquet").option("path", result).option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    last = [None] * len(schema)
    last[schema.names.index("ingested_at")] = dt.datetime(2200, 1, 1)
    spark.createDataFrame([tuple(last)], schema).coalesce(1).write.mode("append").parquet(closing)
    run()
    emitted = spark.read.schema(RESULT).parquet(result)
    newest = emitted.groupBy("conversation_id").agg(F.max_by(F.struct("revision", "outcome", "turn_rows", "prompts", "replies"), "revision").alias("r"))
    known = newest.select("conversation_id", "r.*")
    if not audit:
        return known.drop("revision")
    known = written(known, "conversations")
    stale = written(incomplete(counts, known), "incomplete")
    if not stale.limit(1).count():
        return known.drop("revision")
    again = recomputed(slim_rows(whole.join(stale, "conversation_id", "left_semi"), accounts))
    return known.join(stale, "conversation_id", "left_anti").drop("revision").unionByName(again)


def incomplete(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(conversation_id) of the conversations of ``counts`` (conversation_id, rows) of which the newest revision in ``known`` hasn't seen so many rows."""
    return counts.join(known.select("conversation_id", "revision"), "conversation_id", "left").where("revision is null or revision <> rows").select("conversation_id")


def conversations(spark: SparkSession, sf_dir: str, batches: int = MICRO_BATCHES) -> DataFrame:
    path = os.path.join(sf_dir, "message_rows.parquet")
    files = len(spark.read.parquet(path).inputFiles())
    return rebuild_all(spark, path, table(spark, sf_dir, "accounts"), max_files=-(-files // batches) if files > 1 else None)


def outcomes(results: DataFrame, chats: DataFrame) -> DataFrame:
    """(conversation_id, outcome, turn_rows) of each distinct ``chats.id``; without messages it is empty. Null ids have no row."""
    ids = chats.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct()
    return ids.join(results, "conversation_id", "left").select(
        "conversation_id", F.coalesce("outcome", F.lit("empty")).alias("outcome"), F.coalesce("turn_rows", F.lit("")).alias("turn_rows")
    )
