"""Problem 9: mix sources to target shares of the total size by dependent rounding.

Every document of a source gets the same expected number of copies. Its whole part is certain; the
fractional parts are rounded by a pivotal process that is balanced on size: two open documents
exchange probability so that their expected size together stays, and at each step one becomes
certain. A partition leaves one open document a source; these residuals are combined through a
reduction tree, so nothing is gathered in one place. Each block goes from its largest document to its smallest, so that the one
left open, by which a source may miss its goal, is a small one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import TOKENIZER_DIR, token_counts
from threadloom.session import written

FAN_IN = 256
EPSILON = 1e-9
_COLUMNS = ["doc_id", "source", "n_tokens", "whole", "share", "copies"]
_SCHEMA = "doc_id bigint, source string, n_tokens bigint, whole bigint, share double, copies bigint"


def pivot(items: list[list], random: np.random.Generator) -> tuple[list[tuple[int, int]], list | None]:
    """Round ``items`` ([tag, size, probability]) one against the next.

    Returns the decided (tag, 0 or 1) and the one item that may stay open. Expectations of all items and the expected size
    of each pair are kept. Items without size round alone at their probability.
    """
    decided, open_item = [], None
    draws = random.random(2 * len(items) + 1)
    for at, item in enumerate(items):
        tag, size, p = item
        if p <= EPSILON or p >= 1 - EPSILON:
            decided.append((tag, int(p > 0.5)))
            continue
        if size <= 0:
            decided.append((tag, int(draws[2 * at] < p)))
            continue
        if open_item is None:
            open_item = [tag, size, p]
            continue
        a, b = open_item, [tag, size, p]
        # moving t along (b.size, -a.size) keeps a.size * a.p + b.size * b.p
        up = min((1 - a[2]) / b[1], b[2] / a[1])
        down = min(a[2] / b[1], (1 - b[2]) / a[1])
        t = up if draws[2 * at + 1] * (up + down) < down else -down
        a[2] += t * b[1]
        b[2] -= t * a[1]
        open_item = None
        for x in (a, b):
            if x[2] <= EPSILON or x[2] >= 1 - EPSILON:
                decided.append((x[0], int(x[2] > 0.5)))
            else:
                open_item = x
    return decided, open_item


def _round_frame(frame: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rows of one block of any sources, with ``copies`` where decided; one row a source may stay open."""
    frame = frame.sort_values(["source", "n_tokens", "doc_id"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
    copies = np.full(len(frame), -1, np.int64)
    share = frame["share"].to_numpy().copy()
    for _, rows in frame.groupby("source", sort=True).indices.items():
        first = int(frame["doc_id"].iat[rows[0]]) & 0x7FFFFFFF
        random = np.random.default_rng([seed, first, len(rows)])
        items = [[int(i), int(frame["n_tokens"].iat[i]), float(share[i])] for i in rows]
        decided, left = pivot(items, random)
        for i, bit in decided:
            copies[i] = frame["whole"].iat[i] + bit
        if left is not None:
            share[left[0]] = left[2]
    frame["share"] = share
    frame["copies"] = pd.Series(copies, dtype="Int64").where(pd.Series(copies) >= 0)
    return frame[_COLUMNS]


def _first_level(seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        for frame in frames:
            frame["copies"] = pd.Series([None] * len(frame), dtype="Int64")
            out = _round_frame(pd.concat([*left, frame[_COLUMNS]], ignore_index=True) if left else frame, seed)
            is_open = out["copies"].isna()
            left = [out[is_open]] if is_open.any() else []
            yield out[~is_open]
        yield from left

    return run


def plan_shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | float | None = None) -> list[dict]:
    """One row per target: the goal in tokens and the expected copies of each document.

    Sources without tokens can't contribute; the others share the total in proportion. Without
    ``total_tokens`` the total is the largest that meets all of them within ``max_repeats``; with it (a float: as a multiple of the tokens that the
    sources hold), a source that is too small is used up to its cap. The tables of sources are configuration (one row per named source).
    """
    known = {r["source"]: r["tokens"] for r in sizes.join(F.broadcast(targets.select("source")), "source", "left_semi").collect()}
    goals = [r.asDict() for r in targets.orderBy("source").collect()]
    able = [g for g in goals if (known.get(g["source"]) or 0) > 0 and g["target_share"] > 0 and g["max_repeats"] > 0]
    weight = sum(g["target_share"] for g in able)
    reach = [known[g["source"]] * g["max_repeats"] * weight / g["target_share"] for g in able]
    total = min(reach, default=0.0) if total_tokens is None else total_tokens * sum(known[g["source"]] for g in able) if isinstance(total_tokens, float) else float(total_tokens)
    for g in goals:
        tokens = known.get(g["source"]) or 0
        wanted = total * g["target_share"] / weight if g in able else 0.0
        g["copies_each"] = min(wanted / tokens, float(g["max_repeats"])) if g in able else 0.0
        g["source_tokens"] = int(tokens)
    return goals


def mixed_copies(documents: DataFrame, targets: DataFrame, total_tokens: int | float | None = None, folder: str = TOKENIZER_DIR, seed: int = 7) -> tuple[DataFrame, list[dict]]:
    """((doc_id, source, n_tokens, copies) of every document of a target source, the plan).

    Null, empty and unlisted sources take no part; texts without tokens may be copied but weigh nothing. Documents not
    chosen have 0 copies. Ties and equal texts are separate documents. Empty tables give no rows.
    """
    named = documents.select("doc_id", "source").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    counts = token_counts(documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), folder)
    sized = written(named.join(counts, "doc_id").select("doc_id", "source", "n_tokens"), "sizes")
    plan = plan_shares(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets, total_tokens)
    spark = documents.sparkSession
    each = spark.createDataFrame([(g["source"], g["copies_each"]) for g in plan], "source string, each double")
    open_rows = sized.join(F.broadcast(each), "source").select(
        "doc_id", "source", "n_tokens", F.floor("each").cast("bigint").alias("whole"), (F.col("each") - F.floor("each")).alias("share")
    ).withColumn("copies", F.lit(None).cast("bigint"))
    level = written(open_rows.mapInPandas(_first_level(seed), _SCHEMA).withColumn("block", F.spark_partition_id()), "mix-level")
    done = [level.where(F.col("copies").isNotNull()).drop("block")]
    left = level.where(F.col("copies").isNull())
    blocks = left.agg(F.max("block")).first()[0]
    while blocks is not None:
        grouped = left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int"))

        def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            out = _round_frame(frame, seed + 1)
            out["block"] = key[1]
            return out

        level = written(grouped.groupBy("source", "block").applyInPandas(combine, _SCHEMA + ", block int"), "mix-level")
        done.append(level.where(F.col("copies").isNotNull()).drop("block"))
        left = level.where(F.col("copies").isNull())
        if blocks < FAN_IN:  # one open document a source is left: its own coin
            coin = (F.xxhash64("doc_id", "source", F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < F.col("share")
            done.append(left.drop("block").withColumn("copies", F.col("whole") + coin.cast("bigint")))
            break
        blocks //= FAN_IN
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select("doc_id", "source", "n_tokens", "copies"), plan


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | float | None = None, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row per target source: its goal and what the mix actually holds of it.

    ``actual_share`` is of all tokens of the mix (0 where the mix is empty); ``met`` tells whether it is within half a
    percent point of ``target_share``. ``goal_share`` is the target among the sources that have tokens, since the shares of those without fall to the
    others; ``goal_met`` compares with that.
    """
    copies, plan = mixed_copies(documents, targets, total_tokens, folder)
    used = copies.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")
    )
    spark = documents.sparkSession
    goals = spark.createDataFrame(
        [(g["source"], float(g["target_share"]), int(g["max_repeats"]), g["source_tokens"], float(g["copies_each"])) for g in plan],
        "source string, target_share double, max_repeats int, source_tokens bigint, expected_copies double",
    )
    rows = goals.join(written(used, "mixed"), "source", "left").na.fill(0, ["documents", "copies", "most_copies", "tokens"])
    totals = rows.agg(F.sum("tokens").alias("_all"), F.sum(F.when(F.col("source_tokens") > 0, F.col("target_share"))).alias("_weight"))
    tokens, weight = totals.first()
    share = F.col("tokens") / F.lit(float(tokens)) if tokens else F.lit(0.0)
    goal = F.when(F.col("source_tokens") > 0, F.col("target_share") / F.lit(weight)).otherwise(0.0)
    shares = rows.withColumns({"goal_share": goal, "actual_share": share})
    return shares.withColumns({"met": F.abs(share - F.col("target_share")) < 0.005, "goal_met": F.abs(share - F.col("goal_share")) < 0.005})
