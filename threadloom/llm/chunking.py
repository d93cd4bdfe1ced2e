"""Problem 7: cut oversized items into pieces at natural boundaries, with a fixed overlap.

Only items above their limit leave the JVM. For those, boundary offsets are kept as sorted arrays
by strength (message, paragraph, line, sentence, word; conversations lay their messages end to end
by prefix sums of their lengths). The end of a piece is the last boundary at or under the limit, found by binary search
in the strongest array that has one in the later half of the window; without any, it is a hard cut.
The next piece starts the overlap before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "item_kind string, item_key string, piece_no int, start bigint, end bigint, boundary string, piece string"
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"""[.!?…]+["'»”’)\]]*(?=\s)\s+|[。！？]+[」』”]*""")
_WORD = re.compile(r"\s+|(?<=[、，；：])")
LEVELS = ("message", "paragraph", "line", "sentence", "word")
_NO_CUT_BEFORE = re.compile(r"[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿゙゚︀-️︠-︯‍]")


def boundaries(text: str, message_ends: np.ndarray) -> list[np.ndarray]:
    """Sorted offsets after which a piece may end, strongest level first."""
    ends = [message_ends.astype(np.int64)]
    for pattern in (_PARAGRAPH, _LINE, _SENTENCE, _WORD):
        ends.append(np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64))
    return ends


def cut(text: str, max_chars: int, overlap: int, message_ends: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece: none longer than ``max_chars``, each starting ``overlap`` before the last one's end.

    Any overlap under the limit is kept exactly; one that isn't under it could make no progress and counts as one less than the limit.
    """
    size = len(text)
    max_chars = max(1, max_chars)
    overlap = max(0, min(overlap, max_chars - 1))
    levels = boundaries(text, np.array([], np.int64) if message_ends is None else message_ends)
    out, start = [], 0
    while size - start > max_chars:
        limit = start + max_chars
        least = start + max(overlap, max_chars // 2)
        end, kind = 0, "hard"
        for name, offsets in zip(LEVELS, levels):
            at = int(np.searchsorted(offsets, limit, side="right")) - 1
            if at >= 0 and offsets[at] > least:
                end, kind = int(offsets[at]), name
                break
        if kind == "hard":
            for name, offsets in zip(LEVELS, levels):  # any boundary at all before a hard cut
                at = int(np.searchsorted(offsets, limit, side="right")) - 1
                if at >= 0 and offsets[at] > start + overlap:
                    end, kind = int(offsets[at]), name
                    break
        if kind == "hard":
            end = limit
            while end > least and _NO_CUT_BEFORE.match(text[end]):  # not inside a combined character
                end -= 1
            end = limit if end <= least else end
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, size, "end"))
    return out


def oversized(items: DataFrame, kind: str, key: Column, contents: Column, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """(item_kind, item_key, contents) of the items whose contents together exceed the limit, found in the JVM."""
    most = limits[kind][0]
    size = F.aggregate(contents, F.lit(0).cast("bigint"), lambda n, c: n + F.coalesce(F.length(c), F.lit(0)))
    slim = items.select(F.lit(kind).alias("item_kind"), key.cast("string").alias("item_key"), contents.alias("contents"), size.alias("_size"))
    return slim.where(F.col("_size") > most).drop("_size")


def pieces(items: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """The pieces of oversized items (item_kind, item_key, contents): offsets in code points of the joined contents.

    Null contents count as empty; items at or under the limit have no rows, nor have null keys' limits
    any effect. Repeated items are cut each by itself. Joined pieces without their overlaps give back the contents exactly.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for kind, key, contents in zip(frame["item_kind"], frame["item_key"], frame["contents"]):
                parts = [c or "" for c in contents]
                text = "".join(parts)
                ends = np.cumsum([len(p) for p in parts])[:-1]
                most, overlap = limits[kind]
                for n, (start, end, boundary) in enumerate(cut(text, most, overlap, ends)):
                    rows.append((kind, key, n, start, end, boundary, text[start:end]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return items.mapInPandas(run, PIECES)


def limits_of(size_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """The limits by kind: configuration of one row per kind of item."""
    return {r["item_kind"]: (int(r["max_chars"]), int(r["overlap_chars"])) for r in size_limits.collect()}


def message_pieces(messages: DataFrame, size_limits: DataFrame) -> DataFrame:
    limits = limits_of(size_limits)
    return pieces(oversized(messages, "message", F.col("row_id"), F.array("content"), limits), limits)


def conversation_pieces(conversations: DataFrame, size_limits: DataFrame) -> DataFrame:
    limits = limits_of(size_limits)
    contents = F.transform(F.coalesce("messages", F.array().cast(conversations.schema["messages"].dataType)), lambda m: m["content"])
    return pieces(oversized(conversations, "conversation", F.col("id"), contents, limits), limits)
