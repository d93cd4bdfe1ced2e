"""Vendor exports to one model of conversations and messages.

A batch of records is read as arrays of JSON nodes; every field of all conversations and messages is one search, texts are joined and stripped by Arrow, and
messages come back to their conversation by list offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.jsontape import ARRAY, BOOL, NULL, NUMBER, OBJECT, STRING, Tape
from threadloom.operators.nested import conversation_nodes, items_of

MODEL = "export_id bigint, position int, format string, id string, source string, title string, created_at string, updated_at string, messages array<struct<pos:int,role:string,content:string,timestamp:string>>"
_FIELDS = ("conversations", "id", "conversation_id", "uuid", "mapping", "chat_messages", "messages", "message", "author", "role", "content", "parts", "create_time", "update_time", "title", "name", "created_at", "updated_at", "timestamp", "sender", "text")
#: What counts as white space at the ends of a text.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_EARLIEST, _LATEST = -62_135_596_800, 253_402_300_800  # the years 1 to 9999, in seconds since 1970
_TEXT = pa.large_string()


def _full(tape: Tape, nodes: np.ndarray) -> np.ndarray:
    """Whether nodes hold something: no null, empty text, empty list or object, zero or false."""
    out = tape.is_kind(nodes, STRING, NUMBER, BOOL)
    if out.any():
        out[out] &= ~pc.is_in(tape.raw(nodes[out]), pa.array(["", "0", "0.0", "-0", "-0.0", "false"], _TEXT)).to_numpy(zero_copy_only=False)
    holds = tape.is_kind(nodes, OBJECT, ARRAY)
    out[holds] = np.bincount(tape.children(nodes[holds])[0], minlength=int(holds.sum())) > 0
    return out


def _first(tape: Tape, *nodes: np.ndarray) -> np.ndarray:
    """Of several nodes each the first that holds something, else -1."""
    found = np.full(len(nodes[0]), -1)
    for some in nodes:
        found = np.where((found < 0) & _full(tape, some), some, found)
    return found


def _said(tape: Tape, nodes: np.ndarray) -> pa.Array:
    """What a value says as text, null for null and absent ones; lists, objects and truth values as they are written."""
    plain = tape.texts(nodes)
    other = tape.is_kind(nodes, OBJECT, ARRAY, BOOL)
    return pc.if_else(pa.array(other), tape.raw(np.where(other, nodes, -1)), plain) if other.any() else plain


def _joined(owner: np.ndarray, texts: pa.Array, count: int) -> pa.Array:
    """The texts of each owner with line breaks between, white space off the ends; owners come in order."""
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=count))).astype(np.int64)
    return pc.utf8_trim(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), texts.cast(_TEXT)), pa.scalar("\n", _TEXT)), characters=_WHITE)


def _instants(tape: Tape, nodes: np.ndarray) -> pa.Array:
    """Seconds since 1970 as ISO text in UTC, without a fraction of zero; null for anything but a number in range."""
    seconds = _numbers(tape, nodes, np.nan)
    good = (seconds >= _EARLIEST) & (seconds < _LATEST)
    whole = np.floor(np.where(good, seconds, 0))
    micros = np.rint((np.where(good, seconds, 0) - whole) * 1e6).astype(np.int64) + whole.astype(np.int64) * 1_000_000
    stamps = pa.array(np.datetime_as_string(micros.astype("datetime64[us]"), unit="us").astype(object), _TEXT) if len(nodes) else pa.array([], _TEXT)
    text = pc.binary_join_element_wise(pc.replace_substring_regex(stamps, r"\.000000$", ""), pa.scalar("+00:00", _TEXT), pa.scalar("", _TEXT))
    return pc.if_else(pa.array(good), text, pa.scalar(None, _TEXT))


def _numbers(tape: Tape, nodes: np.ndarray, other: float) -> np.ndarray:
    numeric = tape.is_kind(nodes, NUMBER)
    out = np.full(len(nodes), other)
    out[numeric] = pc.cast(tape.texts(nodes[numeric]), pa.float64()).to_numpy(zero_copy_only=False)
    return out


def _tree_messages(tape: Tape, mapping: np.ndarray) -> tuple:
    """(conversation, order, role, content, timestamp) of the messages of trees, in order of their time, ties as written."""
    conv, entry = tape.children(np.where(tape.is_kind(mapping, OBJECT), mapping, -1))
    codes = pc.dictionary_encode(tape.keys(entry)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = codes + conv * (int(codes.max(initial=0)) + 1)
    _, first, of = np.unique(own, return_index=True, return_inverse=True)
    last = np.zeros(len(first), np.int64)
    np.maximum.at(last, of, np.arange(len(own)))  # a repeated key stands where it came first and holds what came last
    conv, entry, at = conv[first], tape.decoded(entry[last]), first
    message = tape.decoded(tape.child(entry, "message"))
    good = tape.is_kind(message, OBJECT)
    conv, message, at = conv[good], message[good], at[good]
    time = tape.child(message, "create_time")
    order = np.lexsort((at, _numbers(tape, time, 0.0), conv))
    conv, message, time = conv[order], message[order], time[order]
    author, content = tape.child(message, "author"), tape.child(message, "content")
    role = tape.child(author, "role")
    roles = pc.if_else(pa.array(role >= 0), _said(tape, role), pa.scalar("unknown", _TEXT))
    owner, part = items_of(tape, tape.decoded(tape.child(content, "parts")))
    spoken = tape.is_kind(part, STRING)
    texts = _joined(owner[spoken], tape.texts(part[spoken]), len(message))
    return conv, np.arange(len(conv)), roles, texts, _instants(tape, time)


def _listed_messages(tape: Tape, lists: np.ndarray, strict: np.ndarray) -> tuple:
    """The same of lists of messages, in order; ``strict`` for those in the second vendor's form."""
    conv, item = items_of(tape, lists)
    item = tape.decoded(item)
    good = tape.is_kind(item, OBJECT)
    conv, item = conv[good], item[good]
    exact = strict[conv]
    field = lambda name: tape.child(item, name)
    body = np.where(exact, _first(tape, field("text"), field("content")), _first(tape, field("content")))
    owner, part = items_of(tape, np.where(exact, body, -1))
    inner = tape.child(part, "text")
    said = pc.if_else(pa.array(tape.is_kind(part, OBJECT)), pc.fill_null(_said(tape, np.where(_full(tape, inner), inner, -1)), ""), _said(tape, part))
    kept = ~tape.is_kind(part, NULL)
    lists_ = _joined(owner[kept], said.filter(pa.array(kept)), len(item))
    plain = pc.fill_null(_said(tape, body), "")
    texts = pc.if_else(pa.array(exact), pc.if_else(pa.array(tape.is_kind(body, ARRAY)), lists_, pc.utf8_trim(plain, characters=_WHITE)), plain)
    role = np.where(exact, _first(tape, field("sender"), field("role")), field("role"))
    roles = pc.if_else(pa.array(role >= 0), _said(tape, role), pa.scalar("unknown", _TEXT))
    stamp = np.where(exact, _first(tape, field("created_at"), field("timestamp")), field("timestamp"))
    return conv, np.arange(len(conv)), roles, texts, _said(tape, stamp)


def normalized_batch(export_ids: pa.Array, records: pa.Array, kind: str = "auto") -> pa.RecordBatch:
    """Conversations (``MODEL``) of a batch of records."""
    tape = Tape(_FIELDS)
    record, position, convs = conversation_nodes(tape, records)
    has = lambda name: tape.child(convs, name) >= 0
    forms = np.where(has("mapping") | has("conversation_id"), 1, np.where(has("chat_messages") | has("uuid"), 2, 0))
    head = np.append(True, record[1:] != record[:-1])[: len(record)]
    form = forms[np.maximum.accumulate(np.where(head, np.arange(len(record)), 0))] if kind == "auto" else np.full(len(record), 1 if kind == "chatgpt" else 2)
    known = form > 0
    record, position, convs, form = record[known], position[known], convs[known], form[known]
    first_form = form == 1
    mapping = tape.decoded(tape.child(convs, "mapping"))
    trees = first_form & tape.is_kind(mapping, OBJECT)
    trees[trees] = _full(tape, mapping[trees])
    chat = tape.child(convs, "chat_messages")
    lists = tape.decoded(np.where(~first_form & (chat >= 0), chat, tape.child(convs, "messages")))
    both = [_tree_messages(tape, np.where(trees, mapping, -1)), _listed_messages(tape, np.where(trees, -1, lists), ~first_form)]
    conv, order = (np.concatenate([x[i] for x in both]) for i in (0, 1))
    roles, texts, stamps = (pa.concat_arrays([x[i].cast(_TEXT) for x in both]) for i in (2, 3, 4))
    rows = np.lexsort((order, conv))
    rows = rows[pc.not_equal(texts, "").to_numpy(zero_copy_only=False)[rows]]
    conv = conv[rows]
    counts = np.bincount(conv, minlength=len(convs))
    offsets = np.append(0, np.cumsum(counts))
    take = lambda a: a.take(pa.array(rows)).cast(pa.string())
    messages = pa.StructArray.from_arrays([pa.array((np.arange(len(rows)) - offsets[conv]).astype(np.int32)), take(roles), take(texts), take(stamps)], ["pos", "role", "content", "timestamp"])

    field = lambda name: tape.child(convs, name)
    pick = lambda one, other: pc.if_else(pa.array(first_form), one, other)
    ids = _said(tape, np.where(first_form, _first(tape, field("id"), field("conversation_id")), _first(tape, field("uuid"), field("id"))))
    names = [pc.fill_null(pick(_said(tape, field(a)), _said(tape, field(b))), "") for a, b in (("title", "name"), ("create_time", "created_at"))]
    bare = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))  # digests only where a conversation has no id
    if len(bare):
        digests = [hashlib.sha1(f"{a}{b}".encode()).hexdigest()[:12] for a, b in zip(*(n.take(pa.array(bare)).to_pylist() for n in names))]
        mask = np.zeros(len(ids), bool)
        mask[bare] = True
        ids = pc.replace_with_mask(ids, pa.array(mask), pa.array(digests, _TEXT))
    title = pc.fill_null(_said(tape, np.where(first_form, _first(tape, field("title")), _first(tape, field("name"), field("title")))), "Untitled")
    created, updated = (pick(_instants(tape, field(a)), _said(tape, field(b))) for a, b in (("create_time", "created_at"), ("update_time", "updated_at")))
    source = pa.array(np.where(first_form, "chatgpt", "claude").astype(object), pa.string())
    columns = [export_ids.cast(pa.int64()).take(pa.array(record)), pa.array(position.astype(np.int32)), source, ids, source, title, created, updated]
    text = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns]
    return pa.RecordBatch.from_arrays([*text, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), messages)], [c.split()[0] for c in MODEL.split(", ")])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield part.column(0), part.column(1)


def rejected_exports(exports: DataFrame) -> DataFrame:
    """(export_id, reason) of the records that ``normalize_exports`` yields nothing for: ``blank``, ``invalid`` (no JSON) or ``unknown`` (no conversation of a known format)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, records in _batches(batches):
            blank = pc.equal(pc.utf8_trim(pc.fill_null(records.cast(_TEXT), ""), characters=_WHITE), "").to_numpy(zero_copy_only=False)
            valid = Tape(_FIELDS).add(records) >= 0
            # a record without conversations of a known format has no row; its number stands for its id
            good = np.zeros(len(records), bool)
            good[normalized_batch(pa.array(np.arange(len(records))), records).column(0).to_numpy()] = True
            reason = np.select([blank, ~valid], ["blank", "invalid"], "unknown").astype(object)
            rows = pa.array(np.flatnonzero(~good))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(rows), pa.array(reason, pa.string()).take(rows)], ["export_id", "reason"])

    return exports.select(F.col("export_id").cast("bigint").alias("export_id"), F.col("record").cast("string").alias("record")).mapInArrow(run, "export_id bigint, reason string")


def normalize_exports(exports: DataFrame, kind: str = "auto") -> DataFrame:
    """Conversations (``MODEL``) of export records (export_id, record).

    ``auto`` takes each record's format from its first conversation; of an unknown format, invalid or blank records yield nothing here and a row of
    ``rejected_exports``. Fields that are null or of another kind count as absent; messages without text are left out; messages of the tree form are in
    order of their time, ties as written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, records in _batches(batches):
            yield normalized_batch(ids, records, kind)

    slim = exports.select(F.col("export_id").cast("bigint").alias("export_id"), F.col("record").cast("string").alias("record"))
    return slim.where(F.trim("record") != "").mapInArrow(run, MODEL)
