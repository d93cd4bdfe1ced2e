"""Nested export records to flat parent-child rows.

The bytes of a batch of records become one array of JSON nodes (``functions.jsontape``), and each level (conversations of a record, entries of a
conversation, parts and attachments of an entry) is the range of children of a level above, as list offsets are: every child has its parent index, ``take``
carries the parent's keys down, and the nearest message ancestor of a tree entry comes from pointer jumping over an index array. No record,
entry or part is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.jsontape import ARRAY, NULL, OBJECT, STRING, Tape

FLAT_SCHEMA = "export_id bigint, conversation_key string, kind string, child_key string, parent_key string"


def _message_above(above: np.ndarray, is_message: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest message above it, -1 for none; rings lead nowhere."""
    n = len(above)
    up = np.append(above, n)  # n is the root, and its own parent
    up[up < 0] = n
    stop = np.append(is_message, True)
    hop = np.where(stop, np.arange(n + 1), up)  # a message answers for itself, any other entry asks above
    for _ in range(max(1, n.bit_length())):
        hop = hop[hop]
    hop[~stop[hop]] = n  # a ring without a message
    found = hop[up[:n]]
    return np.where(found == n, -1, found)


def _joined(*pieces: object) -> pa.Array:
    large = pa.large_string()
    return pc.binary_join_element_wise(*(pa.scalar(p, large) if isinstance(p, str) else p.cast(large) for p in pieces), pa.scalar("", large))


_FIELDS = ("conversations", "id", "conversation_id", "uuid", "mapping", "chat_messages", "messages", "message", "parent", "content", "parts", "text", "attachments", "metadata")


def _named(tape: Tape, nodes: np.ndarray, *names: str) -> pa.Array:
    """Of each object the first of the fields that isn't blank, as text."""
    found = []
    for name in names:
        said = tape.texts(tape.child(nodes, name))
        blank = pc.equal(pc.utf8_trim_whitespace(said), "").fill_null(True)
        found.append(pc.if_else(blank, pa.scalar(None, pa.large_string()), said))
    return pc.coalesce(*found)


def items_of(tape: Tape, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the list, element) of the elements of those nodes that are lists."""
    return tape.children(np.where(tape.is_kind(lists, ARRAY), lists, -1))


def _either(tape: Tape, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, position) of the elements that aren't null of the first list, or of the other where that has none."""
    owner, item = items_of(tape, one)
    full = ~tape.is_kind(item, NULL)
    owner, item = owner[full], item[full]
    more, rest = items_of(tape, np.where(np.bincount(owner, minlength=len(one)) > 0, -1, other))
    full = ~tape.is_kind(rest, NULL)
    return np.append(owner, more[full]), tape.place[np.append(item, rest[full]).astype(np.int64)]


def conversation_nodes(tape: Tape, records: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the record, position, node) of each conversation object in the records, in order."""
    tops = tape.decoded(tape.add(records))
    many = tape.decoded(tape.child(tops, "conversations"))
    listed = np.where(tape.is_kind(tops, ARRAY), tops, np.where(tape.is_kind(many, ARRAY), many, -1))
    owner, item = items_of(tape, listed)
    alone = np.flatnonzero(tape.is_kind(tops, OBJECT) & (listed < 0))
    record_of_conv, spots = np.append(owner, alone), np.append(tape.place[item], np.zeros(len(alone), np.int64))
    convs = tape.decoded(np.append(item, tops[alone]).astype(np.int64))
    good = tape.is_kind(convs, OBJECT)
    record_of_conv, spots, convs = record_of_conv[good], spots[good], convs[good]
    order = np.lexsort((spots, record_of_conv))
    return record_of_conv[order], spots[order], convs[order]


def flatten_batch(export_ids: pa.Array, records: pa.Array) -> pa.RecordBatch:
    """The flat rows of a batch of records, each row once."""
    tape = Tape(_FIELDS)
    record_of_conv, spots, convs = conversation_nodes(tape, records)
    ids = export_ids.cast(pa.int64()).take(pa.array(record_of_conv))
    fallback = _joined(ids.cast(pa.large_string()), ":", pa.array(spots).cast(pa.large_string()))
    conv_keys = pc.coalesce(_named(tape, convs, "id", "conversation_id", "uuid"), fallback)

    # entries of trees
    mapping = tape.decoded(tape.child(convs, "mapping"))
    conv_of, entry = tape.children(np.where(tape.is_kind(mapping, OBJECT), mapping, -1))
    has_tree = np.bincount(conv_of, minlength=len(convs)) > 0
    keys = tape.keys(entry)
    entry = tape.decoded(entry)
    up_node = tape.child(entry, "parent")
    ups = tape.texts(np.where(tape.is_kind(up_node, STRING), up_node, -1))
    message = tape.decoded(tape.child(entry, "message"))
    words = pc.dictionary_encode(pa.concat_arrays([keys, ups]))
    codes = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, above = codes[: len(keys)] + conv_of * (len(words.dictionary) + 1), codes[len(keys) :]
    order = np.argsort(own, kind="stable")
    last = np.append(own[order][1:] != own[order][:-1], True)[: len(order)]
    order = order[last]  # a repeated key means its last entry
    wanted = np.where(above >= 0, above + conv_of * (len(words.dictionary) + 1), -1)[order]
    place = np.minimum(np.searchsorted(own[order], wanted), max(0, len(order) - 1))
    parent = np.where(own[order][place] == wanted, place, -1) if len(order) else place
    is_message = tape.is_kind(message[order], OBJECT)
    up = _message_above(parent.astype(np.int64), is_message)
    tree_conv = conv_of[order]
    tree_keys = keys.take(pa.array(order))
    tree_parents = pc.coalesce(tree_keys.take(pa.array(up, pa.int64(), mask=up < 0)), conv_keys.take(pa.array(tree_conv)))

    # messages of lists
    list_conv, list_item, open_convs = np.zeros(0, np.int64), np.zeros(0, np.int64), ~has_tree
    places = np.zeros(0, np.int64)
    for field in ("chat_messages", "messages"):
        owner, item = items_of(tape, np.where(open_convs, tape.decoded(tape.child(convs, field)), -1))
        at, item = tape.place[item], tape.decoded(item)
        good = tape.is_kind(item, OBJECT)
        list_conv, list_item, places = np.append(list_conv, owner[good]), np.append(list_item, item[good]), np.append(places, at[good])
        open_convs = open_convs & ~(np.bincount(owner[good], minlength=len(convs)) > 0)
    list_keys = pc.coalesce(_named(tape, list_item, "uuid"), pa.array(places).cast(pa.large_string()))

    nodes = np.append(message[order][is_message], list_item).astype(np.int64)
    of_conv = np.append(tree_conv[is_message], list_conv).astype(np.int64)
    message_keys = pa.concat_arrays([tree_keys.filter(pa.array(is_message)), list_keys])
    parents = pa.concat_arrays([tree_parents.filter(pa.array(is_message)), conv_keys.take(pa.array(list_conv))])
    content = tape.decoded(tape.child(nodes, "content"))
    nested = tape.is_kind(content, OBJECT)
    content[nested] = tape.decoded(tape.child(content[nested], "parts"))
    meta = tape.decoded(tape.child(nodes, "metadata"))
    parts = _either(tape, content, tape.decoded(tape.child(nodes, "text")))
    attachments = _either(tape, tape.decoded(tape.child(nodes, "attachments")), tape.decoded(tape.child(meta, "attachments")))

    message_ids, message_convs = ids.take(pa.array(of_conv)), conv_keys.take(pa.array(of_conv))
    out = [(ids, conv_keys, "conversation", conv_keys, ids.cast(pa.large_string())), (message_ids, message_convs, "message", message_keys, parents)]
    for kind, (of, spot), word in (("part", parts, "/parts/"), ("attachment", attachments, "/attachments/")):
        of = pa.array(of.astype(np.int64))
        holder = message_keys.take(of)
        out.append((message_ids.take(of), message_convs.take(of), kind, _joined(holder, word, pa.array(spot).cast(pa.large_string())), holder))
    names = [c.split()[0] for c in FLAT_SCHEMA.split(", ")]
    text = lambda a: a.cast(pa.string())
    table = pa.concat_tables(pa.table([i, text(c), pa.array([kind] * len(i), pa.string()), text(k), text(p)], names=names) for i, c, kind, k, p in out)
    return table.group_by(names, use_threads=False).aggregate([]).select(names)


def flatten_exports(exports: DataFrame, id_column: str = "export_id", record_column: str = "record") -> DataFrame:
    """Flat rows of every conversation, message, part and attachment, each with its parent.

    Null, blank and invalid records and records of other values yield nothing; an empty table yields no
    rows; other columns are ignored. A repeated row of one record comes once; a record delivered
    under two ids yields its rows under each. ``id_column`` must be unique for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield from flatten_batch(part.column(0), part.column(1)).to_batches()

    slim = exports.select(F.col(id_column).cast("bigint").alias("export_id"), F.col(record_column).cast("string").alias("record"))
    return slim.where(F.trim("record") != "").mapInArrow(run, FLAT_SCHEMA)
