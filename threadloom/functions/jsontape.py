"""JSON texts of a whole batch as arrays of nodes, found from the bytes of an Arrow buffer by array operations.

Quotes, escapes, brackets and their nesting come from masks, running sums and sorts over the bytes of all texts at once, and the grammar is checked on
neighbouring tokens, so a text that isn't valid JSON is known as such. A node is a value: its kind, its bytes, its parent, its key and its place among its
siblings. Children are ranges of a sorted parent index, as list offsets are; a field of many objects is one search.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, NUMBER, BOOL, NULL = 1, 2, 3, 4, 5, 6
_OPEN, _CLOSE, _LIST, _END, _COLON, _COMMA, _TEXT, _BARE = range(1, 9)
_SIGNS = np.zeros(256, np.uint8)
_SIGNS[[ord(c) for c in "{}[]:,"]] = (_OPEN, _CLOSE, _LIST, _END, _COLON, _COMMA)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one behind another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow array of texts."""
    lengths = ends - starts
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ranges(starts, lengths)].tobytes()))


class Tape:
    """Nodes of JSON texts; texts can be added, such as JSON text inside a string."""

    def __init__(self, names: tuple[str, ...]):
        self.names = pa.array(names, pa.large_string())
        self.code = {n: i for i, n in enumerate(names)}
        self.data = np.zeros(0, np.uint8)
        self.kind, self.start, self.end, self.parent, self.key_start, self.key_end, self.place, self.field = (np.zeros(0, np.int64) for _ in range(8))

    # -- reading ---------------------------------------------------------------------------------

    def add(self, texts: pa.Array) -> np.ndarray:
        """Read texts; the node of each one's value, -1 where it isn't valid JSON."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets_buffer, values = texts.buffers()
        offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        bad = np.zeros(len(texts), bool)
        tokens = self._tokens(data, offsets, bad)
        return self._nodes(data, *tokens, bad)

    @staticmethod
    def _tokens(data: np.ndarray, offsets: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, type, start, end) of each token of texts whose quotes pair; marks texts that can't be valid."""
        text_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
        slashes = np.flatnonzero(data == 92)
        owner = text_of(slashes)
        fresh = np.append(True, (slashes[1:] != slashes[:-1] + 1) | (owner[1:] != owner[:-1]))[: len(slashes)]
        run = np.arange(len(slashes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))
        escapes = slashes[run % 2 == 0]
        last = escapes + 1 >= offsets[text_of(escapes) + 1]
        bad[text_of(escapes[last])] = True
        escapes = escapes[~last]
        escaped = np.zeros(len(data), bool)
        escaped[escapes + 1] = True
        quotes = np.flatnonzero((data == 34) & ~escaped)
        owner = text_of(quotes)
        bad |= np.bincount(owner, minlength=len(bad)) % 2 == 1
        quotes = quotes[~bad[owner]]
        opening, closing = quotes[::2], quotes[1::2]
        step = np.zeros(len(data) + 1, np.int8)
        step[opening] += 1
        step[closing + 1] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        usable = np.repeat(~bad, np.diff(offsets))
        # strings: no control characters, only known escapes
        bad[text_of(np.flatnonzero(inside & (data < 32)))] = True
        own = escapes[inside[escapes]]
        bad[text_of(own[~_ESCAPED[data[own + 1]]])] = True
        codes = own[data[own + 1] == ord("u")]
        if len(codes):
            padded = np.append(data, np.zeros(6, np.uint8))
            bad[text_of(codes[~(_HEX[padded[codes[:, None] + np.arange(2, 6)]].all(axis=1))])] = True
        free = ~inside & usable & ~_SPACE[data]
        signs = np.flatnonzero(free & (_SIGNS[data] > 0))
        bare = free & (_SIGNS[data] == 0)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[:-1]] = True
        before = np.append(False, bare[:-1]) & ~edge[:-1]
        after = np.append(bare[1:], False) & ~edge[1:]
        first, stop = np.flatnonzero(bare & ~before), np.flatnonzero(bare & ~after) + 1
        start = np.concatenate([signs, opening, first])
        kind = np.concatenate([_SIGNS[data[signs]], np.full(len(opening), _TEXT, np.uint8), np.full(len(first), _BARE, np.uint8)])
        end = np.concatenate([signs + 1, closing + 1, stop])
        order = np.argsort(start, kind="stable")
        return text_of(start[order]), kind[order], start[order], end[order]

    def _nodes(self, data: np.ndarray, text: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, bad: np.ndarray) -> np.ndarray:
        n = len(kind)
        opens, closes = (kind == _OPEN) | (kind == _LIST), (kind == _CLOSE) | (kind == _END)
        fresh = np.append(True, text[1:] != text[:-1])[:n]
        depth = np.cumsum(opens.astype(np.int64) - closes)
        head = np.flatnonzero(fresh)
        base = np.append(0, depth)[head]
        of_text = np.cumsum(fresh) - 1
        after = depth - (base[of_text] if n else 0)
        level = np.where(opens, after - 1, after)  # a bracket and its end share their level
        bad[text[level < 0]] = True
        if n:
            tail = np.append(head[1:], n) - 1
            bad[text[tail[after[tail] != 0]]] = True
        # containers: the last opening bracket one level up
        marks = np.flatnonzero(opens)
        who = np.concatenate([np.arange(n), marks])
        lifted = np.concatenate([level, level[marks] + 1])
        marked = np.concatenate([np.zeros(n, bool), np.ones(len(marks), bool)])
        order = np.lexsort((who, lifted, text[who]))
        latest = np.maximum.accumulate(np.where(marked[order], np.arange(len(order)), -1))
        holder = np.full(n, -1)
        rows = ~marked[order]
        found = latest[rows]
        inner = lifted[order][rows] > 0
        holder[who[order][rows]] = np.where(inner & (found >= 0), who[order][np.maximum(found, 0)], -1)
        # a closing bracket ends the last opening one of its level
        both = np.flatnonzero(opens | closes)
        pairing = both[np.lexsort((both, level[both], text[both]))]
        ender = np.append(False, closes[pairing][1:] & opens[pairing][:-1] & (level[pairing][1:] == level[pairing][:-1]) & (text[pairing][1:] == text[pairing][:-1]))[: len(pairing)]
        lone = closes[pairing] & ~ender
        bad[text[pairing[lone]]] = True
        ended, opener = pairing[ender], pairing[np.flatnonzero(ender) - 1]
        bad[text[ended[kind[ended] != kind[opener] + 1]]] = True
        context = np.where(holder >= 0, kind[np.maximum(holder, 0)], 0)
        # what may follow what
        previous = np.append(0, kind[:-1])[:n]
        previous[head] = 0
        starts = opens | (kind == _TEXT) | (kind == _BARE)
        in_object, in_list, at_root = context == _OPEN, context == _LIST, context == 0
        begun = (previous == _OPEN) | (previous == _COMMA)
        key = (kind == _TEXT) & in_object & begun
        after_key = np.append(False, key[:-1])[:n]
        after_value = np.append(False, (starts & ~key)[:-1] & ~opens[:-1] | closes[:-1])[:n]
        wrong = starts & in_list & ~((previous == _LIST) | (previous == _COMMA))
        wrong |= starts & in_object & ~key & (previous != _COLON)
        wrong |= starts & at_root & (previous != 0)
        wrong |= (kind == _COLON) & ~(in_object & after_key)
        wrong |= (kind == _COMMA) & ~((in_object | in_list) & after_value)
        wrong |= (kind == _CLOSE) & ~((previous == _OPEN) | after_value)
        wrong |= (kind == _END) & ~((previous == _LIST) | after_value)
        bad[text[wrong]] = True
        present = np.zeros(len(bad), bool)
        present[text] = True
        bad |= ~present
        bare = np.flatnonzero(kind == _BARE)
        words = _cut(data, start[bare], end[bare])
        numeric = pc.match_substring_regex(words, _NUMBER).to_numpy(zero_copy_only=False)
        null, true = pc.equal(words, "null").to_numpy(zero_copy_only=False), pc.is_in(words, pa.array(["true", "false"], pa.large_string())).to_numpy(zero_copy_only=False)
        bad[text[bare[~(numeric | null | true)]]] = True

        value = np.flatnonzero(starts & ~key & ~bad[text])
        number = np.full(n, -1)
        number[value] = np.arange(len(value)) + len(self.kind)
        what = np.zeros(n, np.int64)
        what[kind == _OPEN], what[kind == _LIST], what[kind == _TEXT] = OBJECT, ARRAY, STRING
        what[bare] = np.where(numeric, NUMBER, np.where(null, NULL, BOOL))
        parent = np.where(holder[value] >= 0, number[np.maximum(holder[value], 0)], -1)
        order = np.argsort(parent, kind="stable")
        sorted_parent = parent[order]
        lead = np.append(True, sorted_parent[1:] != sorted_parent[:-1])[: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        shift, text_span = len(self.data), kind[value] == _TEXT
        has_key = in_object[value]
        named = np.where(has_key, value - 2, 0)
        key_start, key_end = np.where(has_key, start[named] + 1 + shift, -1), np.where(has_key, end[named] - 1 + shift, -1)
        self.data = np.concatenate([self.data, data])
        fields = np.full(len(value), -1)
        fields[has_key] = pc.index_in(self._texts(key_start[has_key], key_end[has_key]), value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        extend = lambda old, new: np.concatenate([old, new.astype(np.int64)])
        self.kind, self.parent, self.place, self.field = extend(self.kind, what[value]), extend(self.parent, parent), extend(self.place, place), extend(self.field, fields)
        self.start, self.end = extend(self.start, start[value] + text_span + shift), extend(self.end, end[value] - text_span + shift)
        self.key_start, self.key_end = extend(self.key_start, key_start), extend(self.key_end, key_end)
        self.by_parent = np.argsort(self.parent, kind="stable")
        self.parents = self.parent[self.by_parent]
        known = np.flatnonzero(self.field >= 0)
        place_of = self.parent[known] * len(self.names) + self.field[known]
        order = np.argsort(place_of, kind="stable")
        self.spots, self.holders = place_of[order], known[order]
        roots = np.full(len(bad), -1)
        top = value[holder[value] < 0]
        roots[text[top]] = number[top]
        return roots

    # -- asking ----------------------------------------------------------------------------------

    def is_kind(self, nodes: np.ndarray, *kinds: int) -> np.ndarray:
        return (nodes >= 0) & np.isin(self.kind[np.maximum(nodes, 0)], kinds) if len(self.kind) else np.zeros(len(nodes), bool)

    def _texts(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Strings without their escapes; those with any are read in one go."""
        out = _cut(self.data, starts, ends)
        odd = np.flatnonzero(pc.match_substring(out, "\\").to_numpy(zero_copy_only=False)) if len(out) else np.zeros(0, np.int64)
        if len(odd):
            plain = json.loads('["' + '","'.join(out.take(pa.array(odd)).to_pylist()) + '"]')
            mask = np.zeros(len(out), bool)
            mask[odd] = True
            clean = pa.array([x.encode("utf-8", "replace") for x in plain], pa.large_binary()).cast(pa.large_string())
            out = pc.replace_with_mask(out, pa.array(mask), clean)
        return out

    def texts(self, nodes: np.ndarray) -> pa.Array:
        """What strings and numbers say; null for any other node."""
        out = self._texts(np.where(nodes >= 0, self.start[np.maximum(nodes, 0)], 0) if len(self.start) else np.zeros(len(nodes), np.int64), np.where(nodes >= 0, self.end[np.maximum(nodes, 0)], 0) if len(self.end) else np.zeros(len(nodes), np.int64))
        return pc.if_else(pa.array(self.is_kind(nodes, STRING, NUMBER)), out, pa.scalar(None, pa.large_string()))

    def raw(self, nodes: np.ndarray) -> pa.Array:
        """The bytes of nodes as they are written, strings without their quotes; objects and lists have only their bracket's; empty for -1."""
        known = nodes >= 0
        at = np.maximum(nodes, 0)
        zero = np.zeros(len(nodes), np.int64)
        return _cut(self.data, np.where(known, self.start[at], 0), np.where(known, self.end[at], 0)) if len(self.start) else _cut(self.data, zero, zero)

    def keys(self, nodes: np.ndarray) -> pa.Array:
        return self._texts(self.key_start[nodes], self.key_end[nodes])

    def child(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """The value of a field of each object, the last one where it repeats; -1 where there is none."""
        if not len(self.kind) or not len(self.spots):
            return np.full(len(nodes), -1)
        wanted = np.where(self.is_kind(nodes, OBJECT), nodes * len(self.names) + self.code[name], -1)
        at = np.searchsorted(self.spots, wanted, side="right") - 1
        return np.where((at >= 0) & (wanted >= 0) & (self.spots[np.maximum(at, 0)] == wanted), self.holders[np.maximum(at, 0)], -1)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the parent in ``nodes``, child) of all children of the nodes, in order."""
        if not len(self.kind):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = np.where(nodes >= 0, nodes, len(self.kind))
        first, stop = np.searchsorted(self.parents, wanted, side="left"), np.searchsorted(self.parents, wanted, side="right")
        return np.repeat(np.arange(len(nodes)), stop - first), self.by_parent[ranges(first, stop - first)]

    def decoded(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes, strings that are JSON text of an object, a list or such a text again read as that, however often."""
        nodes, left = nodes.copy(), np.arange(len(nodes))
        while len(left := left[self.is_kind(nodes[left], STRING)]):
            texts = self.texts(nodes[left])
            left = left[pc.match_substring_regex(texts, r'^\s*[{\["]').to_numpy(zero_copy_only=False)]
            if not len(left):
                break
            roots = self.add(self.texts(nodes[left]))
            good = self.is_kind(roots, OBJECT, ARRAY, STRING)
            nodes[left[good]] = roots[good]
            left = left[good]
        return nodes
