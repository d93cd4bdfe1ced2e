import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.functions.jsontape import ARRAY, BOOL, NULL, NUMBER, OBJECT, STRING, Tape
from threadloom.operators.nested import flatten_batch, flatten_exports


def _refuse(word: str) -> None:
    raise ValueError(word)


def decoded(value: object) -> object:
    """A value, or what it encodes where it is JSON text of an object, a list or such a text again, however often: each round shortens it."""
    while True:
        if not isinstance(value, str) or value.lstrip()[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = json.loads(value, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner


def record_of(text: str | None) -> object:
    """The value of a record, None where it isn't valid JSON."""
    try:
        return decoded(json.loads(text, parse_constant=_refuse)) if text else None
    except (ValueError, RecursionError):
        return None


def conversations_of(value: object) -> list[tuple[int, dict]]:
    """(position, conversation) of each conversation object in a record."""
    if isinstance(value, dict):
        many = decoded(value.get("conversations"))
        if not isinstance(many, list):
            return [(0, value)]
        value = many
    if not isinstance(value, list):
        return []
    return [(i, c) for i, c in ((i, decoded(x)) for i, x in enumerate(value)) if isinstance(c, dict)]


def named(holder: dict, *names: str) -> str | None:
    """The first of the fields that isn't blank, as text."""
    for name in names:
        value = holder.get(name)
        if isinstance(value, bool) or value is None or isinstance(value, (dict, list)):
            continue
        if str(value).strip():
            return str(value)
    return None


def entries_of(conversation: dict) -> list[tuple[str, str | None, dict | None]]:
    """(key, key of the entry above, message or None) of each entry; only the mapping form has entries above."""
    mapping = decoded(conversation.get("mapping"))
    if isinstance(mapping, dict) and mapping:
        out = []
        for key, entry in mapping.items():
            entry = decoded(entry)
            message = decoded(entry.get("message")) if isinstance(entry, dict) else None
            above = entry.get("parent") if isinstance(entry, dict) else None
            out.append((key, above if isinstance(above, str) else None, message if isinstance(message, dict) else None))
        return out
    for field in ("chat_messages", "messages"):
        items = decoded(conversation.get(field))
        if isinstance(items, list):
            found = [(i, m) for i, m in ((i, decoded(x)) for i, x in enumerate(items)) if isinstance(m, dict)]
            if found:
                return [(named(m, "uuid") or str(i), None, m) for i, m in found]
    return []


def positions(values: object) -> list[int]:
    return [i for i, v in enumerate(values) if v is not None] if isinstance(values, list) else []


def parts_of(message: dict) -> list[int]:
    content = decoded(message.get("content"))
    if isinstance(content, dict):
        content = decoded(content.get("parts"))
    return positions(content) or positions(decoded(message.get("text")))


def attachments_of(message: dict) -> list[int]:
    found = positions(decoded(message.get("attachments")))
    metadata = decoded(message.get("metadata"))
    return found or (positions(decoded(metadata.get("attachments"))) if isinstance(metadata, dict) else [])


def flat(*records):
    table = flatten_batch(pa.array(range(1, len(records) + 1), pa.int64()), pa.array(records, pa.string()))
    return set(map(tuple, table.to_pylist() and [r.values() for r in table.to_pylist()]))


def slow(*records):
    """The same rows by walking each record."""
    out = set()
    for number, text in enumerate(records, 1):
        for position, c in conversations_of(record_of(text)):
            key = named(c, "id", "conversation_id", "uuid") or f"{number}:{position}"
            out.add((number, key, "conversation", key, str(number)))
            entries = entries_of(c)
            by_key = {k: (above, m) for k, above, m in entries}
            for k, above, m in entries:
                if m is None:
                    continue
                seen = set()
                while above in by_key and above not in seen and by_key[above][1] is None:
                    seen.add(above)
                    above = by_key[above][0]
                parent = above if above in by_key and above not in seen else key
                out.add((number, key, "message", k, parent))
                for i in parts_of(m):
                    out.add((number, key, "part", f"{k}/parts/{i}", k))
                for i in attachments_of(m):
                    out.add((number, key, "attachment", f"{k}/attachments/{i}", k))
    return out


TREE = {"id": " ", "conversation_id": "c1", "mapping": {
    "r": {"parent": None, "message": None}, "a": {"parent": "r", "message": {"content": {"parts": ["x", None, {"y": 1}]}}},
    "n": {"parent": "a", "message": None}, "b": {"parent": "n", "message": {"content": None, "metadata": {"attachments": [{}, {}]}}},
    "q": {"parent": "p", "message": None}, "p": {"parent": "q", "message": None}, "z": {"parent": "q", "message": {"text": "t"}}, "l": {"parent": "gone", "message": {}},
}}


def test_tree():
    rows = flat(json.dumps(TREE))
    assert rows == slow(json.dumps(TREE))
    assert (1, "c1", "message", "b", "a") in rows and (1, "c1", "message", "z", "c1") in rows and (1, "c1", "message", "l", "c1") in rows
    assert (1, "c1", "part", "a/parts/2", "a") in rows and (1, "c1", "attachment", "b/attachments/1", "b") in rows


def test_lists_and_encodings():
    listed = {"uuid": "u", "chat_messages": json.dumps([None, {"uuid": "", "text": [{"t": 1}, None, 3]}, {"uuid": "m", "content": [1], "attachments": [{}]}])}
    rows = flat(json.dumps(json.dumps([listed, None, {"messages": [{"content": "x"}]}])))
    assert (1, "u", "message", "1", "u") in rows and (1, "u", "part", "1/parts/2", "1") in rows and (1, "u", "attachment", "m/attachments/0", "m") in rows
    assert (1, "1:2", "conversation", "1:2", "1") in rows and (1, "1:2", "message", "0", "1:2") in rows


def test_many_encodings():
    text = json.dumps({"id": "c", "messages": []})
    for _ in range(11):
        text = json.dumps(text)
    assert flat(text) == {(1, "c", "conversation", "c", "1")}


def test_nothing():
    assert flat("", "{}x", "nope", "null", '{"a": NaN}', "3", "[]") == set()
    assert flat(None) == set()
    assert decoded("[1") == "[1"


json_values = st.recursive(st.none() | st.integers(0, 3) | st.sampled_from(["", " ", "a", "b", "[1]"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["parts", "text", "content"]), x, max_size=2), max_leaves=5)
messages = st.none() | st.fixed_dictionaries({}, optional={"content": json_values, "text": json_values, "attachments": json_values, "uuid": st.sampled_from(["", "u", None]), "metadata": st.fixed_dictionaries({}, optional={"attachments": json_values})})
nodes = st.dictionaries(st.sampled_from("abcd"), st.fixed_dictionaries({}, optional={"parent": st.sampled_from(["a", "b", "c", "x", None]), "message": messages}), max_size=4)
records = st.fixed_dictionaries({}, optional={"id": st.sampled_from(["", "i", None]), "mapping": nodes | st.none(), "chat_messages": st.lists(messages, max_size=3), "messages": st.lists(messages, max_size=3)})


@settings(max_examples=150, deadline=None)
@given(st.lists(records | st.lists(records, max_size=2), max_size=3))
def test_against_walking(values):
    texts = [json.dumps(v) for v in values]
    assert flat(*texts) == slow(*texts)


def value_of(tape, node):
    """A node as a Python value, by walking."""
    kind = tape.kind[node]
    if kind in (OBJECT, ARRAY):
        _, below = tape.children(np.array([node]))
        values = [value_of(tape, x) for x in below]
        return dict(zip(tape.keys(below).to_pylist(), values)) if kind == OBJECT else values
    if kind == STRING:
        return tape.texts(np.array([node]))[0].as_py()
    return {NULL: None, BOOL: bytes(tape.data[tape.start[node] : tape.end[node]]) == b"true"}.get(kind) if kind != NUMBER else json.loads(tape.texts(np.array([node]))[0].as_py())


def shown(value):
    """Half a surrogate pair, which no text can hold, as a question mark."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    return [shown(x) for x in value] if isinstance(value, list) else {shown(k): shown(x) for k, x in value.items()} if isinstance(value, dict) else value


def strict(text):
    def refuse(_):
        raise ValueError

    try:
        return True, json.loads(text, parse_constant=refuse)
    except ValueError:
        return False, None


anything = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=12)
broken = st.text(st.sampled_from('{}[]:,"\\ \n01-.eE+trufalsn\t\x01é'), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.builds(json.dumps, anything) | st.builds(lambda v: json.dumps(v, ensure_ascii=False, indent=1), anything) | broken, max_size=6), st.data())
def test_reader_agrees_with_the_library(texts, data):
    if texts and data.draw(st.booleans()):
        cut = data.draw(st.integers(0, len(texts[0])))
        texts[0] = texts[0][:cut] + data.draw(st.sampled_from(['', '"', ",", "}", "]", "\\", "1", ":"])) + texts[0][cut + data.draw(st.integers(0, 2)) :]
    tape = Tape(("a", "b"))
    tape.add(pa.array(['{"x": [1, "y"]}']))
    roots = tape.add(pa.array(texts, pa.string()))
    for text, root in zip(texts, roots):
        good, value = strict(text)
        assert (root >= 0) == good, text
        if good:
            assert value_of(tape, root) == shown(value), text


def test_repeated_keys_and_long_records():
    twice = '{"id": "x", "id": "c", "mapping": {"a": {"message": {"content": {"parts": [1]}}}, "a": {"message": {"text": [1, 2]}}}}'
    assert flat(twice) == slow(twice) == {(1, "c", k, a, b) for k, a, b in (("conversation", "c", "1"), ("message", "a", "c"), ("part", "a/parts/0", "a"), ("part", "a/parts/1", "a"))}
    deep = {"id": "d", "mapping": {f"n{i}": {"parent": f"n{i - 1}", "message": {} if i % 50 == 0 else None} for i in range(3000)}}
    assert flat(json.dumps(deep), twice[:-1], json.dumps(deep)) == slow(json.dumps(deep), twice[:-1], json.dumps(deep))


def test_operator(spark):
    frame = spark.createDataFrame([(7, json.dumps(TREE), "x"), (8, None, "y"), (9, " ", "z")], "export_id long, record string, kind string")
    rows = flatten_exports(frame).collect()
    assert {r["export_id"] for r in rows} == {7} and len(rows) == len(set(rows))
    assert flatten_exports(frame.limit(0)).count() == 0
