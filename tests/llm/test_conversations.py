import datetime as dt
import os
import time

import pytest

from threadloom.llm import conversations as c

SCHEMA = "row_id long, conversation_id string, account_key string, role string, content string, timestamp string, ingested_at timestamp, extra string"


def rows_of(spec):
    """(conversation, role, content, minute) with ids by position; minute None states no time."""
    out = []
    for i, (conv, role, content, minute) in enumerate(spec, 1):
        stamp = None if minute is None else f"2024-05-06T07:{minute:02d}:00Z" if isinstance(minute, int) else minute
        out.append((i, conv, "a", role, content, stamp, dt.datetime(2024, 5, 6) + dt.timedelta(hours=3 * i), "x"))
    return out


SPEC = [
    ("k", "assistant", "hello", 2), ("k", " USER ", "hi", 1), ("k", "human", " hi\n", "2024-05-06 09:01:00"), ("k", "system", "s", 0), ("k", "tool", " ", 3),  # kept: 4, 2, 1
    ("e", "system", "s", 1), ("e", "user", "​", 2), ("e", None, None, 3),  # empty
    ("b1", "user", "q", 1), ("b1", None, "a", 2), ("b2", "user", "q", None), ("b3", "bot", "a", 1), ("b4", "user", "q", 1), ("b4", "ai", "a", 2), ("b4", "model", "b", 3),
    ("m", "user", "q", 1), ("m", "user", "r", 2), ("m", "assistant", "a", 3), ("n", "user", "q", 1), ("n", "assistant", " ", 2),
    (None, "user", "lost", 1), ("other", "user", "x", 1),
]
EXPECTED = {"k": ("kept", "4,2,1"), "e": ("empty", ""), "b1": ("broken", ""), "b2": ("broken", ""), "b3": ("broken", ""), "b4": ("broken", ""), "m": ("missing_reply", ""), "n": ("missing_reply", ""), "silent": ("empty", "")}


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([("a", "Europe/Berlin", "dmy")], "account_key string, zone string, date_order string")


def run(spark, accounts, tmp_path, parts, **settings):
    path = str(tmp_path / "messages.parquet")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken in order of their time
    results = c.rebuild_all(spark, path, accounts, **settings)
    chats = spark.createDataFrame([(k,) for k in [*EXPECTED, "k", None]], "id string")
    return results, {r["conversation_id"]: (r["outcome"], r["turn_rows"]) for r in c.outcomes(results, chats).collect()}


def test_outcomes(spark, accounts, tmp_path):
    results, got = run(spark, accounts, tmp_path, [rows_of(SPEC)])
    assert got == EXPECTED
    pairs = {r["conversation_id"]: list(zip(r["prompts"], r["replies"])) for r in results.collect()}
    assert pairs["k"] == [(2, 1)] and pairs["m"] == [(17, 18)] and pairs["n"] == [(19, 20)] and pairs["b4"] == []


def test_late_rows_reopen_a_conversation(spark, accounts, tmp_path):
    """Batches of one file in order of arrival, idle after an hour: a conversation is emitted and comes again with its late rows."""
    late = rows_of(SPEC)
    order = late[::2] + late[1::2]  # each conversation arrives in two parts, hours apart
    rows = [(*r[:6], s[6], r[7]) for r, s in zip(order, late)]
    parts = [rows[i : i + 6] for i in range(0, len(rows), 6)]
    _, got = run(spark, accounts, tmp_path, parts, max_files=1, idle_hours=1)
    assert got == EXPECTED


def test_single_file_and_empty(spark, accounts, tmp_path):
    _, got = run(spark, accounts, tmp_path, [[]])
    assert set(got.values()) == {("empty", "")}
    spark.createDataFrame(rows_of(SPEC), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    file = next(str(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.endswith(".parquet"))
    assert c.rebuild_all(spark, file, accounts).where("conversation_id = 'k'").first()["turn_rows"] == "4,2,1"


def test_any_order_of_files(spark, accounts, tmp_path):
    """In one, three and twenty batches, forwards and backwards, with a state that forgets after an hour: the audit recomputes what came too late."""
    rows = rows_of(SPEC)
    for name, parts, files in (("one", [rows], None), ("three", [rows[::3], rows[1::3], rows[2::3]], 1), ("back", [[r] for r in reversed(rows)][:20] + [rows[:-20]], 1)):
        (tmp_path / name).mkdir()
        _, got = run(spark, accounts, tmp_path / name, parts, max_files=files, idle_hours=1, keep_days=1 / 24, delay="1 minute")
        assert got == EXPECTED, name


def test_giant_conversations_stay_out_of_the_state(spark, accounts, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "GIANT_ROWS", 3)
    _, got = run(spark, accounts, tmp_path, [rows_of(SPEC)])
    assert got == EXPECTED


def test_windows_agree_with_the_stream(spark, accounts, tmp_path):
    """Random conversations: the windows of the audit and the stream give the same."""
    import random

    r = random.Random(3)
    spec = [(f"c{r.randint(0, 60)}", r.choice(("user", "assistant", "assistant", "user", "system", "tool", "?")) if r.random() < 0.9 else "bot", r.choice(("a", "b", " a ", " ", None)), r.choice((*range(40), None)) if r.random() < 0.97 else "x") for _ in range(500)]
    results, _ = run(spark, accounts, tmp_path, [rows_of(spec)])
    table = spark.read.parquet(str(tmp_path / "messages.parquet"))
    again = c.recomputed(c.slim_rows(table, accounts))
    order = ["conversation_id", "outcome", "turn_rows", "prompts", "replies"]
    assert sorted(map(tuple, results.select(order).collect())) == sorted(map(tuple, again.select(order).collect()))
