import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from threadloom.functions.textfns import has_visible, strip
from threadloom.operators import index, markers, normalize, render
from threadloom.sources import analyzers, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", " a ", " 　x ", "\x1c y \x1f", "​ z"])
def test_strip_is_pythons(spark, text):
    assert one(spark, strip(F.lit(text))) == text.strip()


@pytest.mark.parametrize("text, seen", [(None, False), ("", False), (" \n ", False), ("​﻿", False), ("ㅤ", False), (".", True), ("字", True), ("🙂", True)])
def test_visible(spark, text, seen):
    assert one(spark, has_visible(F.lit(text).cast("string"))) is seen


def test_render(spark):
    schema = "id string, source string, title string, created_at string, updated_at string, messages array<struct<role:string,content:string,timestamp:string>>"
    frame = spark.createDataFrame([("a/b", "s", None, "t", None, [("user", "hi", None), (None, None, "2")]), ("c", "s", "T", None, None, None)], schema)
    text = render.markdown(*(F.col(c) for c in ("id", "source", "title", "created_at", "updated_at", "messages")))
    rows = frame.select(text.alias("m"), render.transcript(F.col("messages"), 12).alias("t"), render.safe_id(F.col("id")).alias("s")).collect()
    assert rows[0]["m"] == "# \n\n- id: a/b\n- source: s\n- created_at: t\n- updated_at: \n- message_count: 2\n\n---\n\n## Message 1\n\n**user:**\n**time:** \n\nhi\n\n## Message 2\n\n**None:**\n**time:** 2\n"
    assert rows[0]["t"] == "[user] hi\n\n[" and rows[0]["s"] == "a_b" and rows[1]["t"] == "" and "message_count: 0" in rows[1]["m"]
    assert one(spark, render.safe_id(F.lit("é" * 100))) == "_" * 80
    assert one(spark, render.without_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, render.without_fences(F.lit("plain"))) == "plain"
    assert one(spark, render.numbered_list(F.array(F.lit("x"), F.lit("y")))) == "1. x\n2. y"


def test_markers(spark, tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"Common": {"K": [" A ", "", 3, "b"]}, "en": {"k": ["a", "c"]}, "zh": {"k": ["字"]}, "bad": 1}))
    lexicon = markers.load_lexicon(str(path))
    assert markers.marker_set("multi", lexicon, ["k"]) == {"k": ["a", "b", "c", "字"]} and markers.marker_set("zh", lexicon, ["k"]) == {"k": ["a", "b", "字"]}
    assert markers.load_lexicon(None) == markers.load_lexicon("/nope") == {}
    assert one(spark, markers.strength(F.lit("A car：7"), ["a", "c", "x"])) == 4 and one(spark, markers.strength(F.lit(None).cast("string"), ["a"])) == 0
    assert one(spark, markers.mixed(F.lit("not ready"), ["ready"], ["not ready"])) is True
    assert one(spark, markers.clean_list(F.array(F.lit(" a "), F.lit(" "), F.lit(None).cast("string"), F.lit("b"), F.lit("c")), 2)) == ["a", "b"]
    assert one(spark, markers.clean_list(F.lit(None).cast("array<string>"), 2)) == []


def test_index(spark, tmp_path):
    row = {c: None for c in index.COLUMNS}
    rows = [(1, {**row, "id": "a", "title": "old"}), (2, {**row, "id": "b", "title": 'q"x\ny'}), (3, {**row, "id": " a ", "title": "new", "status": "ok"}), (4, {**row, "id": " "}), (5, row)]
    schema = "line_no long, " + ", ".join(f"{c} string" for c in index.COLUMNS)
    frame = spark.createDataFrame([(n, *r.values()) for n, r in rows], schema)
    got = {r["id"]: (r["position"], r["title"], r["status"]) for r in index.upsert(frame, "line_no").collect()}
    assert got == {"a": (1, "new", "ok"), "b": (2, 'q"x\ny', "")}
    files.write_index(index.upsert(frame, "line_no"), str(tmp_path / "index"))
    again = files.read_index(spark, str(tmp_path / "index"))
    assert sorted((r["id"], r["title"]) for r in again.collect()) == [("a", "new"), ("b", 'q"x\ny')]
    jobs = spark.createDataFrame([("a",), ("c",)], "id string")
    assert [r["id"] for r in index.pending(jobs, index.upsert(frame, "line_no")).collect()] == ["c"]
    assert [r["id"] for r in index.finished(jobs, index.upsert(frame, "line_no")).collect()] == ["a"]
    assert index.upsert(frame.limit(0), "line_no").count() == 0


def test_stats(spark):
    frame = spark.createDataFrame([("ok", " a "), ("ok", "B"), ("failed", "A"), (None, None)], "status string, route_recommendation string")
    jobs, done = spark.createDataFrame([("a",), ("b",), (None,)], "id string"), spark.createDataFrame([("b",), ("b",), ("z",)], "id string")
    line = index.stats_line(index.conversion_stats(jobs, done), index.run_stats(frame)).first()["line"]
    assert line == "Run stats: total=3 converted=2 skipped=1 analysis_ok=2 analysis_failed=1 routes[A=1, B=1, C=0, D=0]"


def test_normalize(spark):
    tree = {"title": None, "create_time": 1.5, "mapping": {"x": {"message": {"create_time": 9, "content": {"parts": ["late", 3]}}}, "y": {"message": {"create_time": 2, "author": {"role": "user"}, "content": {"parts": [" early "]}}}, "z": {"message": None}, "w": {"message": {"content": {"parts": [" "]}}}}}
    listed = {"uuid": "u", "name": "N", "created_at": "2024", "chat_messages": [{"sender": "human", "text": "", "content": [{"text": "a"}, {"text": None}, "b"]}, {"text": " "}, 4]}
    frame = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps([listed])), (3, "{"), (4, '{"a": 1}'), (5, None)], "export_id long, record string")
    rows = {r["export_id"]: r for r in normalize.normalize_exports(frame).collect()}
    assert set(rows) == {1, 2}
    assert [(m["role"], m["content"], m["timestamp"]) for m in rows[1]["messages"]] == [("user", "early", "1970-01-01T00:00:02+00:00"), ("unknown", "late", "1970-01-01T00:00:09+00:00")]
    assert rows[1]["title"] == "Untitled" and rows[1]["created_at"] == "1970-01-01T00:00:01.500000+00:00" and len(rows[1]["id"]) == 12
    assert rows[2]["id"] == "u" and rows[2]["messages"][0]["content"] == "a\n\nb" and len(rows[2]["messages"]) == 1


def test_files(spark, tmp_path):
    texts = spark.createDataFrame([("a.md", "x\ny"), ("b.md", ""), ("c.txt", "z")], "file_name string, content string")
    files.write_named_texts(texts, str(tmp_path / "out"))
    assert {r["file_name"]: r["content"] for r in files.read_named_texts(spark, str(tmp_path / "out"), "*.md").collect()}["a.md"] == "x\ny"
    records = spark.createDataFrame([("a", '{"route": "A"}'), ("b", "{")], "file_name string, content string")
    assert [r["record"]["route"] for r in files.parsed_records(records, "route string").collect()] == ["A"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.json").write_text("[]")
    assert files.read_exports(spark, str(tmp_path / "in")).first()["record"] == "[]"


def test_analyzers(spark):
    def ask(prompt):
        if prompt == "fatal":
            from threadloom.sources.analyzers import Fatal

            raise Fatal("401")
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    jobs = spark.createDataFrame([("1", "x"), ("2", "bad"), ("3", "fatal")], "id string, prompt string")
    rows = {r["id"]: r for r in analyzers.called(jobs, ask, retries=1, pause=0).collect()}
    assert rows["1"]["response"] == "X" and rows["2"]["error"] == "no" and rows["3"]["status"] == "failed"
    known = spark.createDataFrame([("1", "r")], "id string, response string")
    assert {r["id"]: r["status"] for r in analyzers.replayed(jobs, known).collect()} == {"1": "ok", "2": "failed", "3": "failed"}


def test_stream_ingest(spark, tmp_path):
    from threadloom.streaming.ingest import ingest_exports

    frame = spark.createDataFrame([(1, '{"uuid": "u", "chat_messages": [{"text": "a"}]}')], "export_id long, record string")
    frame.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest_exports(spark, str(tmp_path / "in"), "export_id long, record string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_core_stands_without_llm():
    code = "import sys; sys.modules['threadloom.llm'] = None; import threadloom.plans.core, threadloom.streaming.ingest, threadloom.sources.files"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["place", "record_key", "utc_text"]


@pytest.mark.parametrize("name", ["conv_markdown", "transcripts", "index_current", "residual_strength", "verdict_markers", "record_faults", "clean_lists", "grade_a_reports", "run_stats", "conversation_sizes"])
def test_oracle(spark, small, name):
    import os

    import duckdb

    from threadloom.plans import core

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    got = core.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    expected = con.execute(core.SQL[name]).fetchdf()[columns]
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    other = [tuple(x) for x in expected.astype(object).where(expected.notna(), None).values.tolist()]
    assert sorted(rows, key=repr) == sorted(other, key=repr)


def test_steps_prompts_and_files(spark):
    steps = spark.createDataFrame([(1, ["No action needed", " N/A "]), (2, ["none", "Send it"]), (3, []), (4, None), (5, [None])], "n int, steps array<string>")
    assert {r["n"]: r["x"] for r in steps.select("n", markers.has_actions(F.col("steps"), ["no action", "none", "n/a"]).alias("x")).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    talk = spark.createDataFrame([("t", [("user", "hi", None)]), (None, None)], "title string, messages array<struct<role:string,content:string,timestamp:string>>")
    asked = [r["p"] for r in talk.select(render.prompts(F.col("title"), F.col("messages"), "salvage").alias("p")).collect()]
    assert asked[0]["user"] == "Title: t\n\n[user] hi" and asked[1]["user"] == "Title: \n\n" and "next_steps" in asked[0]["system"]
    record = spark.createDataFrame([("a/b", "é", None, ["x"])], "id string, topic string, verdict string, next_steps array<string>")
    file = files.analysis_files(record).first()
    assert file["file_name"] == "conv_a_b.analysis.json" and json.loads(file["content"]) == {"topic": "é", "verdict": None, "next_steps": ["x"]} and "é" in file["content"] and "\n" in file["content"]
    found = files.in_name_order(spark.createDataFrame([("b", "1"), ("a", "x{")], "file_name string, content string"))
    assert [r["file_name"] for r in found.collect()] == ["a", "b"] and [r["file_name"] for r in files.rejected_records(found).collect()] == ["a"]


def test_second_look_in_reports(spark):
    frame = spark.createDataFrame([("B", "A", "true", "high", "more facts"), ("A", "A", "false", "low", "none"), (None, "A", None, None, None)], "initial string, final string, applied string, confidence string, reason string")
    lit = lambda x: F.lit(x).cast("string")
    text = render.merged_report(lit("t"), lit("A"), lit("v"), lit(None), F.array(), F.array(), lit("body"), *(F.col(c) for c in frame.columns))
    one, two, three = (r["x"] for r in frame.select(text.alias("x")).collect())
    assert "| initial route | B |" in one and "final route" not in one and "| second look | applied, confidence high |\n| reason | more facts |" in one
    assert two == three and "initial" not in two and "second look" not in two


def test_model_interfaces(monkeypatch):
    chat, plain = analyzers.request_body("chat", "m", "be brief", "hi"), analyzers.request_body("messages", "m", "be brief", "hi")
    assert [m["role"] for m in chat["messages"]] == ["system", "user"] and chat["temperature"] == plain["temperature"] == 0 and plain["system"] == "be brief" and plain["max_tokens"] == 4096
    assert analyzers.reply_object("chat", {"choices": [{"message": {"content": '```json\n{"a": 1}\n```'}}]}) == {"a": 1}
    assert analyzers.reply_object("messages", {"content": [{"type": "text", "text": '{"a": '}, {"type": "other"}, {"type": "text", "text": "2}"}]}) == {"a": 2}
    for bad in ({}, {"choices": []}, {"choices": [{"message": {"content": "[1]"}}]}, {"choices": [{"message": {"content": None}}]}):
        with pytest.raises(ValueError):
            analyzers.reply_object("chat", bad)
    with pytest.raises(ValueError):
        analyzers.http_analyzer("fax", "http://x", "m", "s", "KEY")
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(analyzers.Fatal):
        analyzers.http_analyzer("chat", "http://x", "m", "s", "NO_SUCH_KEY")("hi")


def test_replies_over_http(monkeypatch):
    """A server on this machine: an answer, a refused key, and a wish for a pause."""
    import http.server
    import threading

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked = body["messages"][-1]["content"]
            code = {"bad": 401, "busy": 429}.get(asked, 200)
            self.send_response(code)
            self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(json.dumps({"content": [{"type": "text", "text": json.dumps({"key": self.headers["x-api-key"], "asked": asked})}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "k")
    ask = analyzers.http_analyzer("messages", f"http://127.0.0.1:{server.server_port}/", "m", "s", "SOME_KEY")
    assert json.loads(ask("hi")) == {"key": "k", "asked": "hi"}
    with pytest.raises(analyzers.Fatal):
        ask("bad")
    with pytest.raises(analyzers.Busy) as busy:
        ask("busy")
    assert busy.value.seconds == 7
    server.shutdown()


def test_rejects(spark):
    frame = spark.createDataFrame([(1, None), (2, " "), (3, "{x"), (4, "[]"), (5, "null"), (6, '{"a": 1}'), (7, '{"uuid": "u"}'), (7, "3")], "export_id long, record string")
    assert sorted((r["export_id"], r["reason"]) for r in normalize.rejected_exports(frame).collect()) == [(1, "blank"), (2, "blank"), (3, "invalid"), (4, "unknown"), (5, "unknown"), (6, "unknown"), (7, "unknown")]
