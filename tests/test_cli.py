import json

import pytest

from threadloom import cli
from threadloom.sources import files


def test_convert_and_collect(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    talks = [{"uuid": f"u/{i}", "name": f"T{i}", "chat_messages": [{"sender": "human", "text": f"hello {i}"}]} for i in range(3)]
    (tmp_path / "in/a.json").write_text(json.dumps(talks))
    root = str(tmp_path / "out")
    assert cli.main(["convert", "--input", str(tmp_path / "in"), "--output-root", root, "--sample", "2"]) == 0
    assert cli.main(["convert", "--input", str(tmp_path / "in"), "--output-root", root, "--resume"]) == 0
    assert capsys.readouterr().out.split() == ["converted=2", "skipped=0", "rejected=0", "converted=1", "skipped=2", "rejected=0"]
    rows = files.read_index(spark, root + "/index").orderBy("line_no").collect()
    assert [(r["id"], r["md_file"], r["status"]) for r in rows] == [(f"u/{i}", f"conv_u_{i}.md", "converted") for i in range(3)]
    assert "hello 2" in (tmp_path / "out/markdown/conv_u_2.md").read_text()
    for name, route in (("conv_u_0", " a "), ("conv_u_1", "B"), ("conv_gone", "A")):
        (tmp_path / f"out/markdown/{name}.analysis.json").write_text(json.dumps({"title": "X", "route_recommendation": route, "next_steps": ["go"]}))
    (tmp_path / "out/markdown/bad.analysis.json").write_text("{")
    assert cli.main(["collect", "--input-root", root + "/markdown", "--output-dir", str(tmp_path / "a")]) == 0
    assert capsys.readouterr().out.split() == ["collected=1", "missing=1"]
    text = (tmp_path / "a/conv_u_0.md").read_text()
    assert "1. go" in text and "hello 0" in text and "（無）" in text
    (tmp_path / "in/b.json").write_text("{")
    assert cli.main(["convert", "--input", str(tmp_path / "in"), "--output-root", root, "--resume", "--force", "--sample", "0"]) == 0
    assert capsys.readouterr().out.split() == ["converted=3", "skipped=0", "rejected=1"]
    (tmp_path / "in/a.json").unlink()
    assert cli.main(["convert", "--input", str(tmp_path / "in"), "--output-root", str(tmp_path / "none")]) == 2
    with pytest.raises(SystemExit):
        cli.main(["convert", "--input", "x", "--sample", "-1"])
