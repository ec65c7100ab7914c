"""The command line: training lines of chosen games, datasets, previews and settings."""

import json

import pytest

from playmill import facade

from .conftest import SF


def test_lines_datasets_and_previews(spark, tmp_path, capsys):
    out = tmp_path / "sets"
    assert facade.main(["generate", SF, str(out / "few.jsonl"), "--games", "1, 2", "--n-total", "3", "--sample-size", "7"]) == 0
    lines = [r.value for r in spark.read.text(str(out / "few.jsonl")).collect()]
    assert len(lines) == 7 and all(len(json.loads(json.loads(x)["messages"][0]["content"])) <= 3 for x in lines)
    assert facade.main(["generate", SF, str(out / "again.jsonl"), "--layout", "messages", "--games", "1,2", "--n-total", "3", "--sample-size", "7"]) == 0
    assert sorted(lines) == sorted(r.value for r in spark.read.text(str(out / "again.jsonl")).collect())
    assert facade.main(["generate", SF, str(out / "other"), "--layout", "contents", "--games", "3"]) == 0
    (out / "table.csv").write_text("game_id,line\n1,a\n2,b\n3,c\n")
    got = {(r.format, r.name): (r.files, r.bytes) for r in facade.datasets(spark, str(out)).collect()}
    assert got[("csv", "table.csv")] == (1, 25) and got[("jsonl", "few.jsonl")][1] == sum(len(x.encode()) + 1 for x in lines)
    assert {n for _, n in got} == {"few.jsonl", "again.jsonl", "other", "table.csv"}
    assert [tuple(r) for r in facade.preview(spark, str(out / "table.csv"), 2).collect()] == [("1", "a"), ("2", "b")]
    for name in ("few.jsonl", "other"):
        rows = facade.preview(spark, str(out / name), samples=2, width=5).collect()
        assert len(rows) == 4 and all(r.content is not None and len(r.content) <= 8 for r in rows)
        assert len({r.role for r in rows}) == 2
    assert facade.main(["preview", str(out / "table.csv")]) == 0 and facade.main(["list-datasets", str(out)]) == 0
    assert "again.jsonl" in capsys.readouterr().out
    assert facade.main(["preview", str(out / "x.xlsx")]) == 1


def test_settings(tmp_path, capsys):
    path = str(tmp_path / "s.json")
    assert facade.settings(path) == {}
    assert facade.main(["--settings", path, "config", "--set-season", "2021-2022"]) == 0
    assert facade.main(["--settings", path, "config", "--show"]) == 0
    assert capsys.readouterr().out.splitlines() == ['{"season": "2021-2022"}'] * 2
    with pytest.raises(ValueError):
        facade.settings(path, "2021-2023")
    assert facade.main(["--settings", path, "config", "--set-season", "soon"]) == 1
    assert facade.settings(path) == {"season": "2021-2022"}
