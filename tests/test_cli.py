from tessella import cli
from tests import fixtures as X


def test_docs(spark, tmp_path, capsys):
    for path, content in X.DOCS:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content, newline="")
    (tmp_path / "docs" / "AGENTS.md").write_text("no front matter, but not looked at")
    assert cli.main(["docs", str(tmp_path / "docs")], spark) == 1
    said = capsys.readouterr().out
    assert f"{len(X.FRONT_MATTER_ERRORS) + len(X.MISSING_SECTIONS) + len(X.BROKEN_LINKS)} error(s)" in said and "sub/gone.md" in said
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.md").write_text("---\nname: a\ntype: index\ndescription: d\n---\n[a](a.md)\n")
    assert cli.main(["docs", str(good)], spark) == 0


def test_sniff_and_fix(spark, tmp_path, capsys):
    name = tmp_path / "lib" / "calls.php"
    name.parent.mkdir()
    name.write_text(X.SOURCES["lib/calls.php"][0])
    assert cli.main(["sniff", str(tmp_path / "lib")], spark) == 1
    assert "GlobalCalls: 5" in capsys.readouterr().out
    assert cli.main(["fix", str(tmp_path / "lib"), "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).head().content == X.FIXED["lib/calls.php"]


def test_init(spark, tmp_path):
    source, target = tmp_path / "a", tmp_path / "b"
    (source / "d").mkdir(parents=True)
    (source / "d" / "x.md").write_text("new")
    (source / "conf.yaml").write_text("new")
    assert cli.initialise(spark, str(source), str(target)) == {"copy": 2, "update": 0, "skip": 0}
    (target / "d" / "x.md").write_text("old")
    (target / "conf.yaml").write_text("old")
    assert cli.initialise(spark, str(source), str(target)) == {"copy": 0, "update": 0, "skip": 2}
    assert cli.initialise(spark, str(source), str(target), True, ("conf.yaml",), "var/") == {"copy": 0, "update": 1, "skip": 1}
    assert (target / "d" / "x.md").read_text() == "new" and (target / "conf.yaml").read_text() == "old"
    assert (target / ".gitignore").read_text() == "var/\n"
