"""The command line, on a small store."""

from hitweave.cli import main


def test_session(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha beta\n\nsecond paragraph with gamma")
    (tmp_path / "in" / "b.json").write_text('{"id": "k1", "title": "alpha title"}\n{"id": "k2", "title": "other"}')
    store = str(tmp_path / "store")

    def run(*args):
        code = main(list(args), spark)
        return code, capsys.readouterr().out.strip().splitlines()

    assert run("index", store, str(tmp_path / "in"))[1] == ["3 records"]
    assert sorted(run("search", store, "alpha", "--style", "terse")[1]) == ["a.txt#0", "k1"]
    assert run("search", store, "title/alpha", "--style", "terse")[1] == ["k1"]
    assert run("search", store, "alpha beta", "--smart", "--style", "terse")[1] == ["a.txt#0"]
    assert run("search", store, "alpha AND", "--rpn")[0] == 1
    assert run("scan", store, "al")[1] == ["alpha\t2"]
    run("delete", store, "k1")
    assert run("search", store, "alpha", "--style", "terse")[1] == ["a.txt#0"]
    run("delete", store, "k1", "--undelete")
    assert len(run("search", store, "alpha")[1]) == 2
    run("delete", store, "k2")
    assert run("compact", store, str(tmp_path / "new"))[1] == ["2 records"]
    assert run("info", str(tmp_path / "new"))[1][0].split("\t")[-1] == "2"
