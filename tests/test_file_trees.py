import os

import pytest

from holdfast.operators import records as rec
from holdfast.operators import resampling as rs
from holdfast.sources import broker, files


def tree(tmp_path, content):
    for name, text in content.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_verify_fails_until_a_new_run_is_in_the_manifest(spark, tmp_path):
    root = tree(tmp_path / "data", {"static.json": '{"ok": true}\n', "runs/provider/run 1.json": "{}\n"})
    manifest = str(tmp_path / "manifest")
    listed = files.file_digests(spark, root)
    files.write_manifest(listed.filter("name = 'static.json'"), manifest)
    status = lambda: {r.name: r.status for r in files.verify_tree(spark, root, manifest).collect()}
    assert status() == {"static.json": "ok", "runs/provider/run 1.json": "untracked"}
    files.write_manifest(listed, manifest)
    assert set(status().values()) == {"ok"}
    (tmp_path / "data" / "static.json").write_text("{}")
    os.unlink(tmp_path / "data" / "runs/provider/run 1.json")
    assert status() == {"static.json": "mismatch", "runs/provider/run 1.json": "missing"}


def test_manifest_skips_blank_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("abc  a b.json \n\n  \ndef x.json\n")
    assert {tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.txt")).collect()} == {("a b.json", "abc"), ("x.json", "def")}


def test_newest_source_goes_by_file_time(spark, tmp_path):
    root = tree(tmp_path, {
        "7/inbox/z-older.csv": "ticker\nA\n", "7/inbox/a-newer.csv": "ticker\nB\n", "7/inbox/manual-portfolio.csv": "ticker\nC\n",
        "7/fixture/demo.csv": "ticker\nD\n", "8/private/x.csv": "ticker\nE\n", "8/fixture/demo.csv": "ticker\nF\n", "8/inbox/note.txt": "-",
    })
    for at, name in enumerate(["7/inbox/z-older.csv", "7/inbox/a-newer.csv", "7/inbox/manual-portfolio.csv", "7/fixture/demo.csv"], 1):
        os.utime(tmp_path / name, (at * 1000, at * 1000))
    pick = lambda manual: {(r.portfolio_id, r.kind, r.name) for r in broker.newest_source(broker.inbox_sources(spark, root), manual).collect()}
    assert pick(False) == {("7", "inbox", "a-newer.csv"), ("8", "private", "x.csv")}
    assert pick(True) == {("7", "inbox", "manual-portfolio.csv"), ("8", "private", "x.csv")}


def test_equal_file_times_go_by_name(spark, tmp_path):
    root = tree(tmp_path, {"7/inbox/a.csv": "x", "7/inbox/b.csv": "x"})
    for name in ("a", "b"):
        os.utime(tmp_path / f"7/inbox/{name}.csv", (5, 5))
    assert broker.newest_source(broker.inbox_sources(spark, root)).head().name == "b.csv"


def test_silent_feed_falls_back(spark):
    feeds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "feed string, priority int")
    quotes = spark.createDataFrame([("b", "X"), ("b", "Y"), ("c", "X")], "feed string, ticker string")
    assert {tuple(r) for r in rec.first_answering_feed(quotes, feeds).select("feed", "quotes", "success").collect()} == {("a", 0, False), ("b", 2, True)}


def test_bootstrap_rejects_a_block_longer_than_its_series(spark):
    rows = [("s", k, i, 0.01 * i) for k in "ab" for i in range(4)]
    pair = spark.createDataFrame(rows, "study string, strategy string, period int, ret double")
    assert rs.block_bootstrap_sharpe(pair, "a", "b", 4, 10).head().samples == 10
    with pytest.raises(Exception, match="block must not be longer"):
        rs.block_bootstrap_sharpe(pair, "a", "b", 5, 10).collect()


def test_bootstrap_of_equal_and_constant_series(spark):
    rows = [("s", k, i, 0.01) for k in "ab" for i in range(30)]
    pair = spark.createDataFrame(rows, "study string, strategy string, period int, ret double")
    got = rs.block_bootstrap_sharpe(pair, "a", "b", 7, 50).head()
    assert (got.point_estimate, got.ci_low, got.ci_high, got.prob_a_better, got.samples) == (0, 0, 0, 0, 50)
