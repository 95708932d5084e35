"""Events from listings, runs by the clock, and what a status shows of them."""

import os
import time

import pytest
from pyspark.sql import functions as F

from trawl.streaming.notify import NotifyReader, changes, listing, notified
from trawl.streaming.quiet import quiet_runs
from trawl.streaming.watch import WorkspaceWatch


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            path.unlink()
        else:
            path.write_text(text)


def until(what, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if what():
            return True
        time.sleep(0.2)
    return False


def test_listing_goes_round_skipped_folders(tmp_path):
    put(tmp_path, a="1", x__b="22", node_modules__c="3", x__node_modules__d="4", x__E="5")
    os.chmod(tmp_path / "node_modules", 0)
    table, unreadable = listing(str(tmp_path), frozenset({"node_modules"}))
    assert table["relative_path"].to_pylist() == ["a", "x/E", "x/b"] and table["size"].to_pylist() == [1, 1, 2] and unreadable == []
    os.chmod(tmp_path / "node_modules", 0o755)
    assert listing(str(tmp_path), frozenset(), ("b", "d"))[0]["relative_path"].to_pylist() == ["x/b", "x/node_modules/d"]
    assert listing(str(tmp_path / "none"))[1] == [""]


def test_changes_of_listings(tmp_path):
    put(tmp_path, a="1", b="2", c="3")
    before = listing(str(tmp_path))[0]
    put(tmp_path, a="11", b=None, d="4")
    now = listing(str(tmp_path))[0]
    assert [(p, e) for p, e, *_ in changes(before, now)] == [("a", "modified"), ("d", "created"), ("b", "removed")]
    assert list(changes(now, now)) == []


def test_offsets_repeat_and_lose_nothing(tmp_path):
    root = tmp_path / "ws"
    put(root, a="1")
    options = {"path": str(root), "state": str(tmp_path / "state"), "shares": "3"}
    reader = NotifyReader(options)
    start = reader.initialOffset()
    assert reader.latestOffset() == start and reader.partitions(start, start) == []
    put(root, b="2")
    first = reader.latestOffset()
    put(root, b="22", a=None)
    again = NotifyReader(options)  # the process died after the offset was asked for
    assert again.initialOffset() == start
    second = again.latestOffset()
    events = lambda r, s, e: sorted(x[:2] for p in r.partitions(s, e) for x in r.read(p))
    assert events(again, start, first) == events(again, start, first) == [("b", "created")]
    assert events(again, start, second) == [("a", "removed"), ("b", "created"), ("b", "modified")]
    again.commit(first)
    assert events(NotifyReader(options), first, second) == [("a", "removed"), ("b", "modified")]


def test_restart_from_the_checkpoint(spark, tmp_path):
    root, seen = tmp_path / "ws", []
    put(root, a__k="1", skip__z="0")

    def drain():
        stream = notified(spark, str(root), str(tmp_path / "state"), existing=True, skipped=["skip"])
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r["relative_path"], r["event"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    drain()
    put(root, a__k="12", b="2", skip__y="0")
    drain()
    put(root, b=None)
    drain()
    drain()
    assert seen == [("a/k", "created"), ("a/k", "modified"), ("b", "created"), ("b", "removed")]


def test_a_run_ends_when_it_is_quiet(spark, tmp_path):
    """Under a steady stream there is none; then one, without any later event."""
    root = tmp_path / "ws"
    put(root, a="1")
    stream = notified(spark, str(root), str(tmp_path / "state"))
    q = quiet_runs(stream, 4.0).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        assert until(lambda: os.path.isdir(tmp_path / "state") and os.listdir(tmp_path / "state"))
        for i in range(8):
            put(root, **{f"f{i}": "x"})
            time.sleep(0.7)
        assert until(lambda: spark.table("quiet").agg(F.sum("n")).first()[0] == 8)
        assert spark.table("quiet").count() == 1 and q.exception() is None
    finally:
        q.stop()


def test_a_watch_shows_how_it_stands(spark, tmp_path):
    root, calls = tmp_path / "ws", []
    put(root, a__md="1")

    def reindex():
        calls.append(watch.status())
        if len(calls) == 1:
            raise OSError("busy")

    watch = WorkspaceWatch(spark, str(root), str(tmp_path / "watch"), reindex, ["md"], ["node_modules"], quiet_s=1.0, every="300 milliseconds")
    try:
        assert watch.status()["active"] and until(lambda: (tmp_path / "watch/listings").is_dir() and os.listdir(tmp_path / "watch/listings"))
        (root / "b.md").write_text("x")
        (root / "c.txt").write_text("no event")
        assert until(lambda: watch.status()["failed_runs"] == 1)
        assert calls[0]["indexing"] and watch.status()["last_error"] == "busy" and watch.status()["runs"] == 0
        (root / "b.md").unlink()
        assert until(lambda: watch.status()["runs"] == 1)
        s = watch.status()
        assert s["last_error"] == "" and not s["indexing"] and s["last_run"] > 0
        assert until(lambda: watch.status()["events"] >= 2 and watch.status()["last_event"] > 0)
    finally:
        watch.stop()
    assert not watch.status()["active"]


@pytest.mark.parametrize("uri", ["", "file://"])
def test_addresses(tmp_path, uri):
    put(tmp_path, a="1")
    assert listing(f"{uri}{tmp_path}")[0]["relative_path"].to_pylist() == ["a"]
