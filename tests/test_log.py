"""The commit log: one version for all tables, deltas, dead rows, packing, conflicts, runs that die anywhere."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions import vectors
from trawl.functions.paths import matches_glob
from trawl.index import inverted, log
from trawl.index.embed import ConstantEmbedder, HashEmbedder
from trawl.index.engine import Engine, IndexingFailed
from trawl.index.log import Conflict, Kind, Log
from trawl.index.requests import Progress
from trawl.sources.files import Journal

ROW = T.StructType([T.StructField("relative_path", T.StringType()), T.StructField("v", T.LongType())])
KINDS = {"a": Kind(ROW, "array(v)"), "b": Kind(ROW, "array(v)")}


def table(spark, root, buckets=4):
    return Log(spark, str(root), KINDS, buckets)


def rows(spark, *x):
    return spark.createDataFrame([(f"p{k}", v) for k, v in x], ROW)


def paths(spark, *k):
    return spark.createDataFrame([(f"p{x}",) for x in k], "relative_path string")


def there(df):
    return sorted(tuple(r) for r in df.collect())


def change(t, spark, table="a", gone=(), come=()):
    if gone:
        t.delete(table, paths(spark, *gone))
    if come:
        t.insert(table, rows(spark, *come))


def test_any_history_is_what_a_dictionary_says(spark, tmp_path):
    rng, tables, held = random.Random(2), table(spark, tmp_path), {}
    for step in range(7):
        t, fresh = tables.begin(), {rng.randrange(12): [rng.randrange(99) for _ in range(rng.choice([1, 2]))] for _ in range(4)}
        gone = sorted({*fresh, rng.randrange(12)})
        change(t, spark, gone=gone, come=[(k, v) for k, vs in fresh.items() for v in vs])
        assert t.commit() == tables.version()
        held = {k: v for k, v in held.items() if k not in gone} | fresh
        want = sorted((f"p{k}", v) for k, vs in held.items() for v in vs)
        assert there(tables.read("a")) == want
        if step in (2, 5):
            assert tables.pack() and there(tables.read("a")) == want and not tables.state().files("a", "gone") and tables.state().writes == 0
            assert not tables.pack(least=3)
        state = tables.state()
        assert list(tables.digest("a", tables.read("a"))) == state.digests["a"] and state.digests["a"][0] == len(want)
        tables.vacuum()
        assert there(tables.read("a")) == want


def test_readers_see_one_version_of_both_tables(spark, tmp_path):
    tables = table(spark, tmp_path)
    t = tables.begin()
    change(t, spark, "a", come=[(1, 1), (2, 2)])
    change(t, spark, "b", come=[(1, 10)])
    assert tables.version() == 0 and there(tables.read("a")) == []
    t.commit()
    before = tables.state()
    t = tables.begin()
    change(t, spark, "a", gone=[1], come=[(1, 3)])
    change(t, spark, "b", gone=[1])
    t.commit()
    tables.vacuum(keep=1)
    assert (there(tables.read("a", before)), there(tables.read("b", before))) == ([("p1", 1), ("p2", 2)], [("p1", 10)])
    assert (there(tables.read("a")), there(tables.read("b"))) == ([("p1", 3), ("p2", 2)], [])


def test_one_change_writes_one_bucket(spark, tmp_path):
    tables = table(spark, tmp_path, 8)
    t = tables.begin()
    change(t, spark, come=[(k, k) for k in range(60)])
    t.commit()
    before = tables.state().tables["a"]
    t = tables.begin()
    change(t, spark, gone=[7], come=[(7, 700)])
    t.commit()
    after = tables.state().tables["a"]
    fresh = {p: f for p, f in after.items() if p not in before}
    assert before.keys() <= after.keys() and len({f["bucket"] for f in fresh.values()}) == 1 and len(fresh) == 2
    assert tables.pack(target_bytes=1)  # nothing is small, so only the bucket with a dead row is written anew
    packed = tables.state().tables["a"]
    assert {f["bucket"] for p, f in packed.items() if p not in after} == {f["bucket"] for f in fresh.values()}


def test_transactions_side_by_side(spark, tmp_path):
    tables = table(spark, tmp_path, 64)
    bucket = lambda k: tables.buckets_of("a", paths(spark, k))
    other = next(k for k in range(1, 99) if bucket(k) != bucket(0))
    one, two, three = tables.begin(), tables.begin(), tables.begin()
    change(one, spark, come=[(0, 1)])
    change(two, spark, come=[(other, 2)])
    change(three, spark, gone=[0], come=[(0, 3)])
    assert (one.commit(), two.commit()) == (1, 2)
    three.insert("a", rows(spark, (0, 3)))
    with pytest.raises(Conflict):
        three.commit()
    assert there(tables.read("a")) == sorted([("p0", 1), (f"p{other}", 2)])


def test_a_writer_who_lost_the_lock_commits_nothing(spark, tmp_path):
    tables = table(spark, tmp_path)
    with tables.lock():
        t = tables.begin()
        change(t, spark, come=[(1, 1)])
        tables.files.put("LOCK", "somebody else")
        with pytest.raises(Exception, match="taken the index over"):
            t.commit()
    assert tables.version() == 0 and tables.files.read("LOCK") == "somebody else"


def test_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "CHECKPOINT", 2)
    tables = table(spark, tmp_path)
    for k in range(5):
        t = tables.begin()
        change(t, spark, come=[(k, k)])
        t.commit(meta={"k": k})
    for n in (1, 2, 3):
        tables.files.delete(f"_log/{n:020d}.json")
    state = tables.state()
    assert state.version == 5 and state.meta == {"k": 4} and len(there(tables.read("a"))) == 5


def test_many_small_batches_are_packed(spark, tmp_path):
    """The write counter is in the log; files and bytes shrink, files that are large enough stay."""
    tables = table(spark, tmp_path, 1)
    t = tables.begin()
    t.insert("a", spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("relative_path"), F.xxhash64("id").alias("v")))
    t.commit()
    large = set(tables.state().tables["a"])
    for k in range(12):
        t = tables.begin()
        change(t, spark, come=[(4 * k + i, i) for i in range(4)])
        t.commit()
    before = tables.state()
    small = {p: f for p, f in before.tables["a"].items() if p not in large}
    assert before.writes == 13 and len(small) == 12
    assert tables.pack(target_bytes=1 << 20)
    after = tables.state()
    packed = {p: f for p, f in after.tables["a"].items() if p not in large}
    assert large <= after.tables["a"].keys() and len(packed) * 4 <= len(small) and sum(f["size"] for f in packed.values()) * 4 <= sum(f["size"] for f in small.values())
    assert tables.read("a").count() == 60_048 and after.writes == 0


# ---- the engine on the log


def corpus(spark, texts):
    made = [(p, 1, len(t.encode()), t) for p, t in texts.items()]
    return spark.createDataFrame(made, "relative_path string, mtime_ns long, size long, content string").withColumn("content_hash", F.sha2("content", 256))


FIRST = {"a.md": "# One\n\nThe first text about harbours and boats.\n", "b.md": "# Two\n\nThe second text about bread and ovens.\n", "c.yaml": "rows: 10\n", "empty.md": ""}
SECOND = {"a.md": "# One\n\nNow about mountains and snow instead.\n", "c.yaml": "rows: 10\n", "d.md": "# Four\n\nA new text about trains.\n", "empty.md": ""}


class Stopped(BaseException):
    pass


def snippets(engine):
    return sorted(r["snippet"] for r in engine.chunks.read().select("snippet").collect())


def test_a_run_may_die_between_any_two_writes(spark, tmp_path, monkeypatch):
    points = []
    monkeypatch.setattr("trawl.index.log.reached", points.append)
    monkeypatch.setattr("trawl.index.engine.reached", points.append)
    whole = Engine(spark, str(tmp_path / "whole"), "w", ConstantEmbedder(8))
    whole.reindex(corpus(spark, FIRST))
    old, points[:] = snippets(whole), []
    whole.reindex(corpus(spark, SECOND))
    new, n = snippets(whole), len(points)
    assert n >= 8 and old != new and whole.verified()
    for stop in range(n):
        seen = []

        def die(point, seen=seen, stop=stop):
            seen.append(point)
            if len(seen) == stop + 1:
                raise Stopped(point)

        engine = Engine(spark, str(tmp_path / f"i{stop}"), "w", ConstantEmbedder(8))
        monkeypatch.setattr("trawl.index.log.reached", lambda p: None)
        monkeypatch.setattr("trawl.index.engine.reached", lambda p: None)
        engine.reindex(corpus(spark, FIRST))
        monkeypatch.setattr("trawl.index.log.reached", die)
        monkeypatch.setattr("trawl.index.engine.reached", die)
        with pytest.raises(Stopped):
            engine.reindex(corpus(spark, SECOND))
        monkeypatch.setattr("trawl.index.log.reached", lambda p: None)
        monkeypatch.setattr("trawl.index.engine.reached", lambda p: None)
        again = Engine(spark, str(tmp_path / f"i{stop}"), "w", ConstantEmbedder(8))
        assert snippets(again) == (new if points[stop] == "committed" else old) and again.ready()[0] and not again.desync(), points[stop]
        again.reindex(corpus(spark, SECOND))
        assert snippets(again) == new and again.verified() and not again.files.names("journal"), points[stop]
        assert not again.reindex(corpus(spark, SECOND))["written"]


def test_a_journal_is_carried_out_by_the_next_run(spark, tmp_path):
    """A run had written down that b.md goes, and died; it goes although the next run's files say nothing of it being changed."""
    engine = Engine(spark, str(tmp_path), "w", ConstantEmbedder(8))
    engine.reindex(corpus(spark, FIRST))
    j = Journal(spark, f"{engine.base}/journal/dead", "relative_path")
    j.append(spark.createDataFrame([("b.md",)], "relative_path string"))
    assert not (tmp_path / "none").exists()
    report = engine.reindex(corpus(spark, {k: v for k, v in FIRST.items() if k != "b.md"}))
    assert report["written"] and report["removed"] == 0 and engine.verified()
    assert not any("second text" in s for s in snippets(engine)) and engine.files.names("journal") == []
    engine.files.put("journal/half/part-0", "{")  # never finished: nothing was deleted by it
    assert not engine.reindex(corpus(spark, {k: v for k, v in FIRST.items() if k != "b.md"}))["written"]


def test_files_that_fail_are_listed_and_keep_their_rows(spark, tmp_path):
    class Picky(ConstantEmbedder):
        def embed(self, texts):
            if any("snow" in t for t in texts):
                raise ValueError("the file is too small for a vector")
            return super().embed(texts)

    engine = Engine(spark, str(tmp_path), "w", Picky(8))
    engine.reindex(corpus(spark, FIRST))
    report = engine.reindex(corpus(spark, SECOND | {"huge.md": "x" * (3 << 20)}))
    assert report["changed"] == 1 and report["new"] == 1 and report["removed"] == 1
    assert {r["relative_path"]: r["reason"] for r in engine.rejected.collect()} == {"a.md": "ValueError: the file is too small for a vector", "huge.md": "file too large for indexing"}
    assert any("harbours" in s for s in snippets(engine)) and any("trains" in s for s in snippets(engine)) and engine.verified()
    status = engine.status()
    assert "failed_files" in status["warnings"] and status["failed_files"] == ["a.md"] and not status["indexing"] and status["percent"] == 100.0
    engine.embedder = ConstantEmbedder(8)
    engine.embedder.profile = "constant"
    assert engine.reindex(corpus(spark, SECOND))["changed"] == 1 and engine.rejected.count() == 0


def test_errors_that_are_not_one_files_end_the_run(spark, tmp_path):
    class Down(ConstantEmbedder):
        def embed(self, texts):
            raise OSError("the service is down")

    engine = Engine(spark, str(tmp_path), "w", Down(8))
    with pytest.raises(IndexingFailed, match="down"):
        engine.reindex(corpus(spark, FIRST))
    p = Progress.load(engine.files)
    assert not p.running and "down" in p.error and engine.log.version() == 0


# ---- inverted lists


def test_the_index_follows_the_collection(spark, tmp_path):
    rng = random.Random(3)
    words = ["harbour", "boat", "bread", "oven", "snow", "train", "piano", "lemon", "glass", "tower"]
    texts = {f"d{i % 5}/f{i}.md": f"# T{i}\n\n" + " ".join(rng.choices(words[i % 10 :][:3] or words[:3], k=25)) for i in range(80)}
    engine = Engine(spark, str(tmp_path), "w", HashEmbedder(32))
    engine.reindex(corpus(spark, texts))
    plain = [r["snippet"] for r in engine.search("snow and a train", 5).collect()]
    built = engine.build_index(cells=9)
    assert built["recall"] >= 0.95 and engine.status()["probes"] == built["probes"] and engine.verified()
    for asked, glob in (("snow and a train", None), ("lemon", "d3/*"), ("piano glass", "**/f1*.md")):
        want = vectors.nearest(engine.chunks.read(), engine.embedder.embed([asked])[0], 40, "embedding", "doc_id", None if glob is None else F.col("relative_path").rlike(glob.replace("**/", ".*").replace("*", "[^/]*")))
        state = engine.log.state()
        found = engine._near(state, engine.embedder.embed([asked])[0], 40, matches_glob(F.col("relative_path"), glob), True)
        assert [r["doc_id"] for r in found.orderBy("score", "doc_id").collect()] == [r["doc_id"] for r in want.collect()]
    assert [r["snippet"] for r in engine.search("snow and a train", 5).collect()] == plain
    engine.search("snow and a train", 1, exact=False)
    assert engine.read_files[0] <= engine.read_files[1]
    changed = dict(list(texts.items())[5:]) | {"d9/new.md": "# New\n\nA submarine below the ice."}
    engine.reindex(corpus(spark, changed))
    vector = engine.embedder.embed(["submarine below ice"])[0]
    found = engine._near(engine.log.state(), vector, 40, F.lit(True), True)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in vectors.nearest(engine.chunks.read(), vector, 40, "embedding", "doc_id").collect())
    assert any("submarine" in r["snippet"] for r in found.collect()) or engine.chunks.read().where("relative_path = 'd9/new.md' AND cell IS NOT NULL").count() == 1
    engine.reindex(corpus(spark, dict(list(changed.items())[4:]) | {"rule.md": "# ---\n\n*** --- ***\n"}))
    engine.reindex(corpus(spark, dict(list(changed.items())[6:])))  # nothing but removals
    assert engine.search("*** lemon", 3).count() == 3
    in_cells = engine.log.read("cells").select("doc_id")
    assert there(in_cells) == there(engine.chunks.read().where("embedding IS NOT NULL").select("doc_id")) and engine.verified()
    assert engine.log.pack() and there(engine.log.read("cells").select("doc_id")) == there(in_cells)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 8))
    x[10:40] = x[10]  # a third of all rows is one vector
    held = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0, 2.0]), (104, [None] * 8), (105, [1e-30] * 8)]
    df = spark.createDataFrame(held, "vec_id long, embedding array<double>")
    centroids = inverted.learn(df, "vec_id", "embedding", 8)
    rows = inverted.assigned(df, "embedding", centroids)
    cells = inverted.Cells(centroids, inverted.radii(rows))
    asked = df.where("vec_id % 7 = 0 OR vec_id > 95").withColumnRenamed("vec_id", "query_id")
    want = {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest_batch(df.where("vec_id < 100 OR vec_id = 105"), asked.where("query_id < 100 OR query_id = 105"), 40).collect()}
    for probes in (1, 3):
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in inverted.search(rows, asked, cells, 40, probes).collect()} == want
    found = {(r["query_id"], r["vec_id"]) for r in inverted.search(rows, asked, cells, 5, len(centroids), exact=False).collect()}
    truth = {(q, v) for q, v, r in want if r <= 5}
    assert len(found & truth) >= 0.9 * len(truth)
    none = df.limit(0)
    assert inverted.learn(none, "vec_id", "embedding", 8).shape == (1, 8)
    assert inverted.search(inverted.assigned(none, "embedding", centroids), asked, cells, 3).collect() == []
    assert inverted.search(rows, asked.limit(0), cells, 3).collect() == []


def test_vectors_without_a_direction_are_no_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.nearest(df, [1.0, 0.1], 9).collect()] == [3, 4]


def test_parts_and_shares_are_bounded_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8))
    x[100:250] = x[100]  # more than a part holds
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    centroids = inverted.learn(df, "vec_id", "embedding", 8, 12)
    rows = inverted.assigned(df, "embedding", centroids)
    cells, asked = inverted.Cells(centroids, inverted.radii(rows)), df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest_batch(df, asked, 6).collect())
    for name, value in {"PART": 512, "MATRIX": 64, "FOUND": 50, "LEAST": 16}.items():
        monkeypatch.setattr(inverted, name, value)
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in inverted.search(rows, asked, cells, 6, 2).collect()) == want
    found = inverted.search(rows, asked, cells, 6, len(centroids), exact=False).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in found} & {w[:2] for w in want}) >= 0.9 * len(want)
    searches = []
    own = inverted.search
    monkeypatch.setattr(inverted, "search", lambda *a, **k: searches.append(1) or own(*a, **k))
    sample = asked.limit(20)
    probes, recall = inverted.tuned(rows, sample, cells, 6, 0.9)
    truth = {(r["query_id"], r["vec_id"]) for r in own(rows, sample, cells, 6).collect()}
    again = {(r["query_id"], r["vec_id"]) for r in own(rows, sample, cells, 6, probes, False).collect()}
    assert len(searches) == 2 and recall == len(truth & again) / len(truth) and (recall >= 0.9 or probes == len(centroids))
    parts = inverted.Parts({0: 5, 1: 6, 3: 40, 4: 1}, 5, 10)
    assert parts.count == 7 and [c.tolist() for c in parts.cells] == [[0], [1], [3], [3], [3], [3], [4]]
    blocks = inverted._asked(asked, cells, inverted.Parts({c: 64 for c in range(len(centroids))}, len(centroids), 64), 2, len(centroids), "embedding", False).collect()
    assert max(len(b["ids"]) // 8 for b in blocks) <= 64 // len(centroids)


def test_codes_are_near_what_they_stand_for(spark):
    x = np.random.default_rng(2).standard_normal((50, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    centroids = inverted.learn(df, "vec_id", "embedding", 16, 5)
    for r in inverted.assigned(df, "embedding", centroids).collect():
        back = centroids[r["cell"]] + np.frombuffer(r["code"], np.int8) * r["scale"]
        unit = np.array(r["embedding"]) / np.linalg.norm(r["embedding"])
        assert np.abs(back - unit).max() <= r["scale"] / 2 + 1e-12 and abs(np.linalg.norm(unit - centroids[r["cell"]]) - r["away"]) < 1e-9


def test_a_commit_is_one_small_file(spark, tmp_path):
    tables = table(spark, tmp_path)
    t = tables.begin()
    change(t, spark, come=[(1, 1)])
    t.commit(meta={"x": 1})
    found = json.loads((tmp_path / f"_log/{1:020d}.json").read_text())
    assert found["version"] == 1 and found["meta"] == {"x": 1} and list(found["tables"]) == ["a"]
