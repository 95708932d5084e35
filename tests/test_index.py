import json
import os
import subprocess
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import types as T

from trawl.index.catalog import Catalog
from trawl.index.embed import ConstantEmbedder, HashEmbedder, HttpEmbedder, embedder_of, pooled
from trawl.index.engine import Engine, IdentityMismatch
from trawl.index.snapshot import Store, read_json, write_json
from trawl.sources.config import Settings, load, merged, parse_dotenv
from trawl.sources.files import Journal, contained, git_files, read_files, workspace_files
from trawl.streaming.watch import Poller, debounced, file_events, watch, watched


@pytest.fixture
def workspace(tmp_path):
    root = tmp_path / "ws"
    (root / "docs").mkdir(parents=True)
    (root / "auth.py").write_text("def login(user, password):\n    '''Check the password of a user and open a session for them.'''\n    return user.check(password) and open_session(user)\n")
    (root / "docs/guide.md").write_text("# Cooking\n\nBoil the pasta in salted water for nine minutes.\n")
    (root / "data.yaml").write_text("rows: 10\n")
    return root


def test_incremental_lifecycle(spark, workspace, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), "w", HashEmbedder(64))
    files = lambda: read_files(spark, str(workspace))
    assert engine.ready() == (False, "no index")
    assert engine.reindex(files()) == {"new": 3, "changed": 0, "unchanged": 0, "removed": 0, "written": True}
    version = engine.chunks.version()
    assert not engine.reindex(files())["written"] and engine.chunks.version() == version
    assert engine.search("password of a user", 1).first()["path"] == "auth.py"
    assert [r["path"] for r in engine.search("pasta water", 5, "docs/*").collect()] == ["docs/guide.md"]
    assert engine.search("  ").count() == 0
    (workspace / "data.yaml").unlink()
    (workspace / "docs/guide.md").write_text("# Sailing\n\nReef the main before the wind gets up, not after.\n")
    report = engine.reindex(files())
    assert (report["changed"], report["removed"], report["unchanged"]) == (1, 1, 1)
    assert "Sailing" in engine.search("sailing wind", 1).first()["snippet"]
    status = engine.status()
    assert status["files"] == 2 and status["chunks"] == status["doc_count"] and status["ready"] and not engine.desync()


def test_failed_run_leaves_the_index(spark, workspace, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), "w", HashEmbedder(16))
    engine.reindex(read_files(spark, str(workspace)))
    before = engine.chunks.read().count()
    (workspace / "new.md").write_text("text that is long enough to be a chunk of its own")

    class Broken(HashEmbedder):
        def embed(self, texts):
            raise OSError("down")

    engine.embedder = Broken(16)
    with pytest.raises(Exception, match="down"):
        engine.reindex(read_files(spark, str(workspace)))
    assert engine.chunks.read().count() == before and not engine.files.exists("LOCK")


def test_identity(spark, workspace, tmp_path):
    files = read_files(spark, str(workspace))
    Engine(spark, str(tmp_path), "w", ConstantEmbedder(8)).reindex(files)
    other = Engine(spark, str(tmp_path), "w", ConstantEmbedder(8), collection_id="")
    other.identity = other.identity.__class__(**vars(other.identity) | {"strategy": "prose"})
    with pytest.raises(IdentityMismatch, match="strategy"):
        other.reindex(files)
    assert other.reindex(files, force=True)["written"] and other.ready()[0]


def test_other_formats_are_built_anew(spark, workspace, tmp_path):
    files, engine = read_files(spark, str(workspace)), Engine(spark, str(tmp_path), "w", ConstantEmbedder(8))
    engine.reindex(files)
    write_json(engine.files, "META.json", read_json(engine.files, "META.json") | {"format": 0})
    assert engine.ready() == (False, "identity: format")
    assert engine.reindex(files)["new"] == 3 and engine.ready()[0]
    engine.files.delete("META.json")
    assert engine.reindex(files)["new"] == 3 and engine.ready()[0] and not engine.reindex(files)["written"]


def test_slow_searches_show_in_the_status(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), "w", ConstantEmbedder(8))
    found = []
    for latency in ([], [10.0], [6000.0], [10.0] * 6, [10.0] * 6 + [50.0]):
        engine.latency = latency
        found.append(engine.slow_search())
    assert found == ["", "", "absolute_slow_threshold", "", "median_ratio"]


def test_deletes_are_tried_again(spark, tmp_path, monkeypatch):
    store, calls = Store(spark, str(tmp_path / "t"), SCHEMA, "k"), []

    class Busy:
        def delete(self, path, recursive):
            calls.append(path)
            if len(calls) % 4:
                store.files.fs.getFileStatus(store.files._path("none"))  # raises

    files = store.files
    busy = type("F", (), {"fs": Busy(), "_path": staticmethod(files._path)})()
    with pytest.raises(Py4JJavaError):
        type(files).delete(busy, "x", pause=0)
    type(files).delete(busy, "x", pause=0)
    assert len(calls) == 4


def test_workspace_files(spark, workspace):
    found, warning = workspace_files(spark, str(workspace), ["PY", ".md"], ["docs"])
    assert [r["relative_path"] for r in found.collect()] == ["auth.py"] and warning
    subprocess.run(["git", "init", "-q", str(workspace)], check=True)
    (workspace / ".gitignore").write_text("auth.py\n")
    (workspace / "Other.Py").write_text("1")
    found, warning = workspace_files(spark, str(workspace), ["py"])
    assert [r["relative_path"] for r in found.collect()] == ["Other.Py"] and not warning


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), SCHEMA, "k")
    assert store.read().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    store.upsert(rows((1, "a"), (2, "b")))
    store.upsert(rows((2, "c"), (3, "d")))
    store.delete(rows((1, ""), (1, ""), (9, "")))
    assert sorted(map(tuple, store.read().collect())) == [(2, "c"), (3, "d")]
    staged = store.stage(rows((7, "x")))
    assert store.read().count() == 2
    store.discard(staged)
    with store.lock(), pytest.raises(RuntimeError), store.lock():
        pass
    store.wipe()
    assert store.read().count() == 0


def test_a_dead_writers_lock_is_taken_over(spark, tmp_path):
    store, lock = Store(spark, str(tmp_path / "t"), SCHEMA, "k"), tmp_path / "t/LOCK"
    assert store.files.claim("LOCK")
    with pytest.raises(RuntimeError), store.lock():
        pass
    assert lock.exists()
    os.utime(lock, (1, 1))
    with store.lock(), pytest.raises(RuntimeError), store.lock():
        pass
    assert not lock.exists() and not list(tmp_path.glob("t/LOCK*"))


def test_a_held_lock_stays_fresh(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), SCHEMA, "k")
    with store.lock(stale=2.0):
        time.sleep(3)
        with pytest.raises(RuntimeError), store.lock(stale=2.0):
            pass


def test_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), SCHEMA, "k")
    store.replace(spark.range(1024).selectExpr("id AS k", "'x' AS v").repartition(64))
    before = store.files.sizes(f"v={store.version()}")
    assert store.compact() and store.read().count() == 1024
    after = store.files.sizes(f"v={store.version()}")
    assert len(after) * 4 <= len(before) and sum(after) * 4 <= sum(before) and not store.compact()


def test_catalog_closes_idle_workspaces_oldest_first():
    at = iter(range(100))
    c = Catalog(lambda w: w, most=2, clock=lambda: next(at))
    for w in ("a", "b"):
        with c.borrow(w):
            pass
    with c.borrow("b"), c.borrow("c"):
        assert set(c.engines) == {"b", "c"}
        with pytest.raises(RuntimeError), c.borrow("d"):
            pass
    with pytest.raises(ZeroDivisionError):
        c.reload({"x": lambda: 1 / 0})
    assert set(c.engines) == {"b", "c"}


def test_catalog_takes_over_what_differs():
    c, opened = Catalog(lambda w: w, most=9), []
    open_ = lambda w, spec: opened.append(w) or f"{w}{spec}"
    assert c.apply({"a": 1, "b": 1}, open_) == {"added": ["a", "b"], "changed": [], "removed": []}
    assert c.apply({"a": 1, "b": 2, "c": 1}, open_) == {"added": ["c"], "changed": ["b"], "removed": []}
    assert opened == ["a", "b", "c", "b"] and c.engines == {"a": "a1", "b": "b2", "c": "c1"}
    with c.borrow("c"), pytest.raises(RuntimeError):
        c.apply({"a": 2}, open_)
    with pytest.raises(ZeroDivisionError):
        c.apply({"a": 2}, lambda w, spec: 1 / 0)
    assert c.engines == {"a": "a1", "b": "b2", "c": "c1"}
    assert c.apply({"a": 1}, open_)["removed"] == ["b", "c"] and list(c.engines) == ["a"]


def test_settings_reach_the_engine(spark, tmp_path):
    s = load("dims: 16\nstrategy: prose\nmin_chunk_tokens: 7", environment={"TRAWL_PROVIDER": "constant"}, dotenv="TRAWL_DIMS=8\nTRAWL_PROVIDER=hash")
    engine = Engine.of_settings(spark, str(tmp_path), "w", s)
    assert isinstance(engine.embedder, ConstantEmbedder) and engine.embedder.dims == 8 and engine.routing.strategy == "prose" and engine.opts.min_tokens == 7
    http = embedder_of(load("provider: http\nmodel: m\nembed_url: http://x/", environment={}), {"TRAWL_EMBED_KEY": "k"})
    assert (http.url, http.model, http.key) == ("http://x", "m", "k")
    assert embedder_of(load("provider: onnx\nmodel: a\ntokenizer: b", environment={})).model_path == "a"
    for bad in ("provider: http", "provider: onnx", "provider: none"):
        with pytest.raises(ValueError):
            embedder_of(load(bad, environment={}))


def test_http_embedder():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            if len(seen) == 1:
                self.send_error(503)
                return
            data = [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(body["input"])))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = HttpEmbedder(f"http://127.0.0.1:{server.server_port}", "m", 2, wait_s=0.01)
    assert e.embed(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]] and len(seen) == 2 and seen[1]["dimensions"] == 2
    with pytest.raises(ValueError):
        HttpEmbedder(e.url, "m", 3, wait_s=0.01).embed(["a"])
    server.shutdown()


def test_pooling():
    import numpy as np

    out = pooled(np.array([[[3.0, 0], [0, 4], [9, 9]], [[1.0, 1], [1, 1], [1, 1]]]), np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(out, [[0.6, 0.8], [0, 0]])


def test_files_and_git(spark, workspace):
    assert contained(str(workspace), "docs/guide.md") and not contained(str(workspace), "../x")
    found = {r["relative_path"]: r["content_hash"] for r in read_files(spark, str(workspace), ["md", "py"], ["docs"]).collect()}
    assert list(found) == ["auth.py"]
    assert git_files(str(workspace)) is None
    os.system(f"git -C {workspace} init -q && git -C {workspace} add -A")
    (workspace / "data.yaml").unlink()
    assert git_files(str(workspace)) == ["auth.py", "docs/guide.md"]


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    j.append(spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    j.append(spark.createDataFrame([("c",)], "doc_id string"))
    assert sorted(r[0] for r in j.pending().collect()) == ["a", "b", "c"]
    j.clear()
    assert not (tmp_path / "j").exists()


def test_settings():
    assert load(environment={"TRAWL_WINDOW_LINES": "30", "TRAWL_CONTEXT_PREFIX": "no", "TRAWL_EXTENSIONS": "go, py"}) == Settings(window_lines=30, context_prefix=False, extensions=("go", "py"))
    with pytest.raises(ValueError, match="unknown"):
        merged(Settings(), {"windows": 1})
    with pytest.raises(ValueError, match="unknown"):
        merged(Settings(), {"window_lines": 1}, frozenset({"strategy"}))
    assert parse_dotenv("# c\nexport A='x=1'\nB = 2\n") == {"A": "x=1", "B": "2"}


def test_poller(spark):
    listings = iter([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 1), ("c", 1, 1)], [("a", 2, 1), ("c", 1, 1)]])
    p = Poller(lambda: spark.createDataFrame(next(listings), "relative_path string, mtime_ns long, size long"))
    assert p.poll() is None
    assert {tuple(r) for r in p.poll().collect()} == {("a", "modified"), ("b", "removed"), ("c", "created")}
    assert p.poll().count() == 0


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_paths_below_an_awkward_root(spark, tmp_path, scheme):
    root = tmp_path / "a+b (c)"
    (root / "x").mkdir(parents=True)
    (root / "x/k.py").write_text("1")
    assert [r["relative_path"] for r in read_files(spark, scheme + str(root)).collect()] == ["x/k.py"]
    q = file_events(spark, scheme + str(root)).writeStream.format("memory").queryName("awkward").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["relative_path"] for r in spark.table("awkward").collect()] == ["x/k.py"]


def test_watch_stream_coalesces_and_survives_errors(spark, workspace, tmp_path):
    calls = []
    events = watched(file_events(spark, str(workspace)), ["py", "md"], ["docs"])
    stream, sink = watch(events, lambda: calls.append(1), str(tmp_path / "cp"), availableNow=True)
    stream.awaitTermination(60)
    assert (sink.runs, sink.events, len(calls)) == (1, 1, 1)

    def fail():
        raise OSError("busy")

    stream, sink = watch(events, fail, str(tmp_path / "cp2"), availableNow=True)
    stream.awaitTermination(60)
    assert sink.last_error == "busy" and stream.exception() is None


def test_debounce_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 5), ("b", 1), ("z", 900)], "k string, s int").selectExpr("k", "timestamp_seconds(s) AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = debounced(stream, "2 seconds", "k", late="1 second").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("runs").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r["k"], r["n"]) for r in debounced(rows, "2 seconds", "k").collect()) == [("a", 1), ("a", 2), ("b", 1), ("z", 1)]


def test_requests():
    from trawl.index.requests import SearchRequest, parse_request, redacted

    assert parse_request(b'{"query": "q", "limit": 3}') == SearchRequest("q", 3)
    for bad in (b'{"q": 1}', b"[]", b'{"query": 1}', b'{"limit": true}', b'{"query": "a"} x', b" " * (1 << 20) + b"{}"):
        with pytest.raises(ValueError):
            parse_request(bad)
    assert redacted({"index_path": "/a", "error": "open /a/b failed", "n": 1, "x": {"root": "/r", "m": "ok"}}) == {"error": "open <redacted>", "n": 1, "x": {"m": "ok"}}


def test_progress(spark, tmp_path):
    from trawl.index.requests import Progress
    from trawl.index.snapshot import Files

    files = Files(spark, str(tmp_path / "p"))
    assert Progress.load(files) == Progress()
    p = Progress(True, 30, 7, started=100.0)
    for i in range(50):
        p.add_failed(f"f{i % 25}")
    p.save(files, now=170.0)
    q = Progress.load(files)
    assert q == p and len(q.failed_files) == 20 and q.percent == 23.3 and q.seconds_left(170.0) == 230
    assert q.stalled(291.0) and not q.stalled(290.0)


def test_result_json(spark, workspace, tmp_path):
    from trawl.index.requests import SearchRequest, result_json

    engine = Engine(spark, str(tmp_path / "index"), "w", HashEmbedder(16))
    engine.reindex(read_files(spark, str(workspace)))
    found = json.loads(result_json(engine.search("pasta", 2), SearchRequest("pasta", 2)))
    assert found["query"] == "pasta" and len(found["results"]) == 2 and "doc_id" not in found["results"][0]


def test_hash_embedder_sums_in_order_and_hashes_a_word_once(monkeypatch):
    import math
    import re

    import numpy as np
    import xxhash

    from trawl.index.embed import HashEmbedder

    texts = ["One fish two fish, red fish é blue fish", "", "a b", "x" * 50 + " " + "ab" * 40, *["the same words again and again %d" % (k % 3) for k in range(40)]]
    want = []
    for text in texts:
        v = np.zeros(16)
        for word in re.findall(r"\w+", text.lower()):
            for part, weight in [(word, 1.0), *((word[i : i + 3], 0.3) for i in range(len(word) - 2))]:
                h = xxhash.xxh64_intdigest(part)
                v[h % 16] += weight if h >> 63 else -weight
        n = math.sqrt(float(v @ v))
        want.append((v / n if n else v).tolist())
    hashed, own = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: hashed.append(x) or own(x))
    assert HashEmbedder(16).embed(texts) == want
    assert hashed.count("again") <= 1
