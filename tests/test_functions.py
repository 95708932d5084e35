import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions import paths, text, vectors, versions
from trawl.operators import changes, rerank, stats


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def applied(spark, values, f, kind="string"):
    return [r["y"] for r in column(spark, values, kind).select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("", "a/b.go", True),
        ("  ", "a/b.go", True),
        ("*.go", "a/b.go", True),
        ("*.go", "b.go", True),
        ("a/*.go", "a/b.go", True),
        ("a/*.go", "a/c/b.go", False),
        ("a/**/*.go", "a/c/d/b.go", True),
        ("a/**/*.go", "a/b.go", True),
        ("**/b.go", "b.go", True),
        ("a\\*.go", "a/b.go", True),
        ("a/*.go", "a\\b.go", True),
        ("a/?.{go,md}", "a/x.md", True),
        ("a/[x-z].md", "a/y.md", True),
        ("a/[!x-z].md", "a/y.md", False),
        ("a.b/*", "aXb/c", False),
    ],
)
def test_globs(spark, glob, path, want):
    assert applied(spark, [path], lambda c: paths.matches_glob(c, glob)) == [want]


def test_path_parts(spark):
    names = ["a/b.tar.gz", "x\\y.MD", "plain", ".env", ""]
    assert applied(spark, names, paths.basename) == ["b.tar.gz", "y.MD", "plain", ".env", ""]
    assert applied(spark, names, paths.extension) == [".gz", ".MD", "", ".env", ""]
    assert applied(spark, names, paths.stem) == ["b.tar", "y", "plain", "", ""]


def test_extension_and_directory_filters(spark):
    names = ["a/b.GO", "a/Makefile", "vendor/x.go", "a/vendored/x.go"]
    assert applied(spark, names, lambda c: paths.has_extension(c, ["go"])) == [True, False, True, True]
    assert applied(spark, names, lambda c: paths.has_extension(c, [])) == [True] * 4
    assert applied(spark, names, lambda c: paths.in_skipped_dir(c, ["vendor"])) == [False, False, True, False]
    assert applied(spark, names, lambda c: paths.is_watched(c, ["go"], ["vendor"])) == [True, True, False, True]


def test_cloud_folders(spark):
    names = ["/home/Yandex.Disk/x", "/h/OneDrive - Personal/x", "/h/my-dropbox-archive/x", "/h/Google Drive/x"]
    assert applied(spark, names, paths.in_cloud_folder) == [True, True, False, True]


def test_normal_text(spark):
    assert applied(spark, ["﻿a\r\nb\rc\n", "", "x"], text.normal_text) == ["a\nb\nc\n", "", "x"]


def test_token_count_agrees_with_python(spark):
    values = ["", "abc", "abcd", "ж" * 100, "x" * 351]
    assert applied(spark, values, text.token_count) == [text.count_tokens(v) for v in values]


def test_query_terms(spark):
    values = ["на по to auth", "Foo foo BAR_baz 12 123", ""]
    want = [["auth"], ["foo", "bar", "baz", "123"], []]
    assert applied(spark, values, text.query_terms) == want
    assert [text.terms_of(v) for v in values] == want


def test_headings(spark):
    lines = ["# A", "  ###  B c  ", "####### x", "#", "# ", "#x", "a # b"]
    assert applied(spark, lines, text.heading_title) == ["A", "B c", "", "", "", "", ""]
    assert applied(spark, lines, text.heading_level)[:2] == [1, 3]


def test_redaction(spark):
    values = ["open /var/x: failed", "see C:\\a\\b; and 'd:/e', n/a", "\\\\host\\share", "3/4", ""]
    assert applied(spark, values, text.redact_paths) == ["open <redacted>", "see <redacted>; and '<redacted>', n<redacted>", "<redacted>", "3/4", ""]


def test_collection_ids(spark):
    names = ["abc", "a.b-c_1", "", "-a", "a..b", "a.", "CON", "com1.txt", "x" * 64, "x" * 65, "a b"]
    assert applied(spark, names, text.valid_collection_id) == [True, True, False, False, False, False, False, False, True, False, False]


def test_versions():
    order = ["v0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0"]
    assert sorted(random.Random(1).sample(order, len(order)), key=versions.version_key) == order
    assert versions.is_newer("1.2.0", "v1.2.0-rc1") and not versions.is_newer("1.2.0+build", "1.2.0")


def test_retry_delay():
    assert versions.retry_delay(0, 0.2) == 0.2
    assert all(0.4 <= versions.retry_delay(2, 0.2) <= 0.8 for _ in range(50))


def test_over_fetch():
    assert [rerank.over_fetch(n) for n in (10, 5, 30, 0, -1)] == [50, 40, 100, 50, 50]
    assert [rerank.normal_limit(*x) for x in ((0, None), (0, 7), (500, 3), (4, 9))] == [10, 7, 100, 4]
    with pytest.raises(ValueError):
        rerank.normal_limit(-1)


def hit(path, score, **more):
    return {"doc_id": path, "path": path, "score": score, "chunk_strategy": "line_window", "symbol_name": "", "start_line": 1, "end_line": 30, "snippet": "x" * 80} | more


def ranked(spark, hits, query, limit=10):
    return [r["path"] for r in rerank.rerank(spark.createDataFrame(hits), query, limit).collect()]


def test_rerank_prefers_matching_paths_and_symbols(spark):
    hits = [hit("README.md", 0.30), hit("internal/auth/token.go", 0.40), hit("internal/x.go", 0.38, symbol_name="AuthToken", chunk_strategy="ast")]
    assert ranked(spark, hits, "auth token")[0] == "internal/auth/token.go"
    assert ranked(spark, hits, "zzz")[0] == "internal/x.go"


def test_rerank_demotes_small_chunks_and_keeps_scores(spark):
    hits = [hit("a.go", 0.30, end_line=2), hit("b.go", 0.35)]
    found = rerank.rerank(spark.createDataFrame(hits), "q", 5).collect()
    assert [(r["path"], r["score"]) for r in found] == [("b.go", 0.35), ("a.go", 0.30)]


def test_nearest_under_a_filter_equals_expansion(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"{'target' if i % 40 == 0 else 'other'}/f{i}.go", rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, path string, embedding array<double>")
    q = rng.normal(size=8).tolist()
    found = vectors.nearest(df, q, 3, only=paths.matches_glob(F.col("path"), "target/*.go")).collect()
    x = np.array([r[2] for r in rows])
    far = 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    assert [r["vec_id"] for r in found] == [i for i in np.argsort(far) if i % 40 == 0][:3]


def test_nearest_batch_equals_nearest(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(5)
    queries = [(k, rng.normal(size=6).tolist()) for k in range(3)]
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.nearest_batch(df, queries, 7).collect()}
    for k, q in queries:
        assert [found[k, i + 1] for i in range(7)] == [r["vec_id"] for r in vectors.nearest(df, q, 7).collect()]


def test_nearest_batch_of_many_blocks_ties_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(3).integers(-1, 2, size=(200, 3)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    unit = {i: v / np.linalg.norm(v) for i, v in enumerate(x) if v.any()}
    expected = {(q, k + 1, i) for q in unit if q % 4 == 0 for k, (_, i) in enumerate(sorted((round(1 - float(unit[q] @ v), 9) + 0.0, i) for i, v in unit.items())[:6])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in vectors.nearest_batch(df, asked, 6).collect()} == expected
    assert vectors.nearest_batch(df, asked.limit(0), 6).count() == vectors.nearest_batch(df.limit(0), asked, 6).count() == 0


def test_stale_and_rollback_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"], ["c", "d"])], "old array<string>, new array<string>")
    r = df.select(changes.stale_ids(F.col("old"), F.col("new")).alias("s"), changes.rollback_ids(F.col("old"), F.col("new")).alias("r")).first()
    assert (r["s"], r["r"]) == (["b", "a", "b"], ["d"])


def test_touched_file_is_changed_unless_by_hash(spark):
    f = spark.createDataFrame([("a", 2, 1, "h"), ("b", 1, 1, "")], "relative_path string, mtime_ns long, size long, content_hash string")
    m = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "")], f.schema)
    assert {r[0]: r[1] for r in changes.incremental_diff(f, m).collect()} == {"a": "changed", "b": "changed"}
    assert {r[0]: r[1] for r in changes.incremental_diff(f, m, hash_only=True).collect()} == {"a": "unchanged", "b": "changed"}


def test_latency_window(spark):
    rows = spark.createDataFrame([(i, 100.0 if i != 8 else 900.0) for i in range(1, 30)], "seq long, ms double")
    found = {r["seq"]: (r["degraded"], r["reason"]) for r in stats.rolling_latency(rows).collect()}
    assert found[8] == (True, "median_ratio") and not found[9][0] and not found[2][0]


@pytest.mark.parametrize(("ids", "chunks", "collection", "want"), [([], 0, [], False), (["a"], 1, ["a"], False), (["a"], 1, [], True), (["a"], 1, ["b"], True), (["a", "a"], 2, ["a"], True)])
def test_desync(spark, ids, chunks, collection, want):
    m = spark.createDataFrame([(ids, chunks)], "doc_ids array<string>, chunk_count int")
    c = spark.createDataFrame([(x,) for x in collection], "doc_id string")
    assert stats.desync(m, c).first()["desync"] is want


def test_status_paths():
    assert [paths.status_path("/w/s", p) for p in (" ", "a/b", "/w/s/a", "/w/x", "/w/s", " logs/ ")] == ["", "a/b", "a", "../x", ".", "logs"]


def test_counters(tmp_path):
    assert text.counter_of("http") is text.count_tokens and text.Fixed(0)("abc") == 1 and text.Fixed(7)("") == 7
    with pytest.raises(FileNotFoundError):
        text.counter_of("onnx", str(tmp_path / "none.json"))
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(str(tmp_path / "t.json"))
    assert text.counter_of("ONNX", str(tmp_path / "t.json"))("a b  zzz a") == 4
