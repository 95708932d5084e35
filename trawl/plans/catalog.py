"""The queries of the engine over the driver's tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import paths, text, vectors
from trawl.operators import changes, rerank, stats, windows
from trawl.plans.workspace import FILES_SQL, HITS_SQL, QUERY, SNAPSHOTS_SQL, files, hits, snapshots, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


DIST = "1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit("/vec_"), F.col("vec_id").cast("string"), F.lit(".go"))
    return table(spark, sf_dir, "embeddings").withColumn("path", path)


@query("k1_knn_topk", f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT e.vec_id, e.label, {DIST.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score, vec_id LIMIT 20")
def knn_topk(spark, sf_dir):
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 20)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("k2_knn_filtered", f"SELECT vec_id, path, round(score, 6) AS score FROM (SELECT e.vec_id, 'label_' || e.label::VARCHAR || '/vec_' || e.vec_id::VARCHAR || '.go' AS path, {DIST.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label = 3) ORDER BY score, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    rows = _collection(spark, sf_dir)
    found = vectors.nearest(rows, _vector(spark, sf_dir, 1), 10, only=paths.matches_glob(F.col("path"), "label_3/*.go"))
    return found.select("vec_id", "path", F.round("score", 6).alias("score"))


@query("j9_knn_batch", f"SELECT query_id, vec_id, rank, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {DIST.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest_batch(e, queries, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("centroid_by_label", "SELECT label, pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def centroid_by_label(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode(vectors.doubles(F.col("embedding"))).alias("pos", "x"))
    return cells.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("value"))


@query("a11_l2_normalize", "SELECT vec_id, pos, round(x / norm, 6) AS value FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def l2_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("a11_mean_pool", "WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label) SELECT m.label, m.pos, round(m.x / n.norm, 6) AS value FROM m JOIN n USING (label)")
def mean_pool(spark, sf_dir):
    found = vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding", F.col("embedding").isNotNull())
    return found.select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("k3_over_fetch", "SELECT n_nationkey - 3 AS asked, least(100, greatest(40, CASE WHEN n_nationkey - 3 > 0 THEN n_nationkey - 3 ELSE 10 END * 5))::BIGINT AS fetched FROM nation")
def over_fetch(spark, sf_dir):
    asked = (F.col("n_nationkey") - 3).cast("long")
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") - 3).alias("asked"), rerank.over_fetch_of(asked).cast("long").alias("fetched"))


@query("x6_character_count", "SELECT doc_id, length(text) AS tokens FROM documents")
def character_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.character_count(F.col("text")).cast("long").alias("tokens"))


@query("x15_query_terms", r"SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) >= 3))) AS terms FROM documents")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.query_terms(F.col("text"))).alias("terms"))


_P, _STEM = "lower(path)", "regexp_replace(lower(string_split(path, '/')[-1]), '\\.[^.]*$', '')"
_PATH_BOOST = f"list_sum(list_transform(terms, lambda t: CASE WHEN contains({_P}, t) THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN contains({_STEM}, t) THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN length(t) >= 5 AND contains({_P}, t[1:4]) THEN 0.12::DOUBLE ELSE 0 END))"
_SYMBOL_BOOST = "CASE WHEN symbol_name = '' THEN 0::DOUBLE ELSE list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(symbol_name), t) THEN 0.20::DOUBLE ELSE 0 END)) END"
_PENALTY = f"CASE WHEN string_split({_P}, '/')[-1] IN ('install.md', 'agents.md', 'readme.md', 'changelog.md') THEN 0.12::DOUBLE WHEN {_P} LIKE 'docs/%' OR {_P} LIKE '%/docs/%' THEN 0.12 WHEN {_P} LIKE 'testdata/%' OR {_P} LIKE '%/testdata/%' THEN 0.10 WHEN contains({_P}, 'tests/realworld/corpus/') THEN 0.10 WHEN regexp_matches({_P}, '\\.(md|markdown|mdc|txt)$') THEN 0.08 ELSE 0 END"
_MICRO = "CASE WHEN greatest(end_line - start_line, 0) < 2 OR strlen(snippet) < 40 THEN 0.10::DOUBLE ELSE 0 END"


def _terms():
    return text.query_terms(F.lit(QUERY))


_HITS = HITS_SQL.replace("['token', 'src1', 'handle', 'doc_12']", "['token', 'src1', 'handle']")


@query("r1_path_boost", f"WITH {_HITS} SELECT doc_id, round({_PATH_BOOST}, 6) AS boost FROM hits, q")
def path_boost(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", F.round(rerank.path_boost(F.col("path"), _terms()), 6).alias("boost"))


@query("r4_symbol_boost", f"WITH {_HITS} SELECT doc_id, round({_SYMBOL_BOOST}, 6) AS boost FROM hits, q")
def symbol_boost(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", F.round(rerank.symbol_boost(F.col("symbol_name"), _terms()), 6).alias("boost"))


@query("r6_path_penalty", f"WITH {_HITS} SELECT doc_id, path, {_PENALTY} AS penalty FROM hits")
def path_penalty(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", "path", rerank.path_penalty(F.col("path")).alias("penalty"))


@query("r7_micro_penalty", f"WITH {_HITS} SELECT doc_id, {_MICRO} AS penalty FROM hits")
def micro_penalty(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", rerank.micro_penalty(F.col("start_line"), F.col("end_line"), F.col("snippet")).alias("penalty"))


_ADJ = f"score - {_PATH_BOOST} - ({_SYMBOL_BOOST}) - CASE WHEN chunk_strategy IN ('ast', 'partial') THEN 0.06::DOUBLE ELSE 0 END + ({_PENALTY}) + ({_MICRO})"


@query("k5_rerank", f"WITH {_HITS} SELECT doc_id, path, score, round(adjusted, 6) AS adjusted FROM (SELECT *, round({_ADJ}, 9) AS adjusted FROM (SELECT * FROM hits ORDER BY score, doc_id LIMIT 100), q) ORDER BY round(adjusted, 9), score, doc_id LIMIT 20")
def rerank_hits(spark, sf_dir):
    top = hits(spark, sf_dir).orderBy("score", "doc_id").limit(rerank.over_fetch(20))
    scored = top.withColumn("adjusted", F.round(rerank.adjusted(F.col("score"), _terms()), 9))
    return scored.orderBy("adjusted", "score", "doc_id").limit(20).select("doc_id", "path", "score", F.round("adjusted", 6).alias("adjusted"))


@query("f1_extension_filter", f"WITH {FILES_SQL} SELECT doc_id, relative_path FROM files WHERE regexp_matches(lower(relative_path), '\\.(md|go)$')")
def extension_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.has_extension(F.col("relative_path"), ["MD", ".go"])).select("doc_id", "relative_path")


@query("f2_skip_dirs", f"WITH {FILES_SQL} SELECT doc_id, relative_path FROM files WHERE NOT list_has_any(string_split(relative_path, '/'), ['src3', 'de'])")
def skip_dirs(spark, sf_dir):
    return files(spark, sf_dir).where(~paths.in_skipped_dir(F.col("relative_path"), ["src3", "de"])).select("doc_id", "relative_path")


@query("f3_watch_filter", f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE NOT list_has_any(string_split(relative_path, '/'), ['fr']) AND regexp_matches(relative_path, '\\.go$')")
def watch_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.is_watched(F.col("relative_path"), ["go"], ["fr"])).select("doc_id")


@query("f4_missing_files", f"WITH {FILES_SQL} SELECT doc_id, relative_path FROM files WHERE doc_id % 13 <> 0")
def missing_files(spark, sf_dir):
    f = files(spark, sf_dir)
    return changes.existing_files(f, f.where("doc_id % 13 = 0")).select("doc_id", "relative_path")


@query("f5_glob_filter", f"WITH {FILES_SQL} SELECT doc_id, relative_path FROM files WHERE regexp_matches(relative_path, '^src1[0-9]/[^/]+/[^/]*\\.(md|go)$')")
def glob_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.matches_glob(F.col("relative_path"), "src1[0-9]/**/*.{md,go}")).select("doc_id", "relative_path")


@query("f5_glob_basename", f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE regexp_matches(relative_path, '/doc_1[^/]*\\.md$')")
def glob_basename(spark, sf_dir):
    return files(spark, sf_dir).where(paths.matches_glob(F.col("relative_path"), " doc_1*.md ")).select("doc_id")


@query("f8_rejected_files", "SELECT doc_id, CASE WHEN strlen(text) > 9000 THEN 'file too large for indexing' ELSE 'line too long for indexing' END AS reason FROM documents WHERE strlen(text) > 9000 OR list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) > 700")
def rejected_files(spark, sf_dir):
    return windows.acceptable(files(spark, sf_dir), 9000, 700)[1].select("doc_id", "reason")


@query("f12_redact_paths", """SELECT doc_id, regexp_replace('open /var/' || lang || '/x.db; see C:\\tmp\\' || source || ', or a/b', '(?:\\\\\\\\|[A-Za-z]:[\\\\/]|/[A-Za-z_])[^"'';,)\\]]*', '<redacted>', 'g') AS message FROM documents""")
def redact(spark, sf_dir):
    message = F.concat(F.lit("open /var/"), "lang", F.lit("/x.db; see C:\\tmp\\"), "source", F.lit(", or a/b"))
    return table(spark, sf_dir, "documents").select("doc_id", text.redact_paths(message).alias("message"))


@query("x4_chunk_type", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN regexp_matches(relative_path, '\\.(md|txt)$') THEN 'markdown' WHEN regexp_matches(relative_path, '\\.yaml$') THEN 'config' ELSE 'code' END AS chunk_type FROM files")
def chunk_type(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.chunk_type(F.col("relative_path")).alias("chunk_type"))


@query("x2_path_parts", f"WITH {FILES_SQL} SELECT doc_id, string_split(relative_path, '/')[-1] AS base, regexp_extract(relative_path, '\\.[^.]*$') AS ext FROM files")
def path_parts(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", paths.basename(F.col("relative_path")).alias("base"), paths.extension(F.col("relative_path")).alias("ext"))


@query("x5_token_count", "SELECT doc_id, trunc(length(text) / 3.5)::INTEGER AS tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\x85\xA0]+', ''), '[\s\x85\xA0]+$', '')"


@query("x7_fingerprint", f"SELECT doc_id, substr(sha256({_TRIM.format('text')}), 1, 8) AS fingerprint FROM documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_fingerprint(F.col("text")).alias("fingerprint"))


@query("x9_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("x10_collection_name", "SELECT c_custkey, 'ws_' || substr(sha256(c_name || ':local:384'), 1, 16) AS collection FROM customer")
def collection_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.collection_name(F.col("c_name"), F.lit("local"), F.lit(384)).alias("collection"))


_PREFIX = "'// file: ' || relative_path || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '// scope: section ' || doc_id::VARCHAR || chr(10) END"


def _scope():
    return F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("section "), F.col("doc_id").cast("string")))


@query("x12_embed_text", f"WITH {FILES_SQL} SELECT doc_id, sha256({_PREFIX} || content) AS embed_hash FROM files")
def embed_text(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.sha2(text.embed_text(F.col("relative_path"), _scope(), F.col("content")), 256).alias("embed_hash"))


@query("x13_body_budget", f"WITH {FILES_SQL}, b AS (SELECT doc_id, greatest(1, 435 - trunc(length({_PREFIX}) / 3.5)::INTEGER) AS budget FROM files) SELECT doc_id, budget, CASE WHEN floor(budget * 0.12::DOUBLE)::INTEGER < 1 AND budget > 1 THEN 1 ELSE floor(budget * 0.12::DOUBLE)::INTEGER END AS overlap FROM b")
def body_budget(spark, sf_dir):
    b = files(spark, sf_dir).select("doc_id", text.body_budget(F.col("relative_path"), _scope(), 512, 0.85).alias("budget"))
    return b.select("doc_id", "budget", text.overlap_budget(F.col("budget"), 0.12).alias("overlap"))


_WINDOWS = rf"""{FILES_SQL}, l AS (SELECT relative_path, string_split(regexp_replace(content, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS lines FROM files),
 w AS (SELECT relative_path, lines, unnest(range(0, CASE WHEN len(lines) <= 12 THEN 1 ELSE 1 + ceil((len(lines) - 12) / 8.0)::INTEGER END)) AS k FROM l),
 c AS (SELECT relative_path, k, (k * 8 + 1)::BIGINT AS start_line, least(k * 8 + 12, len(lines))::BIGINT AS end_line,
   coalesce(list_sum(list_transform(lines[1:k * 8], lambda x: strlen(x) + 1)), 0)::BIGINT AS start_byte, array_to_string(lines[k * 8 + 1:k * 8 + 12], chr(10)) AS snippet FROM w),
 chunks AS (SELECT *, (start_byte + strlen(snippet))::BIGINT AS end_byte, row_number() OVER (PARTITION BY relative_path ORDER BY k)::INTEGER AS chunk_index,
   CASE WHEN regexp_matches(relative_path, '\.(md|txt)$') THEN 'markdown' WHEN regexp_matches(relative_path, '\.yaml$') THEN 'config' ELSE 'code' END AS chunk_type FROM c WHERE {_TRIM.format('snippet')} <> '')"""


@query("c2_line_windows", f"WITH {_WINDOWS} SELECT relative_path, chunk_index, start_line, end_line, start_byte, end_byte, sha256(snippet) AS snippet_hash FROM chunks")
def line_windows(spark, sf_dir):
    return windows.line_windows(files(spark, sf_dir), window=12, overlap=4).select("relative_path", "chunk_index", "start_line", "end_line", "start_byte", "end_byte", F.sha2("snippet", 256).alias("snippet_hash"))


@query("x8_doc_ids", f"WITH {_WINDOWS} SELECT relative_path, chunk_index, 'doc_' || substr(sha256(concat_ws(':', relative_path, start_line, end_line, start_byte, end_byte, chunk_index, 'line_window', chunk_type, '', substr(sha256({_TRIM.format('snippet')}), 1, 8))), 1, 16) AS doc_id FROM chunks")
def doc_ids(spark, sf_dir):
    return windows.line_windows(files(spark, sf_dir), window=12, overlap=4).select("relative_path", "chunk_index", "doc_id")


@query("n3_line_offsets", "SELECT doc_id, line_no, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - strlen(line) - 1 AS start_byte FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)")
def line_offsets(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("line") + 1
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.sum(size).over(run) - size).cast("long").alias("start_byte"))


@query("n2_ordinals", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS ordinal FROM conversations")
def ordinals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("ordinal"))


@query("m1_incremental_diff", f"WITH {SNAPSHOTS_SQL} SELECT coalesce(n.relative_path, m.relative_path) AS relative_path, CASE WHEN m.relative_path IS NULL THEN 'new' WHEN n.relative_path IS NULL THEN 'removed' WHEN n.mtime_ns = m.mtime_ns AND n.size = m.size AND m.content_hash <> '' AND n.content_hash = m.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM now n FULL JOIN manifest m USING (relative_path)")
def incremental_diff(spark, sf_dir):
    return changes.incremental_diff(*snapshots(spark, sf_dir))


@query("m1_diff_hash_only", f"WITH {SNAPSHOTS_SQL} SELECT coalesce(n.relative_path, m.relative_path) AS relative_path, CASE WHEN m.relative_path IS NULL THEN 'new' WHEN n.relative_path IS NULL THEN 'removed' WHEN n.content_hash = m.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM now n FULL JOIN manifest m USING (relative_path)")
def diff_hash_only(spark, sf_dir):
    return changes.incremental_diff(*snapshots(spark, sf_dir), hash_only=True)


@query("m3_removed_files", f"WITH {SNAPSHOTS_SQL} SELECT relative_path, chunk_count FROM manifest WHERE relative_path NOT IN (SELECT relative_path FROM now)")
def removed_files(spark, sf_dir):
    now, manifest = snapshots(spark, sf_dir)
    return changes.removed_files(now, manifest).select("relative_path", "chunk_count")


_OLD_NEW = "SELECT doc_id, doc_ids AS old, list_transform(range(1, doc_id % 4 + 1), lambda i: 'd' || doc_id::VARCHAR || '_' || i::VARCHAR) AS new FROM manifest"


def _old_new(spark, sf_dir):
    m = snapshots(spark, sf_dir)[1]
    n = F.pmod("doc_id", F.lit(4)).cast("int")
    new = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return m.select("doc_id", F.col("doc_ids").alias("old"), new.alias("new"))


@query("j3_stale_ids", f"WITH {SNAPSHOTS_SQL} SELECT doc_id, list_filter(old, lambda x: NOT list_contains(new, x)) AS stale FROM ({_OLD_NEW})")
def stale(spark, sf_dir):
    return _old_new(spark, sf_dir).select("doc_id", changes.stale_ids(F.col("old"), F.col("new")).alias("stale"))


@query("j4_rollback_ids", f"WITH {SNAPSHOTS_SQL} SELECT doc_id, list_filter(new, lambda x: NOT list_contains(old, x)) AS rollback FROM ({_OLD_NEW})")
def rollback(spark, sf_dir):
    return _old_new(spark, sf_dir).select("doc_id", changes.rollback_ids(F.col("old"), F.col("new")).alias("rollback"))


@query("w1_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'inserted' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 0")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("updated")).unionByName(o.where("o_orderkey % 5 = 0 AND o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("inserted").alias("o_orderstatus")))
    return changes.upsert(o, new, "o_orderkey")


@query("w2_delete_by_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1")
def delete_by_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    gone = o.where("o_orderkey % 4 = 1")
    return changes.delete_by_id(o, gone.unionByName(gone).unionByName(gone.select((-F.col("o_orderkey") - 1).alias("o_orderkey"))), "o_orderkey")


@query("j6_delete_outcome", "SELECT c_custkey, c_custkey % 4 <> 0 AS deleted FROM customer WHERE c_custkey % 2 = 0")
def delete_outcome(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return changes.delete_outcome(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 4 = 0"), "c_custkey")


@query("j7_poll_diff", f"WITH {SNAPSHOTS_SQL} SELECT * FROM (SELECT coalesce(n.relative_path, m.relative_path) AS relative_path, CASE WHEN m.relative_path IS NULL THEN 'created' WHEN n.relative_path IS NULL THEN 'removed' WHEN n.mtime_ns <> m.mtime_ns OR n.size <> m.size THEN 'modified' END AS event FROM now n FULL JOIN manifest m USING (relative_path)) WHERE event IS NOT NULL")
def poll_diff(spark, sf_dir):
    now, manifest = snapshots(spark, sf_dir)
    return changes.poll_diff(manifest, now)


@query("a1_manifest_stats", f"WITH {SNAPSHOTS_SQL} SELECT count(*) AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM manifest")
def manifest_stats(spark, sf_dir):
    return stats.manifest_stats(snapshots(spark, sf_dir)[1])


@query("a2_unique_ids", f"WITH {SNAPSHOTS_SQL} SELECT count(DISTINCT d) AS unique_ids FROM (SELECT unnest(doc_ids) AS d FROM manifest) WHERE d <> ''")
def unique_ids(spark, sf_dir):
    return stats.unique_id_count(snapshots(spark, sf_dir)[1])


_COLLECTION = "c AS (SELECT d AS doc_id FROM (SELECT unnest(doc_ids) AS d FROM manifest) WHERE d NOT LIKE 'd1%_2')"


@query("a4_desync", f"WITH {SNAPSHOTS_SQL}, {_COLLECTION}, s AS (SELECT (SELECT sum(chunk_count) FROM manifest)::BIGINT AS chunks, (SELECT count(DISTINCT d) FROM (SELECT unnest(doc_ids) AS d FROM manifest)) AS unique_ids, (SELECT count(*) FROM c) AS doc_count, (SELECT count(*) FROM (SELECT DISTINCT unnest(doc_ids) AS d FROM manifest) WHERE d NOT IN (SELECT doc_id FROM c)) AS missing) SELECT *, chunks > 0 AND (unique_ids <> chunks OR doc_count = 0 OR unique_ids <> doc_count OR missing > 0) AS desync FROM s")
def desync(spark, sf_dir):
    manifest = snapshots(spark, sf_dir)[1]
    collection = stats.all_ids(manifest).where("doc_id NOT LIKE 'd1%\\\\_2'")
    return stats.desync(manifest, collection)


@query("a5_diagnostics", "SELECT n_nationkey, list_filter([CASE WHEN n_nationkey * 3 > 2 * (n_nationkey % 4) THEN 'collection_bloat' END, CASE WHEN n_nationkey % 4 > 0 AND n_nationkey * 3 = 0 THEN 'empty_collection' END, CASE WHEN n_nationkey % 2 > 0 THEN 'failed_files' END, CASE WHEN n_nationkey % 3 > 0 THEN 'skipped_paths' END], lambda x: x IS NOT NULL) AS warnings FROM nation")
def diagnostics(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", stats.diagnostics(k % 4, k * 3, k % 2, k % 3).alias("warnings"))


@query("a6_repeated_ids", "SELECT l_returnflag AS relative_path, l_orderkey::VARCHAR AS doc_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return stats.repeated_ids(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("relative_path"), F.col("l_orderkey").cast("string").alias("doc_id")))


@query("a7_ids_in_order", "SELECT conv_id::VARCHAR AS relative_path, list(turn::VARCHAR ORDER BY turn) AS doc_ids, count(*)::INTEGER AS chunk_count FROM conversations GROUP BY conv_id")
def ids_in_order(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("relative_path"), F.col("turn").alias("chunk_index"), F.col("turn").cast("string").alias("doc_id"))
    return stats.ids_in_order(c).select("relative_path", "doc_ids", "chunk_count")


@query("a9_progress", "SELECT p_partkey, CASE WHEN total > 0 THEN round(100.0::DOUBLE * done / total, 1) ELSE 0 END AS percent, CASE WHEN done > 0 AND total > done THEN ceil(37.5::DOUBLE / done * (total - done))::BIGINT ELSE 0 END AS eta FROM (SELECT p_partkey, p_partkey % 50 AS done, p_partkey % 61 AS total FROM part)")
def progress(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("done"), (F.col("p_partkey") % 61).alias("total"))
    return p.select("p_partkey", stats.percent_done(F.col("done"), F.col("total")).alias("percent"), stats.seconds_left(F.lit(37.5), F.col("done"), F.col("total")).alias("eta"))


@query("a12_failed_files", "SELECT event_type || '/' || (user_id % 40)::VARCHAR AS relative_path, min(event_id) AS seq FROM events GROUP BY 1 ORDER BY seq LIMIT 20")
def failed_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 40).cast("string")).alias("relative_path"), F.col("event_id").alias("seq"))
    return stats.failed_files(e)


_SAMPLES = "SELECT user_id % 20 AS stream, event_id AS seq, value * 100 AS ms FROM events"
_FRAME = "(PARTITION BY stream ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("n1_rolling_latency", f"WITH w AS (SELECT *, count(ms) OVER {_FRAME} AS n, median(ms) OVER {_FRAME} AS median_ms FROM ({_SAMPLES})) SELECT stream, seq, n, round(median_ms, 6) AS median_ms, CASE WHEN n < 5 THEN ms >= 5000 ELSE (median_ms > 0 AND ms > median_ms * 2) OR ms >= 5000 END AS degraded, CASE WHEN n >= 5 AND median_ms > 0 AND ms > median_ms * 2 THEN 'median_ratio' WHEN ms >= 5000 THEN 'absolute_slow_threshold' ELSE '' END AS reason FROM w")
def rolling_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("stream"), F.col("event_id").alias("seq"), (F.col("value") * 100).alias("ms"))
    return stats.rolling_latency(e, "stream").select("stream", "seq", "n", F.round("median_ms", 6).alias("median_ms"), "degraded", "reason")


@query("n5_eviction_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey)::INTEGER AS evict_rank FROM supplier WHERE s_suppkey % 3 = 0")
def eviction_order(spark, sf_dir):
    w = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("workspace_id"), (F.col("s_suppkey") % 3).alias("refs"), F.col("s_acctbal").alias("last_used"))
    return stats.eviction_order(w).select("s_suppkey", "evict_rank")


@query("t4_debounce_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_s, floor(epoch(max(ts)))::BIGINT AS last_s, count(*) AS n FROM s GROUP BY user_id, run")
def debounce_sessions(spark, sf_dir):
    from trawl.streaming.watch import debounced

    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    runs = debounced(e, "2 hours", "user_id")
    return runs.select("user_id", F.unix_timestamp("first_event").alias("first_s"), F.unix_timestamp("last_event").alias("last_s"), "n")


@query("x16_headings", r"SELECT doc_id, length(regexp_extract(line, '^\s*(#{1,6}) +(\S.*?)\s*$', 1)) AS level, regexp_extract(line, '^\s*(#{1,6}) +(\S.*?)\s*$', 2) AS title FROM (SELECT doc_id, unnest(string_split('  ' || repeat('#', doc_id % 8) || ' ' || lang || ' ' || source || '  ' || chr(10) || coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^\s*#{1,6} +\S')")
def headings(spark, sf_dir):
    first = F.concat(F.lit("  "), F.repeat(F.lit("#"), F.pmod("doc_id", F.lit(8)).cast("int")), F.lit(" "), "lang", F.lit(" "), "source", F.lit("  "))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat_ws("\n", first, "text"), "\n")).alias("line"))
    found = lines.select("doc_id", text.heading_level(F.col("line")).cast("long").alias("level"), text.heading_title(F.col("line")).alias("title"))
    return found.where("level > 0")


@query("x20_xml_blocks", r"SELECT page_id, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1))::INTEGER AS n, sha256(array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '|')) AS blocks FROM pages")
def xml_blocks(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(text.QUERY_BLOCK.replace("query", "p")), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n"), F.sha2(F.array_join(found, "|"), 256).alias("blocks"))


@query("x24_collection_ids", "SELECT name, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$') AND NOT contains(name, '..') AND NOT ends_with(name, '.') AND lower(string_split(name, '.')[1]) NOT IN ('con', 'prn', 'aux', 'nul') AS valid FROM (SELECT CASE n_nationkey % 6 WHEN 0 THEN n_name WHEN 1 THEN '.' || n_name WHEN 2 THEN 'con.' || n_name WHEN 3 THEN n_name || '..x' WHEN 4 THEN n_name || '.' ELSE 'a_' || n_nationkey::VARCHAR END AS name FROM nation)")
def collection_ids(spark, sf_dir):
    n, k = F.col("n_name"), F.col("n_nationkey") % 6
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit("."), n)).when(k == 2, F.concat(F.lit("con."), n)).when(k == 3, F.concat(n, F.lit("..x"))).when(k == 4, F.concat(n, F.lit("."))).otherwise(F.concat(F.lit("a_"), F.col("n_nationkey").cast("string")))
    return table(spark, sf_dir, "nation").select(name.alias("name")).select("name", text.valid_collection_id(F.col("name")).alias("valid"))


@query("x26_cloud_paths", r"SELECT doc_id, regexp_matches('/' || regexp_replace(lower('/home/me/' || CASE doc_id % 3 WHEN 0 THEN 'One Drive - Home' WHEN 1 THEN 'my-dropbox-archive' ELSE 'work' END || '/' || replace(coalesce(text, ''), chr(10), '/')), '[ ._\-\t]', '', 'g'), '/(gdrive|googledrive|yandexdisk|onedrive|dropbox|icloud)') AS synced FROM documents")
def cloud_paths(spark, sf_dir):
    """Paths of a planted folder and all lines of a text as folders."""
    folder = F.get(F.array(F.lit("One Drive - Home"), F.lit("my-dropbox-archive"), F.lit("work")), F.pmod("doc_id", F.lit(3)).cast("int"))
    path = F.concat(F.lit("/home/me/"), folder, F.lit("/"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("/")))
    return table(spark, sf_dir, "documents").select("doc_id", paths.in_cloud_folder(path).alias("synced"))


def _says(parts):
    return "(" + " OR ".join("contains(message, '" + p.replace("'", "''") + "')" for p in parts) + ")"


@query("x29_error_class", f"SELECT doc_id, CASE WHEN {_says(text.LOCKED)} THEN 'lock' WHEN {_says(text.CORRUPT + text.ONE_FILE)} THEN 'skippable' ELSE 'abort' END AS class FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'Can''t open LOCK file' WHEN 1 THEN 'segment is CORRUPT' WHEN 2 THEN 'line too long for indexing' ELSE '' END || ': ' || coalesce(text, '')) AS message FROM documents)")
def error_class(spark, sf_dir):
    says = F.get(F.array(*map(F.lit, ("Can't open LOCK file", "segment is CORRUPT", "line too long for indexing", ""))), F.pmod("doc_id", F.lit(4)).cast("int"))
    message = F.concat(says, F.lit(": "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.error_class(message).alias("class"))


@query("o2_distinct_in_order", "SELECT doc_id, list_distinct(terms) IS NOT NULL AS ok, len(list_distinct(terms))::INTEGER AS n FROM (SELECT doc_id, string_split(text, ' ') AS terms FROM documents)")
def distinct_in_order(spark, sf_dir):
    words = F.array_distinct(F.split("text", " ", -1))
    return table(spark, sf_dir, "documents").select("doc_id", words.isNotNull().alias("ok"), F.size(words).alias("n"))


@query("s11_seed", "SELECT range AS i, 'seed_' || range::VARCHAR AS doc_id, 'path_' || (range % 10)::VARCHAR || '.go' AS relative_path, range % 8 AS hot FROM range(100)")
def seed(spark, sf_dir):
    from trawl.sources.seed import seed_chunks

    rows = seed_chunks(spark, 100, 8)
    return rows.select("i", "doc_id", "relative_path", (F.array_position("embedding", F.lit(1.0).cast("float")) - 1).alias("hot"))


def _prose_files(spark, sf_dir):
    """Documents as Markdown, every third line a heading, so that sections and overlaps occur."""
    lines = F.split("content", "\n", -1)
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + i % 4).cast("int")), F.lit(" Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x)), "\n")
    return files(spark, sf_dir).select(F.concat(F.lit("docs/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), body.alias("content"))


def _code_files(spark, sf_dir):
    """Documents as Python modules: a function per line."""
    lines = F.filter(F.split("content", "\n", -1), lambda x: F.char_length(x) > 20)
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("def part_"), i.cast("string"), F.lit("(x):\n    note = '"), F.regexp_replace(x, r"['\\]", " "), F.lit("'\n    return x, note\n"))), "\n")
    return files(spark, sf_dir).select(F.concat(F.lit("src/mod_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("relative_path"), body.alias("content"))


_CHUNK_COLUMNS = ["doc_id", "relative_path", "chunk_index", "start_line", "end_line", "chunk_type", "symbol_name", "symbol_kind", "parent_scope", "chunk_strategy"]


@query("c1_chunk_files")
def chunked_files(spark, sf_dir):
    from trawl.chunkers.router import chunk_files

    return chunk_files(files(spark, sf_dir)).select(*_CHUNK_COLUMNS)


@query("c4_prose_chunks")
def prose(spark, sf_dir):
    from trawl.chunkers.router import chunk_files

    return chunk_files(_prose_files(spark, sf_dir)).select(*_CHUNK_COLUMNS)


@query("c6_syntax_chunks")
def syntax(spark, sf_dir):
    from trawl.chunkers.router import chunk_files

    return chunk_files(_code_files(spark, sf_dir)).select(*_CHUNK_COLUMNS)


@query("c8_query_chunks")
def query_blocks(spark, sf_dir):
    from trawl.chunkers.router import chunk_files

    block = F.concat(F.lit("<schema>\n<query>\nSELECT "), F.col("source"), F.lit(", x FROM t;\nSELECT 'a;b' FROM u</query>\n<name>"), F.col("lang"), F.lit("</name>\n</schema>\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("s/"), F.col("doc_id").cast("string"), F.lit(".dcs")).alias("relative_path"), block.alias("content"))
    return chunk_files(rows).select(*_CHUNK_COLUMNS)


@query("e6_hash_embed")
def hash_embed(spark, sf_dir):
    from trawl.index.embed import HashEmbedder, with_embeddings

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return with_embeddings(rows, "text", HashEmbedder(32))


@query("p1_search")
def search(spark, sf_dir):
    """Chunks of all documents, embedded, and the hits of a benchmark text among them."""
    from trawl.chunkers.router import chunk_files
    from trawl.index.embed import HashEmbedder, with_embeddings

    embedder = HashEmbedder(64)
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    made = chunk_files(files(spark, sf_dir).where(paths.matches_glob(F.col("relative_path"), "**/*.md")))
    given = made.withColumn("embed_text", text.embed_text(F.col("relative_path"), F.col("parent_scope"), F.col("snippet")))
    found = with_embeddings(given, "embed_text", embedder).withColumnRenamed("relative_path", "path")
    near = vectors.nearest(found, embedder.embed([asked])[0], rerank.over_fetch(20), "embedding", "doc_id")
    return rerank.rerank(near.drop("embedding"), asked, 20).select("doc_id", "path", "start_line", "end_line", "score", "adjusted")


@query("a8_median_latency", "SELECT stream, round(median(ms), 6) AS median_ms FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS back FROM (SELECT user_id % 20 AS stream, event_id AS seq, value * 100 AS ms FROM events)) WHERE back <= 20 GROUP BY stream")
def median_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("stream"), F.col("event_id").alias("seq"), (F.col("value") * 100).alias("ms"))
    return stats.median_of_last(e, "stream").select("stream", F.round("median_ms", 6).alias("median_ms"))


@query("j5_ids_present", f"WITH {SNAPSHOTS_SQL}, {_COLLECTION} SELECT relative_path, list_filter(doc_ids, lambda x: x NOT LIKE 'd1%_2') AS present, len(list_filter(doc_ids, lambda x: x LIKE 'd1%_2'))::INTEGER AS missing FROM manifest")
def ids_present(spark, sf_dir):
    manifest = snapshots(spark, sf_dir)[1]
    collection = stats.all_ids(manifest).where("doc_id NOT LIKE 'd1%\\\\_2'")
    return stats.present_ids(manifest, collection)


@query("k6_manifest_order", f"WITH {SNAPSHOTS_SQL} SELECT relative_path, chunk_count FROM manifest ORDER BY relative_path LIMIT 50")
def manifest_order(spark, sf_dir):
    return snapshots(spark, sf_dir)[1].orderBy("relative_path").limit(50).select("relative_path", "chunk_count")


@query("x1_slashes", "SELECT doc_id, replace(lang || '\\' || source || '/x', '\\', '/') AS path FROM documents")
def slashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.slashes(F.concat("lang", F.lit("\\"), "source", F.lit("/x"))).alias("path"))


@query("x3_normal_text", "SELECT doc_id, sha256(replace(replace(replace(text, ' ', chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS h FROM documents")
def normal_text(spark, sf_dir):
    ragged = F.concat(F.lit("﻿"), F.replace("text", F.lit(" "), F.lit("\r\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normal_text(ragged), 256).alias("h"))


@query("f6_blank_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*$')))::INTEGER AS blank FROM documents")
def blank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n", -1), text.is_blank)).alias("blank"))


@query("f10_public_hits", f"WITH {_HITS} SELECT path, start_line, end_line, symbol_name, chunk_strategy, score FROM hits ORDER BY score, path LIMIT 30")
def public_hits(spark, sf_dir):
    return hits(spark, sf_dir).orderBy("score", "path").limit(30).select("path", "start_line", "end_line", "symbol_name", "chunk_strategy", "score")


@query("o3_journal_union", f"WITH {SNAPSHOTS_SQL} SELECT d AS doc_id, count(*) AS n FROM (SELECT unnest(doc_ids) AS d FROM manifest UNION ALL SELECT unnest(doc_ids) FROM manifest WHERE doc_id % 2 = 0) GROUP BY d")
def journal_union(spark, sf_dir):
    m = snapshots(spark, sf_dir)[1]
    ids = m.select(F.explode("doc_ids").alias("doc_id")).unionByName(m.where("doc_id % 2 = 0").select(F.explode("doc_ids").alias("doc_id")))
    return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("x17_fences", rf"SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '^\s*(`{{3,}}|~{{3,}})')) AS opens, count(*) FILTER (starts_with(t, '|') OR ends_with(t, '|')) AS tables FROM (SELECT doc_id, line, {_TRIM.format('line')} AS t FROM (SELECT doc_id, unnest(string_split(CASE doc_id % 5 WHEN 0 THEN '  ```py' WHEN 1 THEN '~~' WHEN 2 THEN '| ' || source || ' |' WHEN 3 THEN source || ' | x' ELSE '~~~~' END || chr(10) || coalesce(text, ''), chr(10))) AS line FROM documents)) GROUP BY doc_id")
def fences(spark, sf_dir):
    """Lines, fences and table rows of all texts, each behind a planted line."""
    first = F.get(F.array(F.lit("  ```py"), F.lit("~~"), F.concat(F.lit("| "), "source", F.lit(" |")), F.concat("source", F.lit(" | x")), F.lit("~~~~")), F.pmod("doc_id", F.lit(5)).cast("int"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat(first, F.lit("\n"), F.coalesce("text", F.lit(""))), "\n", -1)).alias("line"))
    found = lines.select("doc_id", text.opens_fence(F.col("line")).alias("opens"), text.is_table_row(F.col("line")).alias("is_table"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("opens").alias("opens"), F.count_if("is_table").alias("tables"))


@query("x18_query_text", r"WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(10) || '  select ' || source || ', b from t ' WHEN 1 THEN 'selected x ' WHEN 2 THEN 'ВЫБРАТЬ Поле ИЗ Т ' ELSE '' END || coalesce(text, '') AS given FROM documents), f AS (SELECT doc_id, regexp_matches(given, '^\s*((?i:select)|ВЫБРАТЬ)(\s|$)') AS is_query, string_split_regex(regexp_extract(given, '^\s*(\S[^\n]*)', 1), '[\s,]+') AS fields FROM t) SELECT doc_id, is_query, CASE WHEN is_query AND len(fields) > 1 THEN fields[2] ELSE '' END AS name FROM f")
def query_text_names(spark, sf_dir):
    start = F.get(F.array(F.concat(F.lit("\n  select "), "source", F.lit(", b from t ")), F.lit("selected x "), F.lit("ВЫБРАТЬ Поле ИЗ Т "), F.lit("")), F.pmod("doc_id", F.lit(4)).cast("int"))
    given = F.concat(start, F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_query_text(given).alias("is_query"), text.query_name(given).alias("name"))


@query("p2_status", f"WITH {SNAPSHOTS_SQL}, {_COLLECTION} SELECT (SELECT count(*) FROM manifest) AS files, (SELECT sum(chunk_count) FROM manifest)::BIGINT AS chunks, (SELECT count(*) FROM c) AS doc_count")
def status(spark, sf_dir):
    manifest = snapshots(spark, sf_dir)[1]
    docs = stats.all_ids(manifest).where("doc_id NOT LIKE 'd1%\\\\_2'").agg(F.count(F.lit(1)).alias("doc_count"))
    return stats.manifest_stats(manifest).crossJoin(docs)  # one row each
