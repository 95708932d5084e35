"""The engine: index files incrementally, search them, and say how things stand."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.chunkers.common import Options
from trawl.chunkers.router import Routing, chunk_files
from trawl.functions import vectors
from trawl.functions.paths import matches_glob
from trawl.functions.text import embed_text, error_class
from trawl.index import inverted
from trawl.index.embed import Embedder, embedder_of, with_embeddings
from trawl.index.log import Kind, Log, State, Transaction, View, reached
from trawl.index.requests import Progress
from trawl.index.snapshot import STALE, read_json, write_json
from trawl.operators import changes, rerank, stats
from trawl.operators.windows import rejection
from trawl.sources.config import Settings
from trawl.sources.files import Journal

_s, _l, _i = T.StringType(), T.LongType(), T.IntegerType()
CHUNK = T.StructType(
    [T.StructField(c, t) for c, t in [("doc_id", _s), ("relative_path", _s), ("start_line", _l), ("end_line", _l), ("chunk_type", _s), ("name", _s), ("snippet", _s), ("symbol_name", _s), ("symbol_kind", _s), ("parent_scope", _s), ("chunk_strategy", _s), ("chunk_index", _i), ("cell", _i), ("embedding", T.ArrayType(T.FloatType()))]]
)
MANIFEST = T.StructType([T.StructField(c, t) for c, t in [("relative_path", _s), ("mtime_ns", _l), ("size", _l), ("chunk_count", T.IntegerType()), ("doc_ids", T.ArrayType(_s)), ("content_hash", _s)]])
CELL = T.StructType([CHUNK["cell"], CHUNK["doc_id"], CHUNK["relative_path"], *inverted.CODED[1:], CHUNK["embedding"]])
KINDS = {"chunks": Kind(CHUNK, "array(doc_id)"), "manifest": Kind(MANIFEST, "doc_ids"), "cells": Kind(CELL, "array(doc_id)", bucket="cell")}
HIT = ["path", "start_line", "end_line", "chunk_type", "snippet", "symbol_name", "symbol_kind", "parent_scope", "chunk_strategy", "score"]
FORMAT = 2
#: Commits after which small files are packed, and after which files that nothing lists are deleted; rows that are taken as
#: queries to see how many cells a search needs.
WRITES, VACUUM, TUNED_ON = 256, 16, 200


class IdentityMismatch(Exception):
    """The index on disk was made for another workspace, embedder or chunking."""


@dataclass(frozen=True)
class Identity:
    workspace_id: str
    collection_id: str
    profile: str
    dims: int
    strategy: str
    fingerprint: str

    @property
    def name(self) -> str:
        owner = self.collection_id or self.workspace_id
        return "ws_" + hashlib.sha256(f"{owner}:{self.profile}:{self.dims}".encode()).hexdigest()[:16]


def chunking_fingerprint(opts: Options, routing: Routing) -> str:
    languages = ";".join(f"{x}:1/{int(routing.include_queries)}" for x in sorted(routing.languages))
    return hashlib.sha256(f"min={opts.min_tokens};overlap={opts.overlap_ratio:.6f};prefix={opts.prefix};{languages}".encode()).hexdigest()[:16]


def mismatch(meta: dict, now: Identity) -> str:
    """The first thing in which an index's meta data differ, or ''. A collection id, if both have one, decides on ownership."""
    if meta.get("collection_id") and now.collection_id:
        if meta["collection_id"] != now.collection_id:
            return "collection_id"
    elif meta.get("workspace_id") != now.workspace_id:
        return "workspace_id"
    for k in ("profile", "dims", "format", "strategy"):
        if meta.get(k) != (FORMAT if k == "format" else getattr(now, k)):
            return k
    return "fingerprint" if meta.get("fingerprint") and meta["fingerprint"] != now.fingerprint else ""


def _best_effort(action: Callable[[], object]) -> None:
    """Upkeep that may fail without harm to what was written."""
    try:
        action()
    except Exception as e:
        logging.getLogger(__name__).warning("upkeep of the index failed: %s", e)


class IndexingFailed(Exception):
    """A run met an error that is not one file's."""


class Engine:
    """An index of one workspace in one folder."""

    def __init__(self, spark: SparkSession, root: str, workspace_id: str, embedder: Embedder, opts: Options | None = None, routing: Routing | None = None, collection_id: str = "") -> None:
        self.spark, self.embedder = spark, embedder
        self.opts, self.routing = opts or Options(), routing or Routing()
        self.identity = Identity(workspace_id, collection_id, embedder.profile, embedder.dims, self.routing.strategy, chunking_fingerprint(self.opts, self.routing))
        self.base = f"{root.rstrip('/')}/{self.identity.name}"
        self.log = Log(spark, self.base, KINDS)
        self.chunks, self.manifest = View(self.log, "chunks"), View(self.log, "manifest")
        self.files, self.latency, self.rejected = self.log.files, [], None
        self.read_files: tuple[int, int] = (0, 0)

    @classmethod
    def of_settings(cls, spark: SparkSession, root: str, workspace_id: str, s: Settings, environment: Mapping[str, str] | None = None) -> Engine:
        """An engine as settings say: the embedder, chunking, routing."""
        opts = Options(embed_ratio=s.embed_ratio, overlap_ratio=s.prose_overlap, prefix=s.context_prefix, min_tokens=s.min_chunk_tokens, window_lines=s.window_lines, overlap_lines=s.overlap_lines)
        return cls(spark, root, workspace_id, embedder_of(s, environment), opts, Routing(strategy=s.strategy))

    def _meta(self) -> dict | None:
        """The meta data of what counts: they are written before the commit, so those of a run that died are passed over."""
        meta, now = read_json(self.files, "META.json"), self.log.version()
        return self.log.state().meta or None if meta and meta.get("version", 0) > now else meta

    # ---- indexing

    def reindex(self, files: DataFrame, force: bool = False) -> dict:
        """Brings the index in step with ``files`` (relative_path, mtime_ns, size, content_hash, content).

        Only new and changed files are chunked and embedded, and only their buckets get new
        files. All tables change in one commit; a run that dies before leaves the old version,
        and what it was about to delete stands in a journal, which the next run carries out. A
        file that cannot be chunked or embedded is listed in ``rejected`` and keeps its old rows;
        an error that is not one file's ends the run. A run with nothing to do writes nothing. An
        index of another format, or without meta data, is built anew.
        """
        with self.log.lock():
            meta = self._meta()
            found = mismatch(meta, self.identity) if meta else ""
            if found == "format" or (not meta and self.log.version()):
                force = True  # made by another version of the engine, or left without meta data: built anew
            elif found and not force:
                raise IdentityMismatch(found)
            if meta and not force and self.desync():
                force = True
            progress = Progress(running=True, started=time.time())
            progress.save(self.files)
            try:
                report = self._run(files, force, meta, progress)
                progress.running = False
            except Exception as e:
                progress.running, progress.error = False, str(e)[:500]
                raise
            finally:
                _best_effort(lambda: progress.save(self.files))
            return report

    def _run(self, files: DataFrame, force: bool, meta: dict | None, progress: Progress) -> dict:
        t = self.log.begin()
        journals = self._journals(t.base)
        if force:
            t.wipe()
        known = self.log.read("manifest", t.base)
        for journal in journals:  # what an earlier run had begun to delete is not known any more
            known = known.join(journal.pending(), "relative_path", "left_anti")
        stat = files.select("relative_path", "mtime_ns", "size", "content_hash", rejection().alias("reason")).cache()
        status = changes.incremental_diff(stat.where("reason IS NULL"), known).join(stat, "relative_path", "left").cache()
        try:
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            report = {s: counts.get(s, 0) for s in ("new", "changed", "unchanged", "removed")}
            progress.files_total, progress.files_done = sum(report.values()), report["unchanged"]
            progress.save(self.files)
            written = force or bool(journals) or report["new"] + report["changed"] + report["removed"] > 0
            if written:
                self._write(t, files, status, journals, meta, progress)
            self._reject(stat.where("reason IS NOT NULL").select("relative_path", "reason"), t.id if written else "")
        finally:
            status.unpersist()
            stat.unpersist()
        if not written:
            return report | {"written": False}
        for journal in journals:
            _best_effort(journal.clear)
        _best_effort(self._upkeep)
        return report | {"written": True}

    def _write(self, t: Transaction, files: DataFrame, status: DataFrame, journals: list[Journal], meta: dict | None, progress: Progress) -> None:
        todo = files.join(status.where("status IN ('new', 'changed')").select("relative_path"), "relative_path", "left_semi")
        made = chunk_files(todo, self.opts, self.routing, errors=True)
        text = embed_text(F.col("relative_path"), F.col("parent_scope"), F.col("snippet"), self.opts.prefix)
        staged = f"{self.base}/data/{t.id}/staged"
        with_embeddings(made.withColumn("embed_text", text), "embed_text", self.embedder, error_col="error").write.parquet(staged)
        reached("staged")
        rows = self.spark.read.parquet(staged)  # chunked and embedded once, whatever is done with it
        bad = self._failed(t, rows, progress)
        rows = rows.join(bad, "relative_path", "left_anti")
        gone = status.where("status IN ('changed', 'removed')").select("relative_path").join(bad, "relative_path", "left_anti")
        for journal in journals:
            gone = gone.unionByName(journal.pending())
        own = Journal(self.spark, f"{self.base}/journal/{t.id}", "relative_path")
        if not t.wiped:
            own.append(gone)
            reached("journal")
            places = self.log.read("chunks", t.base, self.log.buckets_of("chunks", gone)).join(gone.distinct(), "relative_path", "left_semi")
            t.delete("cells", places.where("cell IS NOT NULL").select("relative_path", "cell"))
            t.delete("chunks", gone)
            t.delete("manifest", gone)
        centroids = None if t.wiped else self._centroids(t.base)
        if centroids is None:
            rows = rows.withColumn("cell", F.lit(None).cast("int"))
        else:
            rows = inverted.assigned(rows, "embedding", centroids)
            t.radii = inverted.radii(t.insert("cells", rows))
        t.insert("chunks", rows)
        ids = stats.ids_in_order(rows.select("relative_path", "chunk_index", "doc_id"))
        stat = status.where("status IN ('new', 'changed')").select("relative_path", "mtime_ns", "size", "content_hash").join(bad, "relative_path", "left_anti")
        listed = stat.join(ids, "relative_path", "left").withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>"))})
        t.insert("manifest", listed.select(*MANIFEST.fieldNames()))  # files without chunks, too: they are not new next time
        now = datetime.now(UTC).isoformat()
        meta = vars(self.identity) | {"format": FORMAT, "created_at": (meta or {}).get("created_at", now), "updated_at": now, "version": t.seq}
        write_json(self.files, "META.json", meta)
        reached("meta")
        t.commit(meta=meta, journals=[j.path.rsplit("/", 1)[1] for j in journals] + [t.id])
        progress.files_done = progress.files_total
        _best_effort(own.clear)
        _best_effort(lambda: self.files.delete(staged.removeprefix(f"{self.base}/")))

    def _failed(self, t: Transaction, rows: DataFrame, progress: Progress) -> DataFrame:
        """(relative_path) of the files whose rows hold an error; raises if one of them is not a file's own."""
        errors = rows.where("error IS NOT NULL")
        worst = errors.where(error_class(F.col("error")) != "skippable").select("relative_path", "error").first()
        if worst is not None:
            raise IndexingFailed(f"{worst['relative_path']}: {worst['error']}")
        failed = errors.groupBy("relative_path").agg(F.min("error").alias("reason"))
        for r in failed.orderBy("relative_path").limit(20).collect():
            progress.add_failed(r["relative_path"])
        failed.write.parquet(f"{self.base}/rejected/{t.id}")
        return failed.select("relative_path")

    def _reject(self, rows: DataFrame, run: str) -> None:
        """The rejected files of this run, in a table that takes the place of the last one's."""
        before = set(self.files.names("rejected"))
        if not run and not before and rows.isEmpty():  # nothing to write, nothing to take the place of
            self.rejected = self.spark.createDataFrame([], "relative_path string, reason string")
            return
        path = f"{self.base}/rejected/{run or 'sizes'}"
        rows.write.mode("append" if run else "overwrite").parquet(path)
        for name in before - {run or "sizes"}:
            self.files.delete(f"rejected/{name}")
        self.rejected = self.spark.read.schema("relative_path string, reason string").parquet(path)

    def _journals(self, state: State) -> list[Journal]:
        """Journals of runs that died before their commit; those of committed runs are cleared."""
        out = []
        for name in self.files.names("journal"):
            if name in state.journals or not self.files.exists(f"journal/{name}/_SUCCESS"):
                self.files.delete(f"journal/{name}")  # carried out, or never finished, so that nothing was deleted by it
            else:
                out.append(Journal(self.spark, f"{self.base}/journal/{name}", "relative_path"))
        return out

    def _upkeep(self) -> None:
        writes = self.log.state().writes
        if writes >= WRITES:
            self.log.pack()
        if writes >= WRITES or writes % VACUUM == 0:
            self.log.vacuum()

    def desync(self) -> bool:
        """Whether the manifest names other chunks than the collection holds: by digests of both sets that every commit carries on."""
        state = self.log.state()
        chunks, named = (state.digests.get(t, [0, 0]) for t in ("chunks", "manifest"))
        return bool(state.version) and list(chunks) != list(named)

    def verified(self) -> bool:
        """As ``not desync()``, from the rows themselves."""
        state = self.log.state()
        return all(list(self.log.digest(t, self.log.read(t, state))) == list(state.digests.get(t, [0, 0])) for t in ("chunks", "manifest"))

    # ---- the index for nearest neighbours

    def build_index(self, cells: int = 0, target: float = 0.95) -> dict:
        """Learns centroids and puts every chunk into its cell, in one commit; later runs keep the cells in step.

        Returns the number of cells, how many a search looks in so that it finds ``target`` of
        the ten nearest chunks, and the recall measured on ``TUNED_ON`` chunks.
        """
        with self.log.lock():
            meta, t = self._meta(), self.log.begin()
            rows = self.log.read("chunks", t.base)
            centroids = inverted.learn(rows, "doc_id", "embedding", self.embedder.dims, cells)
            name = f"data/{t.id}/centroids.json"
            write_json(self.files, name, {"centroids": centroids.tolist()})
            placed = inverted.assigned(rows.drop("cell"), "embedding", centroids)
            fresh = t.replace("cells", placed)
            t.replace("chunks", placed)
            t.radii, t.radii_anew = inverted.radii(fresh), True
            numbered = fresh.select("cell", "scale", "code", "embedding", F.xxhash64("doc_id").alias("number"))
            asked = numbered.orderBy("number").limit(TUNED_ON).select(F.col("number").alias("query_id"), "embedding")
            probes, recall = inverted.tuned(numbered, asked, inverted.Cells(centroids, t.radii), 10, target, id_col="number")
            meta = (meta or {}) | {"version": t.seq, "centroids": name, "probes": probes, "recall": recall}
            write_json(self.files, "META.json", meta)
            t.commit(meta=meta)
            return {"cells": len(centroids), "probes": probes, "recall": recall}

    def _centroids(self, state: State) -> np.ndarray | None:
        name = state.meta.get("centroids")
        return np.array(read_json(self.files, name)["centroids"]) if name and state.tables.get("cells") else None

    # ---- searching

    def search(self, query: str, limit: int = 0, path_glob: str | None = None, top_k: int | None = None, exact: bool = True) -> DataFrame:
        """The best hits of a query: nearest chunks under the glob, more than asked for, then reranked.

        With an index only cells that can hold a hit are read, or, without ``exact``, the nearest
        as many as its recall was measured with; ``read_files`` says how many files of all.
        """
        limit = rerank.normal_limit(limit, top_k)
        state = self.log.state()
        if not query.strip():
            return self.log.read("chunks", state).withColumnRenamed("relative_path", "path").limit(0).withColumn("score", F.lit(0.0)).select(*HIT)
        began = time.monotonic()
        vector, k = self.embedder.embed([query])[0], rerank.over_fetch(limit)
        near = self._near(state, vector, k, matches_glob(F.col("relative_path"), path_glob), exact)
        hits = rerank.rerank(near.withColumnRenamed("relative_path", "path").drop("embedding"), query, limit).select(*HIT)
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # at most ``limit`` rows; the latency is that of the whole search
        self.latency = [*self.latency, (time.monotonic() - began) * 1000][-20:]
        return hits

    def _near(self, state: State, vector: list[float], k: int, only: Column, exact: bool) -> DataFrame:
        centroids = self._centroids(state)
        total = len(state.files("chunks", "rows"))
        if centroids is None or not any(vector):
            self.read_files = (total, total)
            return vectors.nearest(self.log.read("chunks", state), vector, k, "embedding", "doc_id", only)
        cells = inverted.Cells(centroids, state.radii)
        x = np.array([vector]) / np.linalg.norm(vector)
        near = lambda b: vectors.nearest(self.log.read("cells", state, b), vector, k, "embedding", "doc_id", only).select("doc_id", "relative_path", "score").collect()
        chosen = {int(c) for c in cells.nearest(x, max(1, state.meta.get("probes", 1)))[0]}
        found = near(chosen)  # k rows
        if exact:
            farthest = found[-1]["score"] if len(found) == k else 4.0
            more = {int(c) for c in np.flatnonzero(cells.possible(x, np.array([farthest]))[0])} - chosen
            if more:
                found = sorted([*found, *near(more)], key=lambda r: (r["score"], r["doc_id"]))[:k]
                chosen |= more
        self.read_files = (len(state.files("cells", "rows", chosen)), len(state.files("cells", "rows")))
        scores = self.spark.createDataFrame(found, "doc_id string, relative_path string, score double").select("doc_id", "relative_path", "score")
        rows = self.log.read("chunks", state, self.log.buckets_of("chunks", scores)).where(F.col("doc_id").isin([r["doc_id"] for r in found]))
        return rows.join(F.broadcast(scores.drop("relative_path")), "doc_id")  # k rows

    # ---- status

    def status(self) -> dict:
        state, progress = self.log.state(), Progress.load(self.files)
        m = stats.manifest_stats(self.log.read("manifest", state)).first()
        docs, failed = self.chunks.count(state), self.rejected.count() if self.rejected is not None else len(progress.failed_files)
        warned = self.spark.range(1).select(stats.diagnostics(F.lit(m["chunks"]), F.lit(docs), F.lit(failed), F.lit(0)).alias("w")).first()["w"]
        return {"files": m["files"], "chunks": m["chunks"], "doc_count": docs, "collection": self.identity.name, "version": state.version, "warnings": warned, "slow_search": self.slow_search(), "ready": self.ready()[0], "indexing": progress.running, "percent": progress.percent, "stalled": progress.stalled(time.time()), "failed_files": progress.failed_files, "last_error": progress.error, "writes_since_packed": state.writes, "probes": state.meta.get("probes", 0)}

    def slow_search(self) -> str:
        """Why the last search counts as slow, '' if it does not or there was none."""
        if not self.latency:
            return ""
        samples = self.spark.createDataFrame(list(enumerate(self.latency)), "seq long, ms double")  # 20 at most
        last = stats.rolling_latency(samples).orderBy(F.desc("seq")).first()
        return last["reason"] if last["degraded"] else ""

    def ready(self) -> tuple[bool, str]:
        """Whether a search can be answered, else what is missing."""
        if self.files.exists("LOCK") and self.files.age("LOCK") <= STALE:
            return False, "indexing"
        meta = self._meta()
        if not meta or not self.log.version():
            return False, "no index"
        found = mismatch(meta, self.identity)
        if found:
            return False, f"identity: {found}"
        if len(self.embedder.embed(["ready"])[0]) != self.embedder.dims:
            return False, "embedder"
        return True, ""
