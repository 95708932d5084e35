"""Tables that change by rows: delta files in hashed partitions, a log with one commit for all tables, merged on read.

A table's rows lie in buckets by the hash of their path, or by a number of their own. A
transaction writes new rows as further files of the buckets concerned, and what goes as
vectors of paths: rows of these paths that were there before are dead. Nothing counts until one
small file with the next number is renamed into ``_log``, and it counts for all tables at once.
A reader folds the log up to a number and reads what it lists, so it sees one version
whatever is written meanwhile; a run that dies leaves files that nothing lists.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.index.snapshot import Files, Locked

#: Commits after which a whole state is written, so that no reader folds more than these.
CHECKPOINT = 32
#: What a row or a dead path was committed for: paths kill only what is older.
SEQ = T.StructField("seq", T.LongType())
WRAP = 1 << 64


class Conflict(Exception):
    """Another transaction changed the same buckets first."""


def reached(point: str) -> None:
    """Called between any two writes; tests stop runs here."""


@dataclass(frozen=True)
class Kind:
    """A table's schema, the column that names what replaces and deletes rows, and what its set digest is of."""

    schema: T.StructType
    ids: str
    key: str = "relative_path"
    #: An integer column that is the bucket; else buckets are by the hash of ``key``.
    bucket: str = ""


@dataclass
class State:
    """What a version consists of: by table the files of rows and of dead paths, and digests of the ids; radii by bucket; meta data."""

    version: int = 0
    tables: dict[str, dict[str, dict]] = field(default_factory=dict)
    digests: dict[str, list[int]] = field(default_factory=dict)
    radii: dict[str, float] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    journals: list[str] = field(default_factory=list)
    #: Commits since files were last packed.
    writes: int = 0

    def fold(self, c: dict) -> State:
        if c.get("wiped"):
            self.tables, self.digests, self.radii, self.meta = {}, {}, {}, {}
        for name, change in c["tables"].items():
            files = self.tables.setdefault(name, {})
            for path in change["remove"]:
                files.pop(path, None)
            files |= change["add"]
            held = self.digests.setdefault(name, [0, 0])
            held[0], held[1] = held[0] + change["digest"][0], (held[1] + change["digest"][1]) % WRAP
        if c["radii_anew"]:
            self.radii = {}
        for bucket, r in c["radii"].items():
            self.radii[bucket] = max(r, self.radii.get(bucket, 0.0))
        self.meta |= c["meta"]
        self.journals = [*self.journals, *c["journals"]][-100:]
        self.version, self.writes = c["version"], 0 if c["packed"] else self.writes + 1
        return self

    def files(self, table: str, kind: str, buckets: set[int] | None = None) -> dict[str, dict]:
        return {p: f for p, f in self.tables.get(table, {}).items() if f["kind"] == kind and (buckets is None or f["bucket"] in buckets)}


class Log(Locked):
    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, Kind], buckets: int = 64) -> None:
        self.spark, self.kinds, self.buckets, self.files = spark, kinds, buckets, Files(spark, root)

    # ---- reading

    def version(self) -> int:
        return max([0, *(int(n[:20]) for n in self.files.names("_log") if len(n) == 25 and n.endswith(".json"))])

    def state(self, version: int | None = None) -> State:
        v = self.version() if version is None else version
        names = [n for n in self.files.names("_log") if n.endswith(".checkpoint")]
        start = max([0, *(c for c in (int(n[:20]) for n in names) if c <= v)])
        out = State(**json.loads(self.files.read(f"_log/{start:020d}.checkpoint"))) if start else State()
        for n in range(start + 1, v + 1):
            out.fold(json.loads(self.files.read(f"_log/{n:020d}.json")))
        return out

    def _rows(self, schema: T.StructType, paths: dict[str, dict]) -> DataFrame:
        schema = T.StructType([*schema.fields, SEQ])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{p}" for p in sorted(paths)))

    def read(self, table: str, state: State | None = None, buckets: set[int] | None = None, seq: bool = False, only: set[str] | None = None) -> DataFrame:
        """A table's live rows, or those of some buckets or files. Buckets without dead paths are read as they are."""
        state, kind = state or self.state(), self.kinds[table]
        rows, gone = state.files(table, "rows", buckets), state.files(table, "gone", buckets)
        if only is not None:
            rows = {p: f for p, f in rows.items() if p in only}
        touched = {f["bucket"] for f in gone.values()}
        clean = {p: f for p, f in rows.items() if f["bucket"] not in touched}
        out = self._rows(kind.schema, clean)
        if len(clean) < len(rows):
            dead = self._rows(T.StructType([kind.schema[kind.key], T.StructField("bucket", T.IntegerType())]), gone)
            dead = dead.groupBy(kind.key, "bucket").agg(F.max("seq").alias("dead_seq")).withColumnsRenamed({kind.key: "dead_key", "bucket": "dead_bucket"})
            old = self._rows(kind.schema, {p: f for p, f in rows.items() if p not in clean})
            same = (old[kind.key] == dead["dead_key"]) & (self._bucket(kind, old) == dead["dead_bucket"]) & (old["seq"] < dead["dead_seq"])
            out = out.unionByName(old.join(dead, same, "left_anti")) if clean else old.join(dead, same, "left_anti")
        return out if seq else out.drop("seq")

    def _bucket(self, kind: Kind, df: DataFrame) -> Column:
        return df[kind.bucket].cast("int") if kind.bucket else F.pmod(F.xxhash64(df[kind.key]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table: str, keys: DataFrame) -> set[int]:
        """The buckets of keys: as many as the table has, at most."""
        kind = self.kinds[table]
        return {r["b"] for r in keys.select(self._bucket(kind, keys).alias("b")).distinct().collect()}

    def digest(self, table: str, rows: DataFrame) -> tuple[int, int]:
        """Count and sum of the hashes of the ids of rows, in no order: sums of parts add up, and go down by what is deleted."""
        one = rows.select(F.explode(F.expr(self.kinds[table].ids)).alias("id")).agg(F.count("id").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s")).first()
        return one["n"], int(one["s"] or 0) % WRAP

    # ---- writing

    def begin(self) -> Transaction:
        return Transaction(self, self.state())

    def pack(self, target_bytes: int = 128 << 20, tables: list[str] | None = None, least: int = 2) -> bool:
        """Packs files below half of ``target_bytes`` into bins of that size, within their bucket, and takes dead rows out; other files stay as they are."""
        t, found = self.begin(), False
        for table in tables or list(self.kinds):
            found |= t.repack(table, target_bytes, least)
        if found:
            t.commit(packed=True)
        return found

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files that neither the current version nor the ``keep`` before it list."""
        now = self.version()
        states = [self.state(v) for v in range(max(0, now - keep), now + 1)]
        listed = {p for s in states for files in s.tables.values() for p in files}
        stray = [p for p in self.files.below("data") if p not in listed]
        for p in stray:
            self.owned()
            self.files.delete(p)
        return len(stray)


class View:
    """One table of a log, as a reader sees it."""

    def __init__(self, log: Log, table: str) -> None:
        self.log, self.table, self.files, self.lock = log, table, log.files, log.lock

    def version(self) -> int:
        return self.log.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self.log.read(self.table, self.log.state(version))

    def count(self, state: State | None = None) -> int:
        """Ids of the live rows, from the log alone."""
        return (state or self.log.state()).digests.get(self.table, [0])[0]


class Transaction:
    """Changes of any of a log's tables that count together or not at all."""

    def __init__(self, log: Log, base: State) -> None:
        self.log, self.base, self.seq, self.id = log, base, base.version + 1, uuid.uuid4().hex
        self.tables: dict[str, dict] = defaultdict(lambda: {"add": {}, "remove": [], "digest": [0, 0]})
        self.radii: dict[str, float] = {}
        self.touched: set[tuple[str, int]] = set()
        self.wiped = self.radii_anew = False

    def _stage(self, table: str, kind: str, rows: DataFrame, low: int | None) -> set[str]:
        """Writes rows, which have a bucket, as files of this transaction."""
        folder = f"data/{self.id}/{table}-{kind}-{len(self.tables[table]['add'])}"
        rows.hint("rebalance", "bucket").withColumn("at", F.col("bucket")).write.partitionBy("at").parquet(f"{self.log.files.root}/{folder}")
        reached(f"{table} {kind}")
        made = {p: {"kind": kind, "bucket": int(p.split("/at=")[1].split("/")[0]), "size": n, "low": self.seq if low is None else low} for p, n in self.log.files.below(folder).items()}
        self.tables[table]["add"] |= made
        self.touched |= {(table, f["bucket"]) for f in made.values()}
        return set(made)

    def insert(self, table: str, rows: DataFrame) -> DataFrame:
        """Adds rows; returns them as they were written, so that nothing need be computed twice."""
        kind = self.log.kinds[table]
        rows = rows.select(*kind.schema.fieldNames())
        made = self._stage(table, "rows", rows.withColumns({"seq": F.lit(self.seq).cast("long"), "bucket": self.log._bucket(kind, rows)}), None)
        written = self.log._rows(kind.schema, dict.fromkeys(made, {})).drop("seq")
        self._count(table, self.log.digest(table, written), 1)
        return written

    def delete(self, table: str, keys: DataFrame) -> None:
        """Kills the rows of ``keys``: a column of the table's key, and of its bucket where rows have one of their own."""
        if self.wiped:
            return
        kind = self.log.kinds[table]
        keys = keys.select(*([kind.key, kind.bucket] if kind.bucket else [kind.key])).distinct()
        buckets = self.log.buckets_of(table, keys)
        if not buckets & {f["bucket"] for f in self.base.files(table, "rows").values()}:
            return
        held = self.log.read(table, self.base, buckets).join(keys, keys.columns, "left_semi")
        self._count(table, self.log.digest(table, held), -1)
        self._stage(table, "gone", keys.select(kind.key, F.lit(self.seq).cast("long").alias("seq"), self.log._bucket(kind, keys).alias("bucket")), None)

    def wipe(self) -> None:
        """All rows of all tables go."""
        self.wiped, self.base.tables, self.base.radii = True, {}, {}

    def replace(self, table: str, rows: DataFrame) -> DataFrame:
        """A table's rows and dead paths go, others come; returns these as they were written."""
        for p, f in self.base.tables.get(table, {}).items():
            self.tables[table]["remove"].append(p)
            self.touched.add((table, f["bucket"]))
        held = self.base.digests.get(table, [0, 0])
        self._count(table, (held[0], held[1]), -1)
        return self.insert(table, rows)

    def _count(self, table: str, digest: tuple[int, int], sign: int) -> None:
        held = self.tables[table]["digest"]
        held[0], held[1] = held[0] + sign * digest[0], (held[1] + sign * digest[1]) % WRAP

    def repack(self, table: str, target_bytes: int, least: int) -> bool:
        kind, by_bucket = self.log.kinds[table], defaultdict(dict)
        for p, f in self.base.files(table, "rows").items():
            by_bucket[f["bucket"]][p] = f
        gone = defaultdict(list)
        for p, f in self.base.files(table, "gone").items():
            gone[f["bucket"]].append((p, f["low"]))
        chosen, low, dropped = set(), {}, []
        for b, files in by_bucket.items():
            newest = max((seq for _, seq in gone[b]), default=0)
            dead = {p for p, f in files.items() if f["low"] < newest}
            small = {p for p, f in files.items() if f["size"] < target_bytes / 2}
            pick = dead | (small if len(small) >= least else set())
            if pick:
                chosen |= pick
                low[b] = min(files[p]["low"] for p in pick)
            dropped += [p for p, _ in gone[b]]
        dropped += [p for b, x in gone.items() if b not in by_bucket for p, _ in x]
        if not chosen and not dropped:
            return False
        if chosen:
            rows = self.log.read(table, self.base, set(low), seq=True, only=chosen)
            self._stage(table, "rows", rows.withColumn("bucket", self.log._bucket(kind, rows)), min(low.values()))
        self.touched |= {(table, b) for b in low}
        self.tables[table]["remove"] += [*sorted(chosen), *dropped]
        return True

    def commit(self, meta: dict | None = None, journals: list[str] | None = None, packed: bool = False) -> int:
        """Makes everything count under the next free number. Transactions in between that touched other buckets do no harm."""
        body = {"tables": dict(self.tables), "radii": self.radii, "meta": meta or {}, "journals": journals or [], "packed": packed, "wiped": self.wiped, "radii_anew": self.radii_anew}
        touched = sorted(self.touched)
        number = self.seq
        while True:
            self.log.owned()
            text = json.dumps({"version": number, "touched": touched, **body})
            reached("commit")
            if self.log.files.publish(f"_log/{number:020d}.json", text):
                break
            other = json.loads(self.log.files.read(f"_log/{number:020d}.json"))
            if self.wiped or other["wiped"] or self.touched & {tuple(x) for x in other["touched"]}:
                raise Conflict(f"version {number} changed the same buckets")
            number += 1
        reached("committed")
        if number % CHECKPOINT == 0:
            self.log.files.write(f"_log/{number:020d}.checkpoint", json.dumps(vars(self.log.state(number))))
        return number
