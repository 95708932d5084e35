"""Phrase collocations: word sequences that stand together far more often than their parts would by chance.

Texts become chunks of word numbers once. Sequences of 1, 2 and more words are then exploded
into rows (language, phrase, count), one for each distinct sequence of a chunk, and summed by
Spark; on their way through the shuffle the rows of a chunk and bucket are lines of one text. A sequence that occurs often enough has only parts that do, so sequences of two
words are exploded where both words may be frequent, longer ones where all their pairs may
be. What may be is said by a bitmap of fixed size: a stray bit costs rows, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.shared import materialise, release, struct, table, width
from trawl.llm.word_chunks import Unsqueezed, squeeze

#: Words after which a chunk ends, at the next end of a piece; bytes of a text that are split at once.
CHUNK_WORDS, SLICE = 3_000_000, 1 << 20
#: Bits of the filter of frequent sequences (8 MB, whatever the data), and of one row of it (Spark's own width).
SLOTS, BITMAP = 1 << 26, 32_768
#: Stands between pieces; no word is equal to it, since it ends a piece itself.
BREAK = b"."
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(BREAK[0] if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Buckets for each shuffle partition, so that hashed buckets lie evenly.
BUCKETS_EACH = 2

ROWS = struct(lang="string", bucket="long", phrases="binary", times="string")


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z), BREAK between pieces, a slice of the text at a time."""
    raw = raw.translate(_TABLE).replace(BREAK, b" . ")
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class _Chunk:
    """Texts of one language as numbers of their words; number 0 is BREAK."""

    def __init__(self, words: list[bytes] = ()) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[BREAK]
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.add(list(words))

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def cut(self) -> list[bytes]:
        """Takes off what follows the last BREAK of the last slice, and returns it."""
        breaks = np.flatnonzero(self.ids[-1] == 0)
        if not len(breaks):
            return []
        rest, names = self.ids[-1][breaks[-1] + 1 :], list(self.numbers)
        self.ids[-1] = self.ids[-1][: breaks[-1] + 1]
        return [names[i] for i in rest.tolist()]

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS and bool((self.ids[-1] == 0).any())

    def packed(self) -> tuple[int, int, bytes]:
        """Numbers by falling frequency, since these compress."""
        ids, names = np.concatenate(self.ids), list(self.numbers)
        times = np.bincount(ids, minlength=len(names))
        order = np.concatenate([[0], 1 + np.argsort(-times[1:], kind="stable")])
        rank = np.empty(len(names), np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        names = [names[i] for i in order.tolist()]
        return len(ids), len(names), squeeze(rank[ids], np.fromiter(map(len, names), np.uint32, len(names)), b"".join(names))


def chunks_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, m, blob): chunks of ``docs`` in one language each; null texts are empty, a null language is 'und'."""
    schema = struct(lang="string", n="long", m="long", blob="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Chunk] = {}

        def row(lang: str) -> pa.RecordBatch:
            n, m, blob = open_.pop(lang).packed()
            return pa.RecordBatch.from_pydict({"lang": [lang], "n": [n], "m": [m], "blob": [blob]}, schema=_arrow(schema))

        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                chunk = open_.setdefault(lang, _Chunk())
                for words in words_of(batch.column(1)[i].as_py()):
                    chunk.add(words)
                    if chunk.full():
                        rest = chunk.cut()
                        yield row(lang)
                        chunk = open_[lang] = _Chunk(rest)
                chunk.add([BREAK])
        for lang in list(open_):
            yield row(lang)
        release()

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text")).mapInArrow(run, schema)


def _arrow(schema) -> pa.Schema:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """The chunks of a task: language, numbers, words."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, n, m, blob = (batch.column(k)[i].as_py() for k in range(4))
            box = Unsqueezed(blob)
            ids, ends = box.array(n, np.uint32).astype(np.int64), np.cumsum(box.array(m, np.uint32)).tolist()
            raw = box.rest()
            yield lang, ids, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _batches(lang: str, phrases: list[bytes], f: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases, in order, packed as lines of one text for each of the buckets ``at``: neighbours are alike, so that these compress."""
    order = np.argsort(at, kind="stable")
    buckets, cuts = np.unique(at[order], return_index=True)
    rows = [order[a:b].tolist() for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]
    texts, times = [b"\n".join(map(phrases.__getitem__, r)) for r in rows], [" ".join(map(str, f[r].tolist())) for r in rows]
    for k in range(0, len(rows), 500):
        n = len(rows[k : k + 500])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(buckets[k : k + n], pa.int64()), pa.array(texts[k : k + n], pa.binary()), pa.array(times[k : k + n], pa.string())], schema=_arrow(ROWS))


def _summed(rows: DataFrame, parts: int) -> DataFrame:
    """(lang, phrase, f) of packed rows; what is alike lies in one bucket, and a frequent phrase is a line a chunk."""
    pairs = F.arrays_zip(F.split(F.col("phrases").cast("string"), "\n", -1).alias("phrase"), F.split("times", " ").alias("f"))
    lines = rows.repartition(parts, "bucket").select("bucket", "lang", F.inline(pairs))
    return lines.groupBy("bucket", "lang", "phrase").agg(F.sum(F.col("f").cast("long")).alias("f")).drop("bucket")


def word_counts(chunks: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words; the row of each language whose phrase is empty counts all its words."""
    parts = width(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _opened(batches):
            times = np.bincount(ids, minlength=len(words))
            times[0] = times[1:].sum()
            order = np.array(sorted(range(1, len(words)), key=words.__getitem__), np.int64)
            order = np.insert(order, 0, 0)
            at = (_mixed([_hashes(lang, words)]) % np.uint64(parts * BUCKETS_EACH))[order]
            at[0] = 0
            yield from _batches(lang, [b"", *(words[i] for i in order[1:].tolist())], times[order], at.astype(np.int64))
        release()

    return _summed(chunks.mapInArrow(run, ROWS), parts)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences, given those of their first, second, ... words."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(35)
    return h


def _slots(parts: list[np.ndarray]) -> np.ndarray:
    return (_mixed(parts) % np.uint64(SLOTS)).astype(np.int64)


def _filter(frequent: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Which slots a frequent sequence has: a bitmap of fixed size, broadcast, so that its size never follows the data."""
    spark = frequent.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shape: defaultdict[tuple, list] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = phrase.split(b" ")
                by_shape[lang, len(words)].append(words)
            for (lang, _), rows in by_shape.items():
                yield pa.RecordBatch.from_arrays([pa.array(_slots([_hashes(lang, list(w)) for w in zip(*rows, strict=True)]))], names=["slot"])

    slots = frequent.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, struct(slot="long"))
    maps = slots.groupBy(F.expr(f"slot div {BITMAP}").alias("at")).agg(F.expr(f"bitmap_construct_agg(slot % {BITMAP})").alias("bits"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in maps.collect():  # SLOTS / BITMAP rows of 4 KB at most
        bits[r["at"] * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    return lambda at: (sent.value[at >> 3] >> (at & 7) & 1).astype(bool)


def sequence_counts(chunks: DataFrame, frequent: DataFrame, size: int, longest: int) -> DataFrame:
    """(lang, phrase, f) of sequences of ``size`` + 1 to ``longest`` words whose parts of ``size`` words may all be in ``frequent``.

    Counts are exact: within a chunk sequences are told apart by number, between chunks by text.
    """
    may_be, parts = _filter(frequent), width(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _opened(batches):
            if len(ids) <= size:
                continue
            h, m = _hashes(lang, words), np.int64(len(words))
            ok = ids != 0
            if size == 1:
                ok = (may_be(_slots([h])) & (np.arange(len(words)) > 0))[ids]
            else:
                for k in range(1, size):
                    ok = ok[:-1] & (ids[k:] != 0)
                at = np.flatnonzero(ok)
                ok[at] = may_be(_slots([h[ids[at + k]] for k in range(size)]))
            code, n = _numbered(ids, ok, size, m), size
            while n < longest and len(ok) > 1:
                n += 1
                ok = ok[:-1] & ok[1:]
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                _, first, back, f = np.unique(code[at] * m + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                columns = [ids[at[first] + k] for k in range(n)]
                lines = list(map(b" ".join, zip(*(map(words.__getitem__, c.tolist()) for c in columns), strict=True)))
                bucket = _mixed([h[c] for c in columns]) % np.uint64(parts * BUCKETS_EACH)
                yield from _batches(lang, lines, f, bucket.astype(np.int64))
                code = np.zeros(len(ok), np.int64)
                code[at] = back
        release()

    return _summed(chunks.mapInArrow(run, ROWS), parts)


def _numbered(ids: np.ndarray, ok: np.ndarray, size: int, m: np.int64) -> np.ndarray:
    """Numbers that tell sequences of ``size`` words at the places ``ok`` apart."""
    at, code = np.flatnonzero(ok), ids[: len(ok)].copy()
    for k in range(1, size):
        code[at] = np.unique(code[at] * m + ids[at + k], return_inverse=True)[1]
    return code


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and
    tabs into words. A phrase with ``a`` occurrences, ``least`` or more, is scored by the cut
    into two parts that makes its score floor(1000 a n / (l r)) least; l and r count its parts,
    n all words of the language; ties go to the shortest first part. Phrases that stand in a
    longer candidate with as many occurrences are left out. Ranks go by score, count and phrase.

    Null texts are empty, null languages are 'und'; texts of blanks, empty texts and empty
    tables have no phrases; repeated rows count as often as they occur; other columns, whatever
    their names, are not looked at. Texts of any length are split in slices.
    """
    chunks = materialise(chunks_of(docs, text_col, lang_col), "collocation-chunks", "uncompressed")
    counted = materialise(word_counts(chunks).where((F.col("phrase") == "") | (F.col("f") >= least)), "collocation-words")
    totals, found = counted.where("phrase = ''").select("lang", F.col("f").alias("n")), [counted.where("phrase <> ''")]
    for size, high in ((1, min(2, longest)), (2, longest)):
        if high > size:
            counts = sequence_counts(chunks, found[-1], size, high)
            found.append(materialise(counts.where(F.col("f") >= least), "collocations"))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    words = F.split("phrase", " ")
    candidates = known.withColumn("words", words).where(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("front"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("back"))
    fronts = known.select("lang", F.col("phrase").alias("front"), F.col("f").alias("l"))
    backs = known.select("lang", F.col("phrase").alias("back"), F.col("f").alias("r"))
    scored = cuts.join(fronts, ["lang", "front"]).join(backs, ["lang", "back"]).join(totals, "lang")
    a, l, r, n = (F.col(c).cast("decimal(16,0)") for c in "alrn")  # 38 digits hold the products
    scored = scored.withColumns({"above": a * n * F.lit(1000).cast("decimal(4,0)"), "below": l * r}).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    longer = candidates.where(F.size("words") > 2)
    shorter = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))
    inside = longer.select("lang", F.col("f").alias("a"), F.explode(shorter).alias("words")).select("lang", F.array_join("words", " ").alias("phrase"), "a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(inside, ["lang", "phrase", "a"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of all ``documents``."""
    return phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents
), starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase FROM starts, range(1, 6) AS sizes(m) WHERE i + m - 1 <= len(words)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, f AS a FROM counts WHERE m > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates e WHERE e.lang = b.lang AND e.a >= b.a AND e.phrase <> b.phrase AND contains(' ' || e.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept) WHERE rank <= 2000"""
}
