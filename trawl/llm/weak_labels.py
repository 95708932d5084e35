"""Quality classifier: weak labels by expectation-maximisation, and a hashed linear scorer.

Overlapping labellers vote keep, reject or nothing on each document: heuristics on its form, a
list of insults, and a lexicon of words and word stems that one half of the curated rows shows
to stand in rejected documents only. What is counted over all documents is how often each
pattern of votes occurs; expectation-maximisation on these counts alone estimates how each
labeller votes on documents of either class, and so the posterior of every pattern. Posteriors,
weighted by how sure they are, train a linear scorer on hashed words, word stems and votes, on
about ``TRAIN_ROWS`` of all rows. Curated labels are no targets: their other half, which no
labeller has seen, says at which score rejects are right. All documents are scored.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import materialise, release, struct, table

#: The bounds on the rows that the scorer is trained on and on the curated rows that are used, about; weights of the scorer.
TRAIN_ROWS, WEIGHTS = 20_000, 1 << 18
#: Reject precision that the scorer's threshold must reach on curated rows held out. Where no threshold does, nothing is rejected.
PRECISION, NEVER = 0.995, 2.0
#: Share of rejected rows among those that hold a word of the lexicon, at least; words that chance may bring in, about; words of the lexicon that call for a vote.
LEXICON_RATE, LEXICON_CHANCE, LEXICON_HITS = 0.98, 0.1, 2
#: Share of good documents that any labeller rejects, at most: what labellers of extremes are taken to be worth, without which
#: those that look for a fault of their own would be counted as the mark of a kind of good documents.
FALSE_REJECTS = 0.003
#: Insults that the toxicity labeller knows, in four languages.
INSULTS = frozenset({
    "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless",
    "abruti", "crétin", "débile", "dégoûtant", "imbécile", "minable", "ordure", "pathétique", "stupide",
    "abschaum", "dumm", "ekelhaft", "erbärmlich", "idioten", "trottel", "versager", "wertlos",
    "asqueroso", "basura", "escoria", "estúpido", "idiota", "imbécil", "inútil", "patético",
})
LABELLERS = ("symbols", "tables", "shouting", "repeated_words", "runs", "repeated_lines", "insults", "lexicon")
KEEP, NONE, REJECT = 0, 1, 2

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"([^\w\s])\1\1")
#: For texts as UTF-8, where bytes below 128 are characters: capitals, all of ASCII, a table that puts spaces for what is no letter, and one that puts 0 for what is no symbol (255 for 0, which is one).
_CAPITALS, _ASCII = bytes(range(65, 91)), bytes(range(128))
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MARKS = bytes(b or 255 if b < 128 and re.match(r"[^\w\s]", chr(b)) else 0 for b in range(256))


def _vote(value: float, clean: float, bad: float) -> int:
    return REJECT if value >= bad else KEEP if value <= clean else NONE


def _sorted(values: np.ndarray) -> np.ndarray:
    """The different values, ascending; sorts ``values``."""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _others(raw: bytes) -> str:
    """The characters outside ASCII of a text in UTF-8."""
    return raw.translate(None, _ASCII).decode()


def _triples(raw: bytes) -> bool:
    """Whether a symbol of ASCII stands three times in a row."""
    a = np.frombuffer(raw.translate(_MARKS), np.uint8)
    return bool(((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & (a[2:] != 0)).any())


def words_of(text: str) -> list[str]:
    """``_WORD.findall`` of the lower-cased text, by table where what stands outside ASCII are letters, as most of it is."""
    low = text.lower()
    raw = low.encode()
    others = _others(raw)
    if others and not others.isalpha():
        return _WORD.findall(low)
    return raw.translate(_LETTERS).decode().split()


def votes(text: str, words: list[str], kinds: set[str], lexicon: frozenset[int] = frozenset(), terms: np.ndarray | None = None) -> tuple[int, ...]:
    """One vote of each labeller. ``words``: the lower-cased words of letters; ``kinds``: the different ones; ``terms``: hashes of these and of stems."""
    n = len(words)
    if not n:
        return (NONE,) * len(LABELLERS)
    raw = text.encode()
    others = _others(raw)
    tokens = text.count(" ") + text.count("\n") + 1
    symbols = len(_SYMBOLS.findall(text)) if others and not others.isalpha() or _triples(raw) else 0
    lines = [x for x in text.split("\n") if x.strip()]
    capitals = (len(raw) - len(raw.translate(None, _CAPITALS)) + sum(map(str.isupper, others))) / max(1, sum(map(len, words)))
    longest = 1 + max(map(len, bytes(map(operator.eq, words, islice(words, 1, None))).split(b"\0"))) if n >= 20 else 1
    return (
        _vote(symbols / tokens, 0.05, 0.3),
        _vote(text.count("|") / tokens, 0.05, 0.2),
        _vote(capitals, 0.25, 0.5) if n >= 10 else NONE,
        _vote(1 - len(kinds) / n, 0.75, 0.9) if n >= 50 else NONE,
        _vote(longest, 4, 8) if n >= 20 else NONE,
        _vote(1 - len(set(lines)) / len(lines), 0.2, 0.6) if len(lines) >= 4 else NONE,
        _vote(sum(words.count(w) for w in kinds & INSULTS), 0, 2),
        _vote(len(lexicon.intersection(terms.tolist())), 0, LEXICON_HITS) if lexicon else NONE,
    )


def code(pattern: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(pattern))


def terms_of(words: list[str], kinds: set[str]) -> np.ndarray:
    """Hashes (32 bits, sorted) of a text's words, and of word stems that occur more than once by how often they do."""
    from xxhash import xxh32_intdigest

    stems = Counter([w[:5] for w in words if len(w) >= 5])
    names = list(map(xxh32_intdigest, kinds))
    names += [xxh32_intdigest(s, k) for s, c in stems.items() if c > 1 for k in range(2, min(c, 4) + 1)]
    return _sorted(np.array(names, np.uint32))


@lru_cache(maxsize=3 ** len(LABELLERS))
def _vote_terms(pattern: tuple[int, ...]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(f"{name}={v}", 99) for name, v in zip(LABELLERS, pattern, strict=True)], np.uint32)


def features(terms: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """Numbers of the features that a text has: hashed terms and votes."""
    return _sorted(np.concatenate([terms, _vote_terms(pattern)]) & np.uint32(WEIGHTS - 1)).astype(np.int32)


def _read(text: str | None, lexicon: frozenset[int] = frozenset(), hashed: bool = True) -> tuple[np.ndarray, tuple[int, ...]]:
    """The terms and votes of a text; without a lexicon terms are only hashed on request."""
    text = text or ""
    words = words_of(text)
    kinds = set(words)
    terms = terms_of(words, kinds) if lexicon or hashed else None
    return terms, votes(text, words, kinds, lexicon, terms)


def signature(text: str | None) -> int:
    """The least hash of three words in a row: most near copies have the same, other texts hardly ever."""
    import xxhash

    words = _WORD.findall((text or "").lower())
    return min((xxhash.xxh32_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def mine_lexicon(rows: list[np.ndarray], bad: np.ndarray, signatures: list[int]) -> np.ndarray:
    """Hashes of terms that stand in rejected rows at ``LEXICON_RATE`` or more, in so many of them that chance hardly brings in any term.

    Rows of one signature, as near copies have, count once: else copies of one text would bring in all its words. They are
    counted by kind of row, so that one good row among many bad copies counts in full.
    """
    some = [(int(k), r, bool(x)) for r, x, k in zip(rows, bad, signatures, strict=True) if len(r)]
    if not any(x for *_, x in some) or all(x for *_, x in some):
        return np.zeros(0, np.uint32)

    def texts(kind: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Terms, how many texts of a kind hold them, and how many texts there are."""
        own = sorted(((k, r) for k, r, x in some if x == kind), key=lambda y: y[0])
        groups: dict[int, list[np.ndarray]] = {}
        for k, r in own:
            groups.setdefault(k, []).append(r)
        names, n = np.unique(np.concatenate([np.unique(np.concatenate(g)) for g in groups.values()]), return_counts=True)
        return names, n, len(groups)

    in_bad, n_bad, n = texts(True)
    in_good, n_good, m = texts(False)
    at = np.minimum(np.searchsorted(in_good, in_bad), len(in_good) - 1)
    beside = np.where(in_good[at] == in_bad, n_good[at], 0)
    least = max(3, math.ceil(math.log(len(np.union1d(in_bad, in_good)) / LEXICON_CHANCE) / math.log((n + m) / n)))
    return in_bad[(n_bad >= least) & (n_bad >= LEXICON_RATE * (n_bad + beside))]


def estimate(counts: dict[int, int], labellers: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over vote patterns: the classes' shares, P(vote | class) by labeller, and P(reject | pattern).

    A labeller that does not vote says nothing; none rejects more than ``FALSE_REJECTS`` of good documents. It starts from documents that any labeller
    rejects: rejecters look for different faults, so most of them pass over a given bad one.
    """
    codes = sorted(counts)
    if not codes:
        return np.array([0.5, 0.5]), np.full((labellers, 2, 3), 1 / 3), {}
    n = np.array([counts[c] for c in codes], float)
    digits = np.array([[c // 3**k % 3 for k in range(labellers)] for c in codes])
    bad = np.where((digits == REJECT).any(axis=1), 0.999, 0.001)
    for _ in range(rounds):
        share = np.array([((1 - bad) * n).sum() + 1, (bad * n).sum() + 1])
        table_ = np.ones((labellers, 2, 3)) * 0.1
        for k in range(labellers):
            for v in (KEEP, REJECT):
                at = digits[:, k] == v
                table_[k, 0, v] += ((1 - bad) * n)[at].sum()
                table_[k, 1, v] += (bad * n)[at].sum()
        table_[:, :, NONE] = 0
        table_ /= table_.sum(axis=2, keepdims=True)
        table_[:, 0, REJECT] = np.minimum(table_[:, 0, REJECT], FALSE_REJECTS)
        table_[:, 0, KEEP] = 1 - table_[:, 0, REJECT]
        table_[:, :, NONE] = 1
        share = share / share.sum()
        log = np.log(share)[None, :] + sum(np.log(table_[k][:, digits[:, k]]).T for k in range(labellers))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return share, table_, dict(zip(codes, bad.tolist(), strict=True))


def _probability(weights: np.ndarray, row: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[row].sum(dtype=np.float64) + weights[-1])))))


def train(rows: list[np.ndarray], target: np.ndarray, epochs: int = 4, rate: float = 0.3, sparse: float | None = None) -> np.ndarray:
    """Weights (the last is the bias) by follow-the-regularised-leader with an L1 term; a row weighs as much as its target is sure. The L1 term, unless given, grows with the rows, as words that few hold do not count."""
    sparse = min(4.0, max(0.6, len(rows) / 2500)) if sparse is None else sparse
    z, n = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)
    rng, sure = np.random.default_rng(5), np.abs(2 * target - 1)

    def weight(i: np.ndarray) -> np.ndarray:
        out = -(z[i] - np.sign(z[i]) * sparse) / ((1 + np.sqrt(n[i])) / rate)
        out[np.abs(z[i]) <= sparse] = 0
        return out

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.append(rows[r], WEIGHTS)
            w = weight(i)
            g = sure[r] * (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - target[r])
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rate * w
            n[i] += g * g
    return weight(np.arange(WEIGHTS + 1))


def threshold(scores: np.ndarray, bad: np.ndarray) -> float:
    """The lowest score, 0.5 at least, from which on rejects are right with ``PRECISION``; ``NEVER`` if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(bad[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(scores[order]) != 0, True) if len(order) else np.zeros(0, bool)  # equal scores go together
    ok = np.flatnonzero((right >= PRECISION) & (scores[order] >= 0.5) & last)
    return float(scores[order][ok[-1]]) if len(ok) else NEVER


class Scorer:
    """What was learnt: scorer weights, the threshold of rejection, the lexicon, and the posterior of each pattern of votes."""

    def __init__(self, weights: np.ndarray, limit: float, lexicon: frozenset[int], posterior: dict[int, float]) -> None:
        self.weights, self.threshold, self.lexicon, self.posterior = weights, limit, lexicon, posterior

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Votes, posterior, score and whether the text is kept."""
        terms, pattern = _read(text, self.lexicon)
        return self.judge(code(pattern), features(terms, pattern) if len(terms) else terms)

    def judge(self, pattern: int, row: np.ndarray) -> tuple[str, float, float, bool]:
        """The same from a text's pattern and the numbers of its features (of a text without terms: none)."""
        score = _probability(self.weights, row) if len(row) else 0.0
        return "".join("k-r"[pattern // 3**k % 3] for k in range(len(LABELLERS))), self.posterior.get(pattern, 0.5), score, score < self.threshold


def _share(rows: int, wanted: int) -> int:
    """Of 2**30 hash values so many that about ``wanted`` of ``rows`` rows have one."""
    return min(1 << 30, int(wanted / max(1, rows) * (1 << 30)))


def _curated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int) -> DataFrame:
    """(half, bad, terms, pattern, signature) of about ``train_rows`` rows with a curated label; an id counts once."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    known = labels.where(good.isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.when(good, 0).otherwise(1)).alias("bad"))
    hashed = F.pmod(F.xxhash64("label_id", F.lit(9)), F.lit(1 << 30))
    picked = known.where(hashed < _share(known.count(), train_rows)).withColumn("half", (hashed % 2).cast("int"))
    met = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("text_id") == F.col("label_id"))  # train_rows rows, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(batch.column(0)[i].as_py()) for i in range(batch.num_rows)]
            copies = [signature(batch.column(0)[i].as_py()) for i in range(batch.num_rows)]
            columns = [pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([code(p) for _, p in found], pa.int32()), pa.array(copies, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns], names=["half", "bad", "terms", "pattern", "signature"])
        release()

    once = met.groupBy("label_id").agg(F.min("text").alias("text"), F.first("half").alias("half"), F.first("bad").alias("bad"))
    return materialise(once.select("text", "half", "bad").mapInArrow(run, "half int, bad int, terms binary, pattern int, signature long"), "curated")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def _mined(curated: DataFrame) -> frozenset[int]:
    """The lexicon of the curated rows of half 0: bounded as they are."""

    def mine(group: pa.Table) -> pa.Table:
        found = mine_lexicon(_arrays(group["terms"]), group["bad"].to_numpy() == 1, group["signature"].to_pylist())
        release()
        return pa.table({"term": pa.array(found, pa.int64())})

    return frozenset(r["term"] for r in curated.where("half = 0").groupBy("half").applyInArrow(mine, "term long").collect())


def _fit(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, train_rows: int, keep: bool) -> tuple[Scorer, DataFrame]:
    """``fit``, and per row of ``docs``: pattern, terms (where trained on) and, with ``keep``, id and features, so that scoring need not read texts again."""
    curated = _curated(docs, labels, id_col, text_col, train_rows) if labels is not None else None
    lexicon = _mined(curated) if curated is not None else frozenset()
    pick = F.pmod(F.xxhash64(id_col, text_col, F.lit(11)), F.lit(1 << 30)) < _share(docs.count(), train_rows)
    schema = struct(pattern="integer", terms="binary")
    if keep:
        schema = schema.add("id", docs.schema[id_col].dataType).add("features", "binary")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, terms, rows = [], [], []
            for i in range(batch.num_rows):
                wanted = batch.column(1)[i].as_py()
                found, pattern = _read(batch.column(0)[i].as_py(), lexicon, wanted or keep)
                codes.append(code(pattern))
                terms.append(found.tobytes() if wanted else None)
                if keep:
                    rows.append(features(found, pattern).tobytes() if len(found) else b"")
            columns = [pa.array(codes, pa.int32()), pa.array(terms, pa.binary())]
            if keep:
                columns += [batch.column(2), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        release()

    known = materialise(docs.select(text_col, pick, *[id_col] * keep).mapInArrow(vote, schema), "votes")
    counts = {r["pattern"]: r["count"] for r in known.groupBy("pattern").count().collect()}  # 3 ** labellers rows at most
    _, _, posterior = estimate(counts, len(LABELLERS))
    rows = known.where("terms IS NOT NULL").select(F.lit(1).alias("one"), "pattern", "terms", F.lit(None).cast("int").alias("bad"))
    if curated is not None:
        rows = rows.unionByName(curated.where("half = 1").select(F.lit(1).alias("one"), "pattern", "terms", "bad"))

    def learn(group: pa.Table) -> pa.Table:
        found = sorted(zip(group["terms"].to_pylist(), group["pattern"].to_pylist(), [-1 if x is None else x for x in group["bad"].to_pylist()], strict=True))
        own = [f for f in found if f[2] < 0]
        order = np.random.default_rng(3).permutation(len(own))
        target = np.array([posterior[own[i][1]] for i in order])
        read = lambda raw, pattern: features(np.frombuffer(raw, np.uint32), pattern)
        patterns = {c: tuple(c // 3**k % 3 for k in range(len(LABELLERS))) for c in posterior}
        sparse = [read(own[i][0], patterns[own[i][1]]) for i in order]
        weights = train(sparse, target)
        held = [f for f in found if f[2] >= 0 and f[0]]
        truth = np.array([f[2] for f in held]) == 1
        if held and truth.any() and not truth.all():
            scores = []
            for raw, pattern, _ in held:
                terms = np.frombuffer(raw, np.uint32)
                full = [pattern // 3**k % 3 for k in range(len(LABELLERS))]
                if lexicon:
                    full[-1] = _vote(len(lexicon.intersection(terms.tolist())), 0, LEXICON_HITS)
                scores.append(_probability(weights, features(terms, tuple(full))))
        else:
            scores, truth = [_probability(weights, r) for r in sparse], target >= 0.5
        out = pa.table({"weights": [weights.astype(np.float32).tobytes()], "threshold": [threshold(np.array(scores), truth)]})
        del found, own, sparse, held
        release()
        return out

    learnt = rows.groupBy("one").applyInArrow(learn, "weights binary, threshold double").collect()
    weights = np.frombuffer(learnt[0]["weights"], np.float32) if learnt else np.zeros(WEIGHTS + 1, np.float32)
    return Scorer(weights, learnt[0]["threshold"] if learnt else NEVER, lexicon, posterior), known


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Scorer:
    """Counts vote patterns over all of ``docs``, estimates the labellers, and trains the scorer on posteriors.

    ``labels`` (may be None) has the id, quality and toxic; rows with a null in either do not
    count, and of an id's several rows the worst does. Rows are trained on by a hash of id and
    text. Without labels (or without held-out ones of either kind) the posteriors of the
    training rows stand for them when the threshold is set.
    """
    return _fit(docs, labels, id_col, text_col, train_rows, False)[0]


def classify(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: id, votes (one of k-r a labeller: keep, nothing, reject), posterior of reject by the votes alone, score (probability of reject by the scorer), kept.

    A null or empty text has no votes and is kept. Null and repeated ids keep their rows; an
    empty table gives an empty result.
    """
    scorer, known = _fit(docs, labels, id_col, text_col, train_rows, True)
    schema = T.StructType([docs.schema[id_col], *struct(votes="string", posterior="double", score="double", kept="boolean").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.judge(p, np.frombuffer(row, np.int32)) for p, row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)
        release()

    return known.select("id", "pattern", "features").mapInArrow(score, schema)


def without_rejected(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps; decided row by row, whatever the ids."""
    scorer, at = fit(docs, labels, id_col, text_col, train_rows), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([scorer(batch.column(at)[i].as_py())[3] for i in range(batch.num_rows)], pa.bool_()))
        release()

    return docs.mapInArrow(keep, docs.schema)


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents classified; half of the labels table makes the lexicon, the other half sets the threshold."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_weak_labels": op9_weak_labels}
