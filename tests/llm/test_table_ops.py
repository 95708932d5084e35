"""Vector links, mixing, sharding, classification and the pipeline against plain versions."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawl.llm import cap_filters, mixing, ring, weak_labels
from trawl.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

# ---- cap filters


def plain_links(rows, least=0.98):
    n = len(rows)
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] is None or rows[i][0] == low))
    return sorted(out, key=lambda r: (r[0] is None, r))


def vectors(seed, n=240, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.2, 0.9])
        rows.append((1000 + i * 7 % 5000, (v * rng.choice([1.0, 2.5])).astype(np.float32).tolist(), int(i % 3)))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_vector_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    rows = vectors(1)
    rows += [(1, [0.0] * 24, 0), (2, None, 0), (3, [float("nan")] + [1.0] * 23, 0), (4, [float("inf")] + [1.0] * 23, 1), (5, [None] + [1.0] * 23, 1), (6, rows[0][1], None), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (9, [], 0)]
    rows += [(10, [1e-30] * 24, 2), (11, [1e30] * 24, 2)] + [(9000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1))
    found = sorted(map(tuple, cap_filters.near_vectors(df).collect()), key=lambda r: (r[0] is None, r))
    assert found == plain_links(rows)


def test_no_vectors(spark):
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_decoding_finds_all_filters_beyond_the_cap():
    code = cap_filters.ProductCode(10, 4, 1)
    rng = np.random.default_rng(2)
    for _ in range(20):
        v = rng.standard_normal(10)
        v /= np.linalg.norm(v)
        s = np.einsum("kq,kcq->kc", (v @ code.turn).reshape(4, -1), code.code)
        total = s[0][:, None, None, None] + s[1][:, None, None] + s[2][:, None] + s[3]
        want = np.flatnonzero(total.ravel() >= code.height)
        got = np.sort(code.decode(v))
        assert len(got) >= cap_filters.LEAST_FILTERS
        if len(want) >= cap_filters.LEAST_FILTERS:
            assert set(want) <= set(got.tolist()) and len(set(got.tolist()) - set(want.tolist())) == 0


def test_recall_on_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    found = con.sql(ORACLE_SQL["op1_cap_filters"])
    at = [found.columns.index(c) for c in ("vec_id", "n_links", "component_id", "kept")]
    got = QUERIES["op1_cap_filters"](spark, SF).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


@pytest.mark.parametrize(("size", "blocks"), [(3, 1), (8, 1), (12, 2), (24, 2), (40, 3), (40, 4)])
def test_recall_as_the_code_grows(size, blocks):
    rng = np.random.default_rng(size)
    code = cap_filters.ProductCode(64, size, 7)
    x = rng.standard_normal((300, 64))
    y = x + rng.standard_normal((300, 64)) * 0.2 * np.linalg.norm(x, axis=1, keepdims=True) / 8  # cosine about 0.98
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = np.flatnonzero((x * y).sum(1) >= 0.98)
    cells = lambda v: set((code.decode(v) // size ** (4 - blocks)).tolist())
    assert len(near) > 80 and np.mean([bool(cells(x[i]) & cells(y[i])) for i in near]) >= 0.97
    assert np.mean([len(cells(v)) for v in x]) <= 2 * cap_filters.CELLS[blocks]


# ---- mixing


def test_raking_equals_plain_fitting(spark):
    rng = np.random.default_rng(3)
    w = rng.random((3, 2, 4)) * (rng.random((3, 2, 4)) > 0.2) * 100
    cells = [(f"s{i}", f"l{j}", f"t{k}", float(w[i, j, k])) for i in range(3) for j in range(2) for k in range(4) if w[i, j, k]]
    goal = [np.array([0.2, 0.3, 0.5]), np.array([0.6, 0.4]), np.array([0.1, 0.2, 0.3, 0.4])]
    names = ["s", "l", "t"]
    targets = {n: spark.createDataFrame([(f"{n}{i}", float(x)) for i, x in enumerate(g)], f"{n} string, target double") for n, g in zip(names, goal, strict=True)}
    found = mixing.rake(spark.createDataFrame(cells, "s string, l string, t string, weight double"), targets, tolerance=1e-9).collect()
    x = w / w.sum()
    for _ in range(500):
        for axis, g in enumerate(goal):
            m = x.sum(axis=tuple(a for a in range(3) if a != axis))
            x = x * (g / m).reshape([-1 if a == axis else 1 for a in range(3)])
    for r in found:
        assert abs(r["fitted"] - x[int(r["s"][1]), int(r["l"][1]), int(r["t"][1])]) < 1e-4


def mixable(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 200)), rng.choice(["a"] * 6 + ["b", "c"]), rng.choice(["en", "de", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None), (5, "", "b", "en"), (5, "", "b", "en")], "doc_id long, text string, source string, lang string").withColumn("weight", F.lit("clash"))


def test_drawn_shares_are_the_targets(spark):
    df = mixable(spark)
    mixed = mixing.mix(df, power=0.3, keep=1.5).cache()
    assert mixed.count() == df.count()
    shares = mixed.groupBy("mix_source").agg(F.sum("mix_weight").alias("w"), F.sum(F.col("mix_weight") * F.col("mix_copies")).alias("k")).collect()
    all_w, all_k = sum(r["w"] for r in shares), sum(r["k"] for r in shares)
    powers = {r["mix_source"]: (r["w"] / all_w) ** 0.3 for r in shares}
    for r in shares:
        assert abs(r["k"] / all_k - powers[r["mix_source"]] / sum(powers.values())) < 0.03
    assert abs(all_k / all_w - 1.5) < 0.06
    twins = mixed.where("doc_id = 5 AND text = ''").select("mix_copies").collect()
    assert twins[0] == twins[1]


def test_rows_without_repeats(spark):
    df = mixable(spark)
    mixed = mixing.mix(df, keep=0.95, repeat=False)
    got = mixed.agg(F.max("mix_copies").alias("most"), (F.sum(F.col("mix_weight") * F.col("mix_copies")) / F.sum("mix_weight")).alias("kept")).first()
    assert got["most"] == 1 and abs(got["kept"] - 0.95) < 0.03
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_twice_and_clashing_names(spark):
    df = mixable(spark, 300).withColumn("mix_weight", F.lit("clash")).withColumn("target", F.lit(1)).withColumn("fitted", F.lit(2))
    once = mixing.mix(df)
    again = mixing.mix(once)
    assert again.count() == once.count() == df.count() and again.columns == once.columns
    assert once.agg(F.max("mix_residual")).first()[0] <= mixing.TOLERANCE


def test_targets_that_contradict_leave_a_residual(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "s string, l string, weight double")
    targets = {"s": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "s string, target double"), "l": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "l string, target double")}
    assert mixing.fit_margins(cells, targets, rounds=4)[1] > 0.5
    bound = {r["s"]: r["fitted"] for r in mixing.rake(cells, {"s": targets["s"]}, most=1.5).collect()}
    assert abs(bound["a"] - 0.75) < 1e-9 and abs(bound["b"] - 0.1) < 1e-9


def test_topics_are_learnt_from_bursts(spark):
    rng = random.Random(6)
    plain = [f"plain{a}{b}" for a in "abcde" for b in "fghij"]
    rows = []
    for i in range(400):
        t = [rng.choice(plain) for _ in range(40)]
        lang = "en" if i % 2 else "de"
        if i % 10 < 4:
            t += [f"{lang}burst{chr(97 + i % 10 // 2)}"] * 6
        rows.append((i, " ".join(t), lang, i % 10 // 2 if i % 10 < 4 else None))
    df = spark.createDataFrame([*rows, (999, None, None, None)], "doc_id long, text string, lang string, truth int")
    seeds = mixing.learn_topics(df, F.col("text"), F.col("lang"))
    counts = {k: collections.Counter(w for _, t, g, _ in rows if g == k for w in t.split()) for k in ("en", "de")}
    held = {k: collections.Counter(w for _, t, g, _ in rows if g == k for w in set(t.split())) for k in ("en", "de")}
    for k in ("en", "de"):
        ridf = {w: round(np.log2(200 / held[k][w]) + np.log2(1 - np.exp(-counts[k][w] / 200)), 9) for w in counts[k] if 2 <= held[k][w] <= mixing.COMMON * 200}
        names = [r["h"] for r in spark.createDataFrame([(w,) for w in sorted(ridf, key=lambda w: (-ridf[w], w))], "w string").select(mixing.term_hash(F.col("w")).alias("h")).collect()]
        assert set(ridf) >= {f"{k}bursta", f"{k}burstb"} and sorted(seeds[k]) == sorted(names[: mixing.TOPICS])
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(f"{k}burst{c}",) for k in ("en", "de") for c in "ab"], "w string").select("w", mixing.term_hash(F.col("w")).alias("h")).collect()}
    found = {r["doc_id"]: r["t"] for r in df.select("doc_id", mixing.topic(F.col("text"), F.col("lang"), seeds).alias("t")).collect()}
    assert all(found[i] == f"topic {seeds[g].index(hashes[f'{g}burst{chr(97 + x)}']) + 1}" for i, _, g, x in rows if x is not None) and found[999] == "other"


# ---- ring


def texts(n):
    rng = random.Random(5)
    return [(i, rng.choice([None, "", "same", f"text {i} é", "x" * rng.randrange(300)])) for i in range(n)]


@pytest.mark.parametrize(("n", "shards"), [(0, 4), (1, 4), (7, 40), (1000, 40), (1234, 7)])
def test_shards_hold_equal_counts_without_gaps(spark, n, shards):
    rows = texts(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("cell", F.lit(0))
    found = ring.shard_rows(df, shards=shards).collect()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for r in found)


def test_repeated_rows_and_null_ids_get_slots(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (1, "b")] * 30
    found = ring.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    assert len(found) == 150 and len({(r["shard"], r["slot"]) for r in found}) == 150


def test_hot_cell_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ring, "LEAST_PART", 8)
    df = spark.createDataFrame([(i, "same") for i in range(500)], "doc_id long, text string")
    found = ring.shard_rows(df, shards=5).collect()
    assert collections.Counter(r["shard"] for r in found) == dict.fromkeys(range(5), 100) and len({(r["shard"], r["slot"]) for r in found}) == 500


def plain_ring(counts, shards, vnodes):
    """Keys one by one: owners take their own first, the rest go on clockwise."""
    owners, room = ring.cell_owners(shards, vnodes), ring.capacities(sum(counts.values()), shards, 0)
    got, left = collections.Counter(), {}
    for c in sorted(counts):
        k = min(counts[c], room[owners[c]])
        room[owners[c]] -= k
        got[c, owners[c]] += k
        left[c] = counts[c] - k
    queue = []
    for step in range(2 * ring.CELLS):
        c = step % ring.CELLS
        while queue and room[owners[c]]:
            got[queue[0], owners[c]] += 1
            room[owners[c]] -= 1
            queue.pop(0)
        if step < ring.CELLS:
            queue += [c] * left.get(c, 0)
    return {k: v for k, v in got.items() if v}


def test_plan_equals_walking_the_ring():
    rng = random.Random(6)
    for shards, vnodes in ((3, 8), (10, 16)):
        counts = {rng.randrange(ring.CELLS): rng.choice([1, 2, 300]) for _ in range(200)}
        got = collections.Counter()
        for s in ring.ring_plan(counts, shards, vnodes):
            got[s["cell"], s["shard"]] += s["hi"] - s["lo"]
        assert dict(got) == plain_ring(counts, shards, vnodes)


def test_one_more_shard_moves_little():
    rng = random.Random(7)
    counts = collections.Counter(rng.randrange(ring.CELLS) for _ in range(40_000))

    def where(shards, spare):
        out = {}
        for s in ring.ring_plan(counts, shards, 64, spare):
            out |= {(s["cell"], r): s["shard"] for r in range(s["lo"], s["hi"])}
        return out

    owners, more = ring.cell_owners(40, 64), ring.cell_owners(41, 64)
    assert all(a == b or b == 40 for a, b in zip(owners, more, strict=True))
    moved = {spare: np.mean([a != b for a, b in zip(where(40, spare).values(), where(41, spare).values(), strict=True)]) for spare in (0.0, 0.25)}
    assert moved[0.25] < 0.15 and moved[0.0] < 0.5
    assert max(collections.Counter(where(40, 0.25).values()).values()) <= 1250


# ---- classifier


def test_em_finds_the_labellers_accuracies():
    rng = random.Random(8)
    hit, false = [0.5, 0.3, 0.7, 0.4], [0.01, 0.02, 0.0, 0.01]
    counts, truth = collections.Counter(), []
    for _ in range(20_000):
        bad = rng.random() < 0.2
        v = tuple(weak_labels.NONE if rng.random() < 0.1 else weak_labels.REJECT if rng.random() < (hit if bad else false)[k] else weak_labels.KEEP for k in range(4))
        counts[weak_labels.code(v)] += 1
        truth.append((weak_labels.code(v), bad))
    _, rates, posterior = weak_labels.estimate(counts, 4)
    assert all(abs(rates[k, 1, weak_labels.REJECT] - hit[k]) < 0.1 for k in range(4))
    assert np.mean([(posterior[c] > 0.5) == bad for c, bad in truth]) > 0.93


def test_votes():
    def of(text):
        return dict(zip(weak_labels.LABELLERS, weak_labels._read(text)[1], strict=True))

    clean = "A plain text about rivers and hills that goes on for a while without any of the faults."
    assert set(of(clean).values()) <= {weak_labels.KEEP, weak_labels.NONE}
    assert of("word### other$$$ more%%% " * 5)["symbols"] == weak_labels.REJECT
    assert of("A | B | C | D | " * 5)["tables"] == weak_labels.REJECT
    assert of("BUY THIS NOW FROM US AND SAVE ALL YOUR MONEY FAST")["shouting"] == weak_labels.REJECT
    assert of("so so so so so so so so so so and " * 9)["runs"] == weak_labels.REJECT
    assert of(clean + " You idiot, you clown")["insults"] == weak_labels.REJECT
    assert set(of("").values()) == set(of(None).values()) == {weak_labels.NONE}


def test_classifier_learns_unlisted_words_on_held_out_rows(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("ran", "tol", "mis", "ked")]
    rows, labels, truth = [], [], {}
    for i in range(1500):
        t = [rng.choice(words) for _ in range(60)]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(4):
                t[rng.randrange(60)] = rng.choice(["vorrluk", "vorrla", "vorrspe"])
        rows.append((i, " ".join(t)))
        truth[i] = bad
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(None, None), (5000, ""), (5001, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("clash"))
    found = weak_labels.classify(docs, spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows) and all(r["kept"] for r in found if r["doc_id"] in (None, 5000))
    held_out = [(r["kept"], truth[r["doc_id"]]) for r in found if r["doc_id"] is not None and r["doc_id"] < 1500 and r["doc_id"] % 2]
    assert np.mean([k != bad for k, bad in held_out]) > 0.95 and sum(not k and not bad for k, bad in held_out) <= 4


def test_lexicon_and_threshold():
    rng = np.random.default_rng(4)
    bad = rng.random(400) < 0.25
    rows = [np.unique(np.append(rng.integers(100, 3000, 80), [7, 9] if b else [8]).astype(np.uint32)) for b in bad]
    apart = list(range(400))
    assert set(weak_labels.mine_lexicon(rows, bad, apart).tolist()) == {7, 9}
    assert not len(weak_labels.mine_lexicon(rows, bad, [0] * 400))  # copies of one text
    assert not len(weak_labels.mine_lexicon(rows, np.zeros(400, bool), apart)) and not len(weak_labels.mine_lexicon([], bad[:0], []))
    assert weak_labels.signature("One two three four") == weak_labels.signature("one TWO three four") != weak_labels.signature(None)
    scores, truth = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.2]), np.array([True, True, True, False, True, False])
    assert weak_labels.threshold(scores, truth) == 0.8
    assert weak_labels.threshold(scores, ~truth) == weak_labels.threshold(scores[:0], truth[:0]) == weak_labels.NEVER  # nothing is rejected


def test_query_equals_its_parts_in_plain_python(spark):
    """The registered query's columns, with the model fitted again from its parts over plain lists."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r["doc_id"]: int(not (r["quality"] == 1 and r["toxic"] == 0)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    half = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in labels], "i long").select("i", (F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1 << 30)) % 2).alias("h")).collect()}
    first = [(weak_labels._read(r["text"])[0], labels[r["doc_id"]], weak_labels.signature(r["text"])) for r in rows if half.get(r["doc_id"]) == 0]
    lexicon = frozenset(weak_labels.mine_lexicon([t for t, *_ in first], np.array([b for _, b, _ in first]) == 1, [k for *_, k in first]).tolist())
    read = {r["doc_id"]: weak_labels._read(r["text"], lexicon) for r in rows}
    counts = collections.Counter(weak_labels.code(p) for _, p in read.values())
    _, _, posterior = weak_labels.estimate(counts, len(weak_labels.LABELLERS))
    own = sorted((t.tobytes(), weak_labels.code(p), p) for t, p in read.values())
    order = np.random.default_rng(3).permutation(len(own))
    weights = weak_labels.train([weak_labels.features(np.frombuffer(own[i][0], np.uint32), own[i][2]) for i in order], np.array([posterior[own[i][1]] for i in order])).astype(np.float32)
    held = [i for i in half if half[i] == 1 and len(read[i][0])]
    score = {i: weak_labels._probability(weights, weak_labels.features(*read[i])) if len(read[i][0]) else 0.0 for i in read}
    limit = weak_labels.threshold(np.array([score[i] for i in held]), np.array([labels[i] for i in held]) == 1)
    found = weak_labels.op9_weak_labels(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["doc_id"]
        assert r["votes"] == "".join("k-r"[v] for v in read[i][1]) and abs(r["posterior"] - posterior[weak_labels.code(read[i][1])]) < 1e-9
        assert abs(r["score"] - score[i]) < 1e-6 and (r["kept"] == (score[i] < limit) or abs(score[i] - limit) < 1e-6)
    assert 0 < sum(not r["kept"] for r in found) and all(r["kept"] for r in found if labels.get(r["doc_id"]) == 0)


def test_each_text_is_parsed_once(spark):
    """Scores come from what was counted; the result reads neither texts nor their files again."""
    found = weak_labels.op9_weak_labels(spark, SF)
    assert found.inputFiles() and not [x for x in found.inputFiles() if "documents.parquet" in x]


def test_words_and_votes_of_odd_texts():
    """Words and capitals by table, symbols only where three stand together, runs by bytes: all as by character and expression."""
    rng = random.Random(12)
    pools = [[chr(i) for i in range(128)], list("ab AB.\n#|é"), [*"aé—…²٣Σ \n_9AİßⅧ\x1c\x85\u3000"]]
    insults = ["idiot", "Idiot", "so", "so", "so", "wörter", "scum!", "SO###", "a—b"]
    for k in range(3000):
        text = "".join(rng.choice(pools[k % 3]) * rng.choice((1, 1, 2, 3, 9)) for _ in range(rng.randrange(99))) if k % 4 else " ".join(rng.choices(insults, k=rng.randrange(60)))
        words = re.findall(r"[^\W\d_]+", text.lower())
        assert weak_labels.words_of(text) == words
        n, tokens, lines = len(words), text.count(" ") + text.count("\n") + 1, [x for x in text.split("\n") if x.strip()]
        run = max((len(list(g)) for _, g in itertools.groupby(words)), default=0)
        stems = collections.Counter(w[:5] for w in words if len(w) >= 5)
        want = (
            weak_labels._vote(len(re.findall(r"([^\w\s])\1\1", text)) / tokens, 0.05, 0.3),
            weak_labels._vote(text.count("|") / tokens, 0.05, 0.2),
            weak_labels._vote(sum(map(str.isupper, text)) / sum(map(len, words)), 0.25, 0.5) if n >= 10 else 1,
            weak_labels._vote(1 - len(set(words)) / n, 0.75, 0.9) if n >= 50 else 1,
            weak_labels._vote(run, 4, 8) if n >= 20 else 1,
            weak_labels._vote(1 - len(set(lines)) / len(lines), 0.2, 0.6) if len(lines) >= 4 else 1,
            weak_labels._vote(sum(w in weak_labels.INSULTS for w in words), 0, 2),
            weak_labels.NONE,
        )
        terms, pattern = weak_labels._read(text)
        assert pattern == (want if n else (weak_labels.NONE,) * 8), repr(text)
        assert terms.tolist() == sorted({xxhash.xxh32_intdigest(w) for w in words} | {xxhash.xxh32_intdigest(s, i) for s, c in stems.items() for i in range(2, min(c, 4) + 1)})


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(i, "a fine text of words " * 5 if i % 4 else "bad### worse$$$ " * 9) for i in range(80)], "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in weak_labels.classify(docs, None).collect()}
    assert all(found[i] == bool(i % 4) for i in found)
    assert weak_labels.classify(docs.limit(0), None).collect() == []


def test_rejected_rows_go_whatever_their_ids(spark):
    rows = [(i if i % 5 else None, "a fine text of words " * 5 if i % 4 else "bad### worse$$$ " * 9, i) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes int")
    left = weak_labels.without_rejected(docs, None)
    assert left.schema == docs.schema and sorted(r["votes"] for r in left.collect()) == [i for i in range(80) if i % 4]


# ---- pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    from trawl.llm.pii import base_spans
    from trawl.llm.shared import materialise

    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs, kept = first, []
    for k, (_, stage) in enumerate(p.STAGES):
        out = materialise(stage(spark, docs, SF), f"test{k}")
        kept.append((docs, out))
        docs = out
    for a, b in kept[:4]:
        assert b.schema.simpleString() == first.schema.simpleString() and 0 < b.count() <= a.count()
    marked = weak_labels.classify(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in marked.where("kept").collect()} == {r["doc_id"] for r in kept[0][1].collect()}
    texts = collections.defaultdict(list)
    for r in kept[1][0].collect():
        texts[r["text"]].append(r["doc_id"])
    left = {r["doc_id"] for r in kept[1][1].collect()}
    assert all(len(left & set(ids)) <= 1 for ids in texts.values())
    assert kept[2][0].count() == kept[2][1].count() and kept[2][1].where(F.size(base_spans(F.col("text"))) > 0).count() == 0
    assert kept[2][1].where("n_chars <> char_length(text)").count() == 0
    last = {r["doc_id"]: r["decoded_sha256"] for r in kept[4][1].collect()}
    assert last == {r["doc_id"]: r["h"] for r in kept[4][0].select("doc_id", F.sha2("text", 256).alias("h")).collect()}


def test_pipeline_keeps_odd_rows(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, "text without an id goes on and on", "en", "s", 1), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], schema)
    assert p.STAGES[0][1](spark, odd, SF).count() <= 4
    docs = odd
    for _, stage in p.STAGES[1:3]:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect()) == [(False, 1), (True, None)]
    for _, stage in p.STAGES:
        assert stage(spark, odd.limit(0), SF).collect() == []


def test_pipeline_mixes_to_tempered_shares(spark):
    import corpus_pipeline as p

    docs = mixable(spark).where("doc_id <> 5")
    out = p.source_mixing(spark, docs, SF).cache()
    assert out.columns == docs.columns

    def shares(df):
        rows = df.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum(mixing.token_weight(F.col("text"))).alias("w")).collect()
        return {r["s"]: r["w"] / sum(x["w"] for x in rows) for r in rows}

    before, after = shares(docs), shares(out)
    total = sum(x**0.8 for x in before.values())
    apart = lambda x: sum(abs(x.get(s, 0.0) - b**0.8 / total) for s, b in before.items()) / 2
    assert apart(after) < 0.01 < apart(before)
    assert out.groupBy(*docs.columns).count().where("count > 1").count() > 0
    tokens = [df.agg(F.sum(mixing.token_weight(F.col("text")))).first()[0] for df in (docs, out)]
    assert abs(tokens[1] / tokens[0] - 0.9) < 0.05


# ---- shared tables


def test_shared_tables_are_read_and_written_in_bounded_pieces(spark):
    import pyarrow.parquet as pq

    from trawl.llm import shared

    def direct():
        jvm = spark.sparkContext._jvm
        kind = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
        pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind)
        return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct")

    wide = F.concat(*[F.sha2(F.concat_ws(":", "id", F.lit(k)), 512) for k in range(8)])
    found = shared.materialise(spark.range(0, 60_000, 1, 1).select("id", wide.alias("text")), "wide")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60_000 and len(groups) > 1
    assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups) <= 1.1 * shared.GROUP_BYTES
    before = direct()
    assert found.agg(F.sum(F.length("text"))).first()[0] == 60_000 * 8 * 128
    assert direct() - before < 4 << 20  # no buffer outside the heap as large as a row group
    spark.conf.set(shared.VECTORED_KEY, "true")
    shared.table(spark, SF, "documents")
    assert spark.conf.get(shared.VECTORED_KEY) == "true"  # a session's own word holds
    spark.conf.unset(shared.VECTORED_KEY)
