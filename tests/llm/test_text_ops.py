"""Token counts, BPE, TIFF, SimHash and PII against plain versions on small and awkward rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from trawl.llm import byte_bpe, katz, pii, simhash, tiff, token_counts, trie_join, vocab, word_chunks
from trawl.llm.components import components

ROWS = [
    (1, "Hello world's end.\n\n  Twice  ", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "naïve café — déjà vu 123 　 \x85 ½ Ⅷ é", "fr"),
    (4, "Hello world's end.\n\n  Twice  ", "fr"),
    (None, "a <|endoftext|> b 日本語 ելք ՠ", "xx"),
    (6, "x" * 3000 + " tail " + "=-" * 40, "en"),
    (7, "the cat " * 4000, "en"),
    (7, "the cat " * 4000, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, repeats, long texts, and columns with names that operators use inside."""
    schema = "doc_id long, text string, lang string"
    return spark.createDataFrame(ROWS, schema).withColumn("key", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("blob", F.col("lang")).repartition(3)


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in ROWS]
    assert by_row(map(tuple, token_counts.count_tokens(docs).collect())) == by_row(want)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def tiktoken_ids(text):
    import tiktoken

    ranks = vocab.read_ranks(vocab.vocabulary_path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=vocab.split_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_bpe_equals_the_library_and_round_trips(docs):
    found = byte_bpe.encode_documents(docs)
    want = []
    for i, x, _ in ROWS:
        ids = tiktoken_ids(x or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest(), ids))
    assert by_row(map(tuple, found.collect())) == by_row(want)
    again = byte_bpe.decode_ids(found, "token_ids").select("doc_id", F.sha2("decoded", 256) == F.col("decoded_sha256"))
    assert all(r[1] for r in again.collect())
    assert byte_bpe.encode_documents(docs.limit(0)).collect() == []


def test_fold_and_heap_merge_alike(spark):
    ranks = vocab.read_ranks(vocab.vocabulary_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    words = [bytes(rng.choice(b" thereadingof\xc3\xa9\xff") for _ in range(rng.randrange(2, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, raw array<int>")
    got = {r["i"]: r["ids"] for r in df.select("i", byte_bpe.fold_merges(F.col("raw"), byte_bpe.RankLiterals(ranks)).alias("ids")).collect()}
    pieces = {r: w for w, r in ranks.items()}
    for i, w in enumerate(words):
        assert b"".join(pieces[k] for k in got[i]) == w
        if w not in ranks:
            assert got[i] == vocab.merge_by_rank(w, ranks)


def test_vocabulary_whose_ranks_do_not_grow(spark):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 301, b"abc": 300, b"xab": 302, b"bcab": 290, b"bc": 310}
    assert {len(vocab.merge_by_rank(p, ranks, r)) for p, r in ranks.items() if len(p) > 1} != {2}
    library = tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    words = ["abcx", "abc", "abab", "bcabc"] + ["".join(rng.choice("abcx") for _ in range(rng.randrange(2, 30))) for _ in range(300)]
    literals = byte_bpe.RankLiterals(ranks)
    df = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, raw array<int>").select("w", byte_bpe.fold_merges(F.col("raw"), literals).alias("ids"))
    found = {r["w"]: r["ids"] for r in df.collect()}
    assert found["abcx"] == [300, 120] and all(found[w] == library.encode(w) for w in words)


def test_plans_hold_no_vocabulary(docs, monkeypatch):
    """The driver makes and keeps texts of the plan at every step of a query: the rank map in them was megabytes."""
    spark, key = docs.sparkSession, "spark.sql.maxPlanStringLength"
    held = spark.conf.get(key)
    spark.conf.set(key, 100_000_000)
    try:
        found = byte_bpe.encode_documents(docs)
        assert len(found._jdf.queryExecution().toString()) < 200_000
    finally:
        spark.conf.set(key, held)
    whole = by_row(map(tuple, found.collect()))
    monkeypatch.setattr(byte_bpe, "ROW_BYTES", 20)  # a word or two a row
    assert by_row(map(tuple, byte_bpe.encode_documents(docs).collect())) == whole


def test_fast_splitter_is_the_pattern():
    import regex

    pattern = vocab.split_pattern()
    fast, plain = vocab.splitter(pattern, True), regex.compile(pattern).findall
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x2000, 0x2030), 32, 39, 115, 0x4E00])) for _ in range(rng.randrange(20)))
        assert fast(text) == plain(text)


def test_squeeze_round_trip():
    a, b = np.arange(70000, dtype=np.uint32), np.array([], np.uint64)
    box = word_chunks.Unsqueezed(word_chunks.squeeze(a, b, b"tail"))
    assert (box.array(len(a), np.uint32) == a).all() and len(box.array(0, np.uint64)) == 0 and box.rest() == b"tail"


def test_small_chunks_give_the_same(docs, monkeypatch):
    whole = by_row(map(tuple, byte_bpe.encode_documents(docs, keep_ids=False).collect()))
    monkeypatch.setattr(word_chunks, "CHUNK_WORDS", 5)
    monkeypatch.setattr(word_chunks, "PACK_DOCS", 1)
    assert by_row(map(tuple, byte_bpe.encode_documents(docs, keep_ids=False).collect())) == whole


# ---- TIFF


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.LZW, tiff.PACKBITS, tiff.ADOBE_DEFLATE])
@pytest.mark.parametrize("tile", [0, 16, 32])
def test_tiff_round_trip(compression, tile):
    rng = random.Random(7)
    for rows in (1, 17, 256, 1025):
        payload = bytes(rng.choice((97, 98, rng.randrange(256))) for _ in range(rows * 64))
        for predictor in (1, 2):
            pages = list(tiff.page_rows(tiff.write_tiff(payload, compression=compression, predictor=predictor, tile=tile)))
            assert b"".join(p["pixels"] for p in pages) == payload and [p["page"] for p in pages] == list(range(-(-rows // 1024)))


def test_lzw_fills_its_table():
    rng = random.Random(8)
    for n in (0, 1, 300, 6000, 30000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_known_packbits():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def big_endian_rgb16():
    """Two rows of two 16-bit RGB pixels, planes apart, with the predictor, in a big-endian file."""
    samples = np.arange(12, dtype=np.uint16).reshape(2, 2, 3) * 1000
    planes = [np.diff(samples[:, :, k].astype(np.int64), axis=1, prepend=0).astype(">u2").tobytes() for k in range(3)]
    body, places = b"", []
    for p in planes:
        places.append(8 + len(body))
        body += p
    extra = 8 + len(body)
    lists = struct.pack(">3I", *places) + struct.pack(">3I", *[8] * 3) + struct.pack(">3H", 16, 16, 16)
    tags = [(256, 3, 1, 2 << 16), (257, 3, 1, 2 << 16), (258, 3, 3, extra + 24), (259, 3, 1, 1 << 16), (273, 4, 3, extra), (277, 3, 1, 3 << 16), (278, 3, 1, 2 << 16), (279, 4, 3, extra + 12), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16)]
    at = extra + len(lists)
    return b"MM\0*" + struct.pack(">I", at) + body + lists + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0", samples


def test_big_endian_planes(spark):
    media, samples = big_endian_rgb16()
    rows = spark.createDataFrame([(1, media), (2, None), (3, b"no"), (4, media[:40]), (5, tiff.write_tiff(b"\1" * 64 * 3000))], "id long, m binary")
    found = [r.asDict() for r in tiff.read_pages(rows, "m", ["id"]).collect()]
    assert [(r["id"], r["page"]) for r in found] == [(1, 0), (3, None), (4, None), (5, 0), (5, 1), (5, 2)]
    assert found[0]["pixels"] == samples.tobytes() and found[0]["samples"] == 3 and found[0]["bits"] == 16
    assert all(r["error"] for r in found if r["id"] in (3, 4))
    with pytest.raises(ValueError, match="clash"):
        tiff.read_pages(rows.withColumnRenamed("id", "page"), "m", ["page"])


def test_circles_and_other_compressions_are_errors():
    media = bytearray(tiff.write_tiff(b"\0" * 64))
    media[-4:] = struct.pack("<I", struct.unpack_from("<I", media, 4)[0])
    assert "circle" in next(tiff.page_rows(bytes(media)))["error"]
    assert "compression" in next(tiff.page_rows(tiff.write_tiff(b"\0" * 64, compression=7)))["error"]


def test_stored_texts(docs):
    found = {r["doc_id"]: r for r in tiff.store_texts(docs).collect()}
    assert found[2]["payload_bytes"] == 64 == found[3]["payload_bytes"] and found[2]["n_bytes"] == 0 and found[2]["media_sha256"] == found[3]["media_sha256"]
    for i in (3, 6, 7):
        pages = b"".join(p["pixels"] for p in tiff.page_rows(bytes(found[i]["media"])))
        text = next((x or "").encode() for k, x, _ in ROWS if k == i)
        assert pages.rstrip(b"\0") == text and len(pages) % 64 == 0 and found[i]["payload_bytes"] == len(pages)


# ---- SimHash


def plain_print(text, size):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, near):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def noisy_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(n // 4)]
    out = []
    for k in range(n):
        t = list(base[k % len(base)])
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


def test_simhash_groups_equal_brute_force(spark):
    texts = [*noisy_texts(80, 9), "", None, "  \n", "One", "one", "TWO words", "two WORDS", "É é é é", "É é é é "]
    rows = [(100 + 7 * i % 997, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, texts[0]), (5000, texts[0])], "doc_id long, text string").withColumn("print", F.lit("clash"))
    prints = [plain_print(t, 3) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    roots = plain_components([prints[i] for i in order], lambda a, b: (a ^ b).bit_count() <= 3)
    want = {rows[i][0]: (prints[i], rows[order[r]][0]) for i, r in zip(order, roots, strict=True)}
    found = {r["doc_id"]: (r["print"] & (2**64 - 1), r["component"]) for r in simhash.near_groups(df).collect()}
    assert found.pop(5000) == want[rows[0][0]] == found.pop(None)
    assert found == want
    assert simhash.near_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize(("bits", "errors"), [(64, 3), (60, 3), (12, 2), (9, 0)])
def test_trie_join_equals_brute_force(bits, errors):
    rng = np.random.default_rng(10)
    top = np.uint64(64 - bits)
    a = rng.integers(0, 2**bits - 1, 300, dtype=np.uint64, endpoint=True) << top
    a = np.sort(np.concatenate([a, a[:100] ^ (np.uint64(1) << (rng.integers(0, bits, 100, dtype=np.uint64) + top)), a[:9]]))
    near = lambda i, j: int(a[i] ^ a[j]).bit_count() <= errors
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if near(i, j)}
    whole = (np.array([0]), np.array([len(a)]))
    got = [(int(x), int(y)) for u, v in trie_join.near_pairs(a, whole, whole, bits, errors) for x, y in zip(u, v, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    halves = sorted(range(len(a)), key=lambda i: (i % 2, a[i]))
    b, cut = a[halves], len(a) - len(a) // 2
    got = [(halves[int(x)], halves[int(y)]) for u, v in trie_join.near_pairs(b, (np.array([0]), np.array([cut])), (np.array([cut]), np.array([len(a)])), bits, errors) for x, y in zip(u, v, strict=True)]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == {(i, j) for i, j in want if i % 2 != j % 2}


def test_every_near_pair_shares_a_cell_and_is_met_first_in_one():
    rng = np.random.default_rng(11)
    shape = trie_join.Shape(4, 3, 7, 22)
    lanes = rng.integers(0, 2**63, (200, 4), dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 4, 3), dtype=np.uint64), axis=2)
    both = np.concatenate([lanes, lanes ^ flips])
    cells = shape.cells(both)
    near = [[int(trie_join.sub_prints(both, t, 22)[i] ^ trie_join.sub_prints(both, t, 22)[i + 200]).bit_count() <= 3 for t in range(7)] for i in range(200)]
    for i in range(200):
        shared = np.flatnonzero(cells[i] == cells[i + 200])
        assert {c // 4 for c in shared.tolist()} >= {t for t in range(7) if near[i][t]}
        owned = 0
        for c in shared.tolist():
            if near[i][c // 4]:
                two = np.array([cells[i][c], cells[i + 200][c]])
                pair = both[[i, i + 200]]
                owned += int(shape.first_met(pair, shape.rest(pair, two), two, np.array([0]), np.array([1]), True)[0])
        assert owned == any(near[i])


@pytest.mark.parametrize("cell", [4, 1 << 18])
def test_small_pieces_and_parts_lose_no_links(spark, monkeypatch, cell):
    texts = noisy_texts(120, 11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, simhash.near_groups(df).collect()))
    for name, value in (("HELD", 64), ("CELL", cell), ("LEAF", 2), ("DEALT", 50)):
        monkeypatch.setattr(trie_join, name, value)
    assert sorted(map(tuple, simhash.near_groups(df).collect())) == whole


def test_members_are_all_possible(spark, monkeypatch):
    from trawl.llm import members

    df = spark.range(5000).withColumn("x", F.concat(F.lit("t"), F.col("id").cast("string"))).unionByName(spark.createDataFrame([(None, None)], "id long, x string"))
    keys = spark.createDataFrame([(i, f"t{i}") for i in range(0, 5000, 50)] + [(None, None)], "k long, y string")
    found = members.possible(df, ["id", "x"], keys, ["k", "y"], "flag").where("flag").collect()
    assert {r["id"] for r in found} >= {None, *range(0, 5000, 50)} and len(found) < 130
    monkeypatch.setattr(members, "SLOTS", 64)  # full: all rows must be joined
    assert members.possible(df, ["id", "x"], keys, ["k", "y"], "flag").where("flag").count() > 3000
    assert members.possible(df, ["id", "x"], keys.limit(0), ["k", "y"], "flag").where("flag").count() == 0


def test_near_copies_at_a_similarity(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for k in range(40):
        t = [rng.choice(words) for _ in range(400)]
        u = list(t)
        for _ in range(4):  # similarity about 0.9
            u[rng.randrange(400)] = "new"
        v = [x if rng.random() < 0.8 else "else" for x in t]  # about 0.2
        rows += [(3 * k, " ".join(t)), (3 * k + 1, " ".join(u)), (3 * k + 2, " ".join(v))]
        pairs.append((3 * k, 3 * k + 1))
    rows += [(900, None), (901, ""), (None, "x y z")]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[a] == found[b] == a for a, b in pairs) and all(found[3 * k + 2] == 3 * k + 2 for k in range(40)) and found[901] == 900


def plain_jaccard(x, y, size=5):
    sets = []
    for t in (x, y):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("cell", [8, 1 << 18])
def test_links_that_are_not_confirmed_hide_no_others(spark, monkeypatch, cell):  # 8: lots are too large for one task, and cells are parted
    rng = random.Random(14)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts = []
    for _ in range(30):  # each two at about 0.74
        t = list(base)
        for i in rng.sample(range(400), 6):
            t[i] = f"v{rng.randrange(10**6)}"
        texts.append(t)
    for t in texts[:12]:  # each has one partner at about 0.93
        u = list(t)
        for i in rng.sample(range(400), 3):
            u[i] = f"z{rng.randrange(10**6)}"
        texts.append(u)
    texts = [" ".join(t) for t in texts]
    roots = plain_components(texts, lambda a, b: plain_jaccard(a, b) >= 0.8)
    assert len(set(roots)) > 5 and len(set(roots)) < len(texts)
    monkeypatch.setattr(trie_join, "CELL", cell)
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == roots


def test_rows_of_one_id_are_judged_one_by_one(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [("x", a, 1), ("x", b, 2), ("y", a + " more", 3), (None, b, 4), (None, "alone " * 9, 5), ("z", "own words here", 6), ("z", "own words here", 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, judged_first int").withColumnRenamed("judged_first", "key")
    left = simhash.without_near_copies(docs)
    assert left.schema == docs.schema
    kept = sorted(r["key"] for r in left.collect())
    assert kept in ([1, 2, 5, 6], [1, 2, 5, 7])
    assert simhash.without_near_copies(docs.limit(0)).collect() == []


def test_columns_of_any_name_come_through(spark):
    names = ["judged_text", "judged_id", "judged_maybe", "judged_first", "judged_digest", "members_map", "members_bits", "maybe", "row", "id", "digest", "key", "n"]
    rows = [(i, f"one two three four five six seven {i // 2}", *(f"{c}{i}" for c in names)) for i in range(8)] + [(None, None, *names)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["doc_id", "text", *names]))
    left = simhash.without_near_copies(docs)
    assert left.schema == docs.schema
    assert sorted(map(tuple, left.collect()), key=str) == sorted([tuple(None if x is None else str(x) for x in r) for r in [*rows[:8:2], rows[8]]], key=str)
    assert simhash.without_near_copies(docs.limit(0)).collect() == []


def test_texts_of_few_shingles(spark):
    """All pairs of similarity 0.8 or more are found where they have nine shingles together or fewer."""
    rng = random.Random(21)
    texts = []
    for k in range(400):
        t = [f"w{rng.randrange(10**6)}" for _ in range(5 + k % 9)]
        texts += [" ".join(t), " ".join([*t, "more"])] if k % 2 else [" ".join(t), " ".join(["first", *t])]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in range(0, 800, 2):
        n = len(texts[k].split()) - 4
        assert (found[k + 1] == k) == (n / (n + 1) >= 0.8) or n > 8, (k, n)


@pytest.mark.parametrize(("rows", "copies"), [(10**4, 24), (10**6, 30), (10**9, 200), (10**11, 1000)])
def test_cells_stay_small(rows, copies):
    shape = simhash.near_shape(rows, 0.8, 0.995, 3)
    assert shape.copies <= copies and rows / 2 ** min(b - a for a, b in zip(shape.ends, shape.ends[1:], strict=False)) <= trie_join.CELL


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (None, 4), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)} | {201: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- PII

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    """(start, kind, end) of each valid base span."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def plain_spans(text):
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in plain_base(text))


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["s"] for r in df.select("i", pii.shown(pii.base_spans(F.coalesce("t", F.lit("")))).alias("s")).orderBy("i").collect()]


def test_base_spans_equal_python(spark):
    rng = random.Random(13)
    parts = ["a@b.c", "x.y+z@m-n.org.", "_d@e.f", "1.2.3.4", "1.2.3.256", "0010.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456.78", "+1 2", "é", " ", "-", "@", ".", "7", "12", "\n", "日"]
    texts = ["", "a@b.c_d@e.f", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(600))]
    assert base_of(spark, texts) == [plain_spans(t) for t in texts]


def test_long_runs_are_found_in_time(spark):
    texts = ["7" * 200_000, "a" * 200_000, "a." * 60_000 + "@", "+1" + " " * 50_000 + "x", "1.2.3.4 " * 3000, "-@" * 5000]
    found = base_of(spark, texts)
    assert found[:4] == ["", "", "", ""] and found[4].count("ip:") == 3000 and found[4].endswith("ip:23992:23999")


def secret_documents(spark):
    rows = [(i, f"Mail jane@corp.org or ask for Zephyrine in town {i} number{i}", i) for i in range(6)]
    rows += [(10 + i, f"In town the people ask for or mail {i} and number{i + 50}", i) for i in range(30)]
    rows += [(50, "Zephyrine is elsewhere", None), (51, None, 3), (52, "call +49 30 1234567 and 4111 1111 1111 1111", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, base int")


def test_terms_that_disclose_are_found_where_the_entity_is(spark):
    found = {r["row"]["doc_id"]: r for r in pii.personal_spans(secret_documents(spark), ["doc_id", "base"]).collect()}
    assert len(found) == 39 and found[51]["base"] == [] and found[50]["terms"] == []
    for i in range(6):
        text = f"Mail jane@corp.org or ask for Zephyrine in town {i} number{i}"
        assert [text[s["start"] : s["stop"]] for s in found[i]["terms"]] == ["Zephyrine"]
    assert all(not found[10 + i]["terms"] for i in range(30))


def test_copies_of_one_text_disclose_nothing(spark):
    rows = [(i, "Write to bob@x.org about Quuxly today") for i in range(20)] + [(100 + i, f"filler {i}") for i in range(50)]
    found = pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert found.where(F.size("terms") > 0).count() == 0 and found.where(F.size("base") == 1).count() == 20


def test_entities_of_one_text_take_part(spark):
    rows = [(0, "Write to bob@x.org or 10.1.2.3 about Quuxly today"), (1, "Ann met eve@y.org with Plimth today"), (2, "Plimth again but eve@y.org is out")]
    rows += [(10 + i, f"or write to them about filler {i} again today") for i in range(3000)]
    found = {r["row"]["doc_id"]: r for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    texts = dict(rows)
    marked = {i: [texts[i][s["start"] : s["stop"]] for s in found[i]["terms"]] for i in range(3)}
    assert marked == {0: ["Quuxly"], 1: ["Ann", "met", "with", "Plimth"], 2: ["Plimth", "but", "is", "out"]}
    assert all(not found[10 + i]["terms"] for i in range(3000))


def test_terms_that_disclose_are_marked_wherever_they_stand(spark):
    df = secret_documents(spark)
    found = {r["row"]["doc_id"]: r for r in pii.personal_spans(df, ["doc_id"], everywhere=True).collect()}
    assert len(found) == 39 and found[50]["base"] == [] and found[51]["terms"] == []
    assert [(s["start"], s["stop"]) for i in (0, 50) for s in found[i]["terms"]] == [(30, 39), (0, 9)]
    assert all(not found[10 + i]["terms"] for i in range(30))
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert out[50] == "<TERM> is elsewhere" and out[51] is None


def plain_terms(rows, support=3, generalise=0.9, remove=0.98):
    """Spans of the query by plain loops: (doc_id, base and term spans, what replaces terms)."""
    texts = {i: t or "" for i, t in rows}
    words = {i: set(regex.findall(r"[\p{L}\p{N}]+", t.lower())) for i, t in texts.items()}
    secret = {w for ws in words.values() for w in ws if re.fullmatch("[a-z0-9]{16,}", w) and re.search("[a-z]", w) and re.search("[0-9]", w)}
    base = {i: plain_base(t) for i, t in texts.items()}

    def key(i, span):
        value = texts[i][span[0] : span[2]]
        return (span[1], value.lower() if span[1] == 0 else value if span[1] == 1 else re.sub("[^0-9]", "", value))

    entities = collections.defaultdict(set)
    for i in texts:
        for e in {key(i, s) for s in base[i]} | {(4, w) for w in words[i] & secret}:
            entities[e].add(i)
    n, df, classes = len(texts), collections.Counter(w for ws in words.values() for w in ws), collections.Counter()
    for ws in words.values():
        classes.update({w[:k] + f"/{k}" for w in ws for k in pii.CLASS_LETTERS})
    best = {w: (2.0, "") for w in secret}
    for ids in entities.values():
        info = np.log2(n / len(ids))
        for w in {w for i in ids for w in words[i]}:
            both = [i for i in ids if w in words[i]]
            copies = min(support, len({texts[i] for i in both}))
            share = (np.log2(len(both) * n / (len(ids) * df[w])) - np.log2((1 + support) / (1 + copies))) / info if info > 0 else 0
            if share >= generalise:
                safe = [f"<{w[:k]}*>" for k in pii.CLASS_LETTERS if np.log2(n / classes[w[:k] + f"/{k}"]) / info < generalise]
                best[w] = max(best.get(w, (0, "")), (share, "" if share >= remove else [*safe, "<TERM>"][0]))
    out = {}
    for i, t in texts.items():
        own = [(m.start(), m.end(), best[m.group().lower()][1]) for m in regex.finditer(r"[\p{L}\p{N}]+", t) if m.group().lower() in best]
        own = [(a, b, v) for a, b, v in own if not any(s[0] < b and a < s[2] for s in base[i])]
        out[i] = ({(s[0], s[1], s[2]) for s in base[i]}, {(a, b): v for a, b, v in own})
    return out


def test_spans_of_the_query_equal_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_terms(rows)
    assert sum(len(t) for _, t in want.values()) > 0  # the method adds spans on the table
    names = dict(enumerate(pii.KINDS))
    found = {r["doc_id"]: r["spans"] for r in pii.op10_pii(spark, sf).collect()}
    for i, (base, terms) in want.items():
        all_ = sorted([(a, k, b) for a, k, b in base] + [(a, 4, b) for a, b in terms])
        assert found[i] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in all_), i


def test_terms_become_classes_of_the_corpus(spark):
    rows = [(i, f"Mail jane@corp.org or ask for Zephyrine in town {i} number{i}") for i in range(6)]
    rows += [(10 + i, f"In town the people ask for zephyrs{i} or mail {i} and number{i + 50}") for i in range(30)] + [(90, "Zephyrine"), (91, 'token = "0123456789abcdef0123" here'), (92, "0123456789ABCDEF0123 again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_terms(rows)
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "<zep*>" in out[0] and out[90] == "<zep*>" and out[91] == 'token = "" here' and out[92] == " again"
    assert {want[0][1][k] for k in want[0][1]} == {"<zep*>"}


def test_sanitised_texts(spark):
    df = secret_documents(spark)
    out = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns and out[51]["text"] is None and out[50]["base"] is None
    assert out[0]["text"] == "Mail <EMAIL> or ask for <TERM> in town 0 number0"  # a term that one other text holds too
    gone = {r["doc_id"]: r["text"] for r in pii.sanitise(df, remove=0.9).collect()}
    assert gone[0] == "Mail <EMAIL> or ask for  in town 0 number0"
    assert out[52]["text"] == "call <PHONE> and <CARD>" and out[10]["text"] == "In town the people ask for or mail 0 and number50"
    softer = {r["doc_id"]: r["text"] for r in pii.sanitise(df, generalise=0.5, remove=2.0).collect()}
    assert "<TERM>" in softer[0] and pii.sanitise(df.limit(0)).collect() == []


# ---- Katz


def plain_katz(rows):
    tokens = [(i, (t or "").encode().lower().split() + ["</s>"]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in tokens]
    one, two, ctx = {}, {}, {}
    for (_, t), h in zip(tokens, held, strict=True):
        if not h:
            for v, w in zip(["<s>", *t[:-1]], t, strict=True):
                one[w], two[v, w], ctx[v] = one.get(w, 0) + 1, two.get((v, w), 0) + 1, ctx.get(v, 0) + 1
    rules = [katz.discounts([sum(1 for c in x.values() if c == r) for r in range(1, 7)]) for x in (one, two)]
    d = lambda c, k: float(katz.discounted(np.array([c]), rules[k])[0])
    n = sum(one.values())
    unknown = 1 - sum(d(c, 0) for c in one.values()) / n if n else 1.0
    single = lambda w: d(one[w], 0) / n if one.get(w) else unknown

    def pair(v, w):
        if not ctx.get(v):
            return single(w)
        own = [(x, c) for (y, x), c in two.items() if y == v]
        keep = sum(d(c, 1) for _, c in own) / ctx[v]
        scale = ctx[v] / (ctx[v] + 1) if 1 - keep < 1e-9 else 1
        if (v, w) in two:
            return scale * d(two[v, w], 1) / ctx[v]
        return (1 - scale * keep) / (1 - sum(single(x) for x, _ in own)) * single(w)

    out = [(i, h, len(t), sum(w in one for w in t), n, sum(np.log10(pair(v, w)) for v, w in zip(["<s>", *t[:-1]], t, strict=True))) for (i, t), h in zip(tokens, held, strict=True)]
    sums = [sum(pair(v, w) for w in one) + pair(v, "never seen") for v in [*ctx, "never seen"]]
    return out, sums


@pytest.mark.parametrize("buckets", [4, 1])
def test_katz_equals_brute_force_and_sums_to_one(spark, monkeypatch, buckets):
    rng = random.Random(14)
    words = ["the"] * 8 + [f"w{int(rng.paretovariate(0.7))}" for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(150)] + [(None, "the THE the"), (3, None), (3, ""), (7, "É é z" * 3)]
    monkeypatch.setattr(katz, "BUCKETS_EACH", buckets)
    monkeypatch.setattr(katz, "CHUNK_WORDS", 300)
    want, sums = plain_katz(rows)
    assert np.allclose(sums, 1, atol=1e-12)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in katz.score_texts(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5]))


def test_katz_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = katz.score_texts(df, held_out=F.lit(True)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in found) and len(found) == 2
    assert katz.score_texts(df.limit(0)).collect() == []


def test_discounts_take_from_every_rare_count():
    for counts in ([10, 4, 2, 1, 1, 1], [5, 9, 1, 1, 1, 1], [0, 0, 3, 0, 0, 0], [1, 0, 0, 0, 0, 0]):
        rule = katz.discounts(counts)
        kept = katz.discounted(np.arange(1, 4), rule)
        assert (kept <= np.arange(1, 4)).all() and (kept > 0).all() and (kept < np.arange(1, 4)).any()


def test_pairs_pack():
    rng = np.random.default_rng(15)
    keys = np.unique(rng.integers(0, 50, 400, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 2**32, 400, dtype=np.uint64))
    times = rng.integers(0, 9, len(keys)).astype(np.uint32)
    m, blob = katz.pack_pairs(keys, times)
    k, t = katz.unpack_pairs(blob, len(keys), m)
    assert (k == keys).all() and (t == times).all()
