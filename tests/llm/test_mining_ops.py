"""Collocations, WARC archives and the prefix trie against plain versions on awkward rows."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import collocations, prefix_trie, warc
from trawl.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", ["op11_collocations", "op12_warc", "op13_prefix_trie"])
def test_query_equals_sql(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert by_text(map(tuple, df.select(*found.columns).collect())) == by_text(found.fetchall())


# ---- collocations


def plain_phrases(rows, longest, least, top):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    kept = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *words), a in kept.items():
        cuts = [(1000 * a * n[lang] // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(g[0] == lang and len(g) > len(words) + 1 and b >= a and any(list(g[i : i + len(words)]) == words for i in range(1, len(g))) for g, b in kept.items())
        if not inside:
            phrase = " ".join(words)
            out[lang].append((-score, -a, phrase.encode(), phrase, a, counts[lang, *words[:k]], counts[lang, *words[k:]], n[lang], score))
    return by_text((lang, i + 1, *r[3:]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top]))


def mixed_texts(seed):
    rng = random.Random(seed)
    words = ["The", "the", "a", "Émile", "é", "big\x1cword", "x\0y", "CAT", "cat", "new", "york", "city"]
    some = [" ".join(rng.choices(words, k=rng.choice([1, 3, 9, 40]))) for _ in range(60)]
    some += [rng.choice(". , ; : ! ? \n \x0b \x0c \r \t".split(" ")).join(rng.sample(words, 8)) for _ in range(60)]
    some += ["new york city hall"] * 9 + ["a a a a a a a a"] * 3 + [None, "", " \t\n", "...", "NEW\tYORK  city"]
    return [(t, rng.choice(["en", "en", "en", "de", None, ""])) for t in some]


@pytest.mark.parametrize(("longest", "least", "top"), [(5, 4, 2000), (3, 2, 7), (2, 3, 2000), (1, 1, 5)])
def test_phrases_equal_brute_force(spark, longest, least, top):
    rows = mixed_texts(longest)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({c: F.lit("clash") for c in ("n", "phrase", "f", "blob", "rank")})
    found = collocations.phrases(df, longest=longest, least=least, top=top)
    assert by_text(map(tuple, found.collect())) == plain_phrases(rows, longest, least, top)


def test_no_phrases(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.phrases(df).collect() == []
    assert collocations.phrases(spark.createDataFrame([(None, None), ("", "en")], df.schema), least=1).collect() == []


def test_scores_beyond_64_bits(spark):
    """The products of the query's own expressions, where counts are as large as they may be."""
    found = spark.createDataFrame([(9 * 10**15, 9 * 10**15, 9 * 10**15)], "a long, n long, l long").selectExpr("cast(a as decimal(16,0)) * cast(n as decimal(16,0)) * cast(1000 as decimal(4,0)) div (cast(l as decimal(16,0)) * cast(l as decimal(16,0))) as score")
    assert found.first()["score"] == 1000


def test_texts_are_cut_anywhere(monkeypatch):
    text = "".join(random.Random(3).choices("ab. ,\tcD\n", k=3000)).encode()
    whole = [w for part in collocations.words_of(text) for w in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(collocations, "SLICE", size)
        assert [w for part in collocations.words_of(text) for w in part] == whole


def test_chunks_end_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 5)
    monkeypatch.setattr(collocations, "SLICE", 4)
    chunk, seen = collocations._Chunk(), []
    text = b"a b c. d e f g h i j k. l m. n o p q. r"
    for words in collocations.words_of(text):
        chunk.add(words)
        if chunk.full():
            rest = chunk.cut()
            names = list(chunk.numbers)
            seen.append([names[i] for i in np.concatenate(chunk.ids).tolist()])
            chunk = collocations._Chunk(rest)
    names = list(chunk.numbers)
    seen.append([names[i] for i in np.concatenate(chunk.ids).tolist()])
    assert len(seen) > 2
    assert all(s[-1] == b"." for s in seen[:-1])
    assert [w for s in seen for w in s] == [w for part in collocations.words_of(text) for w in part]


# ---- WARC


def plain_records(pages):
    groups = collections.defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is not None, x))
        for i, page in enumerate(ids):
            first = len(payload) < 1000 or i == len(ids) - 1
            out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if first else "revisit", None if first else ids[-1]))
    return by_text(out)


@pytest.fixture(scope="module")
def pages():
    long = "ä<p>\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(i, f"http://a/{i}", long) for i in range(40)] + [(None, "http://a/n", long), (7, "http://b", "y" * 999), (8, None, "y" * 999), (9, "bad\r\nX-Evil: 1", "x" * 1000), (10, "u", "x" * 1000)]
    rows += [(20, "u", None), (21, "u", ""), (22, "u", "\0\1\r\n"), (None, None, "z" * 2000), (None, None, "z" * 2000), (50, "same", "r" * 1500), (50, "same", "r" * 1500), (50, "other", "r" * 1500), (60, "u", "no end of line"), (-5, "u", "w" * 1200)]
    rng = random.Random(1)
    return rows + [(100 + i, f"http://c/{i}", "".join(rng.choices("abc<>\n\r é", k=rng.choice([0, 50, 5000])))) for i in range(60)]


def written(spark, df, where, **more):
    warc.write_archives(df, f"{where}/streams")
    warc.normalise(spark, f"{where}/streams", f"{where}/normal", **more)
    return f"{where}/normal"


def test_archives_read_back(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit("clash") for c in ("id", "row", "digest", "payload", "members_map", "value")})
    target = written(spark, df, tmp_path, archive_bytes=4000)
    found = warc.read_records(spark, target)
    short = found.select(warc.page_number(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_number(F.col("refers_to")))
    assert by_text(map(tuple, short.collect())) == plain_records(pages)
    stored = {(r["payload_digest"], bytes(r["payload"])) for r in found.where("record_type = 'response'").collect()}
    assert stored == {(hashlib.sha1(p).hexdigest(), p) for p in ((x[2] or "").encode() for x in pages)}

    streams = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "streams").glob("*.gz")]
    assert sum(s.count(b"WARC-Record-ID: <urn") for s in streams) == len(pages)
    for p in (tmp_path / "streams").glob("*.gz"):  # one member each
        z = zlib.decompressobj(warc.GZIP)
        z.decompress(p.read_bytes())
        assert z.eof and not z.unused_data
    index = warc.index_of(spark, target).collect()
    bodies = {p.parent.name.removeprefix("archive="): p.read_bytes() for p in (tmp_path / "normal/archives").rglob("part-*")}
    assert len(index) == len(pages) and len(bodies) > 3
    for name, body in bodies.items():
        places = sorted((r["offset"], r["length"]) for r in index if r["archive"] == name)
        assert places[0][0] == 0 and sum(n for _, n in places) == len(body)  # gapless
        assert gzip.decompress(body) == b"".join(zlib.decompress(body[at : at + n], warc.GZIP) for at, n in places)
    split = lambda raw: [r for _, r in warc.Splitter().feed(raw)]
    assert sorted(r for s in streams for r in split(s)) == sorted(r for b in bodies.values() for r in split(gzip.decompress(b)))

    some = warc.index_of(spark, target).where("target_uri = 'bad%0D%0AX-Evil: 1'")
    assert [r["payload_bytes"] for r in warc.read_records(spark, target, some, payloads=False).collect()] == [1000]


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(spark, written(spark, df, tmp_path)).collect() == []


def test_records_of_16_mb(spark, tmp_path):
    """The size at a member's end then has no NUL in its last byte."""
    html = "0123456789abcdef" * ((17 << 20) // 16)
    df = spark.createDataFrame([(1, "u", html), (2, "v", "short")], "page_id long, url string, html string").coalesce(1)
    found = warc.read_records(spark, written(spark, df, tmp_path, archive_bytes=1), payloads=False).collect()
    assert sorted((r["record_id"], r["payload_bytes"]) for r in found) == [("<urn:trawl:page:1>", len(html)), ("<urn:trawl:page:2>", 5)]


def test_splitter_takes_any_pieces():
    records = [b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: %d\r\nX: 1\r\n  2\r\n\r\n" % len(b) + b + warc.END for b in (b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", b"abc" * 50)]
    stream = b"".join(records)
    for cut in range(len(stream)):
        s = warc.Splitter()
        assert [r for piece in (stream[:cut], stream[cut:]) for _, r in s.feed(piece)] == records
        s.close()
    s = warc.Splitter()
    assert [f[b"x"] for f, _ in s.feed(stream + b"\r\n")] == [b"1 2"] * 4
    s.close()
    for broken in (stream[:-1], stream[:-60], stream + b"WARC"):
        s = warc.Splitter()
        list(s.feed(broken))
        with pytest.raises(ValueError, match="ends within"):
            s.close()
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.Splitter().feed(b"GET / HTTP\r\n\r\n"))


def test_members_of_others_are_normalised(spark, tmp_path):
    """Streams of several members, and members that end within records, are inflated as one stream."""
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + warc.END
    stream = record * 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(gzip.compress(stream[:100]) + gzip.compress(stream[100:]))
    warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert [(r["record_id"], bytes(r["payload"])) for r in warc.read_records(spark, f"{tmp_path}/out").collect()] == [("<x>", b"abc")] * 5
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"))


# ---- prefix trie


def plain_trie(sequences):
    """conv -> list of (role, text); rows as prefix_trie gives them."""
    nodes = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    children = collections.Counter(s[:-1] for s in nodes if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += children[s] == 0
            saved[s[:d]] += (len(members) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(sequences[c]) == len(s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return by_text(out)


def trees(seed, n=60):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(-4000, 9000), n):
        start = out[rng.choice(list(out))][: rng.randint(0, 4)] if out and rng.random() < 0.8 else []
        out[c] = start + [(rng.choice(["user", "assistant", ""]), rng.choice(["a", "b", "é😀", "long " * 20, ""])) for _ in range(rng.choice([0, 1, 2, 5]))]
    out[9500] = [("user", f"turn {i}") for i in range(300)]  # lies in several ranges
    out[9501] = out[9500][:250] + [("user", "else")]
    return out


def trie_rows(spark, sequences, **more):
    rows = [(c, d, r or None, t or None) for c, s in sequences.items() for d, (r, t) in enumerate(s)]
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    ids = spark.createDataFrame([(c,) for c in sequences] + [(None,)], "conv long")
    out = prefix_trie.prefix_trie(turns.withColumns({c: F.lit("clash") for c in ("f", "path", "part", "n", "depth")}), ids, "turn", **more)
    return by_text(map(tuple, out.collect()))


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (7, 3)])
def test_trie_equals_brute_force(spark, primes):
    """With tiny primes most fingerprints collide, and groups must be split."""
    sequences = trees(sum(primes))
    assert trie_rows(spark, sequences, primes=primes) == plain_trie(sequences)


def test_sums_over_blocks_of_depths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    sequences = trees(5, 20)
    assert trie_rows(spark, sequences) == plain_trie(sequences)


def test_no_conversations(spark):
    assert trie_rows(spark, {}) == []
    assert trie_rows(spark, {3: [], 5: []}) == plain_trie({3: [], 5: []})


def test_scan_in_any_batches():
    rng = np.random.default_rng(1)
    key, hashes = np.sort(rng.integers(0, 9, 200)), rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)
    want, sums = [], {}
    for k, h in zip(key.tolist(), hashes.tolist(), strict=True):
        n, s = sums.get(k, (0, [0, 0]))
        s = [(x + h % p * pow(b, n, p)) % p for x, p, b in zip(s, prefix_trie.PRIMES, prefix_trie.BASES, strict=True)]
        sums[k] = (n + 1, s)
        want.append((n + 1, *s))
    for size in (1, 17, 200):
        found, last, held = [], None, (0, [0, 0])
        for at in range(0, 200, size):
            k = key[at : at + size]
            pos, s = prefix_trie.scan(k, hashes[at : at + size], held if k[0] == last else (0, [0, 0]), prefix_trie.PRIMES)
            found += zip(pos.tolist(), s[0].tolist(), s[1].tolist(), strict=True)
            last, held = k[-1], (found[-1][0], list(found[-1][1:]))
        assert found == want


def test_rebuilt_conversations(spark):
    rng = random.Random(4)
    rows = [(c, None if t == 0 else t, rng.choice(["user", None]), rng.choice(["a", "b", None])) for c in [*range(95, 112), 200, 201, 305, -3, -103, -100] for t in range(rng.choice([1, 3, 8]))]
    rows += [(None, 0, "user", "x"), (201, 1, "b", "tie"), (201, 1, "a", "tie"), (201, 1, "a", "tie")]
    own = collections.defaultdict(list)
    for c, _, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        own[c].append((r or "", t or ""))
    want = {}
    for c in own:
        h, head = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        want[c] = own.get(head, [])[:h] + own[c][h:]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(turns), turns.select(F.col("conv_id").alias("conv")), "pos")
    assert by_text(map(tuple, found.collect())) == plain_trie(want)


# ---- the columns of the TIFF query


def test_tiff_query_digests_what_plain_python_does(spark):
    """Sizes, hashes and features of the samples read back, from the texts alone."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_tiff"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    seen = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        told = dict(x.split("=") for x in r["feature"].split(";"))
        a = np.frombuffer(payload, np.uint8)
        n = np.bincount(a, minlength=256)
        share = n[n > 0] / len(a)
        grid = a.reshape(int(told["rows"]), -1)
        assert int(told["edges"]) == int((grid[:, 1:] != grid[:, :-1]).sum()) and int(told["top"]) == int(n.argmax()) and int(told["pages"]) >= 1
        assert abs(float(told["mean"]) - a.mean()) < 1e-4 and abs(float(told["entropy"]) + float((share * np.log2(share)).sum())) < 1e-4
        assert seen.setdefault(payload, (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])
    assert len({v[0] for v in seen.values()}) == len(seen)
