"""Files in pieces, and files found and read by executors."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trawl.operators.split_windows import split_line_windows
from trawl.operators.windows import line_windows
from trawl.sources.walk import look_into, pieces_of, planned_files, planned_listing

COLUMNS = ["relative_path", "chunk_index", "start_line", "end_line", "start_byte", "end_byte", "snippet", "doc_id"]


def compared(spark, texts, pieces, **more):
    files = spark.createDataFrame(list(texts.items()), "relative_path string, content string")
    want = line_windows(files, **more).select(*COLUMNS)
    given = spark.createDataFrame([(p, k, bytearray(x)) for p, k, x in pieces], "relative_path string, piece int, content binary").repartition(3)
    found = split_line_windows(given, **more).select(*COLUMNS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_cut_at_every_byte(spark):
    text = "﻿one\r\ntwo é\n\n \rfour\r\r\n\nsix 😀 x\nseven\r\n"
    raw = text.encode()
    cuts = {f"p{k}.md": [raw[:k], raw[k:]] for k in range(len(raw) + 1)}
    cuts["bytes.md"] = [raw[k : k + 1] for k in range(len(raw))]
    compared(spark, dict.fromkeys(cuts, text), [(p, i, x) for p, parts in cuts.items() for i, x in enumerate(parts)], window=3, overlap=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_pieces(spark, seed):
    rng, texts, pieces = random.Random(seed), {}, []
    for i in range(12):
        text = "".join(rng.choices(["a", "é", "\n", "\r\n", "\r", " ", "\n\n", "word "], k=rng.choice([0, 1, 5, 300, 2000])))
        texts[f"f{i}.txt"], raw, at, k = text, text.encode(), 0, 0
        while at < len(raw) or k == 0:
            n = rng.choice([0, 1, 2, 7, 100])
            pieces.append((f"f{i}.txt", k, raw[at : at + n]))
            at, k = at + n, k + 1
    compared(spark, texts, pieces, window=rng.choice([4, 40]), overlap=rng.choice([1, 3]))


def test_ordinals_go_on_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("trawl.operators.split_windows.BLOCK", 4)
    text = "\n".join("" if k % 9 < 4 else f"line {k}" for k in range(400))
    compared(spark, {"a.md": text}, [("a.md", k, text.encode()[k * 50 : k * 50 + 50]) for k in range(80)], window=3, overlap=1)


def test_pieces_are_read_twice_and_cut_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = "\n".join(f"line {k}" for k in range(200)).encode()
    pieces = [(f"f{i}.md", k, bytearray(text[k * 100 : k * 100 + 100])) for i in range(4) for k in range(-(-len(text) // 100))]
    given = spark.createDataFrame(pieces, "relative_path string, piece int, content binary")
    assert split_line_windows(given.mapInArrow(count, given.schema), window=12, overlap=4).count() == 100
    assert len(pieces) <= seen.value <= 2 * len(pieces)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "ws"
    for name, text in {"a.py": "1\r\n2", "x/b.PY": "22", "x/y/c.md": "# c", "node_modules/d.py": "no", "x/node_modules/e.py": "no", "big.py": "z" * 3000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "bad.py").write_bytes(b"\xff\xfe ok")
    (tmp_path / "outside.py").write_text("secret")
    os.symlink(tmp_path / "outside.py", root / "link.py")
    os.symlink(root / "x", root / "loop")
    return root


@pytest.mark.parametrize(("scheme", "spread"), [("", 1), ("file://", 64)])
def test_planned_files(spark, tree, scheme, spread):
    listed = planned_listing(spark, f"{scheme}{tree}", ["py"], ["node_modules"], spread)
    found = {r["relative_path"]: (r["size"], r["error"]) for r in listed.collect()}
    assert found == {"a.py": (4, None), "x/b.PY": (2, None), "big.py": (3000, None), "bad.py": (5, None), "link.py": (None, "escapes workspace root")}
    files, failed = planned_files(spark, f"{scheme}{tree}", ["py"], ["node_modules"], max_bytes=1000)
    assert {r["relative_path"]: r["content"] for r in files.collect()} == {"a.py": "1\r\n2", "x/b.PY": "22", "bad.py": "�� ok"}
    assert {r["relative_path"]: r["error"] for r in failed.collect()} == {"big.py": "file too large for indexing", "link.py": "escapes workspace root"}


def test_unreadable_folders_are_recorded(spark, tree):
    rows, more = look_into(str(tree), "none", frozenset(), ())
    assert rows[0][0] == "none" and rows[0][3].startswith("unreadable") and more == []
    files, failed = planned_files(spark, str(tree / "none"))
    assert files.count() == 0 and [r["relative_path"] for r in failed.collect()] == [""]


def test_skipped_folders_are_not_read(spark, tree, monkeypatch):
    """Not even listed: what would fail there does not."""
    seen = []
    monkeypatch.setattr("trawl.sources.walk.look_into", lambda root, folder, *a: seen.append(folder) or look_into(root, folder, *a))
    planned_listing(spark, str(tree), None, ["node_modules"]).collect()
    assert seen and not any("node_modules" in f for f in seen)


def test_large_files_are_many_tasks(spark, tree):
    listed = planned_listing(spark, str(tree), ["py"], ["node_modules"])
    pieces = pieces_of(listed, str(tree), 1000)
    assert {(r["relative_path"], r["piece"]): len(r["content"]) for r in pieces.where("relative_path = 'big.py'").collect()} == {("big.py", k): 1000 for k in range(3)}
    assert [r["snippet"] for r in split_line_windows(pieces).where(F.col("relative_path") == "a.py").collect()] == ["1\n2"]


def test_empty_pieces(spark):
    none = spark.createDataFrame([], "relative_path string, piece int, content binary")
    assert split_line_windows(none).collect() == []
    compared(spark, {"e.md": ""}, [("e.md", 0, b"")])
