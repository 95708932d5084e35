import random

import pytest
from pyspark.sql import functions as F

from trawl.chunkers import prose, query_text, syntax
from trawl.chunkers.common import Options
from trawl.chunkers.router import Routing, chunk_files, chunk_text, route_of, windows_of
from trawl.operators.windows import line_windows, window_options


def runes(budget, **more):
    return Options(max_tokens=budget, embed_ratio=1.0, prefix=False, min_tokens=1, window_lines=5, overlap_lines=1, count=len, **more)


MARKDOWN = """---
title: x
---
intro text

# One

First paragraph here. It has two sentences.

```py
# no heading
x = 1
```

## Two

| a | b |
| 1 | 2 |

last words
"""


def test_markdown_sections():
    found = list(prose.markdown_segments(MARKDOWN))
    assert [(s.kind, s.start, s.title, s.scope) for s in found] == [
        ("front", 1, "", ""),
        ("prose", 4, "", ""),
        ("prose", 6, "One", "section One"),
        ("code", 10, "", "section One"),
        ("prose", 15, "Two", "section One > Two"),
        ("table", 17, "", "section One > Two"),
        ("prose", 20, "", "section One > Two"),
    ]


def test_recursive_split_spans():
    body = "Line A\n\n\nLine B"
    assert prose.recursive_split(body, len(body), len) == [(body, 0, len(body))]
    assert [p[0] for p in prose.recursive_split("One two. Three four; five. Six", 12, len)] == ["One two.", "Three four;", "five. Six"]


def test_budget_is_never_exceeded_and_spans_hold():
    rng = random.Random(3)
    for _ in range(60):
        body = "".join(rng.choice(["word ", "x", ". A", "; ", "\n", "\n\n", "Ж", "…  9"]) for _ in range(rng.randrange(1, 120)))
        budget = rng.randrange(3, 40)
        for piece, a, b in prose.recursive_split(body, budget, len):
            assert 0 < len(piece) <= budget and "".join(piece.split()) == "".join(body[a:b].split())


def test_overlap_stays_within_a_section():
    text = "# A\n\n" + "Alpha beta gamma. " * 12 + "\n\n# B\n\nDelta."
    found = list(prose.prose_chunks("a.md", text, runes(80, overlap_ratio=0.3), True))
    assert len(found) > 3 and found[1].snippet != found[1].snippet.lstrip() or found[1].snippet.startswith("Alpha")
    assert found[-1].snippet == "# B\n\nDelta." and found[-1].symbol == "B"


def test_long_words_have_distinct_ids(spark):
    rows = spark.createDataFrame([("a.txt", " ".join(f"w{i}" for i in range(120)))], "relative_path string, content string")
    ids = [r["doc_id"] for r in chunk_files(rows, Options(max_tokens=40, prefix=False)).collect()]
    assert len(ids) > 1 and len(set(ids)) == len(ids)


def test_queries():
    assert query_text.split_queries("SELECT ';' FROM a; ВЫБРАТЬ \"x;\"\"y\" ИЗ b;; UPDATE c") == ["SELECT ';' FROM a", 'ВЫБРАТЬ "x;""y" ИЗ b']
    assert query_text.query_name("\n select Name, Other from t") == "Name"
    assert query_text.unquoted('"SELECT a\n  |FROM b"') == "SELECT a\nFROM b"
    chunks, rest = query_text.xml_query_chunks("s.dcs", "<a>\n<query>SELECT 1</query>\n<query>none</query></a>", Options(), "module s")
    assert [(c.start_line, c.kind, c.snippet) for c in chunks] == [(2, "query", "SELECT 1")] and "SELECT" not in rest


PYTHON = "import os\n\n\n@wrap\ndef first(a):\n    return a + 1\n\n\nclass Box:\n    def get(self):\n        return self.value\n\n    def put(self, v):\n        self.value = v\n"


def test_python_declarations():
    found = [(c.symbol, c.symbol_kind, c.start_line, c.end_line, c.scope) for c in syntax.syntax_chunks("m/x.py", PYTHON, "python", Options(count=len, max_tokens=400, prefix=False, embed_ratio=1.0))]
    assert ("first", "function", 4, 6, "module x") in found and ("Box", "class", 9, 14, "module x") in found and ("put", "method", 13, 14, "module x > class Box") in found


def test_braces_in_strings_and_comments():
    go = 'package p\n\n// func no() {\nfunc A() string {\n\treturn "}"\n}\n\nfunc (t *T) B() {\n\tif true {\n\t}\n}\n'
    assert [(n.kind, n.name, n.start, n.end) for n in syntax.braced_tree(go, "go")] == [("function", "A", 4, 6), ("method", "B", 8, 11)]


def test_broken_source_falls_back_to_windows():
    assert [c.strategy for c in chunk_text("a.py", "def (:\n x", "syntax", Options())] == ["line_window"]
    with pytest.raises(syntax.NoTree):
        syntax.tree("", "python")


def test_module_regions_and_embedded_queries():
    text = '#Область Main\nПроцедура Run()\n  q = "ВЫБРАТЬ a ИЗ b";\nКонецПроцедуры\n#КонецОбласти\n'
    found = list(syntax.syntax_chunks("m.bsl", text, "bsl", Options(min_tokens=1, count=len, max_tokens=500, prefix=False, embed_ratio=1.0)))
    assert any(c.symbol == "Run" and c.scope == "module m > region Main" for c in found)
    assert any(c.kind == "query" and c.snippet == "ВЫБРАТЬ a ИЗ b" for c in found)


def test_routes():
    r = Routing()
    assert [route_of(e, r) for e in (".md", ".PY", ".tsx", ".dcs", ".rs", "")] == ["prose", "syntax", "syntax", "xml_queries", "line_window", "line_window"]
    assert route_of(".py", Routing(strategy="line_window")) == "line_window" == route_of(".py", Routing(strategy="prose"))


@pytest.mark.parametrize(("window", "overlap", "want"), [(0, 0, (40, 8)), (3, 1, (3, 1)), (4, 9, (4, 1)), (10, 0, (10, 8))])
def test_window_options(window, overlap, want):
    assert window_options(window, overlap) == want


def test_windows_in_python_equal_windows_in_sql(spark):
    rng = random.Random(4)
    texts = ["", "\n\n", "a", "﻿b\r\nc\rd\n", *("\n".join(rng.choice(["", "line ж", "x" * 9]) for _ in range(n)) for n in (5, 12, 13, 50))]
    df = spark.createDataFrame([(f"f{i}.go", t) for i, t in enumerate(texts)], "relative_path string, content string")
    opts = Options(window_lines=5, overlap_lines=2)
    sql = {(r["relative_path"], r["start_line"]): (r["end_line"], r["start_byte"], r["end_byte"], r["snippet"]) for r in line_windows(df, window=5, overlap=2).collect()}
    normal = [t.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    python = {(c.path, c.start_line): (c.end_line, c.start_byte, c.end_byte, c.snippet) for i, t in enumerate(normal) for c in windows_of(f"f{i}.go", t, opts)}
    assert sql == python and len(sql) > 10


def test_all_routes_together(spark):
    rows = spark.createDataFrame([("a.md", MARKDOWN), ("b.py", PYTHON), ("c.yaml", "a: 1"), ("d.txt", None)], "relative_path string, content string")
    found = chunk_files(rows, Options(min_tokens=1))
    assert {(r["relative_path"], r["chunk_strategy"]) for r in found.collect()} == {("a.md", "prose"), ("b.py", "ast"), ("c.yaml", "line_window")}
    assert found.groupBy("doc_id").count().where(F.col("count") > 1).count() == 0


def test_chunks_are_handed_on_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from trawl.chunkers import router

    taken = []
    df = spark.createDataFrame([("a.md", "x")], "relative_path string, content string")
    own = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append(f) or own(self, f, schema))
    router.chunk_files(df)
    texts = [f"# Part {i}\n" + "\n\n".join(f"# Head {k}\n\nSome words {k}." for k in range(90)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}.md" for i in range(60)]), pa.array(texts)], names=["relative_path", "content"])
    out = list(taken[0](iter([batch])))
    want = [(f"d{i}.md", c.snippet) for i, x in enumerate(texts) for c in router.chunk_text(f"d{i}.md", x, "prose", router.Options())]
    assert [(p, x) for b in out for p, x in zip(b.column(0).to_pylist(), b.column(7).to_pylist(), strict=True)] == want
    assert len(want) > 3000 and max(b.num_rows for b in out) <= 1000
    long = [*taken[0](iter([pa.RecordBatch.from_arrays([pa.array([f"q{i}.txt" for i in range(40)]), pa.array([f"word{i} " * 40_000 for i in range(40)])], names=["relative_path", "content"])]))]
    assert max(sum(len(x) for x in b.column(7).to_pylist()) for b in long) < (1 << 21) + 4096
