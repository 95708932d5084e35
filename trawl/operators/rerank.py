"""Lexical rerank of search hits: distances are lowered by matches and raised by demotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.paths import basename, extension, slashes, stem
from trawl.functions.text import query_terms

# Fixed values of the scoring.
IN_PATH, IN_STEM, STEM_PREFIX, IN_SYMBOL, STRUCTURED = 0.18, 0.22, 0.12, 0.20, 0.06
DOCS, TESTDATA, PROSE, MICRO = 0.12, 0.10, 0.08, 0.10
FRONT_PAGES = ("install.md", "agents.md", "readme.md", "changelog.md")
MAX_LIMIT, DEFAULT_LIMIT = 100, 10


def _total(terms: Column, of_term) -> Column:
    return F.aggregate(F.transform(terms, of_term), F.lit(0.0), lambda a, x: a + x)


def path_boost(path: Column, terms: Column) -> Column:
    p, base = F.lower(slashes(path)), F.lower(stem(path))

    def one(t: Column) -> Column:
        early = (F.char_length(t) >= 5) & F.contains(p, F.substring(t, 1, 4))
        return F.when(F.contains(p, t), IN_PATH).otherwise(0.0) + F.when(F.contains(base, t), IN_STEM).otherwise(0.0) + F.when(early, STEM_PREFIX).otherwise(0.0)

    return F.when(path == "", F.lit(0.0)).otherwise(_total(terms, one))


def symbol_boost(symbol: Column, terms: Column) -> Column:
    name = F.lower(symbol)
    return F.when(symbol == "", F.lit(0.0)).otherwise(_total(terms, lambda t: F.when(F.contains(name, t), IN_SYMBOL).otherwise(0.0)))


def strategy_boost(strategy: Column) -> Column:
    return F.when(strategy.isin("ast", "partial"), STRUCTURED).otherwise(0.0)


def path_penalty(path: Column) -> Column:
    """The first rule that fits."""
    p = F.lower(slashes(path))
    return (
        F.when(path == "", 0.0)
        .when(basename(p).isin(*FRONT_PAGES), DOCS)
        .when(p.startswith("docs/") | F.contains(p, F.lit("/docs/")), DOCS)
        .when(p.startswith("testdata/") | F.contains(p, F.lit("/testdata/")), TESTDATA)
        .when(F.contains(p, F.lit("tests/realworld/corpus/")), TESTDATA)
        .when(extension(p).isin(".md", ".markdown", ".mdc", ".txt"), PROSE)
        .otherwise(0.0)
    )


def micro_penalty(start_line: Column, end_line: Column, snippet: Column) -> Column:
    return F.when((F.greatest(end_line - start_line, F.lit(0)) < 2) | (F.octet_length(snippet) < 40), MICRO).otherwise(0.0)


def adjusted(hits_have: Column, terms: Column) -> Column:
    """The adjusted score of a hit with the usual columns; lower is better."""
    return (
        hits_have
        - path_boost(F.col("path"), terms)
        - symbol_boost(F.col("symbol_name"), terms)
        - strategy_boost(F.col("chunk_strategy"))
        + path_penalty(F.col("path"))
        + micro_penalty(F.col("start_line"), F.col("end_line"), F.col("snippet"))
    )


def rerank(hits: DataFrame, query: str, limit: int, tie: str = "doc_id") -> DataFrame:
    """The best ``limit`` hits by adjusted score; ``score`` stays as it was. Ties keep the order of score and id."""
    return hits.withColumn("adjusted", adjusted(F.col("score"), query_terms(F.lit(query)))).orderBy("adjusted", "score", tie).limit(limit)


def over_fetch(limit: int) -> int:
    """How many hits are fetched to rerank ``limit``."""
    return min(100, max(40, (limit if limit > 0 else DEFAULT_LIMIT) * 5))


def over_fetch_of(limit: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(40), F.when(limit > 0, limit).otherwise(DEFAULT_LIMIT) * 5))


def normal_limit(limit: int, top_k: int | None = None) -> int:
    if limit == 0 and top_k is not None:
        limit = top_k
    if limit < 0:
        raise ValueError("limit must not be negative")
    return min(limit or DEFAULT_LIMIT, MAX_LIMIT)
