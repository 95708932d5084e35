"""Mixing sources to target weights by iterative proportional fitting.

Documents are cells by their margins (source, language, topic), and a cell's weight is its
tokens. Raking scales the cells to one margin's targets after the other until all margins
fit. A document is then kept by the probability that its cell's factor calls for, decided by
a hash of the document. Topics are learnt from the corpus: of each of the commonest languages
the words that come in bursts, by residual inverse document frequency over all documents, are
seeds, and a document's topic is the seed it holds most often. All is DataFrame and SQL
functions; texts are read twice and not shuffled, and what is iterated on is the table of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.shared import materialise, table

#: Rounds of raking at most, and the relative error of margins at which it stops.
ROUNDS, TOLERANCE = 30, 1e-4
#: Values of a hash that a document's draw is one of.
DRAWS = 1 << 40


def token_weight(text: Column) -> Column:
    """Tokens of a text as the mixture counts them: its words, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("double")


#: Topics besides "other", languages that have some, hash values of terms, and the shares of a language's documents that a seed may stand in.
TOPICS, LANGUAGES, TERMS, RARE, COMMON = 8, 16, 1 << 20, 0.002, 0.3
#: Letters that a term has at least, and what lies between words: ASCII other than letters.
TERM_LETTERS, BETWEEN = 6, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """A text's longer words in lower case, as they come."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: F.char_length(w) >= TERM_LETTERS)


def term_hash(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERMS))


def learn_topics(docs: DataFrame, text: Column, language: Column) -> dict[str, list[int]]:
    """Seeds by language, as hashes of terms, at most ``TOPICS`` of each of the ``LANGUAGES`` with the most documents.

    A seed's residual inverse document frequency is high: it stands in fewer documents than its
    occurrences, strewn at random, would. Counts are over all documents, by hash of the term.
    """
    marked = docs.select(_margin(language).alias("language"), terms(text).alias("terms"))
    sizes = {r["language"]: r["count"] for r in docs.groupBy(_margin(language).alias("language")).count().orderBy(F.desc("count"), "language").limit(LANGUAGES).collect()}
    if not sizes:
        return {}
    both = marked.where(F.col("language").isin(list(sizes))).select("language", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("distinct", "some"))
    each = both.select("language", "distinct", F.explode("some").alias("term"))
    once, all_ = F.sum("distinct"), F.sum(1 - F.col("distinct"))
    counts = each.groupBy("language", term_hash(F.col("term")).alias("hash")).agg(once.alias("documents"), all_.alias("times"))
    n = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))]), F.col("language"))
    ridf = F.log2(n / F.col("documents")) + F.log2(1 - F.exp(-F.col("times") / n))
    fit = counts.where((F.col("documents") >= F.greatest(F.lit(2.0), RARE * n)) & (F.col("documents") <= COMMON * n)).withColumn("ridf", F.round(ridf, 9))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("ridf"), "hash"))
    found = fit.withColumn("rank", rank).where(F.col("rank") <= TOPICS).select("language", "rank", "hash").collect()  # TOPICS x LANGUAGES rows at most
    return {k: [r["hash"] for r in sorted(found, key=lambda r: r["rank"]) if r["language"] == k] for k in sizes}


def topic(text: Column, language: Column, seeds: dict[str, list[int]]) -> Column:
    """The number of the seed that a text holds most often (the first of several), else "other"."""
    known = [(k, v) for k, v in seeds.items() if v]
    if not known:
        return F.lit("other")
    own = F.element_at(F.create_map(*[x for k, v in known for x in (F.lit(k), F.array(*[F.lit(w).cast("long") for w in v]))]), _margin(language))

    def held(x: Column) -> Column:
        """The seeds that a text holds, as they come; a lambda's variable is evaluated once."""
        return F.struct(x["own"].alias("own"), F.filter(x["found"], lambda h: F.array_contains(x["own"], h)).alias("found"))

    def best(x: Column) -> Column:
        counts = F.transform(x["own"], lambda s: F.size(F.filter(x["found"], lambda w: w == s)))
        return F.get(F.transform(F.array(counts), lambda c: F.concat(F.lit("topic "), F.array_position(c, F.array_max(c)).cast("string"))), F.lit(0))

    whole = F.array(F.struct(own.alias("own"), F.transform(terms(text), term_hash).alias("found")))
    some = F.filter(F.transform(whole, held), lambda x: F.size(x["found"]) > 0)
    return F.coalesce(F.get(F.transform(some, best), F.lit(0)), F.lit("other"))


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): the margin's shares to the ``power``, made to sum to 1. Power 1 keeps the shares, 0 makes them equal."""
    shares = cells.groupBy(margin).agg(F.sum("weight").alias("t")).withColumn("t", F.pow("t", F.lit(power)))
    total = shares.agg(F.sum("t").alias("all"))
    return shares.join(F.broadcast(total)).select(margin, (F.col("t") / F.col("all")).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: float | None = None) -> DataFrame:
    """``cells`` with ``fitted``: weights, summing to 1, whose margins fit ``targets`` (margin -> table (margin, target)); see ``fit_margins``."""
    return fit_margins(cells, targets, rounds, tolerance, most)[0]


def fit_margins(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: float | None = None) -> tuple[DataFrame, float]:
    """``rake``'s table, and its residual: the largest relative error of a margin when the last round began.

    Values without a target have target zero. Margins that cannot be met (a target without a
    cell, targets that contradict each other) are met as nearly as rescaling the others
    allows: then rounds end with a residual above ``tolerance``. ``most``: no cell's weight
    grows beyond so many times its share.
    """
    margins, names = list(targets), cells.columns
    total = cells.agg(F.sum("weight").alias("rake_all"))
    now = cells.join(F.broadcast(total)).withColumn("rake_share", F.col("weight") / F.col("rake_all")).drop("rake_all")  # one row
    for k, m in enumerate(margins):
        now = now.join(targets[m].select(m, F.col("target").alias(f"rake_{k}")), m, "left")
    held = [*names, "rake_share", *[F.coalesce(f"rake_{k}", F.lit(0.0)).alias(f"rake_{k}") for k in range(len(margins))]]
    now = materialise(now.select(*held, F.col("rake_share").alias("fitted")), "cells", share=64)
    off = 0.0
    for _ in range(rounds):
        step = now.withColumn("rake_off", F.lit(0.0))
        for k, m in enumerate(margins):
            sums = step.groupBy(m).agg(F.sum("fitted").alias("rake_sum"))
            target = F.col(f"rake_{k}")
            scaled = F.when(F.col("rake_sum") > 0, F.col("fitted") * target / F.col("rake_sum")).otherwise(F.lit(0.0))
            error = F.abs(F.col("rake_sum") - target) / F.greatest(target, F.lit(1e-12))
            step = step.join(sums, m).withColumn("rake_off", F.greatest("rake_off", error)).withColumn("fitted", F.least(scaled, most * F.col("rake_share")) if most else scaled).drop("rake_sum")
        now = materialise(step.select(*now.columns[: len(names) + 1 + len(margins)], "fitted", "rake_off"), "cells", share=64)
        off = now.agg(F.max("rake_off")).first()[0] or 0.0
        now = now.drop("rake_off")
        if off <= tolerance:
            break
    return now.select(*names, "fitted"), off


def _margin(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, power: float = 0.8, keep: float = 0.9, repeat: bool = True, seed: int = 2) -> DataFrame:
    """The rows of ``docs`` with ``mix_``-columns: margin values, weight, draw, factor, rate, copies and residual.

    ``margins``: name -> expression (source, language and learnt topic by default; null counts as
    ''). ``targets``: name -> table (value column of the margin's name, target), shares that
    sum to 1; by default the shares tempered by ``power``. A row's rate is its cell's factor
    times a level at which ``keep`` of all tokens stay. With ``repeat`` a rate over 1 means
    whole copies and a chance of one more, and the expected shares are the targets. Without
    it rates stop at 1, so that rows are kept or not: cells are raked under that bound, and
    shares come as near as it allows. ``mix_residual`` is the largest relative error of a
    margin that raking ended with, over ``TOLERANCE`` where targets cannot be met. A row's
    draw is a hash of id and text, so equal rows have equal draws. Columns of ``docs`` that
    begin with ``mix_`` are replaced or left out. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    if margins is None:
        text, language = F.col(text_col), F.col("lang")
        margins = {"source": F.col("source"), "lang": language, "topic": topic(text, language, learn_topics(docs, text, language))}
    names = {m: f"mix_{m}" for m in margins}
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit(seed)), F.lit(DRAWS)) / F.lit(float(DRAWS))
    marked = docs.select("*", *[_margin(c).alias(names[m]) for m, c in margins.items()], token_weight(F.col(text_col)).alias("mix_weight"), draw.alias("mix_draw"))
    marked = materialise(marked, "marked")
    keys = list(names.values())
    cells = materialise(marked.groupBy(*keys).agg(F.sum("mix_weight").alias("weight")), "cells", share=64)
    wanted = {names[m]: targets[m].select(_margin(F.col(m)).alias(names[m]), "target") if targets else tempered_targets(cells, names[m], power) for m in margins}
    fitted, residual = fit_margins(cells, wanted, most=None if repeat else 1 / keep)
    sums = fitted.agg(F.sum("weight").alias("all"))
    factors = fitted.join(F.broadcast(sums)).withColumn("mix_factor", F.col("fitted") * F.col("all") / F.col("weight")).drop("all")  # one row
    factors = materialise(factors, "factors", share=64)
    rate = F.col("mix_factor") * F.lit(keep if repeat else _level(factors, keep))
    factors = factors.select(*keys, "mix_factor", (rate if repeat else F.least(F.lit(1.0), rate)).alias("mix_rate"))
    copies = F.floor("mix_rate") + (F.col("mix_draw") < F.col("mix_rate") - F.floor("mix_rate")).cast("long")
    return marked.join(factors, keys).withColumn("mix_copies", copies).withColumn("mix_residual", F.lit(residual))


def _level(factors: DataFrame, keep: float) -> float:
    """What factors are multiplied with so that ``keep`` of all tokens stay, 1 being the highest probability; by bisection on one aggregate a round of many levels."""
    low, high = 0.0, 1e6
    for _ in range(4):
        levels = [low + (high - low) * (k / 64) ** 3 for k in range(65)] if low == 0.0 else [low + (high - low) * k / 64 for k in range(65)]
        kept = [F.sum(F.col("weight") * F.least(F.lit(1.0), F.col("mix_factor") * F.lit(x))) / F.sum("weight") for x in levels]
        found = factors.agg(*[k.alias(f"k{i}") for i, k in enumerate(kept)]).first()
        if found[0] is None:
            return 1.0
        at = next((i for i in range(65) if found[i] >= keep), 64)
        low, high = levels[max(0, at - 1)], levels[at]
    return high


def op2_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the rate that mixes sources, languages and topics to tempered shares, and the copies drawn."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_weight").alias("tokens"), F.round("mix_factor", 6).alias("factor"), F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"), F.round("mix_residual", 6).alias("residual"))


QUERIES = {"op2_raking": op2_raking}
