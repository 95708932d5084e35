"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP, card and phone numbers) come from regular expressions with checks.
Every value found is a protected entity, and so is every secret: a long run of letters and
digits mixed, as keys and tokens are. Over the whole corpus, for each term (word of letters and
digits) that occurs in documents with an entity, the co-occurrence tells how much the term
reveals: the pointwise mutual information of term and entity as a share of the entity's
information content, which is 1 for a term that only occurs beside the entity. Every pair is
scored; one that is met in fewer than ``support`` different texts is scored by a lower estimate:
k texts take log2((1 + support) / (1 + k)) bits from its mutual information. Terms at
``generalise`` or more are generalised, at ``remove`` or more they go, as secrets do: wherever
they stand, or only in documents that hold the entity.

A term is generalised to a class of the corpus: the terms that begin with the same letters,
``CLASS_LETTERS`` of them, most first, whose documents are so many that the class itself would
not disclose; without such a class to <TERM>. All is DataFrame and SQL functions; texts are not
shuffled but for those in which a term is marked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.members import possible
from trawl.llm.shared import materialise, table

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's expressions, each with possessive repeats, which match the same and need no stack, and without new
#: starts inside a run that has failed already, which keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for any match at all; cheaper than the expressions.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]++"
#: A secret: a lower-cased term of so many letters and digits, both of them.
SECRET = "^(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{16,}$"
#: First letters that terms of a class share, and hash values of classes.
CLASS_LETTERS, CLASSES = (3, 1), 1 << 20

SPANS = "array<struct<kind:int,start:int,stop:int,value:string>>"
ORDERED = "array<struct<start:int,kind:int,stop:int,value:string>>"


#: Matches whose offsets are summed at once: arrays grow by copying, so long ones are built in two levels.
RUN = 256


def _located(text: Column, pattern: Column, kind: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """All matches of ``pattern`` (whose values are ``wanted``) as structs (kind, start, stop, value), offsets in code points."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast(SPANS)

    def run(first: Column) -> Column:
        """Offsets of RUN matches from the end of the match before them."""
        pairs = F.arrays_zip(F.slice(parts, first, F.least(F.lit(RUN), F.size(found) - first + 1)).alias("gap"), F.slice(found, first, F.lit(RUN)).alias("value"))

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.char_length(x["gap"])
            stop = begin + F.char_length(x["value"])
            more = F.concat(acc["out"], F.array(_span(F.lit(kind), begin, stop, x["value"])))
            return F.struct(stop.alias("at"), (F.when(wanted(x["value"]), more).otherwise(acc["out"]) if wanted else more).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add)

    def shift(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: _span(s["kind"], s["start"] + acc["at"], s["stop"] + acc["at"], s["value"]))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    runs = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(RUN)), run)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(runs, start, shift)["out"])).otherwise(none)


def _span(kind: Column, start: Column, stop: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), start.alias("start"), stop.alias("stop"), value.alias("value"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _of(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def base_spans(text: Column) -> Column:
    """The valid base spans of a text, of each kind in order."""
    found = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.filter(_located(text, F.lit(PATTERNS[kind]), k), _check(kind))
        if NEEDS[kind]:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPANS))
        found.append(spans)
    return F.concat(*found)


def in_order(spans: Column) -> Column:
    """By start, then kind, then stop."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
    return F.array_sort(key)


def shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _key(span: Column) -> Column:
    """The entity that a span is of: e-mail addresses in lower case, the digits of numbers."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]", ""))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _words(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _term_key(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit((1 << 63) - 1))


def _class_key(word: Column, letters: int) -> Column:
    """Below zero, so that it is no term's key."""
    return -1 - F.pmod(F.xxhash64(F.substring(word, 1, letters), F.lit(letters)), F.lit(CLASSES))


def _keys(words: Column) -> Column:
    """The keys of distinct terms and, once each, of their classes."""

    def classes(letters: int) -> Column:
        return F.array_distinct(F.transform(words, lambda w: _class_key(w, letters)))

    return F.concat(F.transform(words, _term_key), *[classes(k) for k in CLASS_LETTERS])


def _placed(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, n_entity, alone, copy), and (copy, n, words) once a text, of rows (copy, words, entities). ``alone``: the entity is in one text only.

    Entities of one and the same text have equal statistics: they are one, so that a text full of them is not multiplied by its terms.
    """
    by_copy = held.select(F.explode("entities").alias("entity"), "copy").groupBy("entity", "copy").agg(F.count(F.lit(1)).alias("n"))
    by_entity = by_copy.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("copies"), F.min("copy").alias("copy"))
    known = by_entity.select(F.col("entity").alias("value"), F.when(F.col("copies") == 1, F.concat(F.lit("in:"), F.hex("copy"))).otherwise(F.col("entity")).alias("entity"), "n_entity", (F.col("copies") == 1).alias("alone"))
    known = materialise(known, "entities")
    placed = by_copy.select(F.col("entity").alias("value"), "copy").join(known, "value").select("entity", "n_entity", "alone", "copy").distinct()
    once = held.groupBy("copy").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    return materialise(placed, "placed"), once


def _counts(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, count): documents of each class and of each term that ``pairs`` has."""
    asked = pairs.select("key").distinct()
    each = found.select(F.explode("keys").alias("key"))
    return materialise(possible(each, [F.col("key")], asked, ["key"], "members_maybe").where("key < 0 OR members_maybe").groupBy("key").count(), "counts")


def _disclosures(placed: DataFrame, once: DataFrame, found: DataFrame, rows: int, support: int, generalise: float, remove: float) -> DataFrame:
    """The pairs that disclose: (entity, term, key, share, value), the value being what replaces the term."""
    terms = once.select("copy", "n", F.explode("words").alias("term")).withColumn("key", _term_key(F.col("term")))
    beside = placed.where("NOT alone").join(terms, "copy").groupBy("entity", "n_entity", "term", "key").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("copies"))
    single = placed.where("alone").join(once, "copy").select("entity", "n_entity", F.explode("words").alias("term"), F.col("n").alias("n_both"), F.lit(1).cast("long").alias("copies"))
    pairs = materialise(beside.unionByName(single.withColumn("key", _term_key(F.col("term")))), "pairs")
    counts = _counts(found, pairs)
    n = F.lit(float(max(1, rows)))
    information = F.log2(n / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("count")))
    doubt = F.log2(F.lit(1.0 + support) / (F.least(F.col("copies"), F.lit(support)) + 1))
    share = F.when(information > 0, (mutual - doubt) / information).otherwise(F.lit(0.0))
    shown_ = materialise(pairs.join(counts, "key").withColumn("share", share).where(F.col("share") >= generalise).drop("count"), "disclosed")
    general = F.lit("<TERM>")
    for k in reversed(CLASS_LETTERS):
        of_class = counts.select(F.col("key").alias(f"class_{k}"), F.col("count").alias(f"count_{k}"))
        shown_ = shown_.withColumn(f"class_{k}", _class_key(F.col("term"), k)).join(of_class, f"class_{k}")
        safe = F.log2(n / F.col(f"count_{k}")) / information < generalise  # as if the entity always had the class beside it
        general = F.when(safe, F.concat(F.lit("<"), F.substring("term", 1, k), F.lit("*>"))).otherwise(general)
    return shown_.select("entity", "term", "key", "share", F.when(F.col("share") >= remove, F.lit("")).otherwise(general).alias("value"))


def _term_spans(text: Column, marked: Column) -> Column:
    """Spans of the terms that are keys of the map ``marked``; their value is what replaces them."""

    def instead(s: Column) -> Column:
        return _span(s["kind"], s["start"], s["stop"], F.coalesce(F.element_at(marked, F.lower(s["value"])), F.lit("<TERM>")))

    return F.transform(_located(text, F.lit(TERM), 4, lambda v: F.map_contains_key(marked, F.lower(v))), instead)


def personal_spans(docs: DataFrame, keep: list[str], text_col: str = "text", support: int = 3, generalise: float = 0.9, remove: float = 0.98, everywhere: bool = False) -> DataFrame:
    """Per row of ``docs``: row (a struct of the columns ``keep``), base and terms (arrays of spans).

    A null text has no spans. Nulls and clashing names in other columns do not matter, nor do
    repeated rows: statistics count rows, and a row's spans follow from its text. An empty
    table gives an empty result. With ``everywhere`` a term that discloses any entity is marked
    in all texts, by its highest share; else only beside the entity. Secrets are terms in
    either case.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.struct(*[docs[c] for c in keep])
    spans = docs.select(own.alias("row"), text.alias("text"), _words(text).alias("words"), base_spans(text).alias("base"))
    secrets = F.filter("words", lambda w: (F.char_length(w) >= 16) & w.rlike(SECRET))
    spans = spans.select("row", "text", "base", "words", secrets.alias("secrets"))
    some = (F.size("base") > 0) | (F.size("secrets") > 0)
    entities = F.array_distinct(F.concat(F.transform("base", _key), F.transform("secrets", lambda w: F.concat(F.lit("4:"), w))))
    found = spans.select("row", "base", "secrets", F.unhex(F.md5("text")).alias("copy"), some.alias("some"), F.when(some, F.col("words")).alias("words"), F.when(some, entities).alias("entities"), _keys(F.col("words")).alias("keys"))
    found = materialise(found, "spans")
    held = found.where("some")
    placed, once = _placed(held.select("copy", "words", "entities"))
    disclosed = _disclosures(placed, once, found, found.count(), support, generalise, remove)
    best = F.max(F.struct("share", "value")).alias("best")
    if everywhere:
        secret = held.select(F.explode("secrets").alias("term")).distinct().select("term", _term_key(F.col("term")).alias("key"), F.lit(2.0).alias("share"), F.lit("").alias("value"))
        highest = disclosed.select("term", "key", "share", "value").unionByName(secret).groupBy("term", "key").agg(best).select("term", "key", F.col("best.value").alias("value"))
        highest = materialise(highest, "highest")
        each = found.select("copy", F.explode("keys").alias("key"))
        marks = possible(each, [F.col("key")], highest, ["key"], "members_maybe").where("members_maybe AND key >= 0").join(highest, "key").select("copy", "term", "value")
    else:
        beside = disclosed.join(placed.select("entity", "copy"), "entity").select("copy", "term", "share", "value")
        hidden = held.select("copy", F.explode("secrets").alias("term")).select("copy", "term", F.lit(2.0).alias("share"), F.lit("").alias("value"))
        marks = beside.unionByName(hidden).groupBy("copy", "term").agg(best).select("copy", "term", F.col("best.value").alias("value"))
    marks = marks.groupBy("copy").agg(F.map_from_entries(F.collect_set(F.struct("term", "value"))).alias("marked"))
    marks = materialise(marks.withColumnRenamed("copy", "mark_copy"), "marks")
    none = F.array().cast(SPANS)
    rows = possible(found.select("row", "base", "copy"), [F.col("copy")], marks, ["mark_copy"], "members_maybe")
    clean = rows.where("NOT members_maybe").select("row", "base", none.alias("terms"))
    if text_col in keep:
        near = rows.where("members_maybe").withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    else:  # few texts: read again
        again = docs.select(own.alias("row"), text.alias("text")).withColumn("copy", F.unhex(F.md5("text")))
        near = possible(again, [F.col("copy")], marks, ["mark_copy"], "members_maybe").where("members_maybe").withColumn("base", base_spans(F.col("text")))
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    met = near.join(marks, F.col("copy") == F.col("mark_copy"), "left")
    spans_ = F.when(F.col("marked").isNotNull(), F.filter(_term_spans(F.col("text"), F.col("marked")), apart)).otherwise(none)
    return clean.unionByName(met.select("row", "base", spans_.alias("terms")))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced: base spans by their kind, terms by their value; of overlapping spans by the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def clear(acc: Column, s: Column) -> Column:
        more = F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))
        return F.when(s["start"] >= acc["at"], more).otherwise(acc)

    apart = F.aggregate(in_order(spans), F.struct(F.lit(0).alias("at"), F.array().cast(ORDERED).alias("out")), clear)["out"]

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.get(apart, i - 1)["stop"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), F.when(s["kind"] == 4, s["value"]).otherwise(F.get(names, s["kind"])))

    last = F.element_at(apart, -1)["stop"]
    whole = F.concat(F.array_join(F.transform(apart, piece), ""), F.substring(text, last + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text", everywhere: bool = True, **limits: float) -> DataFrame:
    """The rows and columns of ``docs`` with personal data in ``text_col`` replaced, and revealing terms generalised or removed."""
    found = personal_spans(docs, docs.columns, text_col, everywhere=everywhere, **limits)
    names = docs.columns
    text = F.col("row").getField(text_col)
    out = [F.when(text.isNotNull(), _replaced(text, F.concat("base", "terms"))).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
    return found.select(*out)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms in all documents."""
    found = personal_spans(table(spark, sf_dir, "documents"), ["doc_id"], everywhere=True)
    kinds = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    both = F.concat("base", "terms")
    return found.select(F.col("row.doc_id").alias("doc_id"), *kinds, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(both).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
