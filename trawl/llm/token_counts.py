"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies.

``count_tokens`` never materialises token ids: a document is its pre-token frequencies,
a distinct pre-token is its number of pieces, and a document's count is their product sum.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import table
from trawl.llm.vocab import split_pattern, splitter, vocabulary_path
from trawl.llm.word_chunks import Step, by_chunk, check_numbers, distinct_words, sender, split_words

#: Characters whose classes are the same in the pattern library and in the tokenizer library,
#: whatever their Unicode versions. Texts with any other go through the tokenizer's own splitter.
SAFE = r"[^\x00-\u0557\u0600-\u06ff\u0900-\u0963\u2000-\u2064\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f]"


def _splitter(vocabulary: str, pattern: str, public: bool) -> Callable[[], Callable[[str], list[str]]]:
    def make() -> Callable[[str], list[str]]:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        words, odd = splitter(pattern, public), regex.compile(SAFE)

        def plain(text: str) -> list[str]:
            if odd.search(text):
                return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            return words(text)

        def split(text: str) -> list[str]:
            if cut is None or not cut.search(text):
                return plain(text)
            out = []
            for k, part in enumerate(cut.split(text)):
                out += [part] if k % 2 else plain(part) if part else []
            return out

        return split

    return make


def _count_pieces(vocabulary: str) -> Step:
    """The step from rows (word, places) to (places, pieces): the number of pieces, each word being met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        for batch in batches:
            texts = [w.decode() for w in batch.column(0).to_pylist()]
            counts = [1 if t in specials else len(e.ids) for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([[c] for c in counts], pa.list_(pa.int32()))], names=["places", "pieces"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens.

    A null text counts as empty and has no tokens; null and repeated ids keep their rows;
    other columns are not read; an empty table gives an empty result.
    """
    with open(vocabulary or vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()  # executors need not have the file
    chunks = split_words(docs, id_col, text_col, _splitter(content, pattern or split_pattern(), pattern is None), frequencies=True)
    id_type = docs.schema[id_col].dataType
    count, (send, sent) = _count_pieces(content), sender(id_type)
    back = distinct_words(chunks, lambda batches: send(count(batches)), sent)
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)

    def finish(dictionary: tuple, packs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        _, starts, values = dictionary
        pieces = values[starts].astype(np.int64)
        for ids, sizes, lens, numbers, times in packs:
            check_numbers(numbers, len(pieces))
            total = np.concatenate([[0], np.cumsum(pieces[numbers] * times)]) if times is not None else np.zeros(1, np.int64)
            ends = np.cumsum(lens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(sizes.astype(np.int64)), pa.array(total[ends] - total[ends - lens])], names=[id_col, "n_bytes", "n_tokens"])

    return by_chunk(chunks, back, finish, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {"op4_token_counts": op4_token_counts}
