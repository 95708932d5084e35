"""Embedders: texts to vectors, in batches on the executors and one by one for queries."""

from __future__ import annotations

import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawl.functions.versions import RETRYABLE, retry_delay
from trawl.sources.config import Settings


class Embedder(Protocol):
    profile: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashes of words and of their three-letter parts, summed and scaled to length 1: like words, near vectors."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self.profile = dims, f"hash{dims}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        words, parts, kinds, out = _Codes(self.dims, 2), _Codes(self.dims, 0), np.array([-0.3, 0.3, -1.0, 1.0]), []
        for text in texts:
            codes: list[int] = []
            for word in re.findall(r"\w+", text.lower()):
                codes.append(words[word])
                codes += [parts[word[i : i + 3]] for i in range(len(word) - 2)]
            kind, at = np.divmod(np.array(codes, np.int64), self.dims)
            x = np.bincount(at, kinds[kind], self.dims)  # added up in the order of the text
            n = math.sqrt(float(x @ x))
            out.append((x / n if n else x).tolist())
        return out


class _Codes(dict):
    """Where words or their parts count, and whether above or below zero; each is hashed once, ``MOST`` are remembered."""

    MOST = 1 << 15

    def __init__(self, dims: int, kind: int) -> None:
        self.dims, self.kind = dims, kind

    def __missing__(self, part: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(part)
        code = (self.kind + (h >> 63)) * self.dims + h % self.dims
        if len(self) < self.MOST:
            self[part] = code
        return code


class ConstantEmbedder:
    """Every text to the first unit vector."""

    def __init__(self, dims: int = 8) -> None:
        self.dims, self.profile = dims, "constant"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[1.0, *[0.0] * (self.dims - 1)] for _ in texts]


class HttpEmbedder:
    """A service that takes {model, input, dimensions} and gives {data: [{index, embedding}]}."""

    #: Most bytes of a response.
    MOST = 32 << 20

    def __init__(self, url: str, model: str, dims: int, key: str = "", tries: int = 3, wait_s: float = 0.2, timeout_s: float = 30) -> None:
        self.url, self.model, self.dims, self.key = url.rstrip("/"), model, dims, key
        self.tries, self.wait_s, self.timeout_s, self.profile = tries, wait_s, timeout_s, model

    def _call(self, path: str, body: dict | None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url + path, json.dumps(body).encode() if body is not None else None, headers)
        for attempt in range(self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                    raw = r.read(self.MOST + 1)
                if len(raw) > self.MOST:
                    raise ValueError("the response is too large")
                return json.loads(raw)
            except urllib.error.HTTPError as e:
                if e.code not in RETRYABLE or attempt == self.tries:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.tries:
                    raise
            time.sleep(retry_delay(attempt, self.wait_s))
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = {d["index"]: d["embedding"] for d in self._call("/embeddings", {"model": self.model, "input": texts, "dimensions": self.dims})["data"]}
        out = [found.get(i) for i in range(len(texts))]
        if any(v is None or len(v) != self.dims for v in out):
            raise ValueError("the response lacks vectors or has others than asked for")
        return out

    def healthy(self) -> bool:
        return bool(self._call("/models", None))


class OnnxEmbedder:
    """A local model: padded batches, the mean over unmasked tokens, length 1. Needs a model and its tokenizer file."""

    def __init__(self, model_path: str, tokenizer_path: str, dims: int) -> None:
        self.model_path, self.tokenizer_path, self.dims, self.profile = model_path, tokenizer_path, dims, "onnx"
        self._loaded: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_padding()
            self._loaded = (onnxruntime.InferenceSession(self.model_path), tokenizer)
        session, tokenizer = self._loaded
        found = tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(e, k) for e in found], np.int64) for k in ("ids", "attention_mask"))
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        return pooled(hidden, mask).tolist()


def embedder_of(s: Settings, environment: Mapping[str, str] | None = None) -> Embedder:
    """The embedder that settings name: hash, constant, http (its key from the environment variable they name) or onnx."""
    env = os.environ if environment is None else environment
    if s.provider == "hash":
        return HashEmbedder(s.dims)
    if s.provider == "constant":
        return ConstantEmbedder(s.dims)
    if s.provider == "http":
        if not s.embed_url or not s.model:
            raise ValueError("provider http needs embed_url and model")
        return HttpEmbedder(s.embed_url, s.model, s.dims, env.get(s.embed_key_env, ""))
    if s.provider == "onnx":
        if not s.model or not s.tokenizer:
            raise ValueError("provider onnx needs model and tokenizer")
        return OnnxEmbedder(s.model, s.tokenizer, s.dims)
    raise ValueError(f"unknown provider: {s.provider}")


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the unmasked tokens' vectors, scaled to length 1 unless zero."""
    m = mask[:, :, None].astype(np.float64)
    mean = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    n = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(n > 0, n, 1)


def with_embeddings(df: DataFrame, text_col: str, embedder: Embedder, batch: int = 32, error_col: str | None = None) -> DataFrame:
    """``df`` with ``embedding`` array<float> of a text column, embedded in batches; the text column is dropped.

    With ``error_col``, a string column of ``df``, rows that have an error already are passed by,
    and one whose text cannot be embedded gets the message there and no vector; the texts of a
    batch that fails are tried one by one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = embedder.embed(texts)
        if any(len(v) != embedder.dims for v in vectors):
            raise ValueError("a vector of other length than the collection's")
        return vectors

    def each(texts: list[str], errors: list[str | None]) -> list[list[float] | None]:
        todo = [i for i, e in enumerate(errors) if e is None]
        out: list[list[float] | None] = [None] * len(texts)
        try:
            found = embed([texts[i] for i in todo]) if todo else []
        except Exception as e:
            if len(todo) == 1:
                errors[todo[0]] = f"{type(e).__name__}: {e}"
                return out
            for i in todo:
                one = errors[i : i + 1]
                out[i], errors[i] = each(texts[i : i + 1], one)[0], one[0]
            return out
        for i, v in zip(todo, found, strict=True):
            out[i] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                columns, texts = {c: part.column(c) for c in kept}, part.column(text_col).to_pylist()
                if error_col is None:
                    vectors = embed(texts)
                else:
                    errors = columns[error_col].to_pylist()
                    vectors = each(texts, errors)
                    columns[error_col] = pa.array(errors, pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(vectors, pa.list_(pa.float32()))], schema=arrow)

    return df.mapInArrow(run, schema)
