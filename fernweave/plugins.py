"""Models are supplied by the host: what they must offer, how frames go through them, and stubs for tests."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ConfigurationError


class Embeddings(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def dimension(self) -> int: ...


class SparseEmbeddings(Protocol):
    """Texts to (index, value) pairs; queries may have other values than texts."""

    def embed_sparse(self, texts: list[str]) -> list[list[tuple[int, float]]]: ...
    def embed_sparse_query(self, text: str) -> list[tuple[int, float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class TokenCounter(Protocol):
    def count(self, text: str) -> int: ...


class Extractor(Protocol):
    def extract(self, text: str) -> list[dict]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashEmbeddings:
    """Deterministic: each word's digest says where it counts."""

    def __init__(self, size: int = 64):
        self.size = size

    def dimension(self) -> int:
        return self.size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class WordSparse:
    """Deterministic: a word's index is its digest, its value how often it occurs; a query's words count once."""

    def embed_sparse(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        return [sorted((i, float(n)) for i, n in Counter(map(self._index, t.lower().split())).items()) for t in texts]

    def embed_sparse_query(self, text: str) -> list[tuple[int, float]]:
        return [(i, 1.0) for i, _ in self.embed_sparse([text])[0]]

    @staticmethod
    def _index(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") >> 1


class Retrying:
    """Calls the first of several plug-ins' method; after ``retries`` more failures of it the next one's. Waits twice as
    long each time. The last failure is raised."""

    def __init__(self, *models, retries: int = 2, wait: float = 0.2):
        if not models or not 0 <= retries <= 5:
            raise ConfigurationError("need at least one model, and 0 to 5 retries")
        self.models, self.retries, self.wait = models, retries, wait

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)

        def call(*args):
            failure: Exception | None = None
            for model in self.models:
                for k in range(self.retries + 1):
                    try:
                        return getattr(model, name)(*args)
                    except Exception as e:
                        failure = e
                        if k < self.retries:
                            time.sleep(self.wait * 2**k)
            raise failure

        return call


def model_name(model: object) -> str:
    """The class's name without "embeddings", and the model that it says it uses: "openai:small"."""
    kind = re.sub("embeddings?$", "", type(model).__name__.lower()) or type(model).__name__.lower()
    own = getattr(model, "model", "")
    return f"{kind}:{own}" if own else kind


class OverlapReranker:
    """The share of the query's words that a text has."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(t.lower().split())) / max(1, len(q)) for t in texts]


class ExtractiveGenerator:
    """The prompt's last line, as an answer that can be checked."""

    def generate(self, prompt: str) -> str:
        return prompt.strip().rsplit("\n", 1)[-1]


def embedded(df: DataFrame, model: Embeddings, text: str = "text", out: str = "embedding", batch: int = 100) -> DataFrame:
    """Adds vectors, ``batch`` texts a call."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        t = [x or "" for x in texts]
        return pd.Series([v for lo in range(0, len(t), batch) for v in model.embed(t[lo : lo + batch])])

    return df.withColumn(out, vectors(F.col(text)))


def sparse_embedded(df: DataFrame, model: SparseEmbeddings, text: str = "text", out: str = "sparse") -> DataFrame:
    """Adds sparse vectors as arrays of (idx, val); where the model fails an empty one: dense search goes on alone."""

    @F.pandas_udf("array<struct<idx:int,val:double>>")
    def vectors(texts: pd.Series) -> pd.Series:
        try:
            found = model.embed_sparse([x or "" for x in texts])
        except Exception:
            found = [[] for _ in texts]
        return pd.Series([[{"idx": int(i), "val": float(v)} for i, v in row] for row in found])

    return df.withColumn(out, vectors(F.col(text)))


def counted(model: TokenCounter, text: Column) -> Column:
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: model.count(x or ""))

    return count(text)


def reranked(hits: DataFrame, model: Reranker, k: int, text: str = "content", id_col: str = "chunk_id") -> DataFrame:
    """Hits (query_id, query, id, content) in the reranker's order, k for each query. A query has at most a few
    hundred candidates, so its group fits a task."""
    schema = hits.select("query_id", id_col).schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", score double, rank int"

    def one(f: pd.DataFrame) -> pd.DataFrame:
        s = model.rerank(f["query"].iloc[0], f[text].tolist())
        f = f.assign(score=s).sort_values(["score", id_col], ascending=[False, True], kind="stable").head(k)
        return f.assign(rank=range(1, len(f) + 1))[["query_id", id_col, "score", "rank"]]

    return hits.groupBy("query_id").applyInPandas(one, schema)


def mapped(df: DataFrame, fn, text: str = "text") -> DataFrame:
    """Adds ``value`` and ``error`` of a plug-in called on each text: a text that fails doesn't end the job."""

    @F.pandas_udf("value string, error string")
    def call(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            try:
                rows.append((fn(x), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return df.withColumn("_r", call(F.col(text))).select("*", "_r.value", "_r.error").drop("_r")


def metered(df: DataFrame, fn, text: str = "text") -> DataFrame:
    """mapped() for a plug-in that gives a text and what it used, a dict: adds ``input_tokens`` and ``output_tokens``,
    0 where the dict doesn't say or the plug-in fails."""

    @F.pandas_udf("value string, error string, input_tokens long, output_tokens long")
    def call(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            try:
                value, used = fn(x)
                rows.append((value, None, *[max(0, int((used or {}).get(k) or 0)) for k in ("input_tokens", "output_tokens")]))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}", 0, 0))
        return pd.DataFrame(rows, columns=["value", "error", "input_tokens", "output_tokens"])

    return df.withColumn("_r", call(F.col(text))).select("*", "_r.*").drop("_r")


def usage(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, failures and tokens of metered() rows, in all or by columns."""
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failures"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
