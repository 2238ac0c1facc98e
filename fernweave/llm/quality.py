"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader
(FTRL-proximal) updates, scored as sparse dot products."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_one_task, sampled, whole_text, within_chars

#: Words as they are written (capitals are a sign of junk) and runs of other signs.
_WORDS = re.compile(r"\w+|[^\w\s]+").findall
BUCKETS = 1 << 18
MEMO = 500_000


#: Buckets of n-grams that stand for a repetition whatever its words: a word twice, a word again after
#: another, a pair of words that the text has had before.
TWICE, AGAIN, HAD = 1, 2, 3


class Features:
    """Texts to hashed unigrams and bigrams, and repetitions; each occurrence weighs 1 / sqrt(number of n-grams)."""

    def __init__(self):
        self.hashes: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        got = self.hashes.get(word)
        if got is None:
            if len(self.hashes) >= MEMO:
                self.hashes.clear()
            got = self.hashes[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return got

    def ids(self, text: str) -> np.ndarray:
        words = _WORDS(text)
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        n = [int((h[:-1] == h[1:]).sum()), int((h[:-2] == h[2:]).sum()), len(pairs) - len(np.unique(pairs))]
        repeated = np.repeat(np.array([TWICE, AGAIN, HAD], np.uint64), n)
        return np.concatenate([h & np.uint64(BUCKETS - 1), pairs & np.uint64(BUCKETS - 1), repeated]).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; the last coordinate is the bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _row(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(ids, return_counts=True)
    return np.append(at, BUCKETS), np.append(n / np.sqrt(max(1, len(ids))), 1.0)


def train(rows: Iterable[tuple[str, int]], epochs: int = 3, seed: int = 7) -> np.ndarray:
    """The weights (float32, the bias last) from (text, label) rows, shuffled anew in each epoch."""
    features, model = Features(), Ftrl()
    data = [(*_row(features.ids(text)), int(label)) for text, label in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            model.learn(*data[k])
    return model.weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, sample_chars: int = 64 << 20, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled documents whose crc32(id) mod held_out[0] is not held_out[1]: of those the
    ``sample_rows`` ids with the smallest hashes (all, where there are fewer), and of these, in the order of the
    hash, the first ``sample_chars`` characters' worth of texts: the documented bounds on what one task learns from.

    Null labels and labels without an id or a document are left out; of several labels of an id the greatest
    counts, of several texts of an id the least. Without any label all weights are 0, and all scores 0.5.
    """
    d = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y IS NOT NULL AND _id IS NOT NULL").filter(fold("_id", held_out[0]) != held_out[1])
    sample = sampled(d.groupBy("_id").agg(F.max("_y").alias("_y")), sample_rows, "_id", 11)
    # That is at most sample_rows rows of three numbers: what is broadcast. An id that repeats is merged in each task.
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"), F.first("_hash").alias("_hash"))

    def run(batches):
        import pandas as pd

        learnt = [(t, y) for b in within_chars(batches, "_text", sample_chars) for t, y in zip(b["_text"], b["_y"])]
        if learnt:
            yield pd.DataFrame({"w": [train(learnt).tobytes()]})

    made = in_one_task(rows, ["_hash", "_id"], run, "w binary", sample, d)
    return np.frombuffer(made[0].w, np.float32) if made else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``held_out`` (whether crc32(id) mod held_out[0] is held_out[1]), ``score`` (0 to 1, the
    probability of label 1), ``predicted`` (1 if score >= 0.5, else 0).

    A null text counts as empty; the empty text gets what the bias says. Repeated rows and null ids (whose
    text is empty for crc32) stay; other columns aren't read. The weights sent are BUCKETS + 1 numbers.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def run(batches):
        w, features = sent.value, Features()
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                ids = features.ids(text.as_py())
                out.append(float(w[-1]) + (float(w[ids].sum(dtype=np.float64)) / np.sqrt(len(ids)) if len(ids) else 0.0))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(out, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col), whole_text(text_col).alias("_text"), (fold(id_col, held_out[0]) == held_out[1]).alias("held_out"))
    return d.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
