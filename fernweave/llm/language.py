"""Language ID by a linear-chain conditional random field over a text's words.

A word's state is its language. Affixes, character n-grams and the word itself (a lexicon learned from the
training texts), hashed, give each word type a score for each language; learned transitions tie neighbours
in a line together, so that stretches of code-switched text keep their own language. The forward-backward
algorithm gives each word's probabilities; a text's language is the one that holds most of its letters.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Collection, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_one_task, lean, over_batches, sampled, within_chars

#: A word is a run of letters with their combining marks. Python's own letters leave marks out, so texts with any
#: sign from U+0300 on go the other way; for all others both give the same.
_HIGH = re.compile("[\u0300-\U0010ffff]").search
_PLAIN = re.compile(r"[^\W\d_]+").findall
BUCKETS = 1 << 17
#: Bytes that a worker keeps of word types and their scores; numbers (words by labels) that are worked on at a time.
MEMO_BYTES, AT_ONCE = 48 << 20, 800_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    if not _HIGH(text):
        return _PLAIN(text)
    import regex

    return regex.findall(r"(?:[\p{L}\p{Nl}\p{No}]\p{M}*)+", text)


def _mixed(code: np.ndarray, kind: int) -> np.ndarray:
    x = (code + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def hashed_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words one behind the other, each word's number of them): the word, its affixes of one to
    four bytes of UTF-8, its pairs and triples of bytes, hashed."""
    raw = [w.encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size)
    start = end - size
    b = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint64)
    n2, n3 = np.maximum(size - 1, 0), np.maximum(size - 2, 0)
    sizes = 9 + n2 + n3
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int64)
    out[at] = _mixed(np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw)), 1 << 40)
    head = tail = np.ones(len(raw), np.uint64)
    for n in range(1, 5):
        has = size >= n
        head = np.where(has, (head << np.uint64(8)) | b[np.minimum(start + n - 1, len(b) - 1)], head)
        tail = np.where(has, (tail << np.uint64(8)) | b[np.maximum(end - n, 0)], tail)
        out[at + 2 * n - 1] = _mixed(head, 2 << 40)
        out[at + 2 * n] = _mixed(tail, 3 << 40)
    of = np.repeat(np.arange(len(raw)), size)
    place = np.arange(int(size.sum())) - start[of]
    two = (b[:-2] << np.uint64(8)) | b[1:-1]
    inside = place < n2[of]
    out[(at[of] + 9 + place)[inside]] = _mixed(two[inside], 4 << 40)
    three = (two << np.uint64(8)) | b[2:]
    inside = place < n3[of]
    out[(at[of] + 9 + n2[of] + place)[inside]] = _mixed(three[inside], 5 << 40)
    return out, sizes


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """A row of scores for each word type."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    lo = 0
    while lo < len(words):
        # So many words that their features' weights are some 32 MB; a longer word by itself.
        hi, room = lo, max(1, (8 << 20) // max(1, weights.shape[1]))
        while hi < len(words) and (hi == lo or room > 0):
            room -= 9 + 8 * len(words[hi])
            hi += 1
        flat, sizes = hashed_features(words[lo:hi])
        out[lo:hi] = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None].astype(np.float32)
        lo = hi
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Each word's probabilities of the labels, for chains that lie one behind the other in ``scores``.
    Chains are walked side by side, the longest first, so that a step is one operation on all that still run.
    ``pairs``: also the expected number of each transition."""
    n, labels = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lens = lengths[order]
    e = scores - scores.max(axis=1, keepdims=True) if n else scores.copy()
    np.exp(e, out=e)
    t = np.exp(transitions - transitions.max())
    running = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")
    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    a = None
    for k, m in enumerate(running):
        at = starts[:m] + k
        a = e[at] if a is None else (a[:m] @ t) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.ones((0, labels))
    for k in range(len(running) - 1, -1, -1):
        m = running[k]
        at = starts[:m] + k
        now = np.ones((m, labels))
        if len(b):
            now[: len(b)] = (b * e[at[: len(b)] + 1]) @ t.T
            now[: len(b)] /= now[: len(b)].sum(axis=1, keepdims=True)
        beta[at] = b = now
    p = alpha * beta if pairs else np.multiply(alpha, beta, out=alpha)
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return p
    first = np.ones(n, bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    later = np.flatnonzero(first)
    joint = alpha[later - 1][:, :, None] * t[None] * (beta[later] * e[later])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return p, joint.sum(axis=0), later


class Values:
    """A column's values, made when they are asked for."""

    def __init__(self, column):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __iter__(self) -> Iterator[str | None]:
        return (x.as_py() for x in self.column)

    def __contains__(self, value: object) -> bool:
        return any(x == value for x in self)


def chains_of(text: str) -> list[list[str]]:
    """The words of each line, lower-cased."""
    return [w for line in text.lower().split("\n") if (w := words_of(line))]


def train(rows, labels: list[str], epochs: int = 4, at_once: int = 400, rate: float = 0.5, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by stochastic gradient (Adagrad) on the log-likelihood of rows (text, label),
    where each word of a text has the text's label."""
    place = {x: k for k, x in enumerate(labels)}
    types: dict[str, int] = {}
    chains: list[tuple[np.ndarray, int]] = []
    for text, label in rows:
        for words in chains_of(text):
            chains.append((np.array([types.setdefault(w, len(types)) for w in words]), place[label]))
    k = len(labels)
    weights, transitions = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    seen, seen_t = np.full((BUCKETS, k), 1e-2, np.float32), np.full((k, k), 1.0)
    flat, sizes = hashed_features(list(types))
    ends = np.cumsum(sizes)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        mixed = draw.permutation(len(chains))
        for lo in range(0, len(mixed), at_once):
            some = [chains[i] for i in mixed[lo : lo + at_once]]
            lengths = np.array([len(c) for c, _ in some])
            gold = np.repeat([y for _, y in some], lengths)
            used, of = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
            ids = np.concatenate([flat[ends[u] - sizes[u] : ends[u]] for u in used])
            starts = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            norm = np.sqrt(sizes[used])[:, None]
            emit = np.add.reduceat(weights[ids], starts, axis=0) / norm
            p, joint, later = forward_backward(emit[of].astype(np.float64), lengths, transitions, True)
            p[np.arange(len(gold)), gold] -= 1.0
            per_type = np.zeros((len(used), k))
            np.add.at(per_type, of, p)
            touched, back = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(touched), k), np.float32)
            np.add.at(grad, back, np.repeat(per_type / norm, sizes[used], axis=0).astype(np.float32))
            grad = grad / len(gold) * 100 + decay * weights[touched]
            seen[touched] += grad * grad
            weights[touched] -= rate * grad / np.sqrt(seen[touched])
            for y in gold[later]:
                joint[y, y] -= 1.0
            joint = joint / len(gold) * 100 + 0.1 * transitions
            seen_t += joint * joint
            transitions -= 0.2 * joint / np.sqrt(seen_t)
    return weights, transitions


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions
        self.at_once = max(2_000, AT_ONCE // max(1, len(labels)))
        self._forget()

    def _forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.rows, self.held = np.zeros((1024, len(self.labels)), np.float32), 0

    def _rows(self, words: list[str]) -> np.ndarray:
        if self.held > MEMO_BYTES:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.row_of]
        if new:
            base = len(self.row_of)
            self.row_of.update((w, base + i) for i, w in enumerate(new))
            if base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:base], np.zeros((base + 2 * len(new), len(self.labels)), np.float32)])
            self.rows[base : base + len(new)] = emissions(new, self.weights)
            self.held += sum(map(len, new)) * 2 + len(new) * (150 + 8 * len(self.labels))
        return self.rows[np.fromiter(map(self.row_of.__getitem__, words), np.int64, len(words))]

    def shares(self, texts: Collection[str | None]) -> Iterator[tuple[np.ndarray, float, float]]:
        """For each text: the letters of each language by the words' probabilities, the letters by each word's most
        probable language alone, and all letters (0 if there is none). Lines are labelled a number of words at a time,
        so that only a single line's words are ever held together."""
        n = len(texts)
        total, sure, letters = np.zeros((n, len(self.labels))), np.zeros(n), np.zeros(n)
        held: list[list[str]] = []
        owner: list[int] = []
        count = 0

        def label() -> None:
            words = [w for c in held for w in c]
            lengths = np.array([len(c) for c in held], np.int64)
            weight = np.fromiter(map(len, words), np.float64, len(words))
            p = forward_backward(self._rows(words).astype(np.float64), lengths, self.transitions)
            p *= weight[:, None]
            of = np.repeat(np.array(owner), lengths)
            np.add.at(total, of, p)
            np.add.at(sure, of, p.max(axis=1))
            np.add.at(letters, of, weight)

        for i, text in enumerate(texts):
            chains = chains_of(text) if text and self.labels else []
            # Signs for numbers (², Ⅷ) count as word characters; a text of such alone has no letter.
            if not any(c.isalpha() for chain in chains for w in chain for c in w):
                continue
            for chain in chains:
                held.append(chain)
                owner.append(i)
                count += len(chain)
                if count >= self.at_once:
                    label()
                    held, owner, count = [], [], 0
        if held:
            label()
        yield from zip(total, sure, letters)

    def predict(self, texts: Collection[str | None]) -> list[tuple[str, float]]:
        out = []
        for share, _, letters in self.shares(texts):
            best = int(np.argmax(share)) if letters else -1
            out.append((self.labels[best], min(1.0, max(0.0, float(share[best] / share.sum())))) if letters else (UNKNOWN, 0.0))
        return out

    def knows(self, texts: Collection[str | None], least: float) -> list[bool]:
        return [bool(letters) and sure >= least * letters for _, sure, letters in self.shares(texts)]


def fit(docs: DataFrame, sample_rows: int = 200, sample_chars: int = 32 << 20, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """A pickled (labels, weights, transitions), learned from text and non-null language of documents whose
    crc32(id) mod held_out[0] is not held_out[1]: of each language the ``sample_rows`` different texts with the
    smallest hashes (all, where there are fewer), and of these, in the order of the hash, the first ``sample_chars``
    characters' worth of texts. These are the documented bounds on what one task learns from; languages are not
    bounded. The model has BUCKETS numbers a language. Without any such document it knows no language."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    d = d.filter("_lang IS NOT NULL AND _id IS NOT NULL AND _text IS NOT NULL").filter(fold("_id", held_out[0]) != held_out[1]).select("_text", "_lang")

    def run(batches):
        import pandas as pd

        rows = [(x, y) for b in within_chars(batches, "_text", sample_chars) for x, y in zip(b["_text"], b["_lang"])]
        if rows:
            labels = sorted({y for _, y in rows})
            yield pd.DataFrame({"m": [pickle.dumps((labels, *train(rows, labels)))]})

    sample = sampled(d, sample_rows, "_text", 13, "_lang")
    made = in_one_task(sample, ["_hash", "_lang"], run, "m binary", sample, d)
    return bytes(made[0].m) if made else pickle.dumps(([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0))))


def identify(docs: DataFrame, model: bytes, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``held_out``, ``lang_pred`` (und if the text is null or has no letter) and ``score``, the
    language's share of the text's letters by the words' probabilities (0 for und).

    Repeated rows and null ids (whose text is empty for crc32) stay; other columns aren't read. The model sent
    is BUCKETS numbers a language.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = Model(*pickle.loads(sent.value))
        for batch in batches:
            got = of.predict(Values(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), (fold(id_col, held_out[0]) == held_out[1]).alias("held_out"))
    return d.mapInArrow(lean(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, model: bytes, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose words are of known languages: those without letters go, and
    those whose words' most probable languages have a probability of less than ``least`` on average over the letters.
    How many languages a text is in doesn't matter: each word counts for its own."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        of = Model(*pickle.loads(sent.value))
        for batch in batches:
            yield batch.filter(pa.array(of.knows(Values(batch.column(at)), least), pa.bool_()))

    return over_batches(docs, run)
