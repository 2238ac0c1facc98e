"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The model reads regions: stretches of neighbouring tokens with a digit, an @ or a written-out (at). A segment is up to MAX_TOKENS tokens with one
kind, or one token that is none. Features of the whole segment (its shape, its digits, checks, what stands
around it) score it for each kind, kinds of neighbours have a score too, and dynamic programming over ends,
lengths and kinds finds the best cut of a region and each segment's probability. Its labels for training are
the fixed patterns' own matches, and the same matches rewritten in ways that the patterns don't know.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one_task, over_batches, sampled, whole_text, within_chars

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind's place in KINDS, start, end

# Fixed values of the contract, written so that no text takes more than linear time: possessive where
# giving back can't help, and e-mail addresses from their @ outwards.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (x * 2 if x < 5 else x * 2 - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches, leftmost and non-overlapping for each kind, by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


MAX_TOKENS = 5
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
_SPACE = re.compile(r"\s")
_EDGES = ".,;:!?\"'<>|*#%&$"
_RUN = re.compile(r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+|.", re.S)


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of tokens with a trigger, one space apart; each token without the signs at its edges."""
    out: list[list[tuple[int, int]]] = []
    for m in _tokens(text):
        a, b = m
        if out and a - out[-1][-1][1] == 1 and text[a - 1] == " ":
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    for region in out:
        for k, (a, b) in enumerate(region):
            while b - a > 1 and text[b - 1] in _EDGES:
                b -= 1
            while b - a > 1 and text[a] in _EDGES:
                a += 1
            region[k] = (a, b)
    return out


def _tokens(text: str) -> Iterable[tuple[int, int]]:
    """From each trigger outwards to white space: linear in the text, whatever its tokens' lengths."""
    pos = 0
    while m := _TRIGGER.search(text, pos):
        a, b = m.start(), m.end()
        while a > pos and not text[a - 1].isspace():
            a -= 1
        e = _SPACE.search(text, b)
        pos = e.start() if e else len(text)
        yield a, pos


def _shape(text: str) -> str:
    out = []
    for run in _RUN.findall(text[:80]):
        if run[0].isascii() and run[0].isalpha():
            out.append("at" if run == "at" else "a")
        elif "0" <= run[0] <= "9":
            n = len(run)
            out.append(f"9{n if n <= 4 else '5-8' if n <= 8 else '9-12' if n <= 12 else '13-19' if n <= 19 else '20'}")
        else:
            out.append(run[0] if run.isascii() else "u")
    return "".join(out)


def features(text: str, start: int, end: int, tokens: int) -> list[str]:
    """Of the whole segment text[start:end], and of the words beside it. What a feature's name shows of a segment is
    bounded (80 characters' shape, 12 different signs, 20 digits, 12 letters of the word on the left), so that long
    segments share features: no segment is left out for it, and the checks read all of it."""
    s = text[start:end]
    d = _digits(s)
    signs = "".join(sorted({c for c in s if not c.isalnum()}))[:12]
    left = text[max(0, start - 24) : start].rsplit(None, 1)
    out = ["bias", f"shape={_shape(s)}", f"signs={signs}", f"digits={min(len(d), 20)}", f"tokens={tokens}", f"signs={signs},digits={min(len(d), 20)}", f"left={left[-1][-12:].lower() if left else ''}"]
    if 13 <= len(d) <= 19:
        out.append(f"luhn={luhn(d)}")
        out.append(f"luhn={luhn(d)},letters={any(c.isalpha() for c in s)},shape={_shape(s)}")
    if _IP.fullmatch(s):
        out.append(f"octets={_octets(s)}")
    if "@" in s or "(at)" in s or "[at]" in s:
        domain = re.split(r"@|\(at\)|\[at\]", s)[-1]
        out.append(f"domain={bool(_DOMAIN.fullmatch(domain))}")
        out.append(f"local={bool(s[:1].isalnum())},spaces={' ' in s}")
    return out


class SemiMarkov:
    """Weights of a feature for none and each kind; scores of neighbouring kinds."""

    def __init__(self):
        self.w: dict[str, list[float]] = {}
        self.g: dict[str, list[float]] = {}
        self.trans = [[0.0] * 5 for _ in range(5)]
        self.trans_g = [[1.0] * 5 for _ in range(5)]
        self._memo: dict = {}

    def _scored(self, text: str, region: list[tuple[int, int]], keep: bool = True):
        """By end and length: (features if kept, scores). A single token may be none; longer ones are of a kind."""
        out = []
        for j in range(len(region)):
            row = []
            for n in range(1, min(MAX_TOKENS, j + 1) + 1):
                fs = features(text, region[j - n + 1][0], region[j][1], n)
                score = [0.0] * 5
                for f in fs:
                    if w := self.w.get(f):
                        for y in range(5):
                            score[y] += w[y]
                if n > 1:
                    score[0] = -math.inf
                row.append((fs if keep else None, score))
            out.append(row)
        return out

    def _forward_backward(self, rows):
        t, n = self.trans, len(rows)
        a = [[-math.inf] * 5 for _ in range(n)]
        for j in range(n):
            for k, (_, s) in enumerate(rows[j]):
                p = j - k - 1
                for y in range(5):
                    if s[y] > -math.inf:
                        before = 0.0 if p < 0 else _sum(a[p][x] + t[x][y] for x in range(5))
                        a[j][y] = _sum((a[j][y], before + s[y]))
        b = [[0.0] * 5 for _ in range(n)]
        for j in range(n - 2, -1, -1):
            for x in range(5):
                b[j][x] = _sum(t[x][y] + rows[j + k + 1][k][1][y] + b[j + k + 1][y] for k in range(min(MAX_TOKENS, n - 1 - j)) for y in range(5))
        return a, b, _sum(a[-1])

    def _probability(self, a, b, z, rows, j, k, y) -> float:
        s, p = rows[j][k][1][y], j - k - 1
        if s == -math.inf:
            return 0.0
        before = 0.0 if p < 0 else _sum(a[p][x] + self.trans[x][y] for x in range(5))
        return math.exp(min(0.0, before + s + b[j][y] - z))

    def gradient(self, text: str, region: list[tuple[int, int]], gold: list[tuple[int, int, int]]) -> tuple[float, dict[str, list[float]], list[list[float]]]:
        """Of the region's cut ``gold`` ((last token, tokens, kind + 1 or 0), in order): minus its log-likelihood, and
        the derivatives by features' weights and by transitions: expected less observed counts."""
        rows = self._scored(text, region)
        a, b, z = self._forward_backward(rows)
        right = set(gold)
        grads: dict[str, list[float]] = {}
        pairs = [[0.0] * 5 for _ in range(5)]
        loss = z
        for j in range(len(rows)):
            for k, (fs, s) in enumerate(rows[j]):
                p = j - k - 1
                for y in range(5):
                    if s[y] == -math.inf:
                        continue
                    q = self._probability(a, b, z, rows, j, k, y)
                    here = (j, k + 1, y) in right
                    if here:
                        loss -= s[y]
                    if abs(q - here) > 1e-9:
                        for f in fs:
                            grads.setdefault(f, [0.0] * 5)[y] += q - here
                    if p >= 0 and q > 1e-9:
                        for x in range(5):
                            pairs[x][y] += math.exp(min(0.0, a[p][x] + self.trans[x][y] + s[y] + b[j][y] - z))
        for (_, _, x), (_, _, y) in zip(gold, gold[1:]):
            pairs[x][y] -= 1.0
            loss -= self.trans[x][y]
        return loss, grads, pairs

    def learn(self, text: str, region: list[tuple[int, int]], gold: list[tuple[int, int, int]], rate: float = 0.3, trans_rate: float = 0.1, decay: float = 1e-3) -> None:
        """One step (Adagrad) for a region, of weights and transitions alike."""
        _, grads, pairs = self.gradient(text, region, gold)
        for f, g in grads.items():
            w, h = self.w.setdefault(f, [0.0] * 5), self.g.setdefault(f, [1.0] * 5)
            _step(w, h, g, rate, decay)
        for w, h, g in zip(self.trans, self.trans_g, pairs):
            _step(w, h, g, trans_rate, decay)

    def decode(self, text: str, region: list[tuple[int, int]], least: float) -> list[Span]:
        """The segments of a kind in the region's best cut that are at least that probable."""
        rows = self._scored(text, region, keep=False)
        n, t = len(rows), self.trans
        best = [[-math.inf] * 5 for _ in range(n)]
        back: list[list[tuple[int, int]]] = [[(0, -1)] * 5 for _ in range(n)]
        for j in range(n):
            for k, (_, s) in enumerate(rows[j]):
                p = j - k - 1
                for y in range(5):
                    if p < 0:
                        v, x = s[y], -1
                    else:
                        v, x = max((best[p][x] + t[x][y], x) for x in range(5))
                        v += s[y]
                    if v > best[j][y]:
                        best[j][y], back[j][y] = v, (k, x)
        out: list[Span] = []
        a = b = z = None
        j, y = n - 1, max(range(5), key=lambda y: best[n - 1][y])
        while j >= 0:
            k, x = back[j][y]
            if y:
                if a is None:
                    a, b, z = self._forward_backward(rows)
                if self._probability(a, b, z, rows, j, k, y) >= least:
                    out.append((y - 1, region[j - k][0], region[j][1]))
            j, y = j - k - 1, x
        return out[::-1]

    def added(self, text: str, base: list[Span], least: float) -> list[Span]:
        """What the model finds beside the patterns' spans."""
        taken = _Taken(base)
        out = []
        for region in regions(text):
            lo, hi = region[0][0], region[-1][1]
            near = text[max(0, lo - 24) : hi]
            if hi - lo < 200:
                if near not in self._memo:
                    if len(self._memo) >= 20_000:  # about 10 MB
                        self._memo.clear()
                    self._memo[near] = [(y, a - lo, b - lo) for y, a, b in self.decode(text, region, least)]
                got = [(y, a + lo, b + lo) for y, a, b in self._memo[near]]
            else:
                got = self.decode(text, region, least)
            out += [(y, a, b) for y, a, b in got if not taken.meets(a, b)]
        return out


def _step(w: list[float], h: list[float], g: list[float], rate: float, decay: float) -> None:
    for y in range(5):
        if g[y]:
            v = g[y] + decay * w[y]
            h[y] += v * v
            w[y] -= rate * v / math.sqrt(h[y])


def _sum(xs: Iterable[float]) -> float:
    xs = list(xs)
    m = max(xs, default=-math.inf)
    return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))


class _Taken:
    """Whether a stretch overlaps any of the spans: of those that start before its end, the furthest end decides."""

    def __init__(self, spans: Iterable[Span]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def _rewritten(kind: int, found: str, draw: Random) -> str | None:
    """A match in a form that the patterns don't know, for training."""
    if kind == 0:
        return found.replace("@", draw.choice(["(at)", "[at]"]), 1)
    if kind == 2 and len(d := _digits(found)) == 16:
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        parts = found.split(" ", 1)
        return parts[1] if len(parts) == 2 and len(_digits(parts[1])) >= 9 else None
    return None


def _gold(text: str, region: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, int]] | None:
    """The region's cut by the spans; None if a span's ends aren't token ends or spans overlap."""
    inside = [s for s in spans if s[1] < region[-1][1] and s[2] > region[0][0]]
    starts, ends = {a: k for k, (a, _) in enumerate(region)}, {b: k for k, (_, b) in enumerate(region)}
    kind_at: dict[int, tuple[int, int]] = {}
    for y, a, b in inside:
        if a not in starts or b not in ends or ends[b] - starts[a] >= MAX_TOKENS:
            return None
        if any(k in kind_at for k in range(starts[a], ends[b] + 1)):
            return None
        for k in range(starts[a], ends[b] + 1):
            kind_at[k] = (ends[b], y)
    out, k = [], 0
    while k < len(region):
        if k in kind_at:
            last, y = kind_at[k]
            out.append((last, last - k + 1, y + 1))
            k = last + 1
        else:
            out.append((k, 1, 0))
            k += 1
    return out


def train(texts: Iterable[str], epochs: int = 4, seed: int = 3) -> SemiMarkov:
    model, draw, data = SemiMarkov(), Random(seed), []
    for text in texts:
        spans = base_spans(text)
        data.append((text, spans))
        for kind, a, b in spans:
            new = _rewritten(kind, text[a:b], draw)
            lo, hi = max(0, a - 60), min(len(text), b + 30)
            if new and not any(s != (kind, a, b) and s[1] < hi and s[2] > lo for s in spans):
                data.append((text[lo:a] + new + text[b:hi], [(kind, a - lo, a - lo + len(new))]))
    jobs = []
    for text, spans in data:
        for region in regions(text):
            if gold := _gold(text, region, spans):
                jobs.append((text, region, gold))
    for _ in range(epochs):
        draw.shuffle(jobs)
        for job in jobs:
            model.learn(*job)
    model.g, model.trans_g = {}, []
    return model


def fit(docs: DataFrame, sample_rows: int = 3_000, sample_chars: int = 32 << 20, text_col: str = "text") -> bytes:
    """A pickled model, trained in one task on the ``sample_rows`` different texts with a digit or an @ that have the
    smallest hashes (all, where there are fewer), and of these, in the order of the hash, on the first
    ``sample_chars`` characters' worth of texts: the documented bounds. Without any such text it knows nothing."""
    d = docs.select(whole_text(text_col).alias("_text")).filter(F.col("_text").rlike("[0-9@]"))

    def run(batches):
        import pandas as pd

        texts = [t for b in within_chars(batches, "_text", sample_chars) for t in b["_text"]]
        if texts:
            yield pd.DataFrame({"m": [pickle.dumps(train(texts))]})

    sample = sampled(d, sample_rows, "_text", 17)
    made = in_one_task(sample, ["_hash"], run, "m binary", sample, d)
    return bytes(made[0].m) if made else pickle.dumps(SemiMarkov())


def find_spans(text: str, model: SemiMarkov, least: float = 0.95) -> tuple[list[Span], list[Span]]:
    """(the patterns' spans, all spans), each by kind, then start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + model.added(text, base, least))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for y, a, b in spans)


def private_spans(docs: DataFrame, model: bytes, least: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id; of the patterns' spans the number of each kind (``n_email``, ``n_ip``, ``n_card``,
    ``n_phone``) and ``base_sha256`` (kind:start:end, by kind as listed, then start, comma-joined); ``spans``, all
    spans in that form: the patterns' and the model's of at least that probability that overlap none of them.
    Offsets count code points, ends are exclusive.

    A null or empty text has no spans. Repeated rows and null ids stay; other columns aren't read.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        crf = pickle.loads(sent.value)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans = [], []
            for text in batch.column("_text"):
                base, every = find_spans(text.as_py(), crf, least)
                for y in range(4):
                    counts[y].append(sum(s[0] == y for s in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: bytes, least: float = 0.95, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span (overlapping ones as one, named by the first) replaced by its kind in angle
    brackets, and the column of the text's length, if there is one, brought up to date. Null texts stay null."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        crf = pickle.loads(sent.value)
        for batch in batches:
            out = []
            for text in batch.column(at):
                t = text.as_py()
                out.append(t if t is None else _without(t, find_spans(t, crf, least)[1]))
            columns = batch.columns
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    made = over_batches(docs, run)
    return made.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else made


def _without(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for y, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[y].upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]
