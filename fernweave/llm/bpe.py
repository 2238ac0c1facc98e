"""Byte-level BPE: encoding by longest matches with backtracking, decoding, and token counts.

The vocabulary is a list of byte strings in merge order. Bytes are mapped to Latin-1 characters so that a
character automaton (pyahocorasick) finds, in one pass over a piece, the longest vocabulary entry that starts
at each position. The encoder takes the longest, accepts it if it is compatible with the token before it
(the two, side by side, are what merging makes of their bytes), shortens it if not, and steps back if
nothing fits; memoised compatibility and a mark for dead positions keep that linear in the piece's length.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import lean, slices, whole_text

#: Bytes of each memo in a worker (of chunks, of pieces, of compatible pairs); it is emptied when full.
MEMO_BYTES = 64 << 20


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, on the driver: from its own disk, or from any store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def read_ranks(data: bytes) -> list[bytes]:
    """A rank file (base64, rank) as byte strings in rank order. Gaps are left empty."""
    found = {int(rank): base64.b64decode(text) for text, rank in (line.split() for line in data.splitlines() if line.strip())}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def printable_bytes() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for: bytes that print as
    Latin-1 stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte strings, the rank at which a pair is merged, and the pair that each string is merged from.

    ``merges`` are pairs of ids with the id made, in the order of merging; None derives them from the order
    of ``words`` (rank files, where any two neighbours whose bytes are a word merge at the word's rank, and a
    piece that is a word is that one token, whether merges lead to it or not).

    Built on the driver and sent; a worker adds its automaton and memos, which are not sent back.
    """

    def __init__(self, words: list[bytes], merges: list[tuple[int, int, int]] | None = None):
        self.words = words
        self.id_of = {w: i for i, w in enumerate(words) if w}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        #: What a pair makes, and when: ids of single bytes come before all merges.
        self.made: dict[tuple[int, int], int] = {}
        self.order: list[int] = [0] * len(words)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(words))]
        if merges is not None:
            for k, (a, b, c) in enumerate(merges):
                self.made[a, b] = c
                self.order[c] = k + 1
                self.halves[c] = (a, b)
        else:
            for i, w in enumerate(words):
                if len(w) > 1:
                    self.order[i] = i + 1
                    parts = self.merge(w, below=i)
                    if len(parts) == 2:
                        self.made[parts[0], parts[1]] = i
                        self.halves[i] = (parts[0], parts[1])
        self.pieces_are_words = merges is None
        #: Entries that merges don't lead to are never part of a longer piece's tokens.
        self.reached = [len(w) == 1 or (len(w) > 1 and self.halves[i][0] != i) for i, w in enumerate(words)]
        self.sizes = [len(w) for w in words]
        self._forget()

    def _forget(self) -> None:
        self._trie = None
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_trie", "_fits", "_shorter")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Merges step by step, as the definition has it; quadratic, for short strings and proofs.
        ``below``: only pairs that make ids under it, found by their bytes."""
        parts = [self.byte_ids[b] for b in piece]
        while len(parts) > 1:
            best, at, into = None, -1, -1
            for k in range(len(parts) - 1):
                if below is None:
                    c = self.made.get((parts[k], parts[k + 1]))
                else:
                    c = self.id_of.get(self.words[parts[k]] + self.words[parts[k + 1]])
                    c = c if c is not None and c < below else None
                if c is not None and (best is None or self.order[c] < best):
                    best, at, into = self.order[c], k, c
            if best is None:
                break
            parts[at : at + 2] = [into]
        return parts

    @property
    def trie(self):
        if self._trie is None:
            import ahocorasick

            self._trie = ahocorasick.Automaton()
            for i, w in enumerate(self.words):
                if self.reached[i]:
                    self._trie.add_word(w.decode("latin-1"), i)
            self._trie.make_automaton()
        return self._trie

    def fits(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no merge across their border comes before the merges that
        made the parts at the border. Undoes the later of the two last merges step by step."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) * 150 > MEMO_BYTES:
                self._fits.clear()
            got = self._fits[a, b] = self._border(a, b)
        return got

    def _border(self, a: int, b: int) -> bool:
        order, halves = self.order, self.halves
        limit = None  # merges of that order or later had not happened yet when the border parts were a, b
        while True:
            c = self.made.get((a, b))
            if c is not None and (limit is None or order[c] < limit[0] or (order[c] == limit[0] and limit[1])):
                return False
            # The later merge is undone first. Of equal ones the left is made first, so the right is undone.
            if order[a] > order[b]:
                limit = (order[a], False)
                a = halves[a][1]
            else:
                if order[b] == 0:
                    return True
                limit = (order[b], True)
                b = halves[b][0]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece (what the pattern matched)."""
        one = self.id_of.get(piece)
        if one is not None and (self.pieces_are_words or self.reached[one]):
            return [one]
        text = piece.decode("latin-1")
        n = len(text)
        longest = [0] * n
        sizes, known = self.sizes, self._fits
        for end, i in self.trie.iter(text):  # by their ends: the last for a start is its longest
            longest[end + 1 - sizes[i]] = i
        dead: set[int] = set()
        out: list[int] = []
        pos, token, before = 0, longest[0], -1
        while True:
            end = pos + sizes[token]
            if end not in dead and (before < 0 or (known[before, token] if (before, token) in known else self.fits(before, token))):
                out.append(token)
                if end == n:
                    return out
                pos, before, token = end, token, longest[end]
                continue
            token = self.shorter(token)
            while token < 0:
                # Nothing fits behind this prefix: it is dead, and the token before it is to be shortened.
                dead.add(pos)
                token = out.pop()
                before = out[-1] if out else -1
                pos -= sizes[token]
                token = self.shorter(token)

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of this one; -1 for a single byte."""
        got = self._shorter.get(token)
        if got is None:
            w, got = self.words[token], -1
            for n in range(len(w) - 1, 0, -1):
                i = self.id_of.get(w[:n])
                if i is not None and self.reached[i]:
                    got = i
                    break
            self._shorter[token] = got
        return got


def json_vocabulary(data: bytes) -> tuple[Vocabulary, list[str]]:
    """The vocabulary of a byte-level tokenizers file, and the strings of its added tokens."""
    spec = json.loads(data)
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("only byte-level BPE files without a normalizer")
    added = spec.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with options are not supported")
    to_byte = printable_bytes()
    special = {t["content"] for t in added}
    ids = spec["model"]["vocab"]
    words = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        if text not in special:
            words[i] = bytes(to_byte[c] for c in text)
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Vocabulary(words, [(ids[a], ids[b], ids[a + b]) for a, b in pairs]), sorted(special, key=len, reverse=True)


_RUNS = re.compile(r"\s\s").search


class _Memo(dict):
    """What ``make`` gives for a key. Forgets all when it holds MEMO_BYTES, and keeps no long keys."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key: str):
        got = self.make(key)
        if len(key) <= 64:
            self.held += 200 + len(key) + (len(got) if isinstance(got, bytes) else 0)
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[key] = got
        return got


class Chunks:
    """Cuts a text where the pattern must cut it anyway, with str.split: before a space or line feed that
    has no other white space beside it, as only runs of white space and the single character in front of a
    word take any. What a chunk gives is remembered. A chunk without a leading line feed stands for itself
    behind a space. Texts with runs of white space go through the pattern as a whole, and so do all texts if
    the pattern is another than pattern()'s (``exact`` false)."""

    def __init__(self, split: str, exact: bool, of_piece):
        import regex

        self.pieces = regex.compile(split).findall
        self.of_piece = of_piece
        self.exact = exact
        self.behind = _Memo(lambda chunk: self.whole(chunk if chunk[:1] == "\n" else " " + chunk))

    def whole(self, text: str):
        raise NotImplementedError

    def values(self, text: str) -> list:
        if not self.exact or _RUNS(text):
            return [self.whole(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return [self.whole(first), *map(self.behind.__getitem__, rest)]


class _IdChunks(Chunks):
    """Chunks to the bytes of their ids, little-endian unsigned 32-bit integers."""

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.of_piece.__getitem__, self.pieces(text)))


class _CountChunks(Chunks):
    def whole(self, text: str) -> int:
        return sum(map(self.of_piece.__getitem__, self.pieces(text)))


class _Sent:
    """Made on the driver and broadcast whole, so that no executor needs the vocabulary's file. What is remembered stays in
    the worker until forget(), or until Spark takes the broadcast from it; that it does only when the worker has another
    task, which may be long after."""

    _chunks = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_chunks"}

    @property
    def chunks(self) -> Chunks:
        if self._chunks is None:
            self._chunks = self._make_chunks()
        return self._chunks

    def forget(self) -> None:
        self._chunks = None
        self.vocabulary._forget()
        gc.collect()  # memos and what fills them refer to each other


class Codec(_Sent):
    """Texts to ids and back, each match of the pattern by itself."""

    def __init__(self, data: bytes, split: str | None = None):
        self.vocabulary, self.split, self.exact = Vocabulary(read_ranks(data)), split or pattern(), split in (None, pattern())

    def _make_chunks(self) -> Chunks:
        return _IdChunks(self.split, self.exact, _Memo(lambda piece: array("I", self.vocabulary.encode(piece.encode("utf-8"))).tobytes()))

    def encode(self, text: str) -> array:
        out = array("I")
        out.frombytes(b"".join(self.chunks.values(text)))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.words.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, split: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: its id, ``n_tokens``, ``ids`` (array of ints; only with ``with_ids``), ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the bytes that the ids decode to).

    A null text counts as empty and has no ids. Repeated rows and null ids stay as they are; other columns are not
    read. An empty table gives an empty result. Texts of any length are encoded whole. ``path`` is read on the driver.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Codec(read_file(spark, path), split))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    names = [id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]

    def encoded(batch):
        codec = sent.value
        n, raw, ids_sha, decoded_sha = [], [], [], []
        for text in batch.column("_text"):
            ids = codec.encode(text.as_py())
            n.append(len(ids))
            data = ids.tobytes()
            if with_ids:
                raw.append(data)
            ids_sha.append(sha(data))
            decoded_sha.append(sha(codec.decode(ids)))
        columns = [batch.column(id_col), pa.array(n, pa.int64())]
        if with_ids:
            ends = pa.array([0, *accumulate(n)], pa.int32())
            columns.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(raw))])))
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=names)

    def run(batches):
        try:
            for batch in batches:
                yield from map(encoded, slices(batch))
        finally:
            sent.value.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long{', ids array<int>' if with_ids else ''}, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, whole_text(text_col).alias("_text")).mapInArrow(lean(run), schema)


def encoding_digests(docs: DataFrame, path: str, split: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() without the ids."""
    return encode_documents(docs, path, split, id_col, text_col, with_ids=False)


class _CountOf(dict):
    """From a piece to its number of tokens: holds the pieces proved to be one token, merges the rest."""

    def __init__(self, vocabulary: Vocabulary, single: list[str]):
        super().__init__(dict.fromkeys(single, 1))
        self.merged = _Memo(lambda piece: len(vocabulary.encode(piece.encode("utf-8"))))

    def __missing__(self, piece: str) -> int:
        return self.merged[piece]


def whole_tokens(vocabulary: Vocabulary) -> list[str]:
    """The vocabulary's strings that, alone, are merged into one token; proved by merging each by the
    definition. Entries that aren't whole characters can't be pieces and are left out."""
    out = []
    for i, w in enumerate(vocabulary.words):
        if w and vocabulary.merge(w) == [i]:
            try:
                out.append(w.decode("utf-8"))
            except UnicodeDecodeError:
                pass
    return out


class Counter(_Sent):
    """Counts a text's tokens. The strings that are one token are proved here, on the driver, and sent as a list."""

    def __init__(self, data: bytes, split: str | None = None):
        self.vocabulary, special = json_vocabulary(data)
        self.single = whole_tokens(self.vocabulary)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split, self.exact = split or pattern(), split in (None, pattern())

    def _make_chunks(self) -> Chunks:
        return _CountChunks(self.split, self.exact, _CountOf(self.vocabulary, self.single))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(self.chunks.values(p)) for p in parts)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, split: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit), as the
    tokenizers library counts them for a byte-level BPE file: an added token's string inside a text is one token.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids stay as they are; other
    columns are not read; an empty table gives an empty result. ``path`` is read on the driver.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Counter(read_file(spark, path), split))

    def run(batches):
        counter = sent.value
        for batch in batches:
            n_bytes, n = [], []
            for text in batch.column("_text"):
                t = text.as_py()
                n_bytes.append(text.as_buffer().size)
                n.append(counter.count(t))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, whole_text(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
