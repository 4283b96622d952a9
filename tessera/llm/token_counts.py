"""Exact token counts of every prefix by dynamic programming."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SHORT, Merges, byte_symbols
from .shared import TEXTS, lean

#: How a byte-level vocabulary file splits text into pieces (fixed values of that format).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contractions of that pattern that a cut can shorten to what is none.
_CUT_CONTRACTIONS = ("'re", "'ve", "'ll")
#: White space that is split otherwise when the text ends behind it.
_WIDE = regex.compile(r"\s{2,}(?=\S)")
LIMIT = 512
BUDGETS = (128, 512, 2048)
#: Pairs of tokens that a worker remembers before it begins anew, and bytes of remembered pieces, about; that bounds its memory.
PAIRS, KNOWN_BYTES = 1_000_000, 112 << 20


class _Known(dict):
    """Steps of whole pieces (see PrefixCounter.steps); those of a missing one are computed."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self._steps, self._held = counter.steps, 0

    def __missing__(self, piece: str) -> bytes:
        found = self._steps(piece)
        if len(piece) <= SHORT:
            if self._held >= KNOWN_BYTES:  # forget the older half
                for old in [p for p, _ in zip(self, range(len(self) // 2), strict=False)]:
                    del self[old]
                self._held //= 2
            self[piece] = found
            self._held += 220 + 2 * len(piece)
        return found


class PrefixCounter:
    """Token counts of all prefixes of a piece.

    If a piece's tokens are t1 ... tn, those of the prefix that t1 ... tk make up are t1 ... tk. So the last token of
    every prefix is the one that ends there, whose start has a prefix solved before, and that stays
    apart from that prefix's last token when the two are encoded together. One pass over the ends thus gives the count of every prefix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merges = Merges(spec["model"])
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.single = [self.merges.ids[s] for s in symbols]
        self.token = {bytes(byte_of[c] for c in t): i for t, i in self.merges.ids.items() if all(c in byte_of for c in t)}
        self.text = {i: t for t, i in self.token.items()}
        self.trie = self._trie()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.piece = regex.compile(PIECE)
        self.pairs: dict[int, bool] = {}
        self.known = _Known(self)

    def _trie(self) -> tuple:
        """Nodes (token that ends here or -1, children by byte)."""
        root: list = [-1, {}]
        for data, t in self.token.items():
            node = root
            for b in data:
                node = node[1].setdefault(b, [-1, {}])
            node[0] = t
        return root

    def _apart(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when they are encoded together."""
        key = a << 20 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            data = self.text[a] + self.text[b]
            found = self.pairs[key] = self.merges.parts([self.single[x] for x in data]) == [a, b]
        return found

    def prefixes(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i], for i from 0 to its length."""
        n, root, known = len(data), self.trie, self.pairs.get
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            node, before, count = root, last[start], counts[start] + 1
            for end in range(start + 1, n + 1):
                node = node[1].get(data[end - 1])
                if node is None:
                    break
                t = node[0]
                if t >= 0 and last[end] < 0:
                    if start:
                        apart = known(before << 20 | t)
                        if apart is None:
                            apart = self._apart(before, t)
                        if not apart:
                            continue
                    last[end], counts[end] = t, count
        return counts

    def steps(self, piece: str) -> bytes:
        """By how much the count changes at each character of a piece, a signed byte each."""
        if piece in _CUT_CONTRACTIONS:  # cut before its end it is no contraction but a mark and a letter
            counts = [0, 1, 2, self.prefixes(piece.encode("utf-8"))[-1]]
        else:
            data = piece.encode("utf-8")
            counts = self.prefixes(data)
            if len(data) > len(piece):
                counts = [c for i, c in enumerate(counts) if i == len(data) or data[i] & 0xC0 != 0x80]
        if len(counts) < 128:  # no step can be larger than the count
            return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])
        return _narrow(np.diff(np.array(counts, np.int32)), piece)

    def _parts(self, text: str) -> list[tuple[int, int, bool, list[str]]]:
        """(start, end, whether it is a special token, pieces) of each part of a text between special tokens, and of each of those."""
        found, at = [], 0
        for k, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            found.append((at, at + len(part), bool(k % 2), [] if k % 2 else self.piece.findall(part)))
            at += len(part)
        return found

    def index(self, text: str | None) -> bytes:
        """The prefix index of a text: by how much its token count changes at each character, a signed byte each.

        The running sum is the count of every prefix, encoded alone. Pieces that a cut leaves whole or shortens give it by themselves. Where the
        pattern splits a cut text otherwise, the count is put right: behind white space of two or more characters, which is one piece
        at the end of a text, and inside special tokens, which are plain text as long as they are cut.
        """
        if not text:
            return b""
        known, out, wide, cut = self.known, [], [], []
        parts = self._parts(text)
        for start, end, special, pieces in parts:
            if special:
                out.append(b"\x01" + bytes(end - start - 1))
                cut.append((start, end, last))
            else:
                out += [known[p] for p in pieces]
                wide += [m.span() for m in _WIDE.finditer(text, start, end)]
                last = len(pieces[-1]) if pieces else 0
        found = b"".join(out)
        if not wide and not cut:
            return found
        counts = prefix_counts(found)
        right = counts.copy()
        for start, end in wide:
            right[end] = counts[start] + self._total([text[start:end]])
        for start, end, last in cut:
            begin = start - last  # the piece before may go on
            for k in range(start + 1, end):
                right[k] = counts[begin] + self._total(self.piece.findall(text[begin:k]))
        return _narrow(np.diff(right), text)

    def _total(self, pieces: list[str]) -> int:
        return sum(int(np.frombuffer(self.known[p], np.int8).sum()) for p in pieces)

    def count(self, text: str | None) -> int:
        return int(prefix_counts(self.index(text))[-1])


def _narrow(steps: np.ndarray, text: str) -> bytes:
    if len(steps) and (steps.max() > 127 or steps.min() < -127):
        raise OverflowError(f"the count changes by more than 127 at one character of {text[:40]!r}")
    return steps.astype(np.int8).tobytes()


def prefix_counts(index: bytes) -> np.ndarray:
    """Token count of every prefix, by number of characters from 0 on."""
    out = np.zeros(len(index) + 1, np.int32)
    np.cumsum(np.frombuffer(index, np.int8), dtype=np.int32, out=out[1:])
    return out


def longest_within(counts: np.ndarray, budgets: Iterable[int]) -> list[int]:
    """For each budget, the characters of the longest prefix that has at most so many tokens: a look-up, nothing is encoded."""
    out = []
    for budget in budgets:
        fits = counts <= budget
        out.append(len(counts) - 1 - int(np.argmax(fits[::-1])) if fits.any() else 0)
    return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of the file that a worker uses last: what it remembers serves later tasks too."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


_INDEX = "doc_id long, n_bytes long, n_chars long, n_tokens long, index binary"


def prefix_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, index), one row for each input row, without a shuffle.

    index holds a signed byte for each character, whose running sum is the exact token count of every prefix. Null counts as
    empty: no bytes and no tokens. Repeated rows and null ids are kept. Texts are counted whole. Other columns are ignored.
    """

    def run(batches):
        dp = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [dp.index(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int(prefix_counts(x)[-1]) for x in found], pa.int64()),
                pa.array(found, pa.binary()),
            ], names=["doc_id", "n_bytes", "n_chars", "n_tokens", "index"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, TEXTS), _INDEX)


def answers(indexed: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, fits): fits[k] is the number of characters of the longest prefix within budgets[k].

    Only the stored counts are read. A budget that no prefix but the empty one meets gives 0.
    """

    def run(batches):
        for batch in batches:
            fits = [longest_within(prefix_counts(x or b""), budgets) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fits, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_chars", "n_tokens", "fits"])

    rows = indexed.select("doc_id", "n_bytes", "n_chars", "n_tokens", "index")
    return rows.mapInArrow(lean(run, TEXTS), "doc_id long, n_bytes long, n_chars long, n_tokens long, fits array<long>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, budgets: tuple[int, ...] = BUDGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits), one row for each input row: the answers of each text's prefix index.

    fits[k] is the number of characters of the longest prefix with at most budgets[k] tokens. Null counts as empty: no bytes and no
    tokens. Repeated rows and null ids are kept. Texts are counted whole, whatever their length. Other columns are ignored. The index goes
    from task to task as an Arrow batch and is not written.
    """
    found = answers(prefix_index(docs, path, id_col, text_col), budgets)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits")
