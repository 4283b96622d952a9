"""BPE encoding and decoding with a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TEXTS, lean

#: Words of more symbols than this go through a heap instead of repeated scans; the result is the same.
SHORT = 256
#: Bytes of remembered words and ids, about, at which a task begins anew; that bounds its memory.
CACHE_BYTES = 24 << 20
NO_RANK = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge ranks of a vocabulary file: pair of token ids -> (rank, merged id)."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.ids[a], self.ids[b]] = k
            self.made.append(self.ids[a + b])

    def parts(self, symbols: list[int]) -> list[int]:
        """Token ids of a word, given those of its symbols."""
        return self._scan(symbols) if len(symbols) <= SHORT else self._heap(symbols)

    def _scan(self, symbols: list[int]) -> list[int]:
        """Hold the parts and the rank of each adjacent pair side by side; merge at the first least rank until none is left."""
        parts, rank = list(symbols), self.rank.get
        ranks = [rank(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _heap(self, symbols: list[int]) -> list[int]:
        n, parts, rank = len(symbols), list(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.made[r], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (s := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]


class WordBpe:
    """Encoder and decoder of a word-level vocabulary file: NFC, lower case, words by pattern, an end-of-word mark.

    Results equal those of the tokenizers library without added special tokens; strings of special tokens that
    occur in a text become those tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merges = Merges(spec["model"])
        pre = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pre["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        tokens = {i: t for t, i in [*self.merges.ids.items(), *self.added.items()]}
        symbols = byte_symbols()
        self.symbol = [self.merges.ids[s] for s in symbols]
        self.ending = [self.merges.ids[s + self.merges.suffix] for s in symbols]
        #: the tokens and the decimal forms by id
        self.names = [""] * (max(tokens) + 1)
        for i, token in tokens.items():
            self.names[i] = token
        self.decimals = [str(i) for i in range(len(self.names))]
        self.cache: dict[str, list[int]] = {}
        self.held = 0

    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # the library lowers each character by itself, without the rule for a final sigma
        return text.replace("Σ", "σ").lower()

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        return self.merges.parts([*(self.symbol[b] for b in data[:-1]), self.ending[data[-1]]])

    def _word(self, word: str) -> list[int]:
        ids = self.word_ids(word)
        if len(word) <= SHORT:
            if self.held >= CACHE_BYTES:
                self.cache.clear()
                self.held = 0
            self.cache[word] = ids
            self.held += 250 + 4 * len(word) + 8 * len(ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        text, out = text or "", []
        get, own = self.cache.get, self._word
        for k, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            if k % 2:
                out.append(self.added[part])
            else:
                for word in self.pattern.findall(self.normal(part)):
                    out += get(word) or own(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder; special tokens stay."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def written(self, ids: Iterable[int]) -> str:
        """The decimal ids joined by one space."""
        decimals = self.decimals
        return " ".join([decimals[i] for i in ids])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text; null text has none."""

    def run(batches):
        bpe = WordBpe(path)  # lives as long as the task
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run, TEXTS), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the decoded text of each array of ids."""

    def run(batches):
        bpe = WordBpe(path)  # lives as long as the task
        for batch in batches:
            text = pa.array([bpe.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each input row, without a shuffle.

    Each text is encoded whole, and its ids are decoded again; digests are taken in the task, so ids need not be written.
    Null and empty texts have no tokens. Repeated rows and null ids are kept as they are. Words of any length
    are taken whole. Other columns are ignored.
    """

    def run(batches):
        bpe = WordBpe(path)  # lives as long as the task
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.written(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run, TEXTS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
