"""Hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

P(word | history) = P(class | features) * P(leaf | class, features) * P(word | leaf). Both softmaxes have weights that are rows of hashed
features of the history: the previous word, the previous two, the word before the previous, and the one before that; within a class the first two count, each hashed
with the class. The commonest words are classes, the next commonest of each class are leaves of their own; the words left of a class are its last leaf, which they share by
their smoothed counts, with one place for words never seen, times the weights of word pairs:

P(word | leaf, context) = share(word) * exp(weight(context, word)) / norm(context)

A context is a hash of the class and of the previous word, whatever that is. Every pair of a context and one of the HEAD words of a
last leaf that the training texts hold has a weight, so their number grows with the corpus. Pairs meet in shards by context, which take the gradient steps and score. Sums to one over all words.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, stage

#: The commonest words alone in their classes, and all classes.
ALONE, CLASSES = 12, 32
#: At most this many words, the commonest, are sent to every task; the others meet by their hashes.
HEAD = 1 << 17
#: Leaves of a class with more than one word: all but the last are one word each.
LEAVES = CLASSES
#: Hash rows of each kind of feature: those of the class softmax, and those within classes. Weights have (KINDS + DEEP) * ROWS * CLASSES cells, whatever the corpus.
ROWS = 8192
KINDS, DEEP = 4, 2
#: Steps of counts to an octave, in which the commonest words are found, and into how many parts the last of them is split.
STEPS, SPLIT = 16, 1 << 20
#: Tokens of a gradient step, its rate, and how often the tasks' weights are averaged in one pass over the corpus.
STEP, RATE, ROUNDS = 8_192, 0.1, 2
#: Previous words from this rank on make contexts; those with more tokens than CONTEXT make several, by hashes of the word before them.
PAIR_FROM, CONTEXT = 0, 1 << 20
#: What a weight of a pair costs, in occurrences, and the steps; they start at the solution that holds where no weight is zero.
DISCOUNT, PAIR_STEPS = 0.75, 4
#: Rows of pairs that a shard solves at once, or those of one context.
PAIR_ROWS = 1 << 19
#: Rows that a task packs at once; training tokens for each shard where contexts and rare words meet, and for each where the sums of texts do.
PACK, SHARD, SUMS = 1 << 20, 1 << 20, 1 << 22
#: Words that a counting task holds at most.
FLUSH = 300_000
SMOOTH = 0.1
END = b"\n"  # no word
#: Scores of the softmax are cut off here, far beyond those that learning reaches.
LIMIT = 60.0
_SLICE = 512


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def ending_of(words: list[bytes]) -> np.ndarray:
    """The last three bytes of each word as a number: what stands for a rare word."""
    return np.fromiter((int.from_bytes(w[-3:][::-1], "little") for w in words), np.int64, len(words))


def class_of(endings: np.ndarray) -> np.ndarray:
    """Class of a word that has none of its own, by its last two bytes."""
    return (ALONE + _mixed(endings & 0xFFFF) % np.uint32(CLASSES - ALONE)).astype(np.uint8)


def row_of(endings: np.ndarray) -> np.ndarray:
    """Feature row of a rare word."""
    return (ROWS // 2 + _mixed(endings) % np.uint32(ROWS // 2)).astype(np.uint16)


def _grouped(key: np.ndarray, text: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, columns, n): equal rows as one with their number, by text. key: 64 bits from the columns; where those of different rows begin alike, equal rows may be left apart."""
    order = np.argsort((text.astype(np.uint64) << np.uint64(40)) | (key.view(np.uint64) >> np.uint64(24)))
    rows = [c[order] for c in (text, *columns)]
    new = np.zeros(len(text), bool)
    new[:1] = True
    for c in rows:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return *(c[at] for c in rows), np.diff(np.r_[at, len(text)])


class _Places(dict):
    """Places of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Head:
    """The commonest words with their counts, in order of count; the end of a text comes first."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, class_n: np.ndarray, class_v: np.ndarray):
        self.words, self.counts, self.n, self.v, self.class_n, self.class_v = words, counts, n, v, class_n, class_v
        self.pair_from, self.context = PAIR_FROM, CONTEXT

    def open(self) -> Head:
        """Tables that a worker looks words up in."""
        if hasattr(self, "at"):
            return self
        self.at = _Places((w, k) for k, w in enumerate(self.words))
        endings = ending_of(self.words)
        rank = np.arange(len(self.words))
        self.cls = np.where(rank < ALONE, rank, class_of(endings)).astype(np.uint8)
        self.row = np.where(rank < ROWS // 2, rank, row_of(endings)).astype(np.uint16)
        #: the leaf of each word within its class, by rank
        order = np.argsort(self.cls, kind="stable")
        first = np.searchsorted(self.cls[order], np.arange(CLASSES))
        self.leaf = np.empty(len(self.words), np.uint8)
        self.leaf[order] = np.minimum(rank - first[self.cls[order]], LEAVES - 1)
        single = self.leaf < LEAVES - 1
        prior = np.zeros((CLASSES, LEAVES))
        prior[self.cls[single], self.leaf[single]] = self.counts[single] + 1
        rest_n = self.class_n - np.bincount(self.cls[single], self.counts[single], minlength=CLASSES)
        rest_v = self.class_v - np.bincount(self.cls[single], minlength=CLASSES)
        prior[:, -1] = rest_n + 1
        with np.errstate(divide="ignore"):
            self.deep_bias = np.maximum(np.log(prior / prior.sum(1, keepdims=True)), -LIMIT).astype(np.float32)
        self.scale = np.log10(rest_n + SMOOTH * (rest_v + 1))
        known = np.log10(self.counts + SMOOTH)
        self.base = known
        self.inside = np.where(single, 0.0, known - self.scale[self.cls])
        self.names = hashes(self.words)[:, 0]
        #: into how many contexts each word is split
        self.split = np.int64(1) << np.ceil(np.log2(np.maximum(self.counts / self.context, 1))).astype(np.int64)
        return self


class Batch:
    """Tokens of several texts in a row, with the classes and features of each."""

    def __init__(self, texts: list[str | None], head: Head):
        words: list[bytes] = []
        lengths = np.zeros(len(texts), np.int64)
        lead = [END] * (KINDS - 1)
        for k, text in enumerate(texts):
            own = tokens(text)
            lengths[k] = len(own) + 1
            words += lead
            words += own
            words.append(END)
        ids = np.fromiter(map(head.at.__getitem__, words), np.int32, len(words))
        self.tail = np.flatnonzero(ids < 0)
        self.rare = [words[k] for k in self.tail]
        endings = ending_of(self.rare)
        cls, row = head.cls[ids], head.row[ids]
        cls[self.tail], row[self.tail] = class_of(endings), row_of(endings)
        spans = lengths + len(lead)
        self.starts = np.r_[0, np.cumsum(spans)[:-1]] + len(lead)
        real = np.ones(len(words), bool)
        real[(self.starts[:, None] - 1 - np.arange(len(lead))).ravel()] = False
        self.place = p = np.flatnonzero(real)
        self.lengths, self.ids = lengths, ids
        one, two, three = row[p - 1], row[p - 2], row[p - 3]
        pair = (one.astype(np.uint32) * np.uint32(0x9E3779B1) ^ two.astype(np.uint32) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - ROWS.bit_length() + 1)
        #: a row of the weights for each kind of feature and token
        self.features = np.stack([one, ROWS + pair.astype(np.uint16), 2 * ROWS + two, 3 * ROWS + three])
        self.classes = cls[p]
        leaf = head.leaf[ids]
        leaf[self.tail] = LEAVES - 1
        #: the tokens whose class has several words, their leaves, and the rows of the weights within classes
        self.deep = np.flatnonzero(self.classes >= ALONE)
        self.leaves = leaf[p][self.deep]
        own = self.classes[self.deep].astype(np.uint32) << np.uint32(16)
        self.deep_features = np.stack([((KINDS + k) * ROWS + (_mixed(own | self.features[k, self.deep]) & np.uint32(ROWS - 1))).astype(np.uint16) for k in range(DEEP)])

    def __len__(self) -> int:
        return len(self.place)

    def pairs(self, head: Head, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, context, word, n): how often each text has a word of a last leaf, -1 if it is rare, in a context. rare: hashes of the rare words."""
        rest = self.deep[self.leaves == LEAVES - 1]
        before = self.ids[self.place[rest] - 1]
        rest = rest[(before < 0) | (before >= head.pair_from)]
        at = self.place[rest]

        def named(at):
            ids = self.ids[at]
            name, unknown = head.names[ids], ids < 0
            name[unknown] = rare[np.searchsorted(self.tail, at[unknown])]
            return name, np.where(unknown, 1, head.split[ids])

        (name, split), classes = named(at - 1), self.classes[rest]
        context = _contexts(name, classes)
        if len(many := np.flatnonzero(split > 1)):
            context[many] = _contexts(context[many], named(at[many] - 2)[0] & (split[many] - 1))
        word = self.ids[at].astype(np.int64)
        text = np.searchsorted(np.cumsum(self.lengths), rest, side="right")
        return _grouped(context + word * np.int64(0x27D4EB2F165667C5), text, context, word)


def _sums(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Scores of all classes (or leaves) for each token, within +-LIMIT; bias is one row, or one for each token."""
    s = np.take(weights, features[0], axis=0)
    for rows in features[1:]:
        s += np.take(weights, rows, axis=0)
    s += bias
    return np.clip(s, -LIMIT, LIMIT, out=s)


_ONES = np.ones(CLASSES, np.float32)


def log_shares(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural log of P(class | features): a row for each token."""
    s = _sums(weights, bias, features)
    return s - np.log(np.exp(s) @ _ONES)[:, None]


def log_share(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of P(class | features) for the class of each token."""
    s = _sums(weights, bias, features)
    own = s[np.arange(len(s)), classes].astype(np.float64)
    return own - np.log(np.exp(s, out=s) @ _ONES)


def segment_sums(rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, few: int = 16) -> np.ndarray:
    """Sum of each segment of rows. Short segments are summed all at once, place by place; only the others go one by one."""
    out = np.take(rows, starts, axis=0)
    live = np.flatnonzero((counts > 1) & (counts <= few))
    for k in range(1, few):
        out[live] += np.take(rows, starts[live] + k, axis=0)
        live = live[counts[live] > k + 1]
    if len(long := np.flatnonzero(counts > few)):
        own = counts[long]
        out[long] = np.add.reduceat(rows[np.repeat(counts > few, counts)], np.cumsum(own) - own, axis=0)
    return out


def _steps(b: Batch, head: Head, bias: np.ndarray):
    """(tokens, bias, features, classes) of each step over a batch: in turn over the classes of all tokens, and over the leaves of those that have some."""
    for at in range(0, len(b), STEP):
        part = slice(at, at + STEP)
        yield part, bias, b.features[:, part], b.classes[part]
    for at in range(0, len(b.deep), STEP):
        part = slice(at, at + STEP)
        yield b.deep[part], head.deep_bias[b.classes[b.deep[part]]], b.deep_features[:, part], b.leaves[part]


class Learner:
    """Adaptive gradient steps on one task's part of the corpus."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.copy()
        self.sum, self.seen = np.full(len(weights), 1e-3, np.float32), np.zeros(len(weights), np.int64)

    def step(self, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> None:
        g = _sums(self.weights, bias, features)
        np.exp(g, out=g)
        g /= (g @ _ONES)[:, None]
        g[np.arange(len(g)), classes] -= 1
        flat = features.ravel()  # 16-bit numbers: sorted in linear time
        order = np.argsort(flat, kind="stable")
        flat = np.take(flat, order)
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        rows, counts = flat[starts], np.diff(np.r_[starts, len(flat)])
        total = segment_sums(np.take(g, order % len(g), axis=0), starts, counts)
        self.sum[rows] += np.einsum("ij,ij->i", total, total) / CLASSES
        self.weights[rows] -= (RATE / np.sqrt(self.sum[rows]))[:, None] * total
        self.seen[rows] += counts


def hashes(words: list[bytes]) -> np.ndarray:
    """128 bits for each word, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)


def _contexts(names: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """64 bits for each previous word, by its hash, and class."""
    x = names.view(np.uint64) + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """Staged (h, g, w, c): the words of the training texts with their hashes; each task hands on sums."""

    def run(batches):
        total: Counter[bytes] = Counter()

        def out():
            if total:
                columns = [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())]
                total.clear()
                yield pa.RecordBatch.from_arrays(columns, names=["w", "c"])

        for _, texts in _texts(batches, 0):
            for text in texts:
                total.update(tokens(text))
            total[END] += len(texts)
            if len(total) > FLUSH:
                yield from out()
        yield from out()

    def named(batches):
        for batch in batches:
            if batch.num_rows:
                h, g = hashes(batch.column(0).to_pylist()).T
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), *batch.columns], names=["h", "g", "w", "c"])

    counts = docs.select("text").mapInArrow(lean(run), "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    return stage(counts.mapInArrow(lean(named), "h long, g long, w binary, c long"), "words")


def _head(words: DataFrame) -> Head:
    """About the HEAD commonest words, from a histogram of the counts in fine steps; of the step that does not fit, a share by hash. Totals of the classes cover all words."""
    spark = words.sparkSession
    step = F.floor(F.log2("c") * STEPS)
    cut, share, room = 0, SPLIT, HEAD
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        cut = r["step"]
        if r["n"] > room:
            share = SPLIT * room // r["n"]
            break
        room -= r["n"]
    found = words.where((step > cut) | ((step == cut) & (F.pmod("h", F.lit(SPLIT)) < share))).select("w", "c").toArrow()
    common = sorted(((w, c) for w, c in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True) if w != END), key=lambda x: (-x[1], x[0]))
    totals = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("w") == F.lit(END), F.col("c"))).alias("ends")).first()
    listed = [(END, totals["ends"] or 0), *common]
    alone = spark.sparkContext.broadcast({w: k for k, (w, _) in enumerate(listed[:ALONE])})

    def classes(batches):
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            own, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            k = class_of(ending_of(own))
            for i, w in enumerate(own):
                if w in alone.value:
                    k[i] = alone.value[w]
            n += np.bincount(k, c, minlength=CLASSES).astype(np.int64)
            v += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.select("w", "c").mapInArrow(lean(classes), "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    return Head([w for w, _ in listed], np.array([c for _, c in listed], float), totals["n"] or 0, totals["v"], class_n, class_v)


def _texts(batches, column: int, most: int = 2 << 20):
    """Slices of a few megabytes of text, or one long text: (slice, texts)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.r_[0, np.flatnonzero(np.diff(size // most)) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            yield part, part.column(column).to_pylist()


def train(docs: DataFrame, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias): in each round the tasks take gradient steps over their part of a share of the corpus, and the rows of
    their weights are averaged by how often each task has met them. Averages are summed in slices of rows over the cluster."""
    spark = docs.sparkSession
    prior = head.class_n + 1
    bias = np.log(prior / prior.sum()).astype(np.float32)
    weights = np.zeros(((KINDS + DEEP) * ROWS, CLASSES), np.float32)
    sent_head = spark.sparkContext.broadcast(head)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((weights, bias))

        def learn(batches, sent=sent):
            own, (weights, bias) = sent_head.value.open(), sent.value
            learner = Learner(weights)
            for _, texts in _texts(batches, 0):
                for _, *step in _steps(Batch(texts, own), own, bias):
                    learner.step(*step)
            for at in range(0, len(learner.seen), _SLICE):
                part = slice(at, at + _SLICE)
                if learner.seen[part].any():
                    half = np.clip(learner.weights[part], -LIMIT, LIMIT).astype(np.float16)
                    columns = [pa.array([at]), pa.array([half.tobytes()], pa.binary()), pa.array([learner.seen[part].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["at", "weights", "seen"])

        def add(batches):
            total: dict[int, list] = {}
            for batch in batches:
                for at, half, seen in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    s = np.frombuffer(seen, np.int64)
                    h = np.frombuffer(half, np.float16).reshape(-1, CLASSES) * s[:, None].astype(np.float64)
                    if at in total:
                        total[at][0] += h
                        total[at][1] = total[at][1] + s
                    else:
                        total[at] = [h, s]
            if total:
                means = [(h / np.maximum(s, 1)[:, None]).astype(np.float32).tobytes() for h, s in total.values()]
                columns = [pa.array(list(total)), pa.array(means, pa.binary()), pa.array([s.tobytes() for _, s in total.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "weights", "seen"])

        share = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("text")
        schema = "at long, weights binary, seen binary"
        for r in share.mapInArrow(lean(learn), schema).repartition("at").mapInArrow(lean(add), schema).collect():
            met = np.frombuffer(r["seen"], np.int64) > 0
            part = slice(r["at"], r["at"] + _SLICE)
            weights[part][met] = np.frombuffer(r["weights"], np.float32).reshape(-1, CLASSES)[met]
    return weights, bias


def _score(sent_head, sent):
    names = ["doc_id", "uid", "held_out", "n_tokens", "n_known", "base", "score", "h", "g", "context", "word", "n"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def rows(**given):
        """Rows with the given columns; the others are null."""
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        head, (weights, bias) = sent_head.value.open(), sent.value
        for part, texts in _texts(batches, 3):
            b = Batch(texts, head)
            share = np.zeros(len(b))
            for tokens_, *of in _steps(b, head, bias):
                share[tokens_] += log_share(weights, *of)
            ids = b.ids[b.place]
            common = ids >= 0
            c = np.where(common, head.counts[ids], 0)
            base, inside = np.where(common, head.base[ids], 0.0), np.where(common, head.inside[ids], -head.scale[b.classes])
            first = np.r_[0, np.cumsum(b.lengths)[:-1]]
            sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, share / np.log(10) + inside)]
            sums[1] -= b.lengths * np.log10(head.n + SMOOTH * (head.v + 1))
            yield rows(doc_id=part.column(0), uid=part.column(1), held_out=part.column(2), n_tokens=b.lengths, n_known=sums[0], base=sums[1], score=sums[2])
            uid, held = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            h, g = np.ascontiguousarray(hashes(b.rare).T)
            doc, context, word, n = b.pairs(head, h)
            if len(doc):
                yield rows(uid=uid[doc], held_out=held[doc], context=context, word=word, n=n)
            if len(b.tail):
                doc, h, g, n = _grouped(h, np.searchsorted(b.starts, b.tail, side="right") - 1, h, g)
                yield rows(uid=uid[doc], held_out=held[doc], h=h, g=g, n=n)

    return run


def pair_gains(starts: np.ndarray, n: np.ndarray, shares: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of what the pairs of each context multiply the shares of their words by, and of what all other words' shares are multiplied by.

    The weights w >= 0 of a context maximise sum(n * log p) - discount * sum(w) for p = share * exp(w) / norm, whose gradient is n - discount - p * sum(n). Steps are multiplicative:
    w grows by the log of the ratio of the two parts, all pairs of the context at once.
    """
    sizes = np.diff(np.r_[starts, len(n)])
    total = np.add.reduceat(n.astype(float), starts)
    target = (n - discount) / np.repeat(total, sizes)
    free = np.maximum(1 - np.add.reduceat(shares, starts), 1e-9)
    norm = free / (discount * sizes / total)
    w = np.zeros(len(n))
    for _ in range(PAIR_STEPS):
        p = shares * np.exp(w) / np.repeat(norm, sizes)
        w = np.maximum(w + np.log(target / p), 0)
        norm = 1 + np.add.reduceat(shares * np.expm1(w), starts)
    other = -np.log10(norm)
    return w / np.log(10) + np.repeat(other, sizes), other


def _solved(held: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The gain of each row of whole contexts, sorted by context, under the weights learned from the rows that are not held out."""
    new = np.r_[True, context[1:] != context[:-1]]
    order = np.argsort((np.cumsum(new) << 32) + word)
    held, word, n = held[order], word[order], n[order]
    pair = np.flatnonzero(new | np.r_[True, word[1:] != word[:-1]])
    of_pair, of_context = np.diff(np.r_[pair, len(n)]), np.cumsum(new) - 1
    met = np.add.reduceat(np.where(held | (word < 0), 0, n), pair)
    known = met > 0
    gain, other = np.zeros(len(pair)), np.zeros(of_context[-1] + 1)
    if known.any():
        inner = of_context[pair[known]]
        starts = np.flatnonzero(np.r_[True, inner[1:] != inner[:-1]])
        gain[known], other[inner[starts]] = pair_gains(starts, met[known], shares[word[pair[known]]], DISCOUNT)
    gain[~known] = other[of_context[pair[~known]]]
    out = np.empty(len(n))
    out[order] = np.repeat(gain, of_pair)
    return out


_TYPES = ("u1", "u2", "u4", "u8", "f8")


def packed(*columns: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers from 0 on in as few bytes as the largest needs."""
    parts = []
    for c in columns:
        k = 4 if c.dtype.kind == "f" else int(np.searchsorted([8, 16, 32], int(c.max()).bit_length())) if len(c) else 0
        parts += [struct.pack("<BQ", k, len(c)), c.astype(_TYPES[k]).tobytes()]
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        k, n = struct.unpack_from("<BQ", data, at)
        out.append(np.frombuffer(data, _TYPES[k], n, at + 9))
        at += 9 + out[-1].nbytes
    return out


def _shards(head: Head) -> tuple[int, int]:
    """Shards of contexts (and as many of rare words), and of texts."""
    return max(64, int(head.n) // SHARD), max(16, int(head.n) // SUMS)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start, and the end."""
    return np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]


def _part(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; shards are ranges of them."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _part_of_texts(uid: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(uid >> 10) % np.uint32(shards)).astype(np.int64)


def _batch(blocks) -> pa.RecordBatch:
    shard, data = zip(*blocks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(data, pa.binary())], names=["shard", "block"])


_BLOCKS = "shard long, block binary"


def _pack(batches, head: Head):
    """Blocks of the rows that _score gives: pairs by the shard of their context, then rare words by that of their hash, then texts by that of their sums."""
    shards, of_texts = _shards(head)

    def column(batch, name):
        return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def blocks(held, first, keys, others):
        """Sorted by the first key, whose runs (with the second key) are written once."""
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        keyed = rows[0].view(np.uint64)
        order = np.argsort(keyed) if keys == 1 else np.lexsort((rows[1], keyed))
        rows = [c[order] for c in rows]
        keyed, least = keyed[order], rows[keys].min()
        rows[keys] = rows[keys] - least
        cuts = _cuts(_part(keyed, shards))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = [c[lo:hi] for c in rows]
            new = np.ones(hi - lo, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in own[:keys]])
            at = np.flatnonzero(new)
            runs = [c[at].view(np.uint64) for c in own[:keys]]
            yield first + int(_part(keyed[lo : lo + 1], shards)[0]), packed(np.array([least]), *runs, np.diff(np.r_[at, hi - lo]), *own[keys : keys + 3], *others(own[keys + 3 :]))

    held, kinds = {"context": [], "h": []}, {"context": (0, 1, lambda c: ((c[0] + 1) & 0xFFFF, (c[0] + 1) >> 16)), "h": (shards, 2, lambda c: ())}
    size = dict.fromkeys(held, 0)

    def flushed(kind):
        if held[kind]:
            yield _batch(blocks(held[kind], *kinds[kind]))
            held[kind], size[kind] = [], 0

    for batch in batches:
        names, n = batch.schema.names, batch.num_rows
        if not n:
            continue
        for kind, keys, more in (("context", ["context"], ["word"]), ("h", ["h", "g"], [])):
            if kind in names and batch.column(names.index(kind)).null_count < n:
                held[kind].append([*(column(batch, k) for k in keys), column(batch, "uid"), column(batch, "held_out").astype(np.uint8), column(batch, "n").astype(np.int64), *(column(batch, k).astype(np.int64) for k in more)])
                size[kind] += n
                if size[kind] >= PACK:
                    yield from flushed(kind)
        if "n_tokens" in names and batch.column(names.index("n_tokens")).null_count < n:
            doc_id = batch.column(names.index("doc_id"))
            whole = pc.fill_null(doc_id, 0).to_numpy().view(np.uint64)
            rows = [column(batch, "uid"), np.asarray(doc_id.is_null().to_numpy(zero_copy_only=False), np.uint8), whole, column(batch, "held_out").astype(np.uint8), *(column(batch, k) for k in ("n_tokens", "n_known", "base", "score"))]
            part = _part_of_texts(rows[0], of_texts)
            yield _batch((2 * shards + int(k), packed(*(c[part == k] for c in rows))) for k in np.unique(part))
    for kind in held:
        yield from flushed(kind)


def _by_shard(batches):
    """(shard, the arrays of its blocks) of blocks sorted by shard."""
    rows = ((k, data) for b in batches for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for shard, blocks in groupby(rows, lambda r: r[0]):
        yield shard, (unpacked(data) for _, data in blocks)


def _sums_by_text(uid: np.ndarray, columns: list[np.ndarray], shards: int):
    """Blocks of the sums of each column by text: (shard, block)."""
    order = np.argsort(uid, kind="stable")
    uid = uid[order]
    first = _cuts(uid)[:-1]
    uid, sums = uid[first], [np.add.reduceat(c[order], first) for c in columns]
    part = _part_of_texts(uid, shards)
    order = np.argsort(part, kind="stable")
    uid, sums, cuts = uid[order], [c[order] for c in sums], _cuts(part[order])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = _cuts(group := uid[lo:hi] >> 10)
        yield int(part[order[lo]]), packed(group[at[:-1]], np.diff(at), uid[lo:hi] & 1023, *(c[lo:hi] for c in sums))


def _pair_gains_of(parts, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uid, gain times n) of all rows of a shard's contexts, solved PAIR_ROWS rows or one context at once."""
    rows = [(least[0].astype(np.int64) + uid, held, np.repeat(c, times), low.astype(np.int64) + (high.astype(np.int64) << 16) - 1, n) for least, c, times, uid, held, n, low, high in parts]
    uid, held, context, word, n = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.argsort(context)
    uid, held, context, word, n = uid[order], held[order] > 0, context[order], word[order], n[order].astype(np.int64)
    ends, out, lo = _cuts(context)[1:], np.empty(len(n)), 0
    while lo < len(n):
        hi = int(ends[min(np.searchsorted(ends, lo + PAIR_ROWS), len(ends) - 1)])
        out[lo:hi] = _solved(held[lo:hi], context[lo:hi], word[lo:hi], n[lo:hi], shares) * n[lo:hi]
        lo = hi
    return uid, out


def _rare_logs_of(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, n times log10 of the smoothed count, n if the count is not 0) of all rows of a shard's rare words, which are counted here."""
    rows = [(least[0].astype(np.int64) + uid, held, np.repeat(h, times), np.repeat(g, times), n) for least, h, g, times, uid, held, n in parts]
    uid, held, h, g, n = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((g, h))
    uid, held, h, g, n = uid[order], held[order], h[order], g[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    c = np.repeat(np.add.reduceat(np.where(held > 0, 0, n), first), np.diff(np.r_[first, len(n)]))
    return uid, n * np.log10(c + SMOOTH), np.where(c > 0, n, 0)


_TEXT_SUMS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, more double, also long, pairs double"


def _text_sums(blocks: DataFrame, sent_head) -> DataFrame:
    """A row for each text: its own figures, the sums over its rare words (more, also) and over its pairs.

    The rows of a context meet in one task, which learns its weights from those that are not held out and scores all; those of a rare word
    do for its count. A shard has about SHARD tokens, or one context; a context has CONTEXT tokens at most where the words before its previous word differ.
    """

    def solve(batches):
        head = sent_head.value.open()
        shares, (shards, of_texts) = 10**head.inside, _shards(head)
        for shard, parts in _by_shard(batches):
            if shard < shards:
                uid, out = _pair_gains_of(parts, shares)
                yield _batch(_sums_by_text(uid, [out], of_texts))
            elif shard < 2 * shards:
                uid, *out = _rare_logs_of(parts)
                yield _batch(_sums_by_text(uid, out, of_texts))
            else:
                yield _batch((shard - 2 * shards, packed(*p)) for p in parts)

    def texts(batches):
        for _, parts in _by_shard(batches):
            docs, sums = [], []
            for p in parts:
                if len(p) == 8:
                    docs.append(p)
                else:
                    sums.append(((np.repeat(p[0], p[1]).astype(np.int64) << 10) + p[2], p[3:]))
            own = [np.concatenate(c) for c in zip(*docs, strict=True)] if docs else [np.zeros(0, np.int64)] * 8
            uid = np.unique(np.concatenate([own[0].astype(np.int64), *(u for u, _ in sums)]))
            more, also, pairs = np.zeros(len(uid)), np.zeros(len(uid), np.int64), np.zeros(len(uid))
            for u, c in sums:
                at = np.searchsorted(uid, u)
                if len(c) == 1:
                    pairs[at] += c[0]
                else:
                    more[at] += c[0]
                    also[at] += c[1].astype(np.int64)
            absent, at = np.ones(len(uid), bool), np.searchsorted(uid, own[0].astype(np.int64))
            absent[at] = False

            def spread(c, kind, at=at, absent=absent):
                out = np.zeros(len(absent), kind)
                out[at] = c
                return out

            null = absent.copy()
            null[at] |= own[1] > 0
            columns = [pa.array(uid), pa.array(spread(own[2].astype(np.uint64).view(np.int64), np.int64), mask=null), pa.array(spread(own[3] > 0, bool), mask=absent)]
            columns += [pa.array(spread(own[k].astype(t), t), mask=absent) for k, t in ((4, np.int64), (5, np.int64), (6, float), (7, float))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(more), pa.array(also), pa.array(pairs)], names=[c.split()[0] for c in _TEXT_SUMS.split(", ")])

    shards, of_texts = _shards(sent_head.value)
    met = blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(solve), _BLOCKS)
    return met.repartition(of_texts, "shard").sortWithinPartitions("shard").mapInArrow(lean(texts), _TEXT_SUMS)


def pair_scores(pairs: DataFrame, sent_head) -> DataFrame:
    """(uid, pairs): the sum of the gains of each text's pairs (uid, held_out, context, word, n); uid is not negative."""
    rows = pairs.select("uid", "held_out", "context", "word", "n")
    return _text_sums(rows.mapInArrow(lean(lambda batches: _pack(batches, sent_head.value)), _BLOCKS), sent_head).select("uid", "pairs")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    Words are lower-cased (A-Z); the end of a text is a token. The model learns from the texts whose crc32(doc_id) mod 10 is not 0,
    and all texts are scored whole. base_score is the log10 probability under smoothed word counts, score that under the model.
    The commonest words are looked up in each task; the others are counted where all their rows meet, and pairs are scored where those of their context do.

    Null and empty texts have the end as their only token. A null id counts as the empty string, which is held out. Rows that repeat are learned from and
    scored each for itself. Weights depend on how rows are dealt to tasks, as every task takes steps of its own, and on the order of sums of floats:
    scores of other layouts differ a little, base scores by rounding only. With nothing to learn from, no token is known and classes are equally likely. Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), (F.crc32(key.cast("binary")) % 10 == 0).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    learned = rows.where(~F.col("held_out"))
    words = _counted(learned)
    head = _head(words)
    sent, sent_head = spark.sparkContext.broadcast(train(learned, head)), spark.sparkContext.broadcast(head)
    score = _score(sent_head, sent)
    texts = _text_sums(rows.mapInArrow(lean(lambda batches: _pack(score(batches), sent_head.value)), _BLOCKS), sent_head)
    return texts.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("also")).alias("n_known"),
        F.lit(head.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"),
        (F.col("score") + F.col("more") + F.col("pairs")).alias("score"),
    )
