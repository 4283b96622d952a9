"""Jaccard join of word n-grams with R-trees over count vectors.

Each distinct set of shingles is a point: the number of its shingles in each of GROUPS hash groups. The sum of
coordinate minima of two points bounds the size of the intersection from above, and so does the sum against the upper
corner of an R-tree node for all points below it. Where a point can meet another is decided by the rarest shingles:
two sets with a Jaccard coefficient of t or more share one among the rarest n - ceil(t n) + 1 of each, whatever the order,
as long as it is one order for all. Sets that share such a shingle share a block, and each block has an R-tree. First the pivot of each block is
searched for in its tree, and each set is compared with the pivot that finds it most often; then the trees are searched for what lies in
different components of one block.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import TEXTS, drop_staged, fresh, lean, stage

WORDS = 5
#: Two sets link when HUNDRED * intersection >= SIMILAR * union.
SIMILAR, HUNDRED = 80, 100
GROUPS = 64
#: Counters of the frequency sketch, which orders shingles by rarity; its size does not depend on the data.
SKETCH_BITS, SLICE_BITS = 19, 13
#: A shingle that may be in this many sets more than its counter's background is salted; a block holds about as many sets.
BLOCK = 4_096
#: Rows of a task's blocks whose trees are built at once, and pairs of a query and a node that are looked at together.
SLAB, PIECE = 50_000, 30_000
#: Pairs that one set verifies in one group of rows.
STAR = 512
#: A set weighs about as much as so many rows of numbers.
SET_ROWS = 100
FANOUT = 16
#: Words that a task remembers, and sets that it has already entered.
WORD_CACHE, SET_CACHE = 100_000, 200_000
SLOTS = 1 << 23
#: Names of sets are the leading half of 128 bits. Of those who share it, as a few sets in many billions do, all but one get the other half; so many at most.
NAME_BITS, MOST_SHARED = 64, 100_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct n-grams of lower-cased words as 64-bit hashes, sorted."""

    def __init__(self, words: int = WORDS):
        self.words, self.seen = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(self.seen) > WORD_CACHE:
            self.seen.clear()
        seen, out = self.seen, []
        for w in text.encode("utf-8", "surrogatepass").lower().split():
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        if not out:
            return np.zeros(0, np.uint64)
        a, n = np.array(out, np.uint64), self.words
        if len(a) < n:  # the whole sequence is one; its length keeps it apart from longer ones
            rows, mixed = 1, np.array([len(a)], np.uint64)
            columns = [a[k : k + 1] for k in range(len(a))]
        else:
            rows = len(a) - n + 1
            mixed, columns = np.zeros(rows, np.uint64), [a[k : k + rows] for k in range(n)]
        for column in columns:
            mixed = (mixed ^ column) * _P
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


class Namer:
    """64-bit names of sets; equal sets have equal names. shared: the leading halves that several sets have, with the other half of the one that keeps it."""

    def __init__(self, shared: dict[int, int] | None = None):
        self.shared, self.drop = shared or {}, 64 - NAME_BITS

    def halves(self, shingles: np.ndarray) -> tuple[int, int]:
        name, other = struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
        return name >> self.drop, other

    def __call__(self, shingles: np.ndarray) -> int:
        name, other = self.halves(shingles)
        return other if self.shared.get(name, other) != other else name


def count_vector(shingles: np.ndarray) -> bytes:
    counts = np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def vectors_of(column: list[bytes]) -> np.ndarray:
    """Count vectors as a matrix; a counter that has run over bounds nothing."""
    found = np.frombuffer(b"".join(column), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    found[found == 255] = 1 << 24
    return found


def rare_count(n: int) -> int:
    """How many of its rarest shingles a set of n must show so that no similar set can miss them all."""
    return n - -(-SIMILAR * n // HUNDRED) + 1


def needed(a, b):
    """Least intersection of linked sets of a and b members."""
    return -(-SIMILAR * (a + b) // (HUNDRED + SIMILAR))


class CountForest:
    """R-trees over count vectors, one for each block, packed by sorting and laid side by side.

    A node keeps its upper corner and its least and greatest set size. block: the numbers of the blocks from 0 on, ascending. Rows
    are those of `order`: results are places in it.
    """

    def __init__(self, block: np.ndarray, vectors: np.ndarray, sizes: np.ndarray):
        wide = np.argsort(-vectors.clip(max=255).var(axis=0), kind="stable")[:2]
        self.order = np.lexsort((vectors[:, wide[1]], vectors[:, wide[0]] // 4, sizes // 8, block))
        self.vectors, self.sizes, self.block = vectors[self.order], sizes[self.order], block
        counts = np.bincount(block)
        #: of each level: corner, least, most, and of each node the first child and their number
        self.levels = [(self.vectors, self.sizes, self.sizes, None, None)]
        while counts.max() > 1 or len(self.levels) == 1:
            corner, least, most, *_ = self.levels[-1]
            nodes = -(-counts // FANOUT)
            first, into = np.cumsum(counts) - counts, np.cumsum(nodes) - nodes
            starts = np.repeat(first, nodes) + FANOUT * (np.arange(nodes.sum()) - np.repeat(into, nodes))
            children = np.diff(np.r_[starts, len(corner)])
            self.levels.append((np.maximum.reduceat(corner, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), starts, children))
            counts = nodes

    def search(self, queries: np.ndarray):
        """Pairs (query, row) of one block whose bound allows a link, in pieces; a row also meets itself."""
        todo = [(len(self.levels) - 1, queries[at : at + PIECE], self.block[queries[at : at + PIECE]]) for at in range(0, len(queries), PIECE)]
        while todo:
            level, q, node = todo.pop()
            corner, least, most, starts, children = self.levels[level]
            bound, size = np.minimum(corner[node], self.vectors[q]).sum(axis=1), self.sizes[q]
            fits = (bound >= needed(least[node], size)) & (HUNDRED * most[node] >= SIMILAR * size) & (SIMILAR * least[node] <= HUNDRED * size)
            q, node = q[fits], node[fits]
            if not len(q):
                continue
            if not level:
                yield q, node
                continue
            n = children[node]
            below = np.repeat(starts[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q = np.repeat(q, n)
            todo += [(level - 1, q[at : at + PIECE], below[at : at + PIECE]) for at in range(0, len(q), PIECE)]


def _summary(docs: DataFrame, words: int) -> DataFrame:
    """Staged: a row for each document (n, name, vector), and slices of the frequency sketch of each task."""
    schema = "doc_id long, n long, name long, other long, vector binary, slice int, counters binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("other", pa.int64()), ("vector", pa.binary()), ("slice", pa.int32()), ("counters", pa.binary())])
    namer = Namer()

    def run(batches):
        cut, sketch = Shingler(words), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                found = cut(text)
                np.add.at(sketch, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                rows.append((doc, len(found), *(namer.halves(found) if len(found) else (None, None)), count_vector(found), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow) if rows else pa.RecordBatch.from_pylist([], arrow)
        slices = sketch.reshape(-1, 1 << SLICE_BITS).astype("<i4")
        rows = [(None, None, None, None, None, k, s.tobytes()) for k, s in enumerate(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return stage(docs.mapInArrow(lean(run, TEXTS), schema), "shingles")


def _sketch(summary: DataFrame) -> np.ndarray:
    """The summed counters: a table of fixed size."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(data, "<i8" if len(data) == 8 << SLICE_BITS else "<i4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["slice", "counters"])

    rows = summary.where("slice is not null").select("slice", "counters").repartition("slice").mapInArrow(lean(add), "slice int, counters binary")
    out = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int64)
    for row in rows.collect():
        out[row["slice"]] = np.frombuffer(row["counters"], "<i8")
    return out.ravel()


def _entries(docs: DataFrame, sketch: np.ndarray, namer: Namer, words: int) -> DataFrame:
    """(key, salt, name, n, pos): each set under its rarest shingles, with their places in its order of rarity.

    Shingles that may be frequent are salted. A task enters a set once, or again when it has met many others.
    """
    sent = docs.sparkSession.sparkContext.broadcast((sketch, 2 * int(np.median(sketch))))

    def run(batches):
        cut, (often, background), entered = Shingler(words), sent.value, set()
        for batch in batches:
            if len(entered) > SET_CACHE:
                entered.clear()
            keys, salts, names, sizes, places = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                found = cut(text)
                n = len(found)
                if HUNDRED * n < SIMILAR * (n + 1) or n == 0:  # only equal sets can be as similar
                    continue
                name = namer(found)
                if name in entered:
                    continue
                entered.add(name)
                seen = often[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rare = np.lexsort((found, seen))[: rare_count(n)]
                keys.append(found[rare].view(np.int64))
                parts = (seen[rare] - background).clip(0) // BLOCK + 1
                salts.append(np.where(parts > 1, 1 + (name & (2**63 - 1)) % parts, 0).astype(np.int32))
                names.append(np.full(len(rare), name, np.int64))
                sizes.append(np.full(len(rare), n, np.int32))
                places.append(np.arange(len(rare), dtype=np.int32))
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays([join(keys, np.int64), join(salts, np.int32), join(names, np.int64), join(sizes, np.int32), join(places, np.int32)], names=["key", "salt", "name", "n", "pos"])

    return docs.select("text").mapInArrow(lean(run, TEXTS), "key long, salt int, name long, n int, pos int")


def _whole(batches, least: int = 1):
    """The rows of sorted batches as arrays, in runs of at least so many rows that end where the first two columns change."""
    held: list[pa.RecordBatch] = []

    def out(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        return [table.column(k).chunk(0) if table.num_rows else None for k in range(table.num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if held and sum(h.num_rows for h in held) >= least:
            last = tuple(held[-1].column(k)[-1].as_py() for k in range(2))
            same = (one == last[0]) & (two == last[1])
            end = len(same) if same.all() else int(np.argmin(same))
            if end:
                held.append(batch.slice(0, end))
            if end == batch.num_rows:
                continue
            yield out(held)
            held, batch = [], batch.slice(end)
        held.append(batch)
    if held:
        yield out(held)


def reach(n, pos):
    """A pair whose first common shingle is at these places of sets of these sizes has an intersection of at most the smaller reach."""
    return n - pos


def _blocks(entries: DataFrame) -> DataFrame:
    """Staged (key, name, n, pos, pivot, salted): the members of each block of two sets or more, and its pivot.

    The pivot is the set with the fewest rarer shingles of its own, so the one nearest to what the block has in
    common. A salted shingle has several blocks; their pivots meet once more.
    """

    def gather(batches):
        for got in _whole(batches):
            yield met(*(x.to_numpy(zero_copy_only=False) for x in got))

    def met(key, salt, name, n, pos):
        new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        once = new | np.r_[True, name[1:] != name[:-1]]  # equal sets are next to each other
        key, salt, name, n, pos, new = (x[once] for x in (key, salt, name, n, pos, new))
        block = np.cumsum(new) - 1
        order = np.lexsort((n, block))  # a set is out where not even the next larger or smaller one is near its size
        near = (np.diff(block[order]) == 0) & (HUNDRED * n[order][:-1].astype(np.int64) >= SIMILAR * n[order][1:].astype(np.int64))
        able = np.zeros(len(n), bool)
        able[order] = np.r_[near, False] | np.r_[False, near]
        able |= salt > 0
        key, salt, name, n, pos, block = (x[able] for x in (key, salt, name, n, pos, block))
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        counts = np.diff(np.r_[starts, len(key)])
        pivot = np.repeat(name[starts], counts)
        alive = counts > 1
        two = starts[counts == 2]  # most blocks by far: chance meetings, which sizes and places mostly rule out
        a, b = n[two].astype(np.int64), n[two + 1].astype(np.int64)
        left = np.minimum(reach(a, pos[two]), reach(b, pos[two + 1]))
        alive[counts == 2] = (left >= needed(a, b)) & (HUNDRED * np.minimum(a, b) >= SIMILAR * np.maximum(a, b))
        keep = np.repeat(alive, counts) | (salt > 0)
        columns = (key, name, n, pos, pivot, salt > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=["key", "name", "n", "pos", "pivot", "salted"])

    sorted_ = entries.repartition("key", "salt").sortWithinPartitions("key", "salt", "pos", "n", "name")
    return stage(sorted_.mapInArrow(lean(gather), "key long, name long, n int, pos int, pivot long, salted boolean"), "blocks")


def _found_by_pivots(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, pivot, common): what the trees find for the pivots of their blocks, and in how many blocks."""
    rows = blocks.select("key", "pivot", "name", "n", "pos").join(classes.select("name", "vector"), "name").select("key", "pivot", "name", "n", "pos", "vector")

    def search(batches):
        for key, pivot, name, n, pos, vector in _whole(batches, SLAB):
            key, pivot, name, n, pos = (x.to_numpy(zero_copy_only=False) for x in (key, pivot, name, n, pos))
            forest = CountForest(np.cumsum(np.r_[False, (np.diff(key) != 0) | (np.diff(pivot) != 0)]), vectors_of(vector.to_pylist()), n.astype(np.int64))
            name, pivot, left = (x[forest.order] for x in (name, pivot, reach(n, pos).astype(np.int64)))
            for q, row in forest.search(np.flatnonzero(name == pivot)):
                fits = (row != q) & (np.minimum(left[row], left[q]) >= needed(forest.sizes[row], forest.sizes[q]))
                yield pa.RecordBatch.from_arrays([pa.array(name[row[fits]]), pa.array(name[q[fits]])], names=["name", "pivot"])

    met = rows.repartition("key", "pivot").sortWithinPartitions("key", "pivot", "n", "name")
    return met.mapInArrow(lean(search), "name long, pivot long").groupBy("name", "pivot").agg(F.count("*").alias("common"))


def _bounded(pairs: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Staged (a, b): the pairs that sizes and count vectors allow to link."""
    one = classes.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    two = classes.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy() for k in (2, 4))
                bound = np.minimum(vectors_of(batch.column(3).to_pylist()), vectors_of(batch.column(5).to_pylist())).sum(axis=1)
                fits = pa.array((bound >= needed(na, nb)) & (HUNDRED * na >= SIMILAR * nb) & (HUNDRED * nb >= SIMILAR * na))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(fits), batch.column(1).filter(fits)], names=["a", "b"])

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "va", "nb", "vb")
    return stage(joined.mapInArrow(lean(keep), "a long, b long"), "pairs", rows)


def _sets(docs: DataFrame, names: DataFrame, classes: DataFrame, namer: Namer, words: int) -> DataFrame:
    """Staged (name, members): the sets of the given names, cut again from a document of each.

    A bit table of fixed size tells the tasks which documents may be asked for; a set may come from several tasks, and a few
    come that nothing asks for.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    asked = names.join(classes.select("name", "doc_id"), "name")
    bits = np.zeros(SLOTS, bool)
    for batch in asked.select(slot("doc_id").alias("slot")).distinct().toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        cut, table, seen = Shingler(words), np.unpackbits(sent.value).astype(bool), set()
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for k in np.flatnonzero(table[batch.column(0).to_numpy()]):
                found = cut(texts[k].as_py())
                name = namer(found)
                if len(found) and name not in seen:
                    seen.add(name)
                    rows.append((name, found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["name", "members"])

    return stage(docs.select(slot("doc_id").alias("slot"), "text").mapInArrow(lean(run, TEXTS), "name long, members binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, namer: Namer, words: int) -> DataFrame:
    """Staged (u, v): the pairs whose sets are similar.

    Pairs meet at their second set, the hub, in groups of about STAR; a hub's set goes to each of its groups once, and
    each member's set to its hubs.
    """
    n = pairs.count()
    names = stage(pairs.select(F.col("a").alias("name")).unionAll(pairs.select(F.col("b").alias("name"))).distinct(), "names", 2 * n)
    sets = _sets(docs, names, classes, namer, words)
    hubs = stage(pairs.groupBy("b").agg((F.ceil(F.count("*") / STAR)).cast("int").alias("parts")), "hubs", n)
    parts = pairs.join(hubs, "b").select(F.col("a").alias("name"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    own = hubs.select(F.col("b").alias("name"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    met = own.unionAll(parts).join(sets, "name").select("b", "part", "role", F.col("name").alias("a"), "members")
    met = met.repartition("b", "part").sortWithinPartitions("b", "part", "role")

    def check(batches):
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for b, role, a, members in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                found = np.frombuffer(members, np.uint64)
                if role == 0:
                    at, own = b, found
                elif at == b:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if HUNDRED * both >= SIMILAR * (len(own) + len(found) - both):
                        us.append(a)
                        vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    links = stage(met.mapInArrow(lean(check), "u long, v long"), "links", SET_ROWS * n)
    for old in (names, sets, hubs):
        drop_staged(old)
    return links


def _across(blocks: DataFrame, joined: DataFrame, classes: DataFrame, tried: DataFrame, rows: int) -> DataFrame:
    """(a, b): what may still link sets of one block that no link connects so far.

    Only blocks that hold several components are looked at. The rows of a block's largest component are dealt over its
    parts, the others go to each part; R-trees over the parts then find the pairs across components that the bounds allow.
    """
    of = blocks.join(joined.withColumnRenamed("node", "name"), "name", "left").select("key", "name", "pos", F.coalesce("component", "name").alias("component"))
    sizes = of.groupBy("key", "component").agg(F.count("*").alias("rows"))
    keys = sizes.groupBy("key").agg(F.sum("rows").alias("rows"), F.count("*").alias("kinds"), F.max_by("component", "rows").alias("largest"))
    mixed = stage(keys.where("kinds > 1").select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts"), "largest"), "mixed", rows)
    found = of.join(mixed, "key").join(classes.select("name", "n", "vector"), "name")
    other = F.col("component") != F.col("largest")
    part = F.when(other, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")))
    dealt = found.select("key", F.explode(part).alias("part"), "name", "component", "n", "pos", other.alias("other"), "vector")
    met = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "n", "name")

    def search(batches):
        for key, part, name, component, n, pos, other, vector in _whole(batches, SLAB):
            key, part, name, component, n, pos, other = (x.to_numpy(zero_copy_only=False) for x in (key, part, name, component, n, pos, other))
            block = np.cumsum(np.r_[False, (np.diff(key) != 0) | (np.diff(part) != 0)])
            forest = CountForest(block, vectors_of(vector.to_pylist()), n.astype(np.int64))
            name, component, other, left = (x[forest.order] for x in (name, component, other, reach(n, pos).astype(np.int64)))
            seen, held = [], 0
            for q, row in forest.search(np.flatnonzero(other)):
                fits = (component[row] != component[q]) & (~other[row] | (row > q))
                fits &= np.minimum(left[row], left[q]) >= needed(forest.sizes[row], forest.sizes[q])
                a, b = name[q[fits]], name[row[fits]]
                seen.append(np.c_[np.minimum(a, b), np.maximum(a, b)])
                held += len(a)
                if held > 500_000:
                    yield _distinct(seen)
                    seen, held = [], 0
            yield _distinct(seen)

    old = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.mapInArrow(lean(search), "a long, b long").distinct().join(old, ["a", "b"], "left_anti")


def _distinct(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _classes(rows: DataFrame, n_rows: int) -> DataFrame:
    """Staged: each distinct set with its smallest document, and the least and greatest of the other halves of its name."""
    ends = (F.min("other").alias("other"), F.max("other").alias("last"))
    return stage(rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("vector").alias("vector"), *ends), "classes", n_rows)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    Two documents link when their sets of distinct n-grams of lower-cased words have a Jaccard coefficient of at least 0.8; a document
    with fewer words has its whole sequence as one. component_id is the smallest doc_id that links reach.

    Equal sets are one class and never expanded into pairs. Its rarest shingles put each class in blocks, whose R-trees
    find the sets that their pivots may link with, and then what may link different components.
    Every pair looked at that survives the bounds is verified on the whole sets. Pairs inside a component that links already span are not
    looked at, so components are complete, but links are neither all found nor counted.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows are copies of one another; null ids take part and are
    passed over for component_id, which is null only if all of a component's ids are. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    summary = _summary(docs, words)
    rows, n_rows = summary.where("slice is null"), summary.count()
    sketch, classes, namer = _sketch(summary), _classes(rows, n_rows), Namer()
    shared = classes.where("other <> last").select("name", "other").limit(MOST_SHARED + 1).collect()
    if len(shared) > MOST_SHARED:
        raise ValueError("too many sets share their names")
    if shared:
        namer = Namer({r["name"]: r["other"] for r in shared})
        keeps = F.broadcast(docs.sparkSession.createDataFrame([(r["name"], r["other"]) for r in shared], "name long, keeps long"))
        named = rows.join(keeps, "name", "left").withColumn("name", F.when(F.col("keeps") != F.col("other"), F.col("other")).otherwise(F.col("name")))
        rows = stage(named.select("doc_id", "n", "name", "other", "vector"), "renamed", n_rows)
        classes = _classes(rows, n_rows)
    blocks = _blocks(_entries(docs, sketch, namer, words))
    n_classes, n_blocks = classes.count(), blocks.count()
    # each set with the pivot that finds it in the most blocks
    stars = _found_by_pivots(blocks, classes).groupBy("name").agg(F.max_by("pivot", F.struct("common", "pivot")).alias("b"))
    stars = stage(stars.select(F.col("name").alias("a"), "b"), "stars", n_classes)
    tops = blocks.where("salted").groupBy("key").agg(F.min(F.struct("pos", "n", "name")).alias("top")).select("key", F.col("top.name").alias("b"))
    over = blocks.where("salted").select("key", F.col("pivot").alias("a")).distinct().join(tops, "key").where("a <> b").select("a", "b").distinct()
    first = stage(stars.unionAll(_bounded(over, classes, n_blocks)).distinct(), "first", 2 * n_classes)
    links = _verified(first, docs, classes, namer, words)
    joined = components(links, links.count())
    across = _bounded(_across(blocks, joined, classes, first, n_blocks), classes, n_blocks)
    second = _verified(across, docs, classes, namer, words)
    more = second.count()
    final = components(links.unionAll(second), links.count() + more) if more else joined
    member = classes.select("name", "doc_id").join(final.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    member = stage(member, "members", n_classes)
    least = stage(member.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least", n_classes)
    named = stage(member.join(least, "component").select("name", "component_id"), "named", n_classes)
    for old in (classes, blocks, stars, first, across, links, second, member, least):
        drop_staged(old)
    out = rows.select("doc_id", "n", "name").join(named, "name", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a smaller id of their component stands for, with all their columns.

    Rows without an id are kept; rows that repeat an id are kept or dropped together.
    """
    other = fresh(docs, "gone")
    gone = ngram_join(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(stage(gone, "gone", docs.count()), F.col(id_col) == F.col(other), "left_anti")
