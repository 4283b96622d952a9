"""Algorithms in which each step depends on the one before: grouping, first fit, content-defined chunks.

They run per independent unit (a tree, a staging batch, a file), each of which one task holds; the units are dealt over the cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_GROUP = 4
MASK = 63
#: Content-defined chunks (fixed values of the format).
LEAST_CHUNK, MOST_CHUNK, CHUNK_BITS = 8 * 1024, 128 * 1024, 16


def boundary(key: str, mask: int = MASK) -> bool:
    """Whether a key may end a node: the low bits of the first four bytes of its hash, read little-endian, are zero."""
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "little") & mask == 0


def boundary_groups(entries: DataFrame, mask: int = MASK, least: int = LEAST_GROUP) -> DataFrame:
    """(tree, key, group_id): keys in order; a node is closed at a boundary key once it has `least` entries."""

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", key=lambda c: c.map(lambda k: k.encode()), ignore_index=True)
        groups, group, held = [], 0, 0
        for key in frame["key"]:
            groups.append(group)
            held += 1
            if held >= least and boundary(key, mask):
                group, held = group + 1, 0
        return frame.assign(group_id=groups)[["tree", "key", "group_id"]]

    return entries.select("tree", "key").groupBy("tree").applyInPandas(assign, "tree string, key string, group_id long")


def _waste(size: int, slab: int) -> float:
    allocated = -(-size // slab) * slab
    return (allocated - size) / allocated if allocated else 0.0


def admits(size: int, length: int, slab: int, cap: int, tight: float) -> bool:
    """Whether an open pack of this size takes a blob.

    An empty pack takes any. Beyond the cap only what completes the current slab of a pack below the cap is taken. Below the
    waste bound, and beyond the cap, a blob must fit the slab's tail or lower the wasted share.
    """
    if size == 0:
        return True
    tail = slab - size % slab
    over = size + length > cap
    if over and (size >= cap or length > tail):
        return False
    if over or _waste(size, slab) < tight:
        return length <= tail or _waste(size + length, slab) < _waste(size, slab)
    return True


def first_fit(blobs: DataFrame, slab: int, cap: int, tight: float) -> DataFrame:
    """(batch, path, pack): blobs of a batch in order of path, each into the first open pack that takes it."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path", ignore_index=True)
        sizes, packs = [], []
        for length in frame["length"].tolist():
            k = next((k for k, size in enumerate(sizes) if admits(size, length, slab, cap, tight)), len(sizes))
            if k == len(sizes):
                sizes.append(0)
            sizes[k] += length
            packs.append(k)
        return frame.assign(pack=packs)[["batch", "path", "length", "pack"]]

    return blobs.select("batch", "path", "length").groupBy("batch").applyInPandas(pack, "batch string, path string, length long, pack long")


def gear_table() -> np.ndarray:
    """A random 64-bit word for each byte, from a rule: boundaries are stable, but not those of other tables."""
    return np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % b).digest()[:8] for b in range(256)), "<u8")


_GEAR = gear_table()


def gear_ends(data: bytes, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks of data. The rolling hash of the last 64 bytes is built by doubling, for all places at once."""
    h, width = _GEAR[np.frombuffer(data, np.uint8)], 1
    while width < 64 and width < len(h):
        h = h + np.r_[np.zeros(width, np.uint64), h[:-width] << np.uint64(width)]
        width *= 2
    hits = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
    ends, start = [], 0
    while start < len(data):
        k = np.searchsorted(hits, start + least)
        end = min(int(hits[k]) if k < len(hits) else len(data), start + most, len(data))
        ends.append(end)
        start = end
    return ends


def cdc_chunks(files: DataFrame, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, bits: int = CHUNK_BITS) -> DataFrame:
    """(key, offset, length, hash): content-defined chunks of the UTF-8 bytes of each file."""

    def run(batches):
        for batch in batches:
            keys, offsets, sizes, hashes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, start = (text or "").encode("utf-8", "surrogatepass"), 0
                for end in gear_ends(data, least, most, bits):
                    keys.append(key)
                    offsets.append(start)
                    sizes.append(end - start)
                    hashes.append(hashlib.sha256(data[start:end]).hexdigest())
                    start = end
            columns = [pa.array(keys, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "offset", "length", "hash"])

    return files.select("key", "text").mapInArrow(run, "key string, offset long, length long, hash string")


def shard_buckets(names: DataFrame, level: int = 0) -> DataFrame:
    """(name, bucket): the byte of the name's XXH3 hash that deals a directory over 256 shards at a level."""
    import xxhash

    def run(batches):
        for batch in batches:
            found = [None if n is None else xxhash.xxh3_64_intdigest(n.encode()) >> 8 * level & 0xFF for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["name", "bucket"])

    return names.select("name").mapInArrow(run, "name string, bucket long")
