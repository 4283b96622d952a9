"""Exact deduplication over a cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import collapsed, fresh, lean, stage

SLOTS = 4
MAX_KICKS = 200
#: At this many digests a map task hands on those that it has met once and deletes them from its index; that bounds its memory.
FLUSH = 200_000
#: Digests of one shard, about; their number gives that of the shards.
SHARD = 250_000


class CuckooIndex:
    """Digests with a value, behind a cuckoo filter of 16-bit fingerprints.

    A digest has two candidate buckets, each reachable from the other by its fingerprint. A lookup that finds
    no fingerprint in them ends there; a hit is verified against the full digests stored under the home bucket,
    so answers are exact. When an insertion displaces more than MAX_KICKS fingerprints, the filter is doubled
    and filled again from the stored digests.
    """

    def __init__(self, buckets: int = 1024):
        self._size = 0
        self._reset(buckets)
        self._content: dict[int, list[list]] = {}

    def __len__(self) -> int:
        return self._size

    def _reset(self, buckets: int) -> None:
        self._buckets = 1 << (buckets - 1).bit_length()
        self._mask = self._buckets - 1
        self._filter = array("H", bytes(2 * SLOTS * self._buckets))

    def _place(self, digest: bytes) -> tuple[int, int]:
        return 1 + int.from_bytes(digest[:2], "little") % 65535, int.from_bytes(digest[2:8], "little") & self._mask

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995 >> 3)) & self._mask

    def _has(self, bucket: int, print_: int) -> bool:
        at = bucket * SLOTS
        return print_ in self._filter[at : at + SLOTS]

    def _swap(self, bucket: int, old: int, new: int) -> bool:
        at = bucket * SLOTS
        for k in range(at, at + SLOTS):
            if self._filter[k] == old:
                self._filter[k] = new
                return True
        return False

    def _admit(self, bucket: int, print_: int) -> bool:
        """Put a fingerprint into one of its buckets, moving others out of the way."""
        if self._swap(bucket, 0, print_):
            return True
        for kick in range(MAX_KICKS):
            bucket = self._other(bucket, print_)
            if self._swap(bucket, 0, print_):
                return True
            at = bucket * SLOTS + kick % SLOTS
            print_, self._filter[at] = self._filter[at], print_
        return False

    def _grow(self) -> None:
        kept, buckets = [e for es in self._content.values() for e in es], self._buckets
        while True:
            buckets *= 2
            self._reset(buckets)
            self._content = {}
            for entry in kept:
                print_, home = self._place(entry[0])
                if not self._admit(home, print_):
                    break
                self._content.setdefault(home, []).append(entry)
            else:
                return

    def find(self, digest: bytes) -> list | None:
        """The entry [digest, value] of a live digest, or None."""
        print_, home = self._place(digest)
        if not self._has(home, print_) and not self._has(self._other(home, print_), print_):
            return None
        return next((e for e in self._content.get(home, ()) if e[0] == digest), None)

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live yet."""
        print_, home = self._place(digest)
        self._content.setdefault(home, []).append([digest, value])
        self._size += 1
        if not self._admit(home, print_):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest and one copy of its fingerprint; False if it was not live."""
        if (entry := self.find(digest)) is None:
            return False
        print_, home = self._place(digest)
        self._content[home].remove(entry)
        if not self._content[home]:
            del self._content[home]
        self._size -= 1
        return self._swap(home, print_, 0) or self._swap(self._other(home, print_), print_, 0)

    def entries(self) -> Iterator[list]:
        for found in self._content.values():
            yield from found


_PARTIAL = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("n", pa.int64())])


def _before(a: tuple, b: tuple) -> bool:
    """Order of (doc_id, uid); a null doc_id comes last."""
    return ((a[0] is None), a[0] or 0, a[1]) < ((b[0] is None), b[0] or 0, b[1])


def _out(rows: list[tuple], schema: pa.Schema = _PARTIAL) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000], strict=True), schema.types, strict=True)], schema=schema)


def _fold(flush: int | None):
    """Fold partial rows into one row a digest; with flush, memory is bounded and a digest may come out again.

    A full index hands on and deletes what has been met once, so that frequent digests stay live; if those fill half of it, they go too.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc, uid, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                entry = index.find(digest)
                if entry is None:
                    index.insert(digest, (doc, uid, n))
                else:
                    was = entry[1]
                    first = (doc, uid) if _before((doc, uid), was[:2]) else was[:2]
                    entry[1] = (*first, was[2] + n)
            if flush and len(index) >= flush:
                gone = [(d, *v) for d, v in index.entries() if v[2] == 1]
                if 2 * len(gone) < flush:
                    gone = [(d, *v) for d, v in index.entries()]
                for row in gone:
                    index.delete(row[0])
                yield from _out(gone)
        yield from _out([(d, *v) for d, v in index.entries()])

    return fold


def _shards(rows: int) -> int:
    return rows // SHARD + 1


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (doc_id, uid, digest): SHA-256 of each text with its white space collapsed."""
    return stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("uid"),
            F.unhex(F.sha2(collapsed(F.col(text_col)).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )


def index(found: DataFrame) -> DataFrame:
    """Staged (digest, keep_id, keep_uid, n), one row for each distinct digest.

    Each map task folds its rows through its own index, so that a digest with a third of all rows leaves a task
    about once; the partial rows then meet in the shard of their digest, of which there are as many as rows need.
    """
    rows = found.select("digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("n"))
    schema = "digest binary, keep_id long, keep_uid long, n long"
    parts = max(_shards(found.count()), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stage(rows.mapInArrow(lean(_fold(FLUSH)), schema).repartition(parts, "digest").mapInArrow(lean(_fold(None)), schema), "index")


_LIVE = pa.schema([("digest", pa.binary()), ("n", pa.int64())])


def update(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Staged (digest, n): the live digests after the changes, with the number of their rows.

    live: (digest, n), each digest once, n above 0. changes: (digest, change), any number of rows a digest: how many rows of it come (above 0) or go.
    Changes of a digest are summed before they meet the index, in their task and then in their shard. A digest whose rows have all gone is deleted; rows that go without
    having been there are passed over, as are null digests and changes. Other columns are ignored.
    """
    changes = changes.where("digest is not null").groupBy("digest").agg(F.sum("change").cast("long").alias("n")).where("n <> 0")
    both = live.select("digest", F.col("n").cast("long").alias("n"), F.lit(0).alias("later")).unionAll(changes.select("digest", "n", F.lit(1).alias("later")))

    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for digest, n, later in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                entry = index.find(digest)
                if not later or (entry is None and n > 0):
                    index.insert(digest, n)
                elif entry is not None and entry[1] + n > 0:
                    entry[1] += n
                elif entry is not None:
                    index.delete(digest)
        yield from _out([(d, n) for d, n in index.entries()], _LIVE)

    rows = both.repartition(max(_shards(both.count()), int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "digest").sortWithinPartitions("later")
    return stage(rows.mapInArrow(lean(run), "digest binary, n long"), "live")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Texts are equal when they are identical after collapsing white space. Of equal texts the row with the
    smallest doc_id stays. Null text counts as empty. A null doc_id comes after all others, and of rows that share
    the smallest doc_id exactly one stays. An empty table gives an empty result. Other columns are ignored.
    """
    found = digests(docs, id_col, text_col)
    copies = index(found).where("n > 1")
    return found.join(copies, "digest", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns.

    Rows are matched by doc_id; where input rows repeat a doc_id, the kept ones are told apart by digest, and rows
    that repeat both are reduced to one.
    """
    rows = docs.count()
    result = stage(exact_dedup(docs, id_col, text_col), "decisions", rows)
    repeated = result.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    other, sha, other_sha = (fresh(docs, x) for x in ("drop_id", "sha", "keep_sha"))
    if repeated.isEmpty():
        dropped = stage(result.where(~F.col("kept")).select(F.col("doc_id").alias(other)), "dropped", rows)
        return docs.join(dropped, F.col(id_col) == F.col(other), "left_anti")
    kept = result.where("kept").select(F.col("doc_id").alias(other), F.col("text_sha256").alias(other_sha))
    same = F.col(id_col).eqNullSafe(F.col(other)) & (F.col(sha) == F.col(other_sha))
    named = docs.withColumn(sha, F.sha2(collapsed(F.col(text_col)).cast("binary"), 256))
    return named.join(kept, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
