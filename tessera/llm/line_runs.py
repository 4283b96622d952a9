"""Deduplication of repeated line runs by prefix doubling over line-id sequences.

Every line of every document is a suffix of the corpus's sequence of line ids that ends with its document. Round k of the prefix
doubling ranks the suffixes by their first 2^k lines: the pair of the ranks of two adjacent halves is sorted over the
cluster, and the place of a pair is its new rank. Suffixes that are alone with their rank drop out, because no longer run of theirs repeats.

Suffixes whose longest common prefix covers a run of lines form one interval of the suffix order. For a run of any length l, with
2^k <= l < 2^(k+1), the interval is named by the ranks, in round k, of the run's first and of its last 2^k lines. The first place of an interval in
the order of documents stays; at the others the run is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, drop_staged, lean, stage

#: A run is removed if it has so many words.
LEAST_WORDS = 50

#: Rows of length 0 are suffixes with their rank; others are runs to decide. most: the longest run of the document.
_LEVEL = "uid long, doc_id long, i int, length int, most int, rank long"
_MEET = "uid long, doc_id long, i int, length int, most int, a long, b long"


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """Staged (uid, doc_id, i, words, h1, h2): the lines of each row (uid, doc_id, text), without the white space around them, as 128-bit ids."""
    lines = rows.select("uid", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")))
    return stage(
        lines.select("uid", "doc_id", "i", F.regexp_count("line", F.lit(WORD)).cast("int").alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")),
        "lines",
    )


def _ranked(keys: DataFrame, a: str, b: str) -> DataFrame:
    """Staged (a, b, rank): pairs that occur twice or more, ranked by their place in sorted order.

    Rows are summed before the shuffle; ranges of pairs follow one another, and so do the ids that are given within them.
    """
    twice = stage(keys.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(a, b), "twice")
    out = stage(twice.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    drop_staged(twice)
    return out


def _by_document(batches, width: int):
    """The rows of each document in turn, as arrays; batches are sorted by document and line."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        cuts = np.r_[0, np.flatnonzero(np.diff(columns[0])) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = [c[lo:hi] for c in columns]
            if held and held[-1][0][0] != part[0][0]:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def shortest_runs(i: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line: how many lines from it on, and up to it, make the shortest run of `least` words; 0 if none.

    Lines are those that repeat; a run must not skip a line in between.
    """
    n = len(i)
    cum = np.r_[0, np.cumsum(words, dtype=np.int64)]
    part = np.cumsum(np.r_[0, np.diff(i) != 1])
    last = np.searchsorted(part, part, side="right")  # end of the line's stretch
    first = np.searchsorted(part, part, side="left")
    end = np.searchsorted(cum, cum[:-1] + least, side="left")
    ahead = np.where(end <= last, end - np.arange(n), 0)
    begin = np.searchsorted(cum, cum[1:] - least, side="right") - 1
    back = np.where(begin >= first, np.arange(n) + 1 - begin, 0)
    return ahead, back


def _sorted(rows: DataFrame) -> DataFrame:
    """Each document's rows together and in order: a document's lines fit where its text fits."""
    return rows.repartition("uid").sortWithinPartitions("uid", "i")


def _runs(least: int):
    """Each document's suffixes and, at their first lines, the shortest runs that may be removed."""

    def run(batches):
        for uid, doc, missing, i, words, rank in _by_document(batches, 6):
            ahead, back = shortest_runs(i, words, least)
            both = np.unique(np.concatenate([np.c_[i[ahead > 0], ahead[ahead > 0]], np.c_[(i - back + 1)[back > 0], back[back > 0]]]), axis=0)
            n, most = len(i) + len(both), max(ahead.max(), back.max())
            docs = pa.array(np.full(n, doc[0]), mask=np.full(n, missing[0]))
            first, length = (np.concatenate(c).astype(np.int32) for c in ((i, both[:, 0]), (np.zeros(len(i)), both[:, 1])))
            ranks = pa.array(np.r_[rank, np.zeros(len(both), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, uid[0])), docs, pa.array(first), pa.array(length), pa.array(np.full(n, most, np.int32)), ranks], names=["uid", "doc_id", "i", "length", "most", "rank"])

    return run


def _meetings(level: int):
    """What round `level` decides: the runs whose length it covers (length > 0), and the pairs for the next round (length 0)."""
    step = 1 << level

    def run(batches):
        for uid, doc, missing, start, length, most, rank in _by_document(batches, 7):
            suffix = length == 0
            i, ranks = start[suffix], rank[suffix]
            if not len(i):
                continue
            runs = ~suffix
            first, width = start[runs], length[runs]
            if most[0] >= 2 * step:
                first, width = np.r_[first, i], np.r_[width, np.zeros(len(i), width.dtype)]
            second = first + np.where(width > 0, width - step, step)
            lo, hi = np.searchsorted(i, first), np.searchsorted(i, second)
            there = (lo < len(i)) & (hi < len(i))
            there[there] &= (i[lo[there]] == first[there]) & (i[hi[there]] == second[there])
            if n := int(there.sum()):
                docs = pa.array(np.full(n, doc[0]), mask=np.full(n, missing[0]))
                columns = [pa.array(np.full(n, uid[0])), docs, pa.array(first[there].astype(np.int32)), pa.array(width[there].astype(np.int32)), pa.array(np.full(n, most[0], np.int32)), pa.array(ranks[lo[there]]), pa.array(ranks[hi[there]])]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "i", "length", "most", "a", "b"])

    return run


def _with_id(rows: DataFrame) -> list:
    return ["uid", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("missing")]


def repeated_runs(rows: DataFrame, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines, copies): the staged lines, and staged (uid, doc_id, i, length), the runs that occur earlier."""
    lines = lines_of(rows)
    ranks = _ranked(lines, "h1", "h2")
    active = lines.join(ranks, ["h1", "h2"])
    start = stage(_sorted(active.select(*_with_id(active), "i", "words", "rank")).mapInArrow(lean(_runs(least)), _LEVEL), "level")
    drop_staged(ranks)
    now = start.where("length = 0 and most > 0")
    copies, level = None, 0
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "i")
    while True:
        rows = now.unionAll(start.where(F.col("length").between(1 << level, (2 << level) - 1)))
        met = stage(_sorted(rows.select(*_with_id(rows), "i", "length", "most", "rank")).mapInArrow(lean(_meetings(level)), _MEET), "meetings")
        runs = met.where("length > 0")
        first = stage(runs.groupBy("length", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "intervals")
        late = stage(runs.join(first, ["length", "a", "b"]).where(place > F.col("first")).select("uid", "doc_id", "i", "length"), "copies")
        copies = late if copies is None else copies.unionAll(late)
        pairs = met.where("length = 0")
        if pairs.isEmpty():
            return lines, copies
        ranks = _ranked(pairs, "a", "b")
        after = stage(pairs.join(ranks, ["a", "b"]).select("uid", "doc_id", "i", "length", "most", "rank"), "level")
        for old in (met, first, ranks, *([now] if level else [])):
            drop_staged(old)
        now, level = after, level + 1
        if now.isEmpty():
            return lines, copies


def _merged(batches):
    """Maximal spans of the lines that runs cover, for each document."""
    for uid, start, length in _by_document(batches, 3):
        spans: list[list[int]] = []
        for lo, hi in zip(start.tolist(), (start + length).tolist(), strict=True):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        yield pa.RecordBatch.from_arrays([pa.array(uid[:1]), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["uid", "spans"])


def _spans(copies: DataFrame) -> DataFrame:
    """Staged (uid, spans)."""
    return stage(_sorted(copies.select("uid", "i", "length").distinct()).mapInArrow(lean(_merged), "uid long, spans array<struct<start:int,end:int>>"), "spans")


def line_dedup(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, removed_lines, removed_words, spans), one row for each input row.

    A run of adjacent lines with at least `least` words that also occurs at an earlier place is removed; the order of places is
    doc_id, then line. spans holds the removed lines as [start, end), merged where they touch or overlap. Lines are compared without the
    white space around them. A copy may overlap its original, as in a line that repeats many times.

    Null text has no lines; empty text has one empty line. Null ids come last. Rows that repeat an id come in the order in which they are read, and each
    has its own row. An empty table gives an empty result. Other columns are ignored.
    """
    rows = _numbered(docs, id_col, text_col)
    lines, copies = repeated_runs(rows, least)
    spans = _spans(copies)
    gone = spans.select("uid", F.explode("spans").alias("s")).select("uid", F.explode(F.sequence(F.col("s.start"), F.col("s.end") - 1)).alias("i"), F.lit(1).alias("hit"))
    counts = lines.join(gone, ["uid", "i"], "left").groupBy("uid", F.col("doc_id").alias("doc_id"))
    counts = counts.agg(F.count("*").alias("n_lines"), F.count("hit").alias("removed_lines"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("words"))), F.lit(0)).cast("long").alias("removed_words"))
    found = counts.join(spans, "uid", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    have = found.select("doc_id", "n_lines", "removed_lines", "removed_words", F.coalesce("spans", none).alias("spans"))
    zero = F.lit(0).cast("long")
    textless = docs.where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), zero.alias("n_lines"), zero.alias("removed_lines"), zero.alias("removed_words"), none.alias("spans"))
    return have.unionAll(textless)


def without_runs(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that line_dedup removes, with all their columns.

    Rows are told apart by their place, so ids may repeat or be null; the rows are staged for that. Null text stays null.
    """
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = stage(docs.select(F.monotonically_increasing_id().alias("uid"), whole), "rows")
    given = rows.select("uid", F.col("row")[id_col].cast("long").alias("doc_id"), F.col("row")[text_col].cast("string").alias("text"))
    joined = rows.join(_spans(repeated_runs(given, least)[1]), "uid", "left")
    text = F.col("row")[text_col]
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    left = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*((left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
