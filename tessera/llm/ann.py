"""Nearest neighbours by additive quantisation with exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, stage

#: Codebooks are fitted on at most this many vectors, those with the smallest hashes of their ids.
SAMPLE = 8_192
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 6
#: Candidates by table score that are measured exactly, of each STEP rows of the index.
RERANK, STEP = 128, 4_096
#: Queries that are searched for at once; with the vector length that bounds what is sent to the tasks.
QUERY_BLOCK = 4_096
_SEED = 5


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components that are not all zero. Vectors of floats stay so, others are of doubles."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)


def scale_of(rows: DataFrame) -> float:
    """A power of two near the largest component: divided by it, any vector can be coded in single precision."""
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))).first()[0]
    return float(2.0 ** np.floor(np.log2(most))) if most else 1.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the last axis in double precision; where squares leave its range, of the scaled difference."""
    with np.errstate(over="ignore"):
        off = a - b
        out = np.sqrt((off**2).sum(-1))
    odd = ~np.isfinite(out) | (out < 1e-150)
    if odd.any():
        with np.errstate(over="ignore", invalid="ignore"):
            off = off[odd]
            most = np.abs(off).max(-1, keepdims=True)
            out[odd] = np.where(most[..., 0] > 0, most[..., 0] * np.sqrt(((off / np.where(most > 0, most, 1)) ** 2).sum(-1)), 0.0)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        order = np.argsort(near, kind="stable")
        heads, starts = np.unique(near[order], return_index=True)
        centres[heads] = np.add.reduceat(x[order], starts, axis=0) / np.diff([*starts, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), heads)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


class Codebooks:
    """Full-dimensional codebooks; a vector is coded as the sum of one word of each."""

    def __init__(self, books: np.ndarray):
        self.books = books  # (book, word, dimension)
        m, k, d = books.shape
        self.flat = books.reshape(m * k, d)
        self.norms = (books**2).sum(2)
        self.gram = (self.flat @ self.flat.T).reshape(m, k, m, k)

    @classmethod
    def fit(cls, sample: np.ndarray) -> Codebooks:
        """Each codebook is fitted to what the beam codes of those before it leave over."""
        rng, books = np.random.default_rng(_SEED), []
        left, k = sample.astype(np.float32), min(WORDS, len(sample))
        for _ in range(BOOKS):
            books.append(_kmeans(left, k, rng))
            partial = cls(np.stack(books))
            left = sample - partial.decode(partial.encode(sample))
        return cls(np.stack(books))

    def encode(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self._beam(x[i : i + step]) for i in range(0, len(x), step)]) if len(x) else np.zeros((0, len(self.books)), np.uint8)

    def _beam(self, x: np.ndarray) -> np.ndarray:
        """Keep the BEAM best partial codes; inner products of words replace residual vectors."""
        m, k, _ = self.books.shape
        dots = (x @ self.flat.T).reshape(len(x), m, k)
        codes, cost = np.zeros((len(x), 1, 0), np.int64), np.zeros((len(x), 1), np.float32)
        for book in range(m):
            grown = cost[:, :, None] + (self.norms[book] - 2 * dots[:, book])[:, None, :]
            for before in range(book):
                grown += 2 * self.gram[before, :, book, :][codes[:, :, before]]
            flat = grown.reshape(len(x), -1)
            width = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (len(x), 1))
            cost = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], axis=2)
        return np.take_along_axis(codes, np.argmin(cost, axis=1)[:, None, None], 1)[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(rows: DataFrame) -> tuple[Codebooks | None, int, float]:
    """Codebooks of the usable rows, their dimension, and the scale that coding divides by; vectors of another length than the commonest take no part."""
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return None, 0, 1.0
    d = lengths[0]["d"]
    same = rows.where(F.size("v") == d)
    scale = scale_of(same)
    sample = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    return Codebooks.fit((_matrix(sample.column(0).combine_chunks(), d) / scale).astype(np.float32)), d, scale


def build_index(rows: DataFrame, books: Codebooks, d: int, scale: float = 1.0) -> DataFrame:
    """Staged index: vec_id, code, norm of the coded vector, and the vector for reranking."""
    sent = rows.sparkSession.sparkContext.broadcast(books.books)

    def run(batches):
        own = Codebooks(sent.value)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            codes = own.encode((x / scale).astype(np.float32))
            norms = (own.decode(codes) ** 2).sum(1).astype(np.float32)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(norms), batch.column(1)], names=["vec_id", "code", "norm", "v"])

    kind = dict(rows.dtypes)["v"]
    return stage(rows.where(F.size("v") == d).mapInArrow(lean(run), f"vec_id long, code binary, norm float, v {kind}"), "codes")


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest (score, id) of each row; columns are in order of id."""
    if score.shape[1] <= n:
        return np.tile(np.arange(score.shape[1]), (len(score), 1))
    edge = np.partition(score, n - 1, axis=1)[:, n - 1 : n]
    rank = np.where(score < edge, 0, np.where(score == edge, 1, 2)).astype(np.int8)
    # a stable sort of three classes keeps the smaller ids among ties
    return np.argsort(rank, axis=1, kind="stable")[:, :n]


def search_block(index: DataFrame, books: Codebooks, d: int, scale: float, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Staged (query_id, vec_id, score): the k best of each task for each query of a block; score is the exact distance."""
    sent = index.sparkSession.sparkContext.broadcast((books.flat, len(books.books), ids, queries))

    def run(batches):
        flat, m, q_ids, q = sent.value
        words = len(flat) // m
        tables = ((q / scale).astype(np.float32) @ flat.T).astype(np.float32)
        exact = q.astype(np.float64)
        best_d = np.full((len(q), k), np.inf)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                v_ids = part.column(0).to_numpy()
                order = np.argsort(v_ids, kind="stable")
                v_ids = v_ids[order]
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, m)[order]
                norms, vectors = part.column(2).to_numpy()[order], _matrix(part.column(3), d)[order]
                for lo in range(0, len(q), 128):
                    hi = min(lo + 128, len(q))
                    score = np.broadcast_to(norms, (hi - lo, len(norms))).copy()
                    for b in range(m):
                        score -= 2 * tables[lo:hi, b * words : (b + 1) * words][:, codes[:, b]]
                    score[q_ids[lo:hi, None] == v_ids[None, :]] = np.inf
                    near = _best(score, v_ids, RERANK)
                    distance = distances(vectors[near].astype(np.float64), exact[lo:hi, None, :])
                    distance[np.isinf(np.take_along_axis(score, near, 1))] = np.inf
                    all_d = np.concatenate([best_d[lo:hi], distance], axis=1)
                    all_i = np.concatenate([best_i[lo:hi], v_ids[near]], axis=1)
                    first = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    best_d[lo:hi], best_i[lo:hi] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_i, first, 1)
        found = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, found.sum(1))), pa.array(best_i[found]), pa.array(best_d[found])], names=["query_id", "vec_id", "score"])

    found = stage(index.mapInArrow(lean(run), "query_id long, vec_id long, score double"), "nearest")
    sent.destroy()
    return found


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest others found.

    Every usable row is coded and scored against every query: the queries go to the tasks in blocks of bounded size, one after the other, and each
    task scans its part of the index by table lookups, measures the RERANK best of each STEP rows exactly on the original vectors, and hands on k
    rows a query. Ties go to the smaller id. Vectors that are null, zero, of another length than the commonest or hold null or
    non-finite components take no part, nor do rows without an id. Rows that share a query's id are its own and no candidates;
    of several such rows the smallest vector is the query. Vectors are coded in single precision, divided by a power of two, and
    measured as they are. Fewer than two usable rows give no result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    books, d, scale = fit(rows)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build_index(rows, books, d, scale)
    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "v").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if got.num_rows:
            parts.append(search_block(index, books, d, scale, got.column(0).to_numpy(), _matrix(got.column(1).combine_chunks(), d), k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
