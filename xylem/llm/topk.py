"""Exact top-k search by aggregation of sorted lists, without random access.

A score is the inner product of whole-number vectors: a sum over components, each
a list of the candidates sorted by value.  A query reads all lists in step, that of
a component from its top where its own component is positive, else from its bottom.
After a step, a candidate's score lies between two bounds: entries read count as
they are, unread ones lie between the list's last read value and its end.  The
query stops by itself as soon as no candidate outside its ``k`` best lower bounds
has an upper bound that reaches them; the few still in doubt are then resolved to
their final scores.  Reading that does not pay ends too: where a step beyond a sixteenth of
the lists rules nobody out, or the depth is half the number of candidates left, these
are resolved at once (on vectors without structure that is the usual end: no exact
bound prunes them).

Candidates and queries are dealt into blocks, and each pair of blocks is one group.
Within a group each query reads and stops alone.

Components are kept as doubles, as floor(scale * x) is one; scores are exact whole
numbers of any size, and those beyond 64 bits are returned as the nearest bound,
ranked by their true values within a group.

Vectors with a null or non-finite component, null vectors and null ids take no
part.  Rows of the query's own id are no candidates of it; repeated rows are
candidates each.  Vectors of different lengths count as padded with zeros.  Empty
tables, and queries without candidates, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import prepare, table

K, SCALE, EVERY = 5, 256, 50
CANDIDATES, QUERIES = 4_096, 2_048
#: Entries of each list that the first step reads, how many times as many the next one has read, and the share of the lists
#: from which on a step must rule somebody out.
FIRST, GROWTH, PATIENCE = 8, 3, 16


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): each usable vector's components as floor(scale * x), packed as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten().cast(pa.float64())
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            size = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            ok = (bad[first[1:]] == bad[first[:-1]]) & np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
            y = np.floor(scale * np.where(np.isfinite(x), x, 0))
            own = np.flatnonzero(ok)
            yield pa.RecordBatch.from_pydict({"vec_id": ids.take(pa.array(own)), "v": pa.array([y[first[i] : first[i + 1]].tobytes() for i in own], pa.binary())})

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "vec_id long, v binary")


def _matrix(col: pa.ChunkedArray, d: int) -> np.ndarray:
    rows = [np.frombuffer(x.as_py(), np.float64) for x in col]
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Lists:
    """The sorted lists of a block's candidates, one a component, and how many entries of them were read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.value = np.take_along_axis(self.x, self.order, axis=0)
        self.most, self.read, self.resolved = np.abs(self.x).max(initial=0), 0, 0

    def best(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best candidates but the rows of ``own_id``: larger scores, then smaller ids first."""
        left = np.flatnonzero(self.ids != own_id)
        if self.most * np.abs(q).max(initial=0) * max(1, len(q)) < 2.0**52:
            left = self.read_on(left, q, k)
            score = (self.x[left] @ q).astype(np.int64)
        else:  # beyond what doubles add up exactly: Python's whole numbers, slow but exact
            whole = [int(v) for v in q]
            score = np.array([sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in self.x[left]], object)
        self.resolved += len(left)
        if len(score) > 4 * k and score.dtype != object:  # ties at the bound stay in
            near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            left, score = left[near], score[near]
        top = np.argsort(-score, kind="stable")[:k]
        return [(int(self.ids[left[i]]), max(-(2**63), min(2**63 - 1, int(score[i])))) for i in top]

    def read_on(self, left: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The candidates that can be among the k best, when reading stops."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        if not len(used) or len(left) <= k:
            return left
        # entry t of a list as the query reads it, the best first, and the list's end
        ahead = q[used] > 0
        weight = q[used]
        tail = weight * np.where(ahead, self.value[0, used], self.value[-1, used])
        low = np.full(n, tail.sum())  # what is read counts as it is, the rest as the list's end
        unread = np.ones((n, len(used)))
        column = np.arange(len(used))
        at, step = 0, FIRST
        while at < len(left) / 2:
            to = min(n, step)
            depth = np.arange(at, to)[:, None]
            rows = np.where(ahead, n - 1 - depth, depth)
            who = self.order[rows, used]
            low += np.bincount(who.ravel(), (weight * self.value[rows, used] - tail).ravel(), n)
            unread[who, column] = 0
            self.read += who.size
            at, step = to, GROWTH * to
            # unread entries are at most the last value read
            last = weight * np.where(ahead, self.value[n - at, used], self.value[at - 1, used])
            high, before = low + unread @ (last - tail), len(left)
            floor = np.partition(low[left], before - k)[before - k]
            left = left[high[left] >= floor]
            if len(left) <= k or len(left) == before and at * PATIENCE >= n:
                break
        return left


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all vectors but those of its own id."""
    prepare(vectors.sparkSession)
    cand, quer = whole(vectors, id_col, vector_col, scale), whole(queries, id_col, vector_col, scale)
    nc, nq = (max(1, -(-df.count() // most)) for df, most in ((vectors, CANDIDATES), (queries, QUERIES)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = cand.withColumn("c", deal(nc)).withColumn("q", each(nq))
    quer = quer.withColumn("q", deal(nq)).withColumn("c", each(nc))

    def group(c: pa.Table, q: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(c) and len(q):
            d = max(len(v.as_py()) for col in (c.column("v"), q.column("v")) for v in col) // 8
            qi = q.column("vec_id").to_numpy()
            lists = Lists(c.column("vec_id").to_numpy(), _matrix(c.column("v"), d))
            for i, v in zip(qi.tolist(), _matrix(q.column("v"), d), strict=True):
                rows += [(i, a, score) for a, score in lists.best(i, v, k)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    found = cand.groupBy("c", "q").cogroup(quer.groupBy("c", "q")).applyInArrow(group, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
