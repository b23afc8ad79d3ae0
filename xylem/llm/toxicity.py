"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words learns from confirmed toxic documents and from
unlabelled ones, of which a share (the class prior) is toxic too.  Its risk is

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

so the toxic share hidden in the unlabelled text is taken out, and the rest may
not fall below zero; where it would, the step goes against it instead.

It learns from at most ``positives`` toxic and ``unlabelled`` other documents of
the training folds, picked by a hash of the id (of several rows of one id, the text of the least hash),
and only from those with at most ``MOST`` distinct buckets, so what comes to the
driver is bounded; the prior is the share of toxic
rows among the labelled ones there.  All documents are scored, on all their words.
Texts are scored whole, of any length; a null or empty one is scored as a text
without words.  Rows without an id are scored and not learned from.  Columns that
come along keep their names, but for ``score``, whatever its case.  Without any toxic
training row the model is constant at the prior (0 without labels); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .language import fold
from .runtime import others, prepare, scratch, table, written

BUCKETS, POSITIVES, UNLABELLED, THRESHOLD = 1 << 18, 6_000, 18_000, 0.3
#: Distinct buckets of a row that is learned from.
MOST = 8_192
#: A bucket has a weight if so many toxic documents have it, and its shares lie so many standard errors apart.
LEAST, APART = 3, 5.0
#: Bytes of the word beginnings that are features beside whole words, so that a word family is known by its stem.
STEMS = (4, 5, 6, 7, 8)


def features(texts: pa.Array, live: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row starts, distinct (and live) buckets of words and word beginnings) of each slice."""
    for lo, hi, buf, offs in t.slices(texts):
        buf = t.LOWER[buf]
        starts, ends, firsts = t.words(buf, offs, t.ALNUM)
        row = np.repeat(np.arange(hi - lo), np.diff(firsts)) * BUCKETS
        key = [row + (t.word_hashes(buf, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)]
        for k in STEMS:
            long = ends - starts > k
            stem = t.word_hashes(buf, starts[long], starts[long] + k) ^ np.uint64(0x9E3779B97F4A7C15)
            key.append(row[long] + (stem % np.uint64(BUCKETS)).astype(np.int64))
        key = np.concatenate(key)
        key = np.unique(key if live is None else key[live[key % BUCKETS]])
        yield hi - lo, np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS), key % BUCKETS


def sums(w: np.ndarray, starts: np.ndarray, idx: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(w[idx])])
    return run[starts[1:]] - run[starts[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse rows: buckets one after the other."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.idx = np.concatenate([np.zeros(0, np.int32), *lists])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def only(self, live: np.ndarray) -> Rows:
        """The rows with the live buckets alone."""
        keep = live[self.idx]
        out = Rows([])
        out.starts, out.idx = np.concatenate([[0], np.cumsum(keep)])[self.starts], self.idx[keep]
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.starts[rows + 1] - self.starts[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        return at, self.idx[np.repeat(self.starts[rows] - at[:-1], size) + np.arange(at[-1])]


def told_apart(a: np.ndarray, b: np.ndarray, na: int, nb: int, least: int = LEAST, apart: float = APART) -> np.ndarray:
    """Which buckets have a weight, of the numbers of toxic and unlabelled documents with each and in all."""
    both = (a + b + 1) / (na + nb + 2)
    return (a >= least) & (np.abs(a / na - b / nb) >= apart * np.sqrt(both * (1 - both) * (1 / na + 1 / nb)))


def fit(pos: Rows, unl: Rows, prior: float, epochs: int = 40, rate: float = 0.03, decay: float = 1e-3, least: int = LEAST, apart: float = APART, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias.  A bucket has a weight if ``least`` toxic documents have it, and the shares of toxic and
    unlabelled documents that do lie ``apart`` standard errors apart."""
    prior = float(np.clip(prior, 1e-4, 0.9))
    bias = float(np.log(prior / (1 - prior)))
    w = np.zeros(BUCKETS)
    if not len(pos) or not len(unl):
        return w, bias
    live = told_apart(np.bincount(pos.idx, minlength=BUCKETS), np.bincount(unl.idx, minlength=BUCKETS), len(pos), len(unl), least, apart)
    pos, unl = pos.only(live), unl.only(live)
    m, v, mb, vb, step = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)
    parts = max(1, len(unl) // 1_500)
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(pos)), parts), np.array_split(rng.permutation(len(unl)), parts), strict=True):
            if not len(p) or not len(u):
                continue
            (ps, pi), (us, ui) = pos.take(p), unl.take(u)
            fp, fu = _sigmoid(sums(w, ps, pi) + bias), _sigmoid(sums(w, us, ui) + bias)
            # mean losses: -log(1 - f) of unlabelled and of toxic rows
            rest = -np.log(1 - fu + 1e-9).mean() + prior * np.log(1 - fp + 1e-9).mean()
            if rest >= 0:
                gp, gu = prior * ((fp - 1) - fp) / len(p), fu / len(u)
            else:
                gp, gu = prior * fp / len(p), -fu / len(u)
            g = np.bincount(pi, weights=np.repeat(gp, np.diff(ps)), minlength=BUCKETS) + np.bincount(ui, weights=np.repeat(gu, np.diff(us)), minlength=BUCKETS)
            g = np.where(live, g + decay * w / parts, 0)
            gb = gp.sum() + gu.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    return w, bias


def _picked(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the ids: those of the smallest hashes.  Only about twice as many get as far as the sort."""
    n = ids.count()
    near = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, (2 * most + 100) / max(1, n)) * (1 << 40)))
    return near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(most)


def _live(picked: DataFrame) -> np.ndarray:
    """The buckets that ``fit`` gives a weight, counted by the executors over ``picked`` (y, doc_id, x)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                n[y, np.frombuffer(x.as_py(), dtype=np.int32)] += 1  # buckets of a row are distinct
        some = np.flatnonzero(n.any(axis=0))
        for part in np.array_split(some, len(some) // 10_000 + 1):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part), "a": pa.array(n[1, part]), "b": pa.array(n[0, part])})

    sizes = {r["y"]: r["count"] for r in picked.groupBy("y").count().collect()}
    live = np.zeros(BUCKETS, bool)
    if sizes.get(0) and sizes.get(1):
        got = picked.mapInArrow(count, "bucket long, a long, b long").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST).toArrow()
        bucket, a, b = (got.column(c).to_numpy() for c in ("bucket", "a", "b"))  # at most BUCKETS rows
        live[bucket] = told_apart(a, b, sizes[1], sizes[0])
    return live


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, text_col: str = "text") -> tuple[np.ndarray, float]:
    """Ids are picked without their texts; one scan then gets the features of the ids, whose number is bounded.
    Only the live ones of them come to the driver."""
    with scratch(docs.sparkSession):
        return _trained(docs, labels, positives, unlabelled, text_col)


def _trained(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, text_col: str) -> tuple[np.ndarray, float]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (fold() != 2))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg("toxic")).first()[0] or 0.0
    ids, toxic = rows.select("doc_id").distinct(), marks.where("toxic = 1").select("doc_id")
    others = _picked(ids.join(marks, "doc_id", "left_anti"), unlabelled)
    if others.isEmpty():
        others = _picked(ids.join(toxic, "doc_id", "left_anti"), unlabelled)
    chosen = _picked(toxic, positives).withColumn("y", F.lit(1)).union(others.withColumn("y", F.lit(0)))
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "doc_id long, y int")  # at most positives + unlabelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, starts, idx in features(batch.column(2)):
                out += [x.astype(np.int32).tobytes() for x in np.split(idx, starts[1:-1])]
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "doc_id": batch.column(1), "x": pa.array(out, pa.binary())})

    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("y", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    picked = written(texts.mapInArrow(run, "y int, doc_id long, x binary").where(F.octet_length("x") <= 4 * MOST))
    live = _live(picked)
    shared = docs.sparkSession.sparkContext.broadcast(live)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (np.frombuffer(x.as_py(), dtype=np.int32) for x in batch.column(2))
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "doc_id": batch.column(1), "x": pa.array([x[shared.value[x]].tobytes() for x in lists], pa.binary())})

    got = picked.mapInArrow(only, "y int, doc_id long, x binary").orderBy("doc_id", "x").toArrow()
    y = got.column("y").to_numpy()
    lists = [np.frombuffer(x.as_py(), dtype=np.int32) for x in got.column("x")]
    del got
    return fit(Rows([x for x, k in zip(lists, y, strict=True) if k == 1]), Rows([x for x, k in zip(lists, y, strict=True) if k == 0]), share)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (which replaces a column of that name)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    own = others(docs, ("score",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        live = w != 0
        for batch in batches:
            out = [_sigmoid(sums(w, starts, idx) + bias) for _, starts, idx in features(batch.column(text_col), live)]
            score = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | {"score": score})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema]
    return docs.select(*own).mapInArrow(run, ", ".join([*kinds, "score double"]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prepare(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text", F.coalesce(fold() == 2, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
