"""Quality classifier from overlapping heuristic labellers.

Each labeller votes good, bad or nothing on a document.  Expectation-maximisation
estimates how often each is right, from the counts of vote patterns over all
documents alone: the classes are hidden, and votes are taken as independent
within a class.  The posterior of each pattern is then the label, weighted by its
certainty, of a linear scorer over hashed word shapes and words, which judges all
documents.

The scorer learns from about ``sample`` documents, picked by a hash of id and text, of
repeated rows one, and only of those with at most ``features`` word shapes and words,
so what comes to the driver is bounded; vote patterns are counted over all rows, and
all texts are judged whole, of any length.  A null text counts as an empty one: most
labellers abstain and the rest see no fault.  Ids may be null or repeated.  Columns
that come along keep their names, but for those that results replace, whatever their
case.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .runtime import others, prepare, table

LABELLERS = ("symbols", "capitals", "word_length", "line_ends", "repeated_words", "repeated_lines", "stutter", "decorated_words")
BUCKETS, SAMPLE, FEATURES, THRESHOLD = 1 << 16, 12_000, 4_096, 0.5
GOOD, BAD, NONE = 1, 0, 2

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.ones(256, bool)
_SYMBOL[[*range(0, 33), *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SYMBOL[list(b".,;:'\"?()-")] = False
_LINES = t.byte_class(b"\n\r")
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask)])
    return run[offs[1:]] - run[offs[:-1]]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return np.bincount(rows[new], minlength=n)


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray, sure: np.ndarray | bool = True) -> np.ndarray:
    return np.where(sure & bad, BAD, np.where(sure & good, GOOD, NONE)).astype(np.int64)


def votes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each labeller."""
    n = len(offs) - 1
    starts, ends, firsts = t.words(buf, offs, t.SPACED)
    h = t.word_hashes(buf, starts, ends)
    count = np.diff(firsts)
    rows = np.repeat(np.arange(n), count)
    letters, upper = _per_row(_LETTER[buf], offs), _per_row(_UPPER[buf], offs)
    shown = _per_row(t.SPACED[buf], offs)
    symbols = _ratio(_per_row(_SYMBOL[buf], offs), shown)
    size = _ratio(shown, count)
    ls, le, lf = t.words(buf, offs, _LINES)
    lines, lrows = np.diff(lf), np.repeat(np.arange(n), np.diff(lf))
    lh = t.word_hashes(buf, ls, le)
    ended = np.bincount(lrows, weights=_END[buf[le - 1]], minlength=n) if len(le) else np.zeros(n)
    variety = _ratio(_distinct(h, rows, n), count)
    line_variety = _ratio(_distinct(lh, lrows, n), lines)
    tails = np.bincount(rows, weights=_SYMBOL[buf[ends - 1]], minlength=n) if len(ends) else np.zeros(n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    again = np.bincount(rows[same], minlength=n)
    caps = _ratio(upper, letters)
    return np.stack([
        _vote(symbols, symbols < 0.03, symbols > 0.08),
        _vote(caps, caps < 0.15, caps > 0.4, letters > 0),
        _vote(size, (size > 3) & (size < 10), (size > 14) | (size < 2), count >= 3),
        _vote(ended, ended >= 0.6 * lines, ended <= 0.2 * lines, lines > 0),
        _vote(variety, variety > 0.45, variety < 0.25, count >= 40),
        _vote(line_variety, line_variety > 0.95, line_variety < 0.6, lines >= 3),
        _vote(again, again < 0.05 * count, again > 0.2 * count, count >= 10),
        _vote(tails, tails < 0.05 * count, tails > 0.2 * count, count > 0),
    ], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, chance of each vote by labeller and class, share of good documents).

    A labeller that abstains says nothing: only its votes count, so short texts are no class of their own.
    """
    if not len(patterns):
        return np.zeros(0), np.full((len(LABELLERS), 2, 2), 1 / 2), 0.5
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    # one bad sign says more than one good sign, as good is the rule: the start only
    post = 1 / (1 + np.exp(-(good - 3.0 * bad)))
    hot = np.stack([patterns == k for k in (BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        chance = np.einsum("cp,pjk->jck", w, hot) + 1.0
        chance /= chance.sum(axis=2, keepdims=True)
        share = float(np.clip(w[1].sum() / w.sum(), 1e-4, 1 - 1e-4))
        score = np.einsum("pjk,jck->pc", hot, np.log(chance)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return post, chance, share


def shapes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, buckets, weights): each text's word shapes (kind of the first two bytes, last byte, length) and words,
    as shares of its words."""
    starts, ends, firsts = t.words(buf, offs, t.SPACED)
    n = len(offs) - 1
    kind = _LETTER.astype(np.int64) + _UPPER + 3 * _DIGIT
    size = ends - starts
    second = np.where(size > 1, kind[buf[np.minimum(starts + 1, max(len(buf) - 1, 0))]], 7) if len(buf) else np.zeros(0, np.int64)
    last = np.where(_LETTER[buf[ends - 1]], 0, buf[ends - 1]).astype(np.int64) if len(buf) else np.zeros(0, np.int64)
    shape = ((kind[buf[starts]] * 8 + second) * 256 + last) * 16 + np.minimum(size, 15)
    shape = (t.mix(shape.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS // 2)).astype(np.int64)
    word = (t.word_hashes(buf, starts, ends) % np.uint64(BUCKETS // 2)).astype(np.int64) + BUCKETS // 2
    rows = np.repeat(np.arange(n), np.diff(firsts))
    key, inv = np.unique(np.concatenate([rows * BUCKETS + shape, rows * BUCKETS + word]), return_inverse=True)
    share = np.bincount(inv, minlength=len(key)) / np.maximum(np.diff(firsts), 1)[key // BUCKETS]
    return np.searchsorted(key, np.arange(n + 1) * BUCKETS), key % BUCKETS, share


def dot(w: np.ndarray, starts: np.ndarray, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(w[idx] * x)])
    return run[starts[1:]] - run[starts[:-1]]


def fit(starts: np.ndarray, idx: np.ndarray, x: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels; both classes weigh the same."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(label):
        return w, bias
    good = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    weight = label / good + (1 - label) / (1 - good)
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.clip(dot(w, starts, idx, x) + bias, -40, 40)
        d = weight * (1 / (1 + np.exp(-z)) - label / good / weight) / len(label)
        g = np.bincount(idx, weights=np.repeat(d, np.diff(starts)) * x, minlength=BUCKETS) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.999 * vb + 0.001 * d.sum() ** 2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-7)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-7)
    return w, bias


def _code(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def learn(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", features: int = FEATURES) -> tuple[dict[int, float], tuple[np.ndarray, float], np.ndarray]:
    """(posterior by vote pattern, scorer, chance of each vote by labeller and class)."""
    spark = docs.sparkSession
    prepare(spark)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, buf, offs in t.slices(batch.column(0)):
                found += np.bincount(_code(votes(buf, offs)), minlength=len(found))
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(own), "n": pa.array(found[own])})

    # at most 3 ** 8 patterns, however many documents
    counted = docs.select(text_col).mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    code, n = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    post, chance, _ = estimate(code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, n)
    label = dict(zip(code.tolist(), post.tolist(), strict=True))
    shared = spark.sparkContext.broadcast(label)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, idx, x = [], [], []
            for _, _, buf, offs in t.slices(batch.column(1)):
                y += [shared.value[c] for c in _code(votes(buf, offs)).tolist()]
                starts, i, share = shapes(buf, offs)
                idx += [a.astype(np.int32).tobytes() for a in np.split(i, starts[1:-1])]
                x += [a.astype(np.float32).tobytes() for a in np.split(share, starts[1:-1])]
            small = pa.array([len(a) <= 4 * features for a in idx], pa.bool_())
            yield pa.RecordBatch.from_pydict({"k": batch.column(0), "y": pa.array(y, pa.float64()), "i": pa.array(idx, pa.binary()), "x": pa.array(x, pa.binary())}).filter(small)

    share = min(1.0, sample / max(1, int(n.sum())))
    key = F.xxhash64("doc_id", text_col) if "doc_id" in docs.columns else F.xxhash64(text_col)
    some = docs.select(key.alias("k"), text_col).where(F.pmod(F.col("k"), F.lit(1 << 40)) < int(share * (1 << 40))).dropDuplicates(["k"])
    got = some.mapInArrow(gather, "k long, y double, i binary, x binary").orderBy("k", "y", "i").toArrow()
    lists = [np.frombuffer(v.as_py(), np.int32).astype(np.int64) for v in got.column("i")]
    starts = np.concatenate([[0], np.cumsum([len(a) for a in lists])]).astype(np.int64)
    x = np.concatenate([np.zeros(0), *(np.frombuffer(v.as_py(), np.float32) for v in got.column("x"))])
    return label, fit(starts, np.concatenate([np.zeros(0, np.int64), *lists]), x, got.column("y").to_numpy()), chance


def judged(docs: DataFrame, model: tuple, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with n_good, n_bad (votes), weak_label (the pattern's posterior), score and keep."""
    label, (w, bias), _ = model
    shared = docs.sparkSession.sparkContext.broadcast((label, w.astype(np.float32), bias))
    own = others(docs, ("n_good", "n_bad", "weak_label", "score", "keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, w, bias = shared.value
        for batch in batches:
            good, bad, weak, score = [], [], [], []
            for _, _, buf, offs in t.slices(batch.column(text_col)):
                v = votes(buf, offs)
                good += (v == GOOD).sum(axis=1).tolist()
                bad += (v == BAD).sum(axis=1).tolist()
                weak += [label.get(c, 0.5) for c in _code(v).tolist()]
                score += (1 / (1 + np.exp(-np.clip(dot(w, *shapes(buf, offs)) + bias, -40, 40)))).tolist()
            cols = {c: batch.column(c) for c in own}
            cols |= {"n_good": pa.array(good, pa.int64()), "n_bad": pa.array(bad, pa.int64()), "weak_label": pa.array(weak, pa.float64()), "score": pa.array(score, pa.float64()), "keep": pa.array(np.array(score) >= threshold, pa.bool_())}
            yield pa.RecordBatch.from_pydict(cols)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema]
    return docs.select(*own).mapInArrow(run, ", ".join([*kinds, "n_good long, n_bad long, weak_label double, score double, keep boolean"]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, learn(docs)).select("doc_id", "n_good", "n_bad", "weak_label", "score", "keep")
