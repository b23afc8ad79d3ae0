"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  An n-gram of letters binds its
letters' vectors, each rotated by its place (here three letters; a run of other
characters is one blank letter).  A document bundles its n-grams' vectors, a
language the unit vectors of its training documents; a document gets the language
whose prototype has the largest cosine (ties: the smaller name).

Prototypes are learned from at most ``per_language`` documents of each language,
picked by a hash of the id; everything else covers all rows.  A null text, or one
without letters, is ``und`` with score 0, as is every row where nothing could be
learned.  A null lang or id takes no part in learning; rows with one id are learned
from and judged each by its own text.  Texts are judged whole, of any length.
Columns that come along keep their names, but for those that results replace, whatever
their case.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .runtime import others, prepare, table, tidied

DIM, LETTERS, SEED, PER_LANGUAGE = 512, 48, 20_241, 4_000
#: Bytes of text whose triples are counted at once.
SLICE = 1 << 19


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


@lru_cache(1)
def _letters() -> np.ndarray:
    """The letter number of each code point: 0 for what is no letter, a-z by themselves, others by hash; case is ignored."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2_654_435_761 >> 7) % (LETTERS - 27)
    return out


@lru_cache(1)
def _base() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, DIM))


def vectors(code: np.ndarray) -> np.ndarray:
    """The vectors of letter triples, as rows: the bound, rotated letter vectors."""
    base = _base()
    return np.roll(base, 2, axis=1)[code // LETTERS**2] * np.roll(base, 1, axis=1)[code // LETTERS % LETTERS] * base[code % LETTERS]


def triples(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, triple number) of every letter triple of a slice; each text has a blank before and after."""
    letter = _letters()[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(at) + 2)
    code = np.zeros(len(letter) + 2 * (len(offs) - 1), dtype=np.int32)
    place = np.arange(len(letter)) + 2 * np.repeat(np.arange(len(offs) - 1), np.diff(at)) + 1
    code[place] = letter
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (rows[1:] != rows[:-1])
    code, rows = code[keep], rows[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = rows[2:] == rows[:-2]
    return rows[2:][whole], ((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:])[whole].astype(np.int64)


def encoded(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, document vectors) block by block; rows without letters have zero vectors."""
    for lo, hi, buf, offs in t.slices(texts, SLICE):
        rows, code = triples(buf, offs)
        used = np.flatnonzero(np.bincount(code, minlength=LETTERS**3))
        number = np.zeros(LETTERS**3, dtype=np.int64)
        number[used] = np.arange(len(used))
        space = vectors(used).astype(np.float32)
        step = max(1, 1_000_000 // max(1, len(used)))
        for a in range(0, hi - lo, step):
            b = min(hi - lo, a + step)
            i, j = np.searchsorted(rows, [a, b])
            counts = np.bincount((rows[i:j] - a) * len(used) + number[code[i:j]], minlength=(b - a) * len(used)).reshape(b - a, len(used))
            yield lo + a, counts.astype(np.float32) @ space if len(used) else np.zeros((b - a, DIM), np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages of the training documents and their unit prototypes, as (languages, vectors)."""
    train = docs.select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (fold() != 2))
    counts = train.groupBy("lang").count()
    share = F.broadcast(counts.select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share")))  # a row a language
    picked = train.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, v in encoded(batch.column(0)):
                own, v = langs[lo : lo + len(v)], unit(v)
                for x in set(own):
                    sums[x] = sums.get(x, 0) + v[own == x].sum(axis=0, dtype=np.float64)
        for x, v in sums.items():
            # whole numbers, so that the sum does not hang on the order of the tasks
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * DIM), "i": pa.array(np.arange(DIM)), "v": pa.array(np.rint(v * 2**20).astype(np.int64))})

    rows = picked.select("text", "lang").mapInArrow(tidied(run), "lang string, i long, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    if not len(rows):
        return [], np.zeros((0, DIM))
    wide = rows.pivot(index="lang", columns="i", values="v").sort_index()
    return list(wide.index), unit(wide.to_numpy(dtype=np.float64))


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (which replace columns of these names)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = others(docs, ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, space = shared.value
        for batch in batches:
            pred, score = [], []
            for _, v in encoded(batch.column(text_col)):
                if not len(names):
                    pred, score = pred + ["und"] * len(v), score + [0.0] * len(v)
                    continue
                cos = unit(v) @ space.T
                best = cos.argmax(axis=1)
                some = np.abs(v).sum(axis=1) > 0
                pred += [names[k] if s else "und" for k, s in zip(best, some, strict=True)]
                score += np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema]
    return docs.select(*own).mapInArrow(tidied(run), ", ".join([*kinds, "lang_pred string", "score double"]))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prepare(spark)
    out = identified(docs.select("doc_id", "text", F.coalesce(fold() == 2, F.lit(False)).alias("held_out")), prototypes(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
