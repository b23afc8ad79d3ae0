"""Benchmark decontamination: find passages of test items in training documents.

A word is a maximal run of digits, letters and non-ASCII characters of the text
with A-Z lower-cased.  A window is ``n`` consecutive words of an item; an item of
fewer words (but some) is one window.  A document word inside any occurrence of
a window is hit.

The windows' hashes are broadcast where the benchmark's measured bytes are
within ``max_broadcast_bytes``.  Beyond that, a bit table of at most so many bytes is
broadcast, which nearly all windows of the documents fail; those that pass meet the
benchmark's windows in a join on hash and words, and each row's hits come back to
it.  Either way hits are verified on the words, so collisions never count.

Nulls: a null text has no words and is never hit; an item without an id is scanned
for, but not listed; one without a text is no item.  Texts may be of any length.
Empty tables give empty results (no items: nothing is hit).  Rows with a repeated id
are judged apart.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .runtime import others, prepare, table, tidied, written

WINDOW = 13
U = np.uint64


class WindowIndex:
    """Sorted window hashes by window length, each with its words and the items that hold it."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW) -> None:
        found: dict[int, dict[bytes, set]] = {}
        for item, text in items:
            w = split_words(text)
            if w:
                k = min(n, len(w))
                own = found.setdefault(k, {})
                for i in range(len(w) - k + 1):
                    own.setdefault(b" ".join(w[i : i + k]), set()).update([] if item is None else [str(item)])
        self.tables = {}
        for k, own in found.items():
            keys = list(own)
            buf = np.frombuffer(b" ".join(keys), dtype=np.uint8)
            lens = np.array([len(x) + 1 for x in keys], dtype=np.int64)
            offs = np.concatenate([[0], np.cumsum(lens)])
            offs[-1] = len(buf)
            starts, ends, firsts = t.words(buf, offs, t.ALNUM)
            g, _ = t.gram_hashes(t.word_hashes(buf, starts, ends), firsts, k)
            by: dict[int, list] = {}
            for h, key in zip(g.tolist(), keys, strict=True):
                by.setdefault(h, []).append((key, sorted(own[key])))
            self.tables[k] = (np.sort(np.array(list(by), dtype=np.uint64)), by)


def split_words(text: str | None) -> list[bytes]:
    buf = t.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends, _ = t.words(buf, np.array([0, len(buf)]), t.ALNUM)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _known(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions in h whose hash is in the table; a small bit table first, as nearly all are not."""
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(sorted_hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
    if not len(at):
        return at
    k = np.searchsorted(sorted_hashes, h[at])
    k[k == len(sorted_hashes)] = 0
    return at[sorted_hashes[k] == h[at]]


def scan(index: WindowIndex, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]]:
    """For each slice: words a row, hit words a row, the hit mask over the slice's words, items a row."""
    for lo, hi, buf, offs in t.slices(texts):
        buf = t.LOWER[buf]
        starts, ends, firsts = t.words(buf, offs, t.ALNUM)
        h = t.word_hashes(buf, starts, ends)
        edge = np.zeros(len(starts) + 2, dtype=np.int64)
        items: list[set] = [set() for _ in range(hi - lo)]
        for k, (hashes, by) in index.tables.items():
            g, at = t.gram_hashes(h, firsts, k)
            for j in _known(hashes, g):
                a = int(at[j])
                seen = b" ".join(buf[starts[i] : ends[i]].tobytes() for i in range(a, a + k))
                for key, held in by[int(g[j])]:
                    if key == seen:
                        edge[a] += 1
                        edge[a + k] -= 1
                        items[int(t.row_of(firsts, np.array([a]))[0])].update(held)
        mask = np.cumsum(edge)[: len(starts)] > 0
        total = np.concatenate([[0], np.cumsum(mask)])
        yield np.diff(firsts), total[firsts[1:]] - total[firsts[:-1]], mask, items


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = WINDOW, max_broadcast_bytes: int = 8 << 20, share: int = 20,
                  text_col: str = "text", item_col: str = "item_id", keep_columns: bool = False, remove_spans: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted ids as strings), contaminated (a 1/share-th of its words or more are hit).

    With ``keep_columns`` all input columns come along (``contaminated`` and the others replace clashing names); with
    ``remove_spans`` too, hit words are cut from the text of each document.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = bench.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    if size > max_broadcast_bytes:
        return _large(docs, bench, n, max_broadcast_bytes, share, text_col, item_col, keep_columns, remove_spans)
    index = spark.sparkContext.broadcast(pickle.dumps(WindowIndex([(r[0], r[1]) for r in bench.select(item_col, text_col).toLocalIterator()], n)))
    added = ("n_words", "n_hit", "items", "contaminated")
    own = others(docs, added) if keep_columns else ["doc_id"]
    out = docs.select(*own, *([] if text_col in own else [text_col])).schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in out if f.name in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = pickle.loads(index.value)
        for batch in batches:
            texts = batch.column(text_col)
            counts, hits, items, cut, row = [], [], [], [], 0
            for w, hit, mask, its in scan(windows, texts):
                counts.append(w)
                hits.append(hit)
                items += [sorted(x) for x in its]
                if remove_spans:
                    first = np.concatenate([[0], np.cumsum(w)])
                    cut += [cut_words(texts[row + i].as_py(), mask[first[i] : first[i + 1]]) if hit[i] else texts[row + i].as_py() for i in range(len(w))]
                row += len(w)
            w = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            hit = np.concatenate(hits) if hits else np.zeros(0, dtype=np.int64)
            cols = {c: batch.column(c) for c in own}
            if remove_spans:
                cols[text_col] = pa.array(cut, type=pa.string())
            cols |= {"n_words": pa.array(w, type=pa.int64()), "n_hit": pa.array(hit, type=pa.int64()),
                     "items": pa.array(items, type=pa.list_(pa.string())), "contaminated": pa.array((hit > 0) & (share * hit >= w))}
            yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join([*kinds, "n_words long", "n_hit long", "items array<string>", "contaminated boolean"])
    return docs.select(*dict.fromkeys([*own, text_col])).mapInArrow(tidied(run), schema)


def cut_words(text: str | None, mask: np.ndarray) -> str | None:
    """The text without the masked words."""
    if text is None:
        return None
    raw = text.encode()
    buf = t.LOWER[np.frombuffer(raw, dtype=np.uint8)]
    starts, ends, _ = t.words(buf, np.array([0, len(buf)]), t.ALNUM)
    out, at = [], 0
    for i in np.flatnonzero(mask):
        out.append(raw[at : starts[i]])
        at = ends[i]
    return b"".join([*out, raw[at:]]).decode()


def _windows(texts: pa.Array, sizes: list[int] | None, n: int, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first word, words of it, hash, text) of windows: of benchmark items (``sizes`` None: ``n`` words, or all of a
    shorter item), or of documents for each of the sizes, where the bit table may have them."""
    for lo, hi, buf, offs in t.slices(texts):
        buf = t.LOWER[buf]
        starts, ends, firsts = t.words(buf, offs, t.ALNUM)
        h, count = t.word_hashes(buf, starts, ends), np.diff(firsts)
        for k in sorted({min(n, c) for c in count.tolist() if c}) if sizes is None else sizes:
            g, at = t.gram_hashes(h, firsts, k)
            row = t.row_of(firsts, at)
            keep = (k == n) | (count[row] == k) if sizes is None else (bits[(g >> U(6)) % U(len(bits))] >> (g & U(63))) & U(1) == 1
            keep = np.broadcast_to(keep, g.shape)
            g, at, row = g[keep], at[keep], row[keep]
            text = [b" ".join(buf[starts[i] : ends[i]].tobytes() for i in range(a, a + k)).decode() for a in at.tolist()]
            yield lo + row, at - firsts[row], np.full(len(g), k), g, text


def _large(docs: DataFrame, bench: DataFrame, n: int, bound: int, share: int, text_col: str, item_col: str, keep_columns: bool, remove_spans: bool) -> DataFrame:
    """The same for benchmarks that are too large to broadcast: windows meet in a join."""
    spark = docs.sparkSession
    words = max(1, bound // 8)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, k, g, text in _windows(batch.column(1), None, n, None):
                yield pa.RecordBatch.from_pydict({"k": pa.array(k.astype(np.int32)), "g": pa.array(t.signed(g)), "words": pa.array(text, pa.string()), "item": batch.column(0).take(pa.array(row))})

    known = written(bench.select(F.col(item_col).cast("string").alias("item"), text_col).mapInArrow(index, "k int, g long, words string, item string").distinct())
    sizes = sorted(r[0] for r in known.select("k").distinct().collect())  # at most n
    # the table's words by their number: at most ``bound`` bytes, however large the benchmark
    place = F.pmod(F.shiftrightunsigned("g", 6), F.lit(words))
    rows = known.select(place.alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("g").bitwiseAND(63).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(words, U)
    bits[rows.column("i").to_numpy()] = rows.column("b").to_numpy().view(U)
    shared = spark.sparkContext.broadcast(bits)
    own = others(docs, ("n_words", "n_hit", "items", "contaminated")) if keep_columns else ["doc_id"]
    numbered = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))

    def scan_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, k, g, text in _windows(batch.column(1), sizes, n, shared.value):
                yield pa.RecordBatch.from_pydict({"row": batch.column(0).take(pa.array(row)), "at": pa.array(at), "k": pa.array(k.astype(np.int32)), "g": pa.array(t.signed(g)), "words": pa.array(text, pa.string())})

    hits = written(numbered.select("row", "text").mapInArrow(scan_, "row long, at long, k int, g long, words string").join(known, ["k", "g", "words"]).select("row", "at", "k", "item"))
    spans = hits.select("row", "at", "k").distinct().groupBy("row").agg(F.collect_list(F.struct("at", "k")).alias("spans"))
    items = hits.where("item is not null").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = numbered.join(spans, "row", "left").join(items, "row", "left").select("own", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<at:bigint,k:int>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    kind = both.select("own").schema[0].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hit, cut = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = text.as_py()
                buf = t.LOWER[np.frombuffer((whole or "").encode(), np.uint8)]
                count = len(t.words(buf, np.array([0, len(buf)]), t.ALNUM)[0])
                edge = np.zeros(count + 1, np.int64)
                for x in found:
                    edge[x["at"]] += 1
                    edge[x["at"] + x["k"]] -= 1
                mask = np.cumsum(edge)[:count] > 0
                total.append(count)
                hit.append(int(mask.sum()))
                cut.append(cut_words(whole, mask) if remove_spans and hit[-1] else whole)
            w, x = np.array(total, np.int64), np.array(hit, np.int64)
            yield pa.RecordBatch.from_pydict({"own": batch.column(0), "text": pa.array(cut, pa.string()), "n_words": pa.array(w), "n_hit": pa.array(x), "items": batch.column(3), "contaminated": pa.array((x > 0) & (share * x >= w))})

    out = both.mapInArrow(tidied(finish), f"own {kind}, text string, n_words long, n_hit long, items array<string>, contaminated boolean")
    first = [(F.col("text") if remove_spans and c == text_col else F.col(f"own.`{c}`")).alias(c) for c in own]
    first += [F.col("text").alias(text_col)] if remove_spans and text_col not in own else []
    return out.select(*first, "n_words", "n_hit", "items", "contaminated")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS x FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
