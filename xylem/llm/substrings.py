"""Substring dedup: remove passages that an earlier document already has.

Documents are parsed relative to all earlier ones (smaller ids), Lempel-Ziv
style: a document is a sequence of factors, each a longest run of words that
continues at one place of one reference document.  Reference text lies in blocks;
the index of their passages is cut by hash range into shards, each of which
answers for every reference block, so a document is parsed against all of them.

1. Each block names the minimizers of its passages (the least of the 7-word
   hashes in each window of ``n`` words); shards tell which occur in two documents.
2. Each block names its windows with such a minimizer, each once, with their
   smallest document and place; shards tell the smallest of all.
3. Each block parses its documents greedily by these answers: a factor starts at
   the first window that an earlier document has, and goes on while that reference
   does; the next one is looked for behind it.  At a factor's end, the windows that
   start in it and reach over its boundary are checked: those with a reference of
   their own make a factor that overlaps.  The words of all factors are removed.

A block names a hash once however many of its documents hold it, so a passage in
a third of all rows costs a shard one entry a block.  Windows are compared by 96
bits.  Words are maximal runs of non-blank bytes, unchanged.

A factor's reference is the earliest document that has its first window, not the
longest match among all: which words are removed is the same, as every window with
an earlier document is in a factor or reaches over the end of one.

Texts may be of any length; columns besides the id and the text are not read.
Nulls: a null text has no words; a null id is neither earlier nor later than any
(nothing is removed from it or for it).  Rows with one id do not remove from each
other.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .runtime import parts, prepare, table, tasks, tidied, tidied_group

WINDOW = 13
SEED = 7
U = np.uint64
_NULL = np.iinfo(np.int64).min


def _window_hashes(h: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: 64-bit hash, 32 further bits, minimizer, first word."""
    g, at = t.gram_hashes(h, firsts, n)
    check, _ = t.gram_hashes(t.mix(h ^ U(0x243F6A8885A308D3)), firsts, n)
    k = min(SEED, n)
    seeds = np.full(len(h), ~U(0), dtype=U)
    s, s_at = t.gram_hashes(h, firsts, k)
    seeds[s_at] = s
    least = seeds.copy()
    for i in range(1, n - k + 1):
        np.minimum(least[: len(h) - i], seeds[i:], out=least[: len(h) - i])
    return g, (check >> U(32)).astype(np.uint32), least[at], at


def _docs(col: pa.Array) -> np.ndarray:
    return col.fill_null(_NULL).to_numpy(zero_copy_only=False)


def _scan(ids: np.ndarray, texts: pa.Array, n: int):
    for lo, hi, buf, offs in t.slices(texts):
        starts, ends, firsts = t.words(buf, offs, t.SPACED)
        g, c, m, at = _window_hashes(t.word_hashes(buf, starts, ends), firsts, n)
        rows = t.row_of(firsts, at)
        yield lo, buf, offs, starts, ends, firsts, g, c, m, at, rows, ids[lo:hi]


def _pack(cols: list[np.ndarray]) -> bytes:
    return b"".join([np.int64(len(cols[0])).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in cols)])


def _unpack(data: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, dtype=np.int64, count=1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, dtype=k, count=n, offset=at))
        at += n * np.dtype(k).itemsize
    return out


def _shards(h: np.ndarray, cols: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    at = ((h >> U(24)) % U(shards)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    own, first = np.unique(at[order], return_index=True)
    for k, rows in zip(own.tolist(), np.split(order, first[1:]), strict=True) if len(own) else ():
        yield k, _pack([c[rows] for c in cols])


_ENTRY = [np.uint64, np.uint32, np.int64, np.int64, np.int32]  # hash, check, smallest document, largest, place in the smallest


def _least(g, c, lo, hi, pos) -> list[np.ndarray]:
    """One entry for each window: smallest document and its first place, largest document."""
    order = np.lexsort((pos, lo, c, g))
    g, c, lo, hi, pos = g[order], c[order], lo[order], hi[order], pos[order]
    if not len(g):
        return [g, c, lo, hi, pos]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
    return [g[first], c[first], lo[first], np.maximum.reduceat(hi, first), pos[first]]


def factors(at: np.ndarray, row: np.ndarray, src: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, end words) of the factors, of the windows (by first word) that have a reference ``src`` at ``place``.

    A run of windows whose references are the next places of one document is one match.  In the greedy order, a match
    that starts in a factor counts only if it reaches over that factor's end."""
    if not len(at):
        return at, at
    a, b = slice(None, -1), slice(1, None)
    head = np.ones(len(at), bool)
    head[1:] = (at[b] != at[a] + 1) | (row[b] != row[a]) | (src[b] != src[a]) | (place[b] != place[a] + 1)
    first = np.flatnonzero(head)
    begin, end = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1] + n
    beyond = np.ones(len(begin), bool)
    beyond[1:] = end[1:] > np.maximum.accumulate(end)[:-1]
    return begin[beyond], end[beyond]


def parsed(docs: DataFrame, n: int = WINDOW, text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, n_factors, kept_sha256; with ``texts``, also kept (its kept words, joined by a space)."""
    prepare(docs.sparkSession)
    blocks = parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(tasks(blocks), "block")

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, block, minimizers of the block and whether two of its documents hold each)."""
        held: dict[int, list] = defaultdict(list)

        def flush() -> Iterator[pa.RecordBatch]:
            for b, got in held.items():
                m = np.sort(np.concatenate(got))  # a minimizer comes once for each document
                u, count = np.unique(m, return_counts=True)
                shard, data = zip(*_shards(u, [u, count > 1], blocks), strict=True) if len(u) else ((), ())
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "block": pa.array([b] * len(shard), pa.int64()), "data": pa.array(data, pa.binary())})
            held.clear()

        size = 0
        for batch in batches:
            block, ids = batch.column("block").to_numpy(), _docs(batch.column("doc_id"))
            for lo, _, _, _, _, _, _, _, m, _, r, _ in _scan(ids, batch.column("text"), n):
                key = np.lexsort((m, r))
                r, m = r[key], m[key]
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (m[1:] != m[:-1])]) if len(r) else np.zeros(0, bool)
                r, m = r[new], m[new]
                own = block[lo + r]
                for b in np.unique(own):
                    held[int(b)].append(m[own == b])
                size += len(m)
            if size > 8_000_000:
                yield from flush()
                size = 0
        yield from flush()

    def recurring(part: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py(), [np.uint64, np.bool_]) for x in part.column("data")]
        blk = np.repeat(part.column("block").to_numpy(), [len(x[0]) for x in got])
        m, several = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        u, inv, count = np.unique(m, return_inverse=True, return_counts=True)
        keep = (count > 1) | (np.bincount(inv, weights=several) > 0)
        sel = keep[inv]
        return _answers(blk[sel], [m[sel]])

    def _answers(blk: np.ndarray, cols: list[np.ndarray]) -> pa.Table:
        order = np.argsort(blk, kind="stable")
        own, first = np.unique(blk[order], return_index=True)
        data = [_pack([c[r] for c in cols]) for r in np.split(order, first[1:])] if len(own) else []
        return pa.table({"block": pa.array(own, pa.int64()), "data": pa.array(data, pa.binary())})

    def windows(text: pa.Table, told: pa.Table) -> pa.Table:
        """(shard, block, entries of the block's windows whose minimizer recurs)."""
        known = np.sort(np.concatenate([np.zeros(0, U), *(_unpack(x.as_py(), [np.uint64])[0] for x in told.column("data"))]))
        out, block = [], text.column("block")[0].as_py() if len(text) else 0
        if len(known) and len(text):
            ids = _docs(text.column("doc_id").combine_chunks())
            for _, _, _, _, _, firsts, g, c, m, at, r, own in _scan(ids, text.column("text"), n):
                k = np.minimum(np.searchsorted(known, m), len(known) - 1)
                sel = (known[k] == m) & (own[r] != _NULL)
                d = own[r[sel]]
                out.append(_least(g[sel], c[sel], d, d, (at - firsts[r])[sel].astype(np.int32)))
        cols = _least(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else [np.zeros(0, k) for k in _ENTRY]
        shard, data = zip(*_shards(cols[0], cols, blocks), strict=True) if len(cols[0]) else ((), ())
        return pa.table({"shard": pa.array(shard, pa.int64()), "block": pa.array([block] * len(shard), pa.int64()), "data": pa.array(data, pa.binary())})

    def smallest(part: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py(), _ENTRY) for x in part.column("data")]
        blk = np.repeat(part.column("block").to_numpy(), [len(x[0]) for x in got])
        g, c, lo, hi, pos = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((pos, lo, c, g))
        g, c, lo, hi, pos, blk = g[order], c[order], lo[order], hi[order], pos[order], blk[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        sel = lo[lead] < hi  # some document of the block is later than the smallest
        return _answers(blk[sel], [g[sel], c[sel], lo[lead][sel], pos[lead][sel]])

    def parse(text: pa.Table, told: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py(), [np.uint64, np.uint32, np.int64, np.int32]) for x in told.column("data")]
        g0, c0, d0, p0 = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, k) for k in (np.uint64, np.uint32, np.int64, np.int32)]
        order = np.lexsort((c0, g0))
        g0, c0, d0, p0 = g0[order], c0[order], d0[order], p0[order]
        ids = _docs(text.column("doc_id").combine_chunks()) if len(text) else np.zeros(0, np.int64)
        total, removed, many, sha, kept = [], [], [], [], []
        for _, buf, offs, starts, ends, firsts, g, c, _, at, r, own in _scan(ids, text.column("text"), n):
            src, place = np.full(len(g), -1, np.int64), np.full(len(g), -1, np.int64)
            if len(g0) and len(g):
                k = np.searchsorted(g0, g)
                left = np.arange(len(g))
                found = np.zeros(len(g), bool)
                while len(left):  # windows whose 64 bits collide lie next to each other
                    kk = k[left]
                    left = left[(kk < len(g0)) & (g0[np.minimum(kk, len(g0) - 1)] == g[left])]
                    hit = left[c0[k[left]] == c[left]]
                    found[hit], src[hit], place[hit] = True, d0[k[hit]], p0[k[hit]]
                    left = left[c0[k[left]] != c[left]]
                    k[left] += 1
                found &= (src < own[r]) & (own[r] != _NULL)
            else:
                found = np.zeros(len(g), bool)
            hit = np.flatnonzero(found)
            begin, end = factors(at[hit], r[hit], src[hit], place[hit], n)
            heads = np.bincount(t.row_of(firsts, begin), minlength=len(own))
            edge = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(end, minlength=len(starts) + 1)
            gone = np.cumsum(edge)[: len(starts)] > 0
            run = np.concatenate([[0], np.cumsum(gone)])
            count, lost = np.diff(firsts), run[firsts[1:]] - run[firsts[:-1]]
            raw = buf.tobytes()
            for i in range(len(own)):
                if lost[i]:
                    words = [raw[starts[j] : ends[j]] for j in (firsts[i] + np.flatnonzero(~gone[firsts[i] : firsts[i + 1]]))]
                else:
                    words = raw[offs[i] : offs[i + 1]].split()
                rest = b" ".join(words)
                sha.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest.decode())
            total.append(count)
            removed.append(lost)
            many.append(heads)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        out = {"doc_id": text.column("doc_id"), "n_words": cat(total), "n_removed": cat(removed), "n_factors": cat(many), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    named, answer = "shard long, block long, data binary", "block long, data binary"
    told = rows.mapInArrow(tidied(minimizers), named).groupBy("shard").applyInArrow(tidied_group(recurring), answer)
    told = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidied_group(windows), named).groupBy("shard").applyInArrow(tidied_group(smallest), answer)
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidied_group(parse), "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string" + ", kept string" * texts)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM x JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda e: NOT list_contains(gone, e[2])), lambda e: e[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
