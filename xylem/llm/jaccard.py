"""N-gram Jaccard join: near-duplicate documents by exact shingle similarity.

The document by n-gram incidence matrix is multiplied with its transpose in
blocks.  Column blocks hold hash ranges of n-grams; in each, only the entries
that a size-derived bound allows are stored: of a document's n-grams, ordered by
one corpus-wide order (rare first), a pair of similarity ``t`` or more must share
one of the first ``n - ceil(t n) + 1``.  Pairs gathered there accumulate their
overlap over that region, which with the sizes bounds the whole overlap; pairs
below go.  The rest accumulate their whole overlap, again as sparse products.

Copies and large groups never become all their pairs: documents with equal sets
are joined by the set's signature, then each n-gram's smallest document is
compared with the others (one pair a posting).  In postings that still hold
several components, the documents outside the largest one are multiplied with all
others, block by block: each document brings a bitmap of the parity of its n-grams'
hashes, the bits in which two differ bound the overlap, and only pairs within the
bound leave the block.  A posting of more than ``BLOCK`` documents is cut into
blocks of its own, so no task holds a hot one whole.

Words are maximal runs of non-blank bytes with A-Z lower-cased.  A document of
fewer than ``n`` words has one shingle, its whole sequence; one without words (or
null) has none and is linked with nothing.  Rows with one id and several texts
count each text.  A null id joins a component, but never names one (its own is
null, if alone).  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .components import components
from .runtime import parts, prepare, scratch, table, tidied, tidied_group, written

N, NUM, DEN = 5, 75, 100
#: Bound of the table of frequent n-grams that is broadcast, and the counts from which an n-gram is in it.
FREQUENT_MOST, FREQUENT_FROM = 1 << 18, 32
LOCAL_MOST = 1 << 16
#: Documents of one posting that meet in one block; the bits of a set's bitmap are twice its size, within these bounds.
BLOCK, BITS = 2_048, (256, 4_096)
#: Pairs of a block that are expanded at once.
PAIRS_AT_ONCE = 1 << 18


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of all shingles of a slice, repeats included."""
    buf = t.LOWER[buf]
    starts, ends, firsts = t.words(buf, offs, t.SPACED)
    h = t.word_hashes(buf, starts, ends)
    g, at = t.gram_hashes(h, firsts, n)
    rows = t.row_of(firsts, at)
    counts = np.diff(firsts)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            sg, sat = t.gram_hashes(h, firsts, k)
            pick = np.searchsorted(sat, firsts[short])
            g, rows = np.concatenate([g, sg[pick]]), np.concatenate([rows, short])
    return rows, g


def frequent(docs: DataFrame, n: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams and their counts, of all documents: a summary of bounded size from each task, summed.

    Used to order n-grams only: a count that is off costs time, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = [], [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(inv, weights=np.concatenate(sums)).astype(np.int64)
            if len(k) > LOCAL_MOST:
                top = np.argpartition(c, len(c) - LOCAL_MOST)[-LOCAL_MOST:]
                k, c = k[top], c[top]
            return k, c

        for batch in batches:
            for _, _, buf, offs in t.slices(batch.column(0)):
                k, c = np.unique(shingles(buf, offs, n)[1], return_counts=True)
                keys.append(k[c > 1])
                sums.append(c[c > 1])
                held += len(keys[-1])
                if held > 2 * LOCAL_MOST:
                    k, c = fold()
                    keys, sums, held = [k], [c], len(k)
        if keys:
            k, c = fold()
            k, c = k[c >= 3], c[c >= 3]
            for lo in range(0, len(k), 10_000):
                yield pa.RecordBatch.from_pydict({"g": pa.array(t.signed(k[lo : lo + 10_000])), "c": pa.array(c[lo : lo + 10_000])})

    counts = docs.select(text_col).mapInArrow(tidied(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT_FROM)
    rows = counts.orderBy(F.desc("c"), "g").limit(FREQUENT_MOST).toArrow()
    g = rows.column("g").to_numpy().view(np.uint64)
    order = np.argsort(g)
    return g[order], rows.column("c").to_numpy()[order]


def weights(often: np.ndarray, often_n: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The counts of frequent n-grams, 0 for others: with the hash, the corpus-wide order."""
    if not len(often) or not len(g):
        return np.zeros(len(g), dtype=np.int64)
    k = np.minimum(np.searchsorted(often, g), len(often) - 1)
    return np.where(often[k] == g, often_n[k], 0)


def profiles(docs: DataFrame, n: int, num: int, den: int, text_col: str, table_: Broadcast) -> DataFrame:
    """Per row: doc_id, n (set size), s1 and s2 (the set's signature), prefix (its first n-grams in the order; empty for a
    null id, which no pair can name, and for a set that this task has already seen under an id), bits (the set's bitmap; null
    without a prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_n = table_.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo, hi, buf, offs in t.slices(batch.column(1)):
                rows, g = shingles(buf, offs, n)
                weight = weights(often, often_n, g)
                order = np.lexsort((g, weight, rows))
                rows, g = rows[order], g[order]
                new = np.ones(len(g), dtype=bool)
                new[1:] = (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])
                rows, g = rows[new], g[new]
                size = np.bincount(rows, minlength=hi - lo).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(size)])
                mixed = t.mix(g ^ np.uint64(0x5851F42D4C957F2D))
                run1, s2 = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)]), np.zeros(hi - lo, dtype=np.uint64)
                s1 = run1[first[1:]] - run1[first[:-1]]
                has = size > 0
                if has.any():
                    s2[has] = np.bitwise_xor.reduceat(g * np.uint64(0x2545F4914F6CDD1D), first[:-1][has])
                length = np.where(has, size - (num * size + den - 1) // den + 1, 0)
                named = has & np.asarray(batch.column(0).slice(lo, hi - lo).is_valid())
                keep = []
                for i, key in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                    keep.append(bool(named[i]) and key not in seen)
                    if named[i]:
                        seen.add(key)
                if len(seen) > 200_000:
                    seen.clear()
                length = np.where(keep, length, 0)
                place = np.arange(len(g)) - first[:-1][rows]
                pre = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(t.signed(g[place < length[rows]])))
                bits = pa.array([b if k else None for b, k in zip(bitmaps(rows, g, size), keep, strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n": pa.array(size), "s1": pa.array(t.signed(s1)), "s2": pa.array(t.signed(s2)), "prefix": pre, "bits": bits})

    return docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(tidied(run), "doc_id long, n long, s1 long, s2 long, prefix array<long>, bits binary")


def bitmaps(rows: np.ndarray, g: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of each row's set: at bit k, whether an odd number of its n-grams have the hash k.  Bitmaps of other lengths compare by
    folding: the two halves' exclusive or is the bitmap of half the length."""
    wide = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * size, 2))).astype(np.int64), *BITS)
    first = np.concatenate([[0], np.cumsum(wide)])
    place = (t.mix(g ^ np.uint64(0x94D049BB133111EB)) & (wide[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[rows] + place, minlength=first[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


_ENTRY = np.dtype([("g", "<u8"), ("d", "<i8"), ("n", "<i4"), ("p", "<i4")])


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _packed(e: np.ndarray) -> bytes:
    """Entries that are sorted by document: byte planes of the columns, compressed; documents as steps from one to the next."""
    step = np.diff(e["d"], prepend=np.int64(0))
    return len(e).to_bytes(4, "little") + pa.compress(b"".join(_planes(np.ascontiguousarray(x)) for x in (e["g"], step, e["n"], e["p"])), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    whole = np.frombuffer(pa.decompress(data[4:], n * _ENTRY.itemsize, codec="zstd"), np.uint8)
    e, at = np.empty(n, _ENTRY), 0
    for name in _ENTRY.names:
        size = _ENTRY[name].itemsize
        column = np.ascontiguousarray(whole[at : at + n * size].reshape(size, n).T).view(_ENTRY[name]).ravel()
        e[name] = np.cumsum(column) if name == "d" else column
        at += n * size
    return e


def postings(profile: DataFrame, buckets: int) -> DataFrame:
    """(g, doc_id, n, place, lead, lead_n, lead_place): the stored incidence entries whose n-gram is in two documents or more.

    Entries travel as packed column blocks, one for each batch and hash range.  ``lead`` is the n-gram's smallest document.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pre = batch.column(2)
            e = np.empty(len(pre.flatten()), dtype=_ENTRY)
            size = np.diff(pre.offsets.to_numpy())
            e["g"] = pre.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            e["d"], e["n"] = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size), np.repeat(batch.column(1).to_numpy(), size)
            e["p"] = np.arange(len(e)) - np.repeat((pre.offsets.to_numpy() - pre.offsets.to_numpy()[0])[:-1], size)
            at = ((e["g"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((e["d"], at))
            e, at = e[order], at[order]
            own, first = np.unique(at, return_index=True)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own), "data": pa.array([_packed(x) for x in np.split(e, first[1:])] if len(own) else [], type=pa.binary())})

    def group(block: pa.Table) -> pa.Table:
        e = np.concatenate([_unpacked(x.as_py()) for x in block.column("data")])
        e = e[np.lexsort((e["d"], e["g"]))]
        new = np.ones(len(e), dtype=bool)
        new[1:] = e["g"][1:] != e["g"][:-1]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = np.maximum.reduceat(e["d"], first) > e["d"][first] if len(first) else np.zeros(0, dtype=bool)
        keep = several[run]
        lead = first[run[keep]]
        e, l = e[keep], e[lead]
        return pa.table({"g": t.signed(e["g"].copy()), "doc_id": e["d"].copy(), "n": e["n"].astype(np.int64), "place": e["p"].astype(np.int64), "lead": l["d"].copy(), "lead_n": l["n"].astype(np.int64), "lead_place": l["p"].astype(np.int64)})

    packed = profile.where("size(prefix) > 0 and doc_id is not null").select("doc_id", "n", "prefix").mapInArrow(tidied(pack), "bucket long, data binary")
    return packed.groupBy("bucket").applyInArrow(tidied_group(group), "g long, doc_id long, n long, place long, lead long, lead_n long, lead_place long")


def _close(a: str, b: str, num: int, den: int):
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def _placed(a: str, b: str, pa: str, pb: str, num: int, den: int):
    """Whether sets of a and b n-grams that share the one at these places of theirs can be similar: before it, they share at
    most the shorter way, after it the shorter rest."""
    most = F.least(pa, pb) + 1 + F.least(F.col(a) - F.col(pa) - 1, F.col(b) - F.col(pb) - 1)
    return _close(a, b, num, den) & (most * den >= num * (F.col(a) + F.col(b) - most))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The overlap count of each pair of sets: entries of both sides as (pair, n-gram), of which those met twice count."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    pair = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)])
    g = np.concatenate([*a, *b]) if len(a) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((g, pair))
    pair, g = pair[order], g[order]
    twice = (g[1:] == g[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][twice], minlength=len(a))


def _lists(col: pa.Array) -> list[np.ndarray]:
    flat, offs = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return np.split(flat, (offs - offs[0])[1:-1]) if len(col) else []


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, order: Broadcast | None = None) -> DataFrame:
    """The pairs (a, b) that ``sets`` (doc_id, n, grams) prove.  With ``order``, grams are only the first of each set in that
    order, and the pairs that they can't disprove are returned."""

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(np.diff(batch.column("ga").offsets.to_numpy()) + np.diff(batch.column("gb").offsets.to_numpy()))
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 18), side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                ga, gb = _lists(batch.column("ga")), _lists(batch.column("gb"))
                most = overlaps(ga, gb)
                if order is not None:
                    most = most + np.minimum(*_beyond(ga, gb, na, nb, *order.value))
                ok = pa.array(den * most >= num * (na + nb - most))
                yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)})

    left, right = (sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(tidied(run), "a long, b long")


def _beyond(ga: list, gb: list, na: np.ndarray, nb: np.ndarray, often: np.ndarray, often_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams of each set lie beyond the nearer end of the two prefixes.

    Up to that end, both sets are known, so their overlap is; beyond, it is at most the smaller of these numbers.
    """
    out = []
    for mine, theirs, size in ((ga, gb, na), (gb, ga, nb)):
        g = np.concatenate(mine).view(np.uint64)
        w = weights(often, often_n, g)
        end = np.array([x[-1] for x in theirs]).view(np.uint64)
        end_w = weights(often, often_n, end)
        count = np.array([len(x) for x in mine])
        pair = np.repeat(np.arange(len(mine)), count)
        known = (w < end_w[pair]) | (w == end_w[pair]) & (g <= end[pair])
        out.append(size - np.bincount(pair[known], minlength=len(mine)))
    return out[0], out[1]


def crossing(entries: DataFrame, bits: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of different roots that share an n-gram of ``entries`` (g, id, n, place, root) and that neither
    places, bitmaps nor the number of shared entries disprove.  ``bits`` has the bitmap of each (id, n)."""
    sizes = entries.groupBy("g", "root").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("main"))
    sizes = sizes.where("main.c < m").select("g", F.ceil(F.col("m") / block).cast("int").alias("across"), F.ceil((F.col("m") - F.col("main.c")) / block).cast("int").alias("down"), F.col("main.root").alias("main"))
    mixed = written(entries.join(sizes, "g").withColumn("out", F.col("root") != F.col("main")).drop("main").join(bits, ["id", "n"]))
    buckets = parts(mixed, 2 << 20)
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    own = ["g", "id", "n", "place", "root", "out", "bits"]
    # a posting of one block is dealt with others of its bucket, its outsiders on both sides of the product (x and y)
    small = mixed.where("across = 1").select(*own, F.col("out").alias("x"), F.lit(True).alias("y"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.pmod(F.shiftright("g", 20), F.lit(buckets)).alias("key"))
    large = mixed.where("across > 1").withColumns({"i": deal("down", 1), "j": deal("across", 2)})
    rows = large.where("out").select(*own, F.lit(True).alias("x"), F.lit(False).alias("y"), "i", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    columns = large.select(*own, F.lit(False).alias("x"), F.lit(True).alias("y"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), "j")
    large = rows.union(columns).withColumn("key", F.xxhash64("g", "i", "j"))

    def product(part: pa.Table) -> pa.Table:
        g, i, j, a, n, place, root = (part.column(c).to_numpy() for c in ("g", "i", "j", "id", "n", "place", "root"))
        order = np.lexsort((j, i, g))
        new = np.ones(len(g), bool)
        new[1:] = (g[order][1:] != g[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])
        group = np.cumsum(new) - 1
        is_x, is_y, out = (part.column(c).to_numpy(zero_copy_only=False)[order] for c in ("x", "y", "out"))
        a, n, place, root = a[order], n[order], place[order], root[order]
        maps = Bitmaps(part.column("bits").take(pa.array(order)))
        xs, ys = np.flatnonzero(is_x), np.flatnonzero(is_y)
        first = np.searchsorted(group[ys], np.arange(group[-1] + 2))
        count = np.diff(first)[group[xs]]
        ends = np.cumsum(count)
        found, lo = [], 0
        while lo < len(xs):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            own, many = xs[lo:hi], count[lo:hi]
            x = np.repeat(own, many)
            y = ys[np.repeat(first[group[own]] - (np.cumsum(many) - many), many) + np.arange(len(x))]
            ok = (root[x] != root[y]) & (~out[y] | (a[x] < a[y]))
            x, y = x[ok], y[ok]
            most = np.minimum(place[x], place[y]) + 1 + np.minimum(n[x] - place[x], n[y] - place[y]) - 1
            ok = (n[x] * den >= n[y] * num) & (n[y] * den >= n[x] * num) & (most * den >= num * (n[x] + n[y] - most))
            x, y = x[ok], y[ok]
            most = (n[x] + n[y] - maps.apart(x, y)) // 2
            ok = most * den >= num * (n[x] + n[y] - most)
            x, y = x[ok], y[ok]
            x, y = np.where(a[x] < a[y], x, y), np.where(a[x] < a[y], y, x)
            found.append(np.stack([a[x], a[y], n[x], n[y]], axis=1))
            lo = hi
        pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "na": pairs[:, 2], "nb": pairs[:, 3], "o": times})

    made = small.union(large.select(small.columns)).groupBy("key").applyInArrow(tidied_group(product), "a long, b long, na long, nb long, o long")
    # a pair's entries are all that their prefixes share (a pair that loses one by its places can't be similar), so with
    # the sizes their number bounds the whole overlap
    left_over = "{0} - ({0} - (({num} * {0} + {den} - 1) div {den}) + 1)"
    most = f"(o + greatest({left_over.format('na', num=num, den=den)}, {left_over.format('nb', num=num, den=den)}))"
    return made.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).where(f"{den} * {most} >= {num} * (na + nb - {most})").select("a", "b").distinct()


class Bitmaps:
    """The bitmaps of a block's rows, as words, at their own length and folded to all shorter ones."""

    def __init__(self, bits: pa.ChunkedArray | pa.Array) -> None:
        raw = [x.as_py() for x in bits]
        self.wide = np.array([len(x) // 8 for x in raw], np.int64)
        self.at, self.words = {}, {}
        upper = None
        for w in sorted(set(2 ** np.arange(BITS[0].bit_length() - 7, BITS[1].bit_length() - 6)), reverse=True):
            own = np.flatnonzero(self.wide == w)
            words = np.frombuffer(b"".join(raw[k] for k in own), np.uint64).reshape(-1, w)
            if upper is not None:
                rows, higher = upper
                own, words = np.concatenate([rows, own]), np.concatenate([higher[:, :w] ^ higher[:, w:], words])
            self.at[int(w)] = np.full(len(raw), -1, np.int64)
            self.at[int(w)][own] = np.arange(len(own))
            self.words[int(w)], upper = words, (own, words)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the shorter-folded bitmaps of the rows x and y differ: at most so many n-grams are in one set only."""
        out = np.zeros(len(x), np.int64)
        wide = np.minimum(self.wide[x], self.wide[y])
        for w, words in self.words.items():
            own = np.flatnonzero(wide == w)
            for lo in range(0, len(own), 1 << 16):
                k = own[lo : lo + (1 << 16)]
                out[k] = np.bitwise_count(words[self.at[w][x[k]]] ^ words[self.at[w][y[k]]]).sum(axis=1)
        return out


def near_duplicates(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links of ``num/den`` or more)."""
    if not 0 < num <= den:
        raise ValueError("the similarity must be in (0, 1]")
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        return written(_components(docs, n, num, den, text_col), keep=True)


def _components(docs: DataFrame, n: int, num: int, den: int, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent(docs, n, text_col))
    profile = written(profiles(docs, n, num, den, text_col, order))
    named = profile.where("n > 0 and doc_id is not null")
    # of each set: its smallest document, and the smallest that has its prefix along, which stands for it below
    copies = written(named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.expr("min(doc_id) filter (where size(prefix) > 0)").alias("node")))
    pre = named.where("size(prefix) > 0").select("doc_id", "n", F.col("prefix").alias("grams"))
    of = written(named.where("size(prefix) > 0").select("doc_id", "s1", "s2", "n").join(copies, ["s1", "s2", "n"]).select("doc_id", "n", "node").distinct())
    post = written(postings(profile, parts(profile, 2 << 20)))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, buf, offs in t.slices(batch.column(1)):
                    rows, g = shingles(buf, offs, n)
                    order = np.lexsort((g, rows))
                    rows, g = rows[order], g[order]
                    new = np.ones(len(g), dtype=bool)
                    new[1:] = (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])
                    rows, g = rows[new], g[new]
                    size = np.bincount(rows, minlength=hi - lo).astype(np.int64)
                    grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(t.signed(g)))
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n": pa.array(size), "grams": grams})

        return whole.mapInArrow(tidied(run), "doc_id long, n long, grams array<long>")

    def links(candidates: DataFrame) -> DataFrame:
        """Of candidate pairs (a < b), those of the wanted similarity."""
        maybe = written(verified(candidates, pre, num, den, order).distinct())
        return written(verified(maybe, texts_of(maybe), num, den).distinct())

    star = post.where((F.col("doc_id") != F.col("lead")) & _placed("n", "lead_n", "place", "lead_place", num, den)).select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = written(_apart(star, of))
    found = links(star)
    label = components(found)
    # what the stars have not joined: postings with several components, those outside the largest by all others
    entries = post.select("g", "doc_id", "n", "place").join(of, ["doc_id", "n"]).select("g", F.col("node").alias("id"), "n", "place").distinct().join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
    bits = profile.where("bits is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "bits").distinct()
    rest = crossing(written(entries), bits, num, den)
    more = links(rest.join(star, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        label = components(found.union(more))
    sets = copies.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = sets.groupBy("root").agg(F.min("rep").alias("component_id"))
    sets = written(sets.join(smallest, "root").select("s1", "s2", F.col("n").alias("n_shingles"), "component_id"))
    out = profile.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(sets, ["s1", "s2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs between different sets, each by its node."""
    ra, rb = of.select(F.col("doc_id").alias("a"), F.col("node").alias("ra")), of.select(F.col("doc_id").alias("b"), F.col("node").alias("rb"))
    return pairs.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(root) FROM r WHERE r.id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
