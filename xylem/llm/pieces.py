"""SentencePiece encoding and decoding on a relational lattice.

A text (a blank is put before it) is cut into words wherever no piece holds the
two characters on both sides of the cut, so no piece can span it.  Each distinct
word of the corpus is segmented once: its substrings up to the longest piece's
length are exploded and equi-joined to the piece table, the edges found are
grouped by word, and a higher-order fold over them gives the word's pieces:

* a unigram vocabulary, whose scores are log probabilities: Viterbi, the best path
  to each position (the largest sum of scores; ties go to the longer last piece);
* a BPE vocabulary, whose scores are the order of merges: sums of them mean
  nothing, and the best path is not the encoding.  The fold merges instead: each
  step takes the lattice edge of the best score, leftmost first, that spans exactly
  two of the present pieces.

A character without a piece becomes its UTF-8 bytes' pieces.

Documents are then encoded in chunks of an Arrow batch.  The most frequent words'
codes, at most ``frequent_words`` of them, are broadcast; a chunk's rarer words are
asked for once, packed by hash bucket, and their codes come back to the chunk.
Meanwhile documents travel as packed word numbers, not as texts.

Words of more than ``LONGEST`` characters (long runs without a blank or another
place that no piece spans) are too large for a lattice row; a worker folds their
edges one by one, with the same result.  Texts may be of any length.

Decoding gives the text back exactly, also with line ends, runs of blanks, and the
character U+2581 itself (by its bytes).  A null text has null ids, an empty one no
ids.  Ids may be null or repeated: rows with equal ids and texts get equal results,
each its own row.  Columns besides the id and the text are not read.  Empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as t
from .runtime import parts, prepare, table, tasks, tidied, tidied_group, written

LONGEST, FREQUENT_WORDS = 256, 200_000
#: A long has a bit for each cut of a word of so many characters.
MASKED = 62
BLANK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    surfaces: tuple[str, ...]  # by id, with blanks as such; empty where the id stands for no text of its own
    scores: tuple[float, ...]
    bytes_from: int  # the id of byte 0
    kind: str  # "bpe" or "unigram"

    @classmethod
    def load(cls, path: str, kind: str | None = None) -> Vocabulary:
        """Of a SentencePiece model; without ``kind``, whole-number scores mean merges."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        odd = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        kind = kind or ("bpe" if all(float(m.get_score(i)).is_integer() for i in range(n)) else "unigram")
        return cls(tuple("" if odd[i] else m.id_to_piece(i).replace(BLANK, " ") for i in range(n)), tuple(m.get_score(i) for i in range(n)), m.piece_to_id("<0x00>"), kind)

    @property
    def longest(self) -> int:
        return max(map(len, self.surfaces), default=1)

    @property
    def unknown(self) -> float:
        """The score of a character without a piece: below that of any single piece that is meant to be found."""
        return min((s for s in self.scores if s > -1e8), default=0.0) - 10

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether some piece holds two characters next to each other: a table of pairs of ASCII bytes, and the sorted pairs of
        code points of which one at least lies beyond."""
        near, far = np.zeros((256, 256), bool), set()
        for s in self.surfaces:
            for a, b in zip(s, s[1:], strict=False):
                if a.isascii() and b.isascii():
                    near[ord(a), ord(b)] = True
                else:
                    far.add(ord(a) << 21 | ord(b))
        return near.ravel(), np.array(sorted(far), np.int64)

    def late(self) -> tuple[set[str], set[str]]:
        """(pieces that two others make of which one has no better a score, so that it may come after the piece's own turn; those others)."""
        score = {s: x for s, x in zip(self.surfaces, self.scores, strict=True) if len(s) > 1}
        late, wakes = set(), set()
        for s, x in score.items():
            for i in range(1, len(s)):
                halves = [h for h in (s[:i], s[i:]) if len(h) > 1]
                if halves and all(h in score for h in halves) and score[last := min(halves, key=score.__getitem__)] <= x:
                    late.add(s)
                    wakes.update(h for h in halves if score[h] == score[last])
        return late, wakes

    def table(self, spark: SparkSession) -> DataFrame:
        late, wakes = self.late() if self.kind == "bpe" else (set(), set())
        rows = [(s, i, float(x), s in late, s in wakes) for i, (s, x) in enumerate(zip(self.surfaces, self.scores, strict=True)) if s]
        return spark.createDataFrame(rows, "surface string, id int, score double, late boolean, wakes boolean")


def cut(buf: np.ndarray, offs: np.ndarray, joined: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank before each text that is not empty, word starts and the end, first word of each row)."""
    some = np.diff(offs) > 0
    buf = np.insert(buf, offs[:-1][some], 32)
    offs = offs + np.concatenate([[0], np.cumsum(some)])
    if not len(buf):
        return buf, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    near, far = joined
    head = np.ones(len(buf), bool)
    head[1:] = ~near[buf[:-1].astype(np.uint16) * np.uint16(256) + buf[1:]]
    if buf.max() > 127:
        begins = np.flatnonzero((buf & 0xC0) != 0x80)
        head[(buf & 0xC0) == 0x80] = False
        point = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        beyond = np.flatnonzero((point[:-1] > 127) | (point[1:] > 127))
        if len(far) and len(beyond):
            pair = point[beyond].astype(np.int64) << 21 | point[beyond + 1]
            k = np.minimum(np.searchsorted(far, pair), len(far) - 1)
            head[begins[beyond + 1]] = far[k] != pair
    head[offs[:-1][some]] = True
    starts = np.flatnonzero(head)
    return buf, np.concatenate([starts, [len(buf)]]), np.searchsorted(starts, offs)


def _strings(buf: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings without nulls."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]], offs - offs[0]


def _packed(*numbers: np.ndarray, text: np.ndarray | None = None) -> bytes:
    """Lists of numbers below 2 ** 32, and bytes, compressed.  Numbers go by planes of bytes, as most are small."""
    head = np.array([len(x) for x in numbers] + [0 if text is None else len(text)], "<u8").tobytes()
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in numbers]
    return head + pa.compress(b"".join([*planes, b"" if text is None else text.tobytes()]), codec="zstd", asbytes=True)


def _unpacked(data: bytes, lists: int) -> list[np.ndarray]:
    """``lists`` lists of numbers, and the bytes."""
    size = np.frombuffer(data, "<u8", lists + 1).astype(np.int64)
    whole = pa.decompress(data[8 * lists + 8 :], int(4 * size[:-1].sum() + size[-1]), codec="zstd", asbytes=True)
    out, at = [], 0
    for n in size[:-1].tolist():
        out.append(np.frombuffer(whole, np.uint8, 4 * n, at).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return [*out, np.frombuffer(whole, np.uint8, offset=at)]


def _dealt(words: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows of its words), by the words' hashes."""
    buf, offs = _raw(words)
    at, lo = np.empty(len(words), np.int64), 0
    while lo < len(words):  # hashing takes many times the bytes it reads
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + t.SLICE_BYTES // 2, side="right")) - 1)
        h = t.word_hashes(buf[offs[lo] : offs[hi]], offs[lo:hi] - offs[lo], offs[lo + 1 : hi + 1] - offs[lo])
        at[lo:hi], lo = (h >> np.uint64(20)) % np.uint64(buckets), hi
    order = np.argsort(at, kind="stable")
    own, first = np.unique(at[order], return_index=True)
    yield from zip(own.tolist(), np.split(order, first[1:]) if len(own) else (), strict=True)


def _counted(words: list[pa.Array], n: list[pa.Array]) -> tuple[pa.Array, pa.Array]:
    got = pa.table({"word": pa.chunked_array(words, pa.string()), "n": pa.chunked_array(n, pa.int64())}).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return got.column("word").combine_chunks(), got.column("n_sum").combine_chunks()


def distinct_words(docs: DataFrame, text_col: str, shared: Broadcast) -> DataFrame:
    """(word, n) of all documents; each task names a word once (or a few times, in very large tasks)."""
    buckets = parts(docs, 8 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            order = pc.sort_indices(words[0])  # neighbours are alike, which packs well
            w, n = words[0].take(order), counts[0].take(order).to_numpy()
            own, data = [], []
            for b, rows in _dealt(w, buckets):
                buf, offs = _raw(w.take(pa.array(rows)))
                own.append(b)
                data.append(_packed(np.diff(offs), np.minimum(n[rows], 0xFFFFFFFF), text=buf))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "data": pa.array(data, pa.binary())})

        for batch in batches:
            for _, _, buf, offs in t.slices(batch.column(0)):
                buf, starts, _ = cut(buf, offs, shared.value)
                got = pc.value_counts(_strings(buf, starts))
                words.append(got.field("values"))
                counts.append(got.field("counts").cast(pa.int64()))
                held += len(got)
                if held > 120_000:
                    words, counts = ([x] for x in _counted(words, counts))
                    if len(words[0]) > 80_000:
                        yield from flush()
                        words, counts = [], []
                    held = len(words[0]) if words else 0
        if words:
            words, counts = ([x] for x in _counted(words, counts))
            yield from flush()

    def united(part: pa.Table) -> pa.Table:
        words, counts = [], []
        for x in part.column("data"):
            size, n, text = _unpacked(x.as_py(), 2)
            words.append(_strings(text, np.concatenate([[0], np.cumsum(size)])))
            counts.append(pa.array(n))
        word, n = _counted(words, counts)
        return pa.table({"word": word, "n": n})

    return docs.select(text_col).mapInArrow(tidied(run), "bucket long, data binary").groupBy("bucket").applyInArrow(tidied_group(united), "word string, n long")


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x.cast("long"), by)


def _viterbi(grouped: DataFrame) -> DataFrame:
    """(word, n, path): the best path through each word's edges, as (b, id)."""
    kind = "struct<score:double,l:int,id:int>"

    # edges come by end and start; ``best`` has the best arrival at each position so far
    def arrive(best, e):
        here = F.struct((F.get(best, e["b"])["score"] + e["score"]).alias("score"), (e["e"] - e["b"]).alias("l"), e["id"].alias("id")).cast(kind)
        known = F.size(best) > e["e"]
        last = F.element_at(best, -1)
        return F.when(~known, F.array_append(best, here)).when((here["score"] > last["score"]) | ((here["score"] == last["score"]) & (here["l"] > last["l"])), F.array_append(F.slice(best, 1, F.size(best) - 1), here)).otherwise(best)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("l"), F.lit(-1).alias("id")).cast(kind))
    best = grouped.select("word", "n", F.aggregate("edges", start, arrive).alias("best"))

    def back(acc, _):
        e = F.element_at("best", acc["at"] + 1)
        return F.when(acc["at"] <= 0, acc).otherwise(F.struct((acc["at"] - e["l"]).alias("at"), F.array_append(acc["path"], F.struct((acc["at"] - e["l"]).alias("b"), e["id"].alias("id"))).alias("path")))

    zero = F.struct((F.size("best") - 1).alias("at"), F.expr("cast(array() as array<struct<b:int,id:int>>)").alias("path"))
    path = best.select("word", "n", F.reverse(F.aggregate("best", zero, back, lambda acc: acc["path"])).alias("path"))

    return path


def _merges(grouped: DataFrame) -> DataFrame:
    """(word, n, path): what is left when the best edge that spans two neighbours is taken again and again, as (b, id).

    A word's cuts are the bits of a long, and one pass over the edges, the best score first, merges what spans exactly
    two pieces.  That is the whole order of merges unless a merge lets an edge of a better score fit after its turn
    (see ``Vocabulary.late``).  Where that happens (the mask becomes 0), and in words of more than ``MASKED`` characters,
    the best edge is searched anew for each merge instead.
    """
    # by score (the best first), then from the left; only edges of several characters merge
    ranked = grouped.withColumn("ranked", F.sort_array(F.transform(F.filter("edges", lambda e: e["e"] - e["b"] > 1), lambda e: F.struct((-e["score"]).alias("cost"), *(e[c].alias(c) for c in ("b", "e", "inner", "outer", "late", "wakes"))))))

    def fits(mask, e):
        return (mask.bitwiseAND(e["outer"]) == e["outer"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1)

    def once(mask, e):
        after = mask.bitwiseAND(F.bitwise_not(e["inner"]))
        missed = e["wakes"] & F.exists("ranked", lambda x: x["late"] & (x["cost"] < e["cost"]) & fits(after, x))
        return F.when(~fits(mask, e), mask).when(missed, F.lit(0).cast("long")).otherwise(after)

    n = F.length("word")
    whole = F.when(n <= MASKED, _shift(F.lit(1), n) - 1 + _shift(F.lit(1), n)).otherwise(F.lit(0).cast("long"))
    masked = ranked.select("word", "n", "edges", "ranked", F.aggregate("ranked", whole, once).alias("mask"))

    # by position: where the piece that starts there ends, 0 where none starts
    def merge(acc, _):
        def spans(e):
            middle = F.get(acc["ends"], e["b"])
            return (middle > 0) & (F.get(acc["ends"], middle) == e["e"])

        # one struct first, so that the search runs once
        found = F.transform(F.array(F.get(F.filter("ranked", spans), F.lit(0))), lambda e: F.struct(
            F.when(e.isNull(), acc["ends"]).otherwise(F.transform(acc["ends"], lambda x, i: F.when(i == e["b"], e["e"]).when((i > e["b"]) & (i < e["e"]), 0).otherwise(x))).alias("ends"), e.isNull().alias("over")))
        return F.when(acc["over"], acc).otherwise(F.get(found, F.lit(0)))

    zero = F.struct(F.concat(F.sequence(F.lit(1), n), F.array(F.lit(0))).alias("ends"), (F.size("ranked") == 0).alias("over"))
    searched = F.aggregate(F.sequence(F.lit(1), n), zero, merge, lambda acc: acc["ends"])
    ends = masked.select("word", "n", "edges", "mask", F.when(F.col("mask") == 0, searched).alias("ends"))

    left = F.when(F.col("ends").isNull(), F.filter("edges", lambda e: (F.col("mask").bitwiseAND(e["outer"]) == e["outer"]) & (F.col("mask").bitwiseAND(e["inner"]) == 0))).otherwise(
        F.filter("edges", lambda e: F.get("ends", e["b"]) == e["e"]))
    return ends.select("word", "n", F.transform(left, lambda e: F.struct(e["b"].alias("b"), e["id"].alias("id"))).alias("path"))


def folded(word: str, vocabulary: Vocabulary, by: dict[str, tuple[float, int]]) -> list[int]:
    """The ids of one word by the same rules as the lattice's, for words of any length.  ``by``: score and id of each surface."""
    n = len(word)
    if vocabulary.kind == "bpe":
        # pieces as a linked list; a heap has each pair of neighbours that makes a piece, the best score and leftmost first
        ends, before = [*range(1, n + 1), n], [*range(-1, n)]
        heap: list[tuple[float, int, int, int]] = []

        def propose(a: int) -> None:
            m = ends[a] if 0 <= a < n else n
            if m < n and (got := by.get(word[a : ends[m]])) is not None:
                heapq.heappush(heap, (-got[0], a, m, ends[m]))

        for a in range(n):
            propose(a)
        while heap:
            _, a, m, e = heapq.heappop(heap)
            if ends[a] == m and ends[m] == e:  # else one of the two is gone
                ends[a], ends[m] = e, -1
                before[e] = a
                propose(a)
                if before[a] >= 0:
                    propose(before[a])
        cuts, at = [], 0
        while at < n:
            cuts.append((at, ends[at]))
            at = ends[at]
    else:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, n + 1):
            top = (float("-inf"), 0)
            for k in range(1, min(vocabulary.longest, e) + 1):
                got = by.get(word[e - k : e], (vocabulary.unknown, -1) if k == 1 else None)
                if got is not None:
                    top = max(top, (best[e - k][0] + got[0], k))
            best.append(top)
        cuts, at = [], n
        while at:
            cuts.append((at - best[at][1], at))
            at -= best[at][1]
        cuts.reverse()
    out: list[int] = []
    for a, e in cuts:
        got = by.get(word[a:e])
        out += [got[1]] if got is not None else [vocabulary.bytes_from + x for x in word[a:e].encode()]
    return out


def segmented(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, n, ids) of ``words`` (word, n; words are distinct): by the lattice of each, or, where it is longer than
    ``LONGEST``, folded one by one."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, tuple[float, int]] = {}
        for batch in batches:  # most tasks have none
            v = shared.value
            by = by or {s: (x, i) for i, (s, x) in enumerate(zip(v.surfaces, v.scores, strict=True)) if s}
            ids = pa.array([folded(w, v, by) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"word": batch.column(0), "n": batch.column(1), "ids": ids})

    return _by_lattice(words.where(F.length("word") <= LONGEST), vocabulary).union(words.where(F.length("word") > LONGEST).mapInArrow(tidied(long), "word string, n long, ids array<int>"))


def _by_lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    n = F.length("word")
    edges = words.select("word", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("b"))
    edges = edges.select("word", "n", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), n - F.col("b")))).alias("l"))
    edges = edges.withColumn("surface", F.substring("word", F.col("b") + 1, F.col("l")))
    edges = edges.join(F.broadcast(vocabulary.table(words.sparkSession)), "surface", "left").where(F.col("id").isNotNull() | (F.col("l") == 1))
    known = [F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(vocabulary.unknown)).alias("score")]
    if vocabulary.kind == "bpe":  # cuts as bits: those at the ends of the edge, those within, and the flags of the piece
        end, one = F.col("b") + F.col("l"), F.lit(1)
        known += [(_shift(_shift(one, F.col("l") - 1) - 1, F.col("b") + 1)).alias("inner"), _shift(one, F.col("b")).bitwiseOR(_shift(one, end)).alias("outer"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("late", "wakes"))]
    edges = edges.select("word", "n", F.struct((F.col("b") + F.col("l")).alias("e"), F.col("b"), *known).alias("edge"))
    grouped = edges.groupBy("word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))
    path = (_merges if vocabulary.kind == "bpe" else _viterbi)(grouped)

    def bytes_of(e):
        c = F.encode(F.substring(F.col("word"), e["b"] + 1, F.lit(1)), "utf-8")
        return F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: (F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int") + vocabulary.bytes_from))

    return path.select("word", "n", F.flatten(F.transform("path", lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(bytes_of(e)))).alias("ids"))


def encoded(docs: DataFrame, vocabulary: Vocabulary, frequent_words: int = FREQUENT_WORDS, text_col: str = "text", digest: bool = False, stable: bool = False) -> DataFrame:
    """(doc_id, ids) of each row; with ``digest``, also decoded_sha256, of the text that the ids decode to.

    ``stable`` says that ``docs`` gives the same batches whenever it is scanned, as files do; otherwise it is written first."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs if stable else written(docs)
    pairs = spark.sparkContext.broadcast(vocabulary.joined())
    # the lattice of a part is grouped in place, so a part has few words
    words = written(segmented(distinct_words(docs, "text", pairs).repartition(tasks(parts(docs, 2 << 20)), "word"), vocabulary))
    counts = words.groupBy("n").count().orderBy(F.desc("n"))
    # the least count that at most ``frequent_words`` words have
    least, total = None, 0
    for r in counts.limit(frequent_words).toLocalIterator():
        total += r["count"]
        if total > frequent_words:
            break
        least = r["n"]
    got = (words.where(F.col("n") >= least) if least is not None else words.limit(0)).select("word", "n", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    first, flat = _lists(got.column("ids"))
    count = len(got)
    # numbering needs the words, spelling only their ids: two broadcasts, so that no worker holds both
    known = spark.sparkContext.broadcast(got.column("word").combine_chunks() if count else pa.array([], pa.string()))
    spelling = spark.sparkContext.broadcast((first, flat))
    del got, first, flat
    rare = words.where(F.col("n") < least) if least is not None else words
    buckets = parts(docs, 16 << 20)

    def numbered(batch: pa.RecordBatch) -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
        """(the chunk's id, words a row, their numbers, its rare words, whose numbers count on from the frequent ones)."""
        key = hashlib.blake2b(np.asarray(batch.column(0).is_valid()).tobytes() + batch.column(0).fill_null(0).to_numpy().tobytes(), digest_size=8)
        size, own = [], []
        for _, _, buf, offs in t.slices(batch.column(1)):
            key.update(offs.tobytes())
            key.update(np.ascontiguousarray(buf))
            buf, starts, firsts = cut(buf, offs, pairs.value)
            own.append(_strings(buf, starts))
            size.append(np.diff(firsts))
        all_ = pa.chunked_array(own, pa.string())
        k = pc.index_in(all_, known.value).combine_chunks()  # one look-up a batch, as it hashes the frequent words anew
        words = all_.filter(k.is_null()).combine_chunks().dictionary_encode()
        code = np.array(k.fill_null(-1).to_numpy(), np.int32)
        code[code < 0] = count + words.indices.to_numpy()
        return int.from_bytes(key.digest(), "little", signed=True), np.concatenate([np.zeros(0, np.int64), *size]), code, words.dictionary

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, _, _, unknown = numbered(batch)
            own, data = [], []
            for b, rows in _dealt(unknown, buckets):
                buf, offs = _raw(unknown.take(pa.array(rows)))
                own.append(b)
                data.append(_packed(rows, np.diff(offs), text=buf))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "chunk": pa.array([chunk] * len(own), pa.int64()), "data": pa.array(data, pa.binary())})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, flat = _lists(batch.column(1))
            own, data = [], []
            for b, rows in _dealt(batch.column(0), buckets):
                buf, offs = _raw(batch.column(0).take(pa.array(rows)))
                own.append(b)
                data.append(_packed(np.diff(offs), np.diff(first)[rows], _gather(first, flat, rows), text=buf))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "data": pa.array(data, pa.binary())})

    def answers(asked: pa.Table, have: pa.Table) -> pa.Table:
        words, sizes, ids = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in have.column("data"):
            size, many, flat, text = _unpacked(x.as_py(), 3)
            words.append(_strings(text, np.concatenate([[0], np.cumsum(size)])))
            sizes.append(many)
            ids.append(flat)
        table_, many, flat = pa.chunked_array(words, pa.string()).combine_chunks(), np.concatenate(sizes), np.concatenate(ids)
        first = np.concatenate([[0], np.cumsum(many)])
        got = [_unpacked(x.as_py(), 2) for x in asked.column("data")]
        wanted = pa.chunked_array([_strings(text, np.concatenate([[0], np.cumsum(size)])) for _, size, text in got], pa.string())
        k = pc.index_in(wanted, table_)
        if k.null_count:
            raise ValueError("a word of the documents has no codes: they changed between two scans; stable=False copies them first")
        k, at, data = k.to_numpy().astype(np.int64), 0, []
        for number, _, _ in got:
            rows = k[at : at + len(number)]
            at += len(number)
            data.append(_packed(number, many[rows], _gather(first, flat, rows)))
        return pa.table({"chunk": asked.column("chunk"), "data": pa.array(data, pa.binary())})

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, size, code, unknown = numbered(batch)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "doc_id": one(batch.column(0)), "known": one(batch.column(1).is_valid()), "rare": pa.array([len(unknown)], pa.int64()), "data": pa.array([_packed(size, code)], pa.binary())})

    def spelled(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        first, flat = spelling.value
        got = [_unpacked(x.as_py(), 3) for x in replies.column("data")]
        number, many, ids = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in got)]) for k in range(3))
        # equal chunks have equal ids and replies, each for all of them: one of each number will do
        own, rows = np.unique(number, return_index=True)
        own_first = np.concatenate([[0], np.cumsum(many)])
        ids = _gather(own_first, ids, rows)
        table_ = np.concatenate([flat, ids.astype(np.int32)])
        begin = np.concatenate([first, len(flat) + np.cumsum(many[rows])])
        decoder = Decoder(vocabulary) if digest else None
        out = []
        for c in range(len(chunks)):
            if chunks.column("rare")[c].as_py() != len(own):
                raise ValueError("a chunk's words have no codes: the documents changed between two scans; stable=False copies them first")
            size, code, _ = _unpacked(chunks.column("data")[c].as_py(), 2)
            doc_id, there = chunks.column("doc_id")[c].values, chunks.column("known")[c].values
            ends = np.cumsum(size)
            lo = 0
            while lo < len(size):  # some words at a time
                start = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, start + 100_000, side="right")))
                w = code[start : int(ends[hi - 1])]
                reach = np.concatenate([[0], np.cumsum(begin[w + 1] - begin[w])])
                flat_ = _gather(begin, table_, w)
                offs = reach[np.concatenate([[0], ends[lo:hi] - start])]
                valid = there.slice(lo, hi - lo)
                cols = {"doc_id": doc_id.slice(lo, hi - lo), "ids": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat_), mask=pc.invert(valid))}
                if decoder:
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(decoder.bytes(flat_[a:b])).hexdigest() if v else None for a, b, v in zip(offs[:-1].tolist(), offs[1:].tolist(), valid.to_pylist(), strict=True)], pa.string())
                out.append(pa.table(cols))
                lo = hi
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in kinds})

    kinds = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int32())), *([pa.field("decoded_sha256", pa.string())] if digest else [])]
    asked = docs.mapInArrow(tidied(asking), "bucket long, chunk long, data binary")
    have = rare.select("word", "ids").mapInArrow(tidied(told), "bucket long, data binary")
    replies = asked.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(tidied_group(answers), "chunk long, data binary")
    chunks = docs.mapInArrow(tidied(coded), "chunk long, doc_id array<long>, known array<boolean>, rare long, data binary")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(tidied_group(spelled), "doc_id long, ids array<int>" + ", decoded_sha256 string" * digest)


def _lists(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of lists without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    offs = col.offsets.to_numpy().astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return offs - offs[0], col.flatten().to_numpy().astype(np.int32)


def _gather(first: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the lists ``rows``, one after the other."""
    size = first[rows + 1] - first[rows]
    return flat[np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        spelled = [s.encode() for s in vocabulary.surfaces]
        for b in range(256):
            spelled[vocabulary.bytes_from + b] = bytes([b])
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.first, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        """The text of the ids, as UTF-8, without the blank before it."""
        n = self.size[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at].tobytes()[1:]


def decoded(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` with ``decoded``, the text of the ids (which replaces a column of that name)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    own = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(shared.value)
        for batch in batches:
            ids = batch.column(ids_col)
            flat, offs = ids.flatten().to_numpy(zero_copy_only=False), None
            size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(size)])
            text = [d.bytes(flat[offs[i] : offs[i + 1]].astype(np.int64)).decode(errors="replace") if ok else None for i, ok in enumerate(np.asarray(ids.is_valid()))]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | {"decoded": pa.array(text, pa.string())})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema]
    return df.select(*own).mapInArrow(run, ", ".join([*kinds, "decoded string"]))


def op4_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text that they decode to."""
    vocabulary = Vocabulary.load(model or default_model())
    out = encoded(table(spark, sf_dir, "documents"), vocabulary, digest=True, stable=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")
