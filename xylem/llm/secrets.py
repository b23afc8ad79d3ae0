"""Secret scans: base patterns, and a randomness test battery on top.

Base spans (assign, access, hex) are fixed patterns with their checks.  Beyond
them, every token of 16 or more key characters is tested.  Its encoding is
inferred from its characters, which gives the alphabet; then three tests ask
whether it departs from random text over that alphabet:

* chi-squared: uneven use of the alphabet;
* runs: switches between the alphabet's lower and upper half;
* serial correlation of neighbouring characters.

Their normal scores are summed up as one departure.  How far ordinary tokens depart
comes from two sources, by length: tokens of letters only in the corpus, of this and
all shorter length classes (longer words depart further, so shorter ones err on the
safe side), and a fixed simulation of words, with or without a number behind, for
corpora that hold few.  Together they give the chance that an ordinary token of that
length departs as little.  Among tokens with letters and digits, the Benjamini-
Hochberg bound on that chance, again by length, decides which are reported, so the
share of ordinary tokens among them stays below ``rate``.  Tokens without letters are
numbers and tokens without digits are words: neither is reported.

All of it is DataFrame operations.  Counts by length class and departure step are
all that leaves the executors: at most ``LENGTHS`` times ``STEPS`` rows, however
many documents.

A null text counts as empty; texts may be of any length.  Ids need not be unique or
not null.  Columns that come along keep their values, whatever their names; ``base``
and ``spans`` replace columns of these names.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import others, table, written
from .spans import counted, joined, placed, replaced, span, with_hits

KINDS = ("assign", "access", "hex", "random")
#: The contract's patterns; possessive forms only keep long runs linear, the matches are the same.
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Encodings, the narrowest first: what their tokens consist of, and their alphabets.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^.*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_="),
)
#: Length classes by their least length, and steps of a quarter of a normal score.
LENGTHS, STEPS, RATE = (16, 20, 24, 32, 48, 64, 128), 240, 0.05
_TOKEN = "array<struct<s:int,e:int,len:int,step:int,digit:boolean>>"


def _times(text: Column, what: str | Column) -> Column:
    """How often ``what`` is in ``text``, without overlaps."""
    what = F.lit(what) if isinstance(what, str) else what
    return (F.length(text) - F.length(F.replace(text, what, F.lit("")))) / F.length(what)


def departure(token: Column) -> Column:
    """The summed departure of a token from random text over its inferred alphabet."""
    number = F.coalesce(*(F.when(token.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)))
    alphabets = F.array(*(F.lit(a) for _, _, a in ENCODINGS))
    halves = F.array(*(F.lit("L" * (len(a) // 2) + "H" * (len(a) - len(a) // 2)) for _, _, a in ENCODINGS))
    # one struct after the other, so that each is computed once
    first = F.struct(F.length(token).cast("double").alias("n"), F.get(alphabets, number).alias("a"), F.get(halves, number).alias("h"), F.split(token, "").alias("c"))
    out = F.transform(F.array(first), lambda x: F.struct(
        x["n"].alias("n"), F.length(x["a"]).cast("double").alias("k"),
        _halved(x["c"], x["a"], x["h"]).alias("half"),
        F.aggregate(F.array_distinct(x["c"]), F.lit(0.0), lambda acc, c: acc + F.pow(_times(token, c), F.lit(2.0))).alias("squares"),
        F.transform(x["c"], lambda c: F.instr(x["a"], c).cast("double")).alias("i"),
    ))
    out = F.transform(out, lambda x: F.struct(
        x["n"].alias("n"), x["k"].alias("k"), x["squares"].alias("squares"), _times(x["half"], "H").alias("up"),
        (1 + _times(x["half"], "HL") + _times(x["half"], "LH")).alias("runs"), x["i"].alias("i"), (F.aggregate(x["i"], F.lit(0.0), lambda a, v: a + v) / x["n"]).alias("mean"),
    ))
    out = F.transform(out, lambda x: F.struct(
        ((x["k"] / x["n"] * x["squares"] - x["n"] - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (x["n"] - 1) / x["n"])).alias("chi"),
        x["n"].alias("n"), x["up"].alias("up"), (x["n"] - x["up"]).alias("low"), x["runs"].alias("runs"),
        F.aggregate(F.zip_with(F.slice(x["i"], F.lit(1), F.size(x["i"]) - 1), F.slice(x["i"], F.lit(2), F.size(x["i"]) - 1), lambda a, b: (a - x["mean"]) * (b - x["mean"])), F.lit(0.0), lambda a, v: a + v).alias("near"),
        F.aggregate(x["i"], F.lit(0.0), lambda a, v: a + (v - x["mean"]) * (v - x["mean"])).alias("spread"),
    ))
    out = F.transform(out, lambda x: F.struct(
        F.greatest(x["chi"], F.lit(0.0)).alias("chi"), (2 * x["up"] * x["low"] / x["n"] + 1).alias("mean"), x["runs"].alias("runs"),
        (2 * x["up"] * x["low"] * (2 * x["up"] * x["low"] - x["n"]) / (x["n"] * x["n"] * (x["n"] - 1))).alias("var"),
        F.when(x["spread"] > 0, F.abs(x["near"] / x["spread"] * F.sqrt(x["n"]) + 1 / F.sqrt(x["n"]))).otherwise(F.sqrt(x["n"])).alias("serial"),
    ))
    return F.get(F.transform(out, lambda x: x["chi"] + F.when(x["var"] > 0, F.abs(x["runs"] - x["mean"]) / F.sqrt(x["var"])).otherwise(F.abs(x["runs"] - x["mean"])) / 2 + x["serial"] / 2), F.lit(0))


def _halved(chars: Column, alphabet: Column, halves: Column) -> Column:
    return F.array_join(F.transform(chars, lambda c: F.substring(halves, F.instr(alphabet, c), F.lit(1))), "")


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(own, base, tokens): all columns of ``docs`` as a struct, the base spans sorted by start and kind, and the tested tokens."""
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = with_hits(df, "text", PATTERNS | {"token": TOKEN})
    spans = []
    for i, k in enumerate(KINDS[:3]):
        long = lambda hit, k=k: F.length(F.regexp_extract(hit, PATTERNS["assign"], 1)) >= 6 if k == "assign" else F.lit(True)
        all_ = placed(k, lambda hit, j, s, e, i=i, long=long: F.struct(span(s, i, e).alias("x"), long(hit).alias("ok")), "struct<x:struct<s:int,k:int,e:int>,ok:boolean>")
        spans.append(F.transform(F.filter(all_, lambda x: x["ok"]), lambda x: x["x"]))

    def tested(hit: Column, j: Column, s: Column, e: Column) -> Column:
        step = F.least(F.floor(departure(hit) * 4), F.lit(STEPS - 1))
        return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), (e - s).cast("int").alias("len"), step.cast("int").alias("step"), F.when(hit.rlike("[A-Za-z]"), hit.rlike("[0-9]")).alias("digit"))

    return df.select("own", F.array_sort(F.concat(*spans)).alias("base"), placed("token", tested, _TOKEN[6:-1]).alias("tokens"))


#: Letters by how often English has them, and how often the first is.
LETTERS, SIMULATED = "etaoinshrdlcumwfgypbvkjxqz", 2_000


def departure_of(token: str) -> float:
    """``departure`` of one token, for the simulation."""
    alphabet = next(a for _, p, a in ENCODINGS if re.match(p, token))
    i = np.array([alphabet.find(c) + 1 for c in token], float)
    n, k = len(token), len(alphabet)
    chi = (k / n * (np.unique(i, return_counts=True)[1] ** 2.0).sum() - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    high = i > k // 2
    up = float(high.sum())
    both, runs = 2 * up * (n - up), 1 + (high[1:] != high[:-1]).sum()
    var = both * (both - n) / (n * n * (n - 1))
    off = abs(runs - both / n - 1)
    x = i - i.mean()
    serial = abs((x[1:] * x[:-1]).sum() / (x * x).sum() * np.sqrt(n) + 1 / np.sqrt(n)) if x.any() else np.sqrt(n)
    return max(chi, 0.0) + (off / np.sqrt(var) if var > 0 else off) / 2 + serial / 2


@lru_cache(1)
def simulated() -> dict[int, np.ndarray]:
    """By length class: how many of ``SIMULATED`` ordinary tokens depart by each step.  Their letters are drawn one by one, so
    they depart less than words with their habits do."""
    r = np.random.default_rng(20_241)
    weight = 1 / np.arange(1, len(LETTERS) + 1) ** 0.9
    out = {}
    for low, high in zip(LENGTHS, (*LENGTHS[1:], 2 * LENGTHS[-1]), strict=True):
        steps = np.zeros(STEPS, np.int64)
        for _ in range(SIMULATED):
            n = int(r.integers(low, high))
            digits = int(r.integers(0, 5))
            word = "".join(r.choice(list(LETTERS), n - digits, p=weight / weight.sum())) + "".join(map(str, r.integers(0, 10, digits)))
            steps[min(int(departure_of(word) * 4), STEPS - 1)] += 1
        out[low] = steps
    return out


def _length(n: Column) -> Column:
    return F.coalesce(*(F.when(n >= k, F.lit(k)) for k in reversed(LENGTHS)))


def limits(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By length class: the largest departure step that is reported."""
    rows = found.select(F.explode("tokens").alias("t")).where("t.digit is not null").groupBy(_length(F.col("t.len")).alias("length"), F.col("t.step").alias("step"), F.col("t.digit").alias("digit")).count().collect()
    counts = {k: np.zeros((2, STEPS), np.int64) for k in LENGTHS}
    for r in rows:  # at most a row for each length class, step and flag
        counts[r["length"]][int(r["digit"]), r["step"]] += r["count"]
    out, ordinary = {}, np.zeros(STEPS, np.int64)
    for k, (own, mixed) in counts.items():  # the shortest first
        ordinary = ordinary + own
        plain = ordinary + simulated()[k]
        chance = (np.cumsum(plain) + 1) / (plain.sum() + 1)
        reported = np.cumsum(mixed)
        ok = np.flatnonzero((reported > 0) & (chance * mixed.sum() <= rate * reported))
        if len(ok):
            out[k] = int(ok[-1])
    return out


def secrets(docs: DataFrame, text_col: str = "text", keep_columns: bool = False, rate: float = RATE) -> DataFrame:
    """doc_id (or, with ``keep_columns``, all columns), ``base`` and ``spans`` (base and random spans, sorted)."""
    own = others(docs, ("base", "spans")) if keep_columns else ["doc_id"]
    found = written(base(docs.select(*dict.fromkeys([*own, text_col])), text_col))
    most = limits(found, rate)

    def reported(x: Column) -> Column:
        top = F.coalesce(*(F.when(_length(x["len"]) == k, F.lit(v)) for k, v in most.items()), F.lit(-1)) if most else F.lit(-1)
        free = ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return x["digit"] & (x["step"] <= top) & free

    more = F.transform(F.filter("tokens", reported), lambda x: span(x["s"], KINDS.index("random"), x["e"]))
    return found.select(*(F.col(f"own.`{c}`") for c in own), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in angle brackets."""
    kept = secrets(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"), F.col(text_col).alias("text")), keep_columns=True)
    kept = kept.select("all", replaced("text", F.col("spans"), KINDS).alias("new"))
    return kept.select(*((F.col("new") if c == text_col else F.col(f"all.`{c}`")).alias(c) for c in docs.columns))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
