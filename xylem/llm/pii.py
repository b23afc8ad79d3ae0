"""Personal data: base patterns, and bootstrapped contextual extraction on top.

Base spans (email, ip, card, phone) are fixed patterns with their checks.  They
are the seeds of the bootstrap.  Instances are identifier-like tokens: they hold a
digit or ``@``, and groups of digits go on over single blanks, so that spaced
phones and cards are one token.  An instance's lexical patterns are the word and
the marks before it (L), those after it (R), and both (B).

Patterns and instances are the two sides of a graph that is scored in rounds.  A
pattern's confidence in a kind is the share of believed ones among those of its
distinct instances whose characters can be of that kind (``PLAUSIBLE``): the lower
bound of it (Wilson, two standard errors) must be ``confidence`` or more.  Besides,
``support`` instances must be believed, and they must be more of all its instances
than chance among so many patterns makes of the kind's share everywhere.  An
instance is believed by noisy-or over its patterns, if it can be of that kind; it
then supports further patterns in the next round.  What is believed in the end, stands in such a pattern and
touches no base span is added, the whole token.

All of it is DataFrame operations: counts are pre-aggregated before they are
shuffled, and patterns meet instances in equi-joins.

A null text counts as empty; texts may be of any length (a cue is looked for within
``CUE`` characters).  Ids need not be unique or not null: rows are told apart by a
number of their own, and repeated rows get equal results.  Columns that come along
keep their values, whatever their names; ``base`` and ``spans`` replace columns of
these names.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import others, scratch, table, written
from .spans import counted, joined, placed, replaced, span, with_hits

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; look-behind and possessive forms only keep long runs linear, the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?=(?:[ -]?[0-9]){14})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: An identifier-like token: with a digit or ``@``, and groups of digits after single blanks.
TOKEN = r"(?<![\p{L}0-9@._%+-])(?=[(+]?+[\p{L}._%:()-]*+[0-9@])[+(]{0,2}+[A-Za-z0-9][A-Za-z0-9._%+@:()/-]*+(?:(?<=[0-9)]) [(]?+[0-9][0-9().-]*+)*+"
CUE = 64
#: The word and marks next to an instance.
LEFT, RIGHT = r"(\p{L}+[^\p{L}0-9]{0,3})$", r"^([^\p{L}0-9]{0,3}\p{L}+)"
#: What a discovered instance of a kind must look like.
PLAUSIBLE = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){2,}$",
    "card": r"^[0-9]([ -]?[0-9]){7,}$",
    "phone": r"^[+(]{0,2}[0-9]([ ()./-]{0,3}[0-9]){5,}$",
}
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.7
_INSTANCE = "array<struct<s:int,e:int,left:string,right:string,surface:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, 2 * _digit(digits, n - i) - F.when(_digit(digits, n - i) > 4, 9).otherwise(0)).otherwise(_digit(digits, n - i)),
    )
    return total % 10 == 0


def _digit(digits: Column, at: Column) -> Column:
    return F.substring(digits, at, F.lit(1)).cast("int")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        digits = F.regexp_replace(hit, "[ -]", "")
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(own, base, instances): all columns of ``docs`` as a struct, the base spans sorted by start and kind, and the tokens."""
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = with_hits(df, "text", PATTERNS | {"token": TOKEN})
    spans = []
    for i, k in enumerate(KINDS):
        all_ = placed(k, lambda hit, j, s, e, k=k, i=i: F.struct(span(s, i, e).alias("x"), _valid(k, hit).alias("ok")), "struct<x:struct<s:int,k:int,e:int>,ok:boolean>")
        spans.append(F.transform(F.filter(all_, lambda x: x["ok"]), lambda x: x["x"]))

    def instance(hit: Column, j: Column, s: Column, e: Column) -> Column:
        surface = F.regexp_replace(hit, r"[^\p{L}0-9)]+$", "")
        before, after = F.get("token_gaps", j), F.concat(F.substring(hit, F.length(surface) + 1, F.lit(CUE)), F.get("token_gaps", j + 1))
        cue = lambda gap, p: F.nullif(F.lower(F.regexp_replace(F.regexp_extract(gap, p, 1), r"\s+", " ")), F.lit(""))
        return F.struct(s.cast("int").alias("s"), (s + F.length(surface)).cast("int").alias("e"), cue(F.substring(before, -CUE, CUE), LEFT).alias("left"), cue(F.substring(after, 1, CUE), RIGHT).alias("right"), surface.alias("surface"))

    return df.select("own", F.array_sort(F.concat(*spans)).alias("base"), placed("token", instance, _INSTANCE[6:-1]).alias("instances"))


def _patterns(left: str, right: str) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("L "), left), F.concat(F.lit("R "), right), F.concat(F.lit("B "), left, F.lit(" | "), right)))


def discovered(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(row, more): the spans that the bootstrap adds to each row of ``found`` (row, base, instances)."""
    inst = found.select("row", "base", F.explode("instances").alias("i")).select("row", "i.*", F.get(F.filter("base", lambda b: (b["s"] < F.col("i.e")) & (F.col("i.s") < b["e"])), F.lit(0))["k"].alias("seed"))
    inst = inst.withColumn("patterns", _patterns("left", "right")).where("size(patterns) > 0")
    # the graph: distinct instances by pattern; a seed kind is the one most of its occurrences have
    edges = written(inst.select(F.explode("patterns").alias("pattern"), "surface", "seed").groupBy("pattern", "surface").agg(F.mode("seed", True).alias("seed")))
    nodes = edges.groupBy("surface").agg(F.min("seed").alias("kind"))
    belief = written(nodes.where("kind is not null"))
    can = [F.col("surface").rlike(PLAUSIBLE[k]) for k in KINDS]
    fits = F.coalesce(*(F.when(F.col("kind") == i, x) for i, x in enumerate(can)))
    of_kind = F.array(*(F.count_if(x | F.coalesce(F.col("seed") == i, F.lit(False))) for i, x in enumerate(can)))
    totals = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), of_kind.alias("can")))
    # the share of each kind among all instances, and how surprising the best of so many patterns is by chance
    all_, several = nodes.count(), totals.where(F.col("n") >= support).count()
    share = {r["kind"]: (r["count"] + 1) / (all_ + 2) for r in belief.groupBy("kind").count().collect()}  # at most a row a kind
    chance = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in share.items()), F.lit(1.0))
    n, m = F.col("n"), F.get("can", F.col("kind"))
    p, q = F.col("known") / n, F.least(F.col("known") / m, F.lit(1.0))
    sure = (q + 2 / m - 2 * F.sqrt(q * (1 - q) / m + 1 / (m * m))) / (1 + 4 / m)
    surprise = n * (p * F.log(p / F.col("chance")) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - F.col("chance")))).otherwise(0))
    for _ in range(rounds):
        by = edges.join(belief, "surface").groupBy("pattern", "kind").agg(F.count("*").alias("known")).where(F.col("known") >= support)
        good = by.join(totals, "pattern").withColumn("chance", chance).where((p > F.col("chance")) & (surprise >= float(np.log(several + 1)) + 3)).select("pattern", "kind", sure.alias("sure")).where(F.col("sure") >= confidence)
        good = written(good.groupBy("pattern").agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"), F.max("sure").alias("sure")))
        if good.isEmpty():
            break
        reached = edges.where("seed is null").join(good, "pattern").where(fits).groupBy("surface", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("sure", F.lit(0.999)))))).alias("belief"))
        reached = reached.where(F.col("belief") >= confidence).groupBy("surface").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
        grown = written(belief.withColumn("first", F.lit(0)).unionByName(reached.withColumn("first", F.lit(1))).groupBy("surface").agg(F.min_by("kind", F.struct("first", "kind")).alias("kind")))
        before, belief = belief, grown
        if grown.count() == before.count():
            break
    new = inst.where("seed is null").select("row", "s", "e", "surface", F.explode("patterns").alias("pattern")).join(good.select("pattern", "kind"), "pattern").where(fits).join(belief, ["surface", "kind"], "left_semi")
    new = new.groupBy("row", "s", "e").agg(F.min("kind").alias("kind"))
    return new.groupBy("row").agg(F.array_sort(F.collect_list(span(F.col("s"), F.col("kind"), F.col("e")))).alias("more"))


def personal_data(docs: DataFrame, text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id (or, with ``keep_columns``, all columns), ``base`` and ``spans`` (base and discovered spans, sorted)."""
    own = others(docs, ("base", "spans")) if keep_columns else ["doc_id"]
    found = written(base(docs.select(*dict.fromkeys([*own, text_col])), text_col).withColumn("row", F.monotonically_increasing_id()))
    # few rows have more spans than base ones; as a table their size is known, and the texts need not be shuffled to meet them
    with scratch(docs.sparkSession):
        more = written(discovered(found.where("size(instances) > 0")), keep=True)
    out = found.drop("instances").join(more, "row", "left")
    return out.select(*(F.col(f"own.`{c}`") for c in own), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``."""
    # the text travels once, beside the other columns; in its place among them is a null
    all_ = F.struct(*((F.lit(None).cast("boolean") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns))
    kept = personal_data(docs.select(all_.alias("all"), F.col(text_col).alias("text")), keep_columns=True)
    kept = kept.select("all", replaced("text", F.col("spans"), KINDS).alias("new"))
    return kept.select(*((F.col("new") if c == text_col else F.col(f"all.`{c}`")).alias(c) for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
