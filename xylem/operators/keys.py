"""Identity constraints and identifiers over whole tables, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of a key that lack a field (XSD2015)."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.col(f).isNull()
    return df.where(bad)


def duplicates(df: DataFrame, scope: list[str], fields: list[str], order: list[Column | str]) -> DataFrame:
    """Rows whose complete tuple came before in their scope (XSD2014)."""
    whole = df.dropna(subset=fields)
    w = Window.partitionBy(*scope, *fields).orderBy(*order)
    return whole.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def orphans(refs: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of a keyref without a key (XSD2016); rows that lack a field are none."""
    known = keys.select([F.col(k).alias(f"_{k}") for k in on.values()]).distinct()
    cond = [F.col(r) == F.col(f"_{k}") for r, k in on.items()]
    return refs.dropna(subset=list(on)).join(known, cond, "left_anti")


def identifiers(ids: DataFrame, refs: DataFrame, doc: str, id_col: str, ref_col: str) -> DataFrame:
    """(doc, code, value, n): IDs that come twice in a document (XSD2011) and references without an ID (XSD2012)."""
    twice = ids.groupBy(doc, F.col(id_col).alias("value")).agg((F.count("*") - 1).alias("n")).where("n > 0").select(doc, F.lit("XSD2011").alias("code"), "value", "n")
    known = ids.select(F.col(doc), F.col(id_col).alias("value")).distinct()
    lost = refs.select(doc, F.explode(F.split(F.trim(ref_col), " +")).alias("value")).join(known, [doc, "value"], "left_anti").groupBy(doc, "value").agg(F.count("*").alias("n")).select(doc, F.lit("XSD2012").alias("code"), "value", "n")
    return twice.union(lost)


def within(inner: DataFrame, scopes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Event rows with the ``scope_seq`` of every scope element that holds them: a range join on start and end numbers."""
    s = scopes.select(F.col(doc).alias("_doc"), F.col("seq").alias("scope_seq"), F.col("end_seq").alias("_end"))
    return inner.join(s, (F.col(doc) == F.col("_doc")) & F.col("seq").between(F.col("scope_seq"), F.col("_end"))).drop("_doc", "_end")
