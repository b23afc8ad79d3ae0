"""Component tables of a schema set, and closures over them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtins import BUILTINS, XSD
from ..functions.facets import Simple
from ..plans.automata import automaton, children
from ..plans.model import CODES, Model
from ..plans.schema import Complex, Element, SchemaError, SchemaSet


def _type(ref: object) -> str | None:
    name = ref if isinstance(ref, tuple) else getattr(ref, "name", None)
    return name if isinstance(name, str) or name is None else f"{{{name[0]}}}{name[1]}" if name[0] else name[1]


def tables(spark: SparkSession, s: SchemaSet) -> dict[str, DataFrame]:
    """documents, types, elements, attributes, attribute_uses, children, substitutes, identity_constraints, diagnostics."""
    own = {n: t for n, t in s.types.items() if n[0] != XSD}
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = {
        "documents": make([(d["uri"], d["target_ns"], d["chameleon"], d["version"]) for d in s.documents], "uri string, target_ns string, chameleon boolean, version string"),
        "types": make([(n[0], n[1], "complex" if isinstance(t, Complex) else "simple", _type(t.base) if isinstance(t, Complex) else t.builtin, getattr(t, "derivation", "restriction"), getattr(t, "content", "simple"), getattr(t, "abstract", False), s.mixed(t) if isinstance(t, Complex) else False) for n, t in own.items()],
                      "ns string, local string, kind string, base string, derivation string, content string, abstract boolean, mixed boolean"),
        "elements": make([(n[0], n[1], _type(e.type), e.nillable, e.abstract, e.default, e.fixed, [_type(h) for h in e.heads]) for n, e in s.elements.items()], "ns string, local string, type string, nillable boolean, abstract boolean, default string, fixed string, heads array<string>"),
        "attributes": make([(n[0], n[1], _type(a.type), a.default, a.fixed) for n, a in s.attributes.items()], "ns string, local string, type string, default string, fixed string"),
        "attribute_uses": make([(n[1], i, _type(a), a.use, a.default, a.fixed) for n, t in own.items() if isinstance(t, Complex) for i, a in enumerate(s.attributes_of(t)[0].values())], "type string, ordinal int, attribute string, use string, default string, fixed string"),
        "children": make([(n[1], i, _type(c), repeats, optional) for n, t in own.items() if isinstance(t, Complex) for i, (c, repeats, optional) in enumerate(children(s, t))], "type string, ordinal int, child string, repeats boolean, optional boolean"),
        "positions": make([(n[1], i, _type(x) if isinstance(x, tuple | Element) else "*", sorted(a.follow[i])) for n, t in own.items() if isinstance(t, Complex) for a in [automaton(s, t)] for i, x in enumerate(a.terms)], "type string, position int, admits string, follow array<int>"),
        "substitutes": make([(_type(h), _type(m), m in s.permitted(h)) for h, ms in s.substitutes.items() for m in ms], "head string, member string, permitted boolean"),
        "identity_constraints": make([(_type(e), c.kind, c.name[1], ["/".join(p) for p in c.selector], ["|".join("/".join(p) for p in f) for f in c.fields], _type(c.refer)) for e in s.elements.values() for c in e.keys], "element string, kind string, name string, selector array<string>, fields array<string>, refer string"),
        "annotations": make(s.annotations, "owner string, documentation string"),
        "diagnostics": make([(d.code, d.message, d.severity, d.uri, d.line) for d in s.diagnostics], "code string, message string, severity string, uri string, line int"),
    }
    return out


def builtin_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b.name, b.base, b.primitive, b.space) for b in BUILTINS.values()], "name string, base string, primitive string, white_space string")


def _settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed, with a plan of their own: below the checkpoint folder, or else on the executors."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.localCheckpoint()
    path = f"{folder}/closures/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(member, ancestor, depth): every id's ancestors over an edge table, at their least depth, itself at 0.

    The reach doubles in each round until nothing is new, so a chain of n edges takes log2(n) rounds and cycles end.  Pairs
    of the full reach are led on by all that are known, so a forest's pairs are made once; each round rests on tables,
    as plans that hold the rounds before would grow threefold in each."""
    e = edges.select(F.col(child).alias("member"), F.col(parent).alias("ancestor")).where("member is not null and ancestor is not null and member <> ancestor").distinct()
    paths = new = _settled(e.withColumn("depth", F.lit(1)))
    reach = 1
    while not (far := new.where(F.col("depth") == reach)).isEmpty():
        on = paths.select(F.col("member").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = far.join(on, "ancestor").where("member <> next").groupBy("member", F.col("next").alias("ancestor")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        new = _settled(longer.join(paths, ["member", "ancestor"], "left_anti"))
        paths, reach = paths.union(new), 2 * reach
    own = edges.select(F.col(child).alias("member")).where("member is not null").distinct().select("member", F.col("member").alias("ancestor"), F.lit(0).alias("depth"))
    return own.union(paths.select("member", "ancestor", "depth"))


def diagnose(df: DataFrame, xml_col: str = "xsd", version: str = "1.0") -> DataFrame:
    """Each row's schema document compiled by itself, lax: its columns with code, severity, message and line, a row a diagnostic.
    Locations lead nowhere, as workers see no files of the caller."""
    own = [c for c in df.columns if c not in (xml_col, "code", "severity", "message", "line")]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema), "code string, severity string, message string, line int"])

    def nowhere(place: str, _: str | None):
        raise FileNotFoundError(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, x in enumerate(batch.column(xml_col).to_pylist()):
                try:
                    got = SchemaSet.load((x or "", f"row:{i}"), resolver=nowhere, version=version, conformance="lax").diagnostics
                except SchemaError as e:
                    got = e.diagnostics
                rows += [i] * len(got)
                found += got
            index = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(index) for c in own} | {
                "code": pa.array([d.code for d in found], pa.string()), "severity": pa.array([d.severity for d in found], pa.string()),
                "message": pa.array([d.message for d in found], pa.string()), "line": pa.array([d.line for d in found], pa.int32())})

    return df.select(*own, xml_col).mapInArrow(run, kinds)


def facets(spark: SparkSession, s: SchemaSet) -> DataFrame:
    """(type, facet, value) of the facets in force on each named simple type; enumerations and patterns a row each."""
    rows = []
    for n, t in s.types.items():
        if n[0] != XSD and isinstance(t, Simple):
            name = _type(n)
            rows += [(name, "pattern", p) for step in t.patterns for p in step] + [(name, "whiteSpace", t.whitespace)]
            for k, v in t.facets.items():
                rows += [(name, k, str(x)) for x in (v if isinstance(v, tuple | list) else [v])]
    return spark.createDataFrame(rows, "type string, facet string, value string")


def counts(spark: SparkSession, s: SchemaSet) -> DataFrame:
    """(component, n): how many of each kind."""
    return spark.createDataFrame(list(Model(s).counts().items()), "component string, n long")


def codes(spark: SparkSession) -> DataFrame:
    """(code, meaning) of all diagnostics."""
    return spark.createDataFrame(list(CODES.items()), "code string, meaning string")
