"""Document operators over DataFrames: validate, events, decode; the schema set is broadcast."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import XSD
from ..functions.facets import Simple
from ..plans.automata import automaton, children
from ..plans.schema import Complex, Name, SchemaSet, Wildcard
from .validator import Events, Rows, Shape, Validator, clark

REPORT = "valid boolean, n_errors int, diagnostics array<struct<code:string,message:string,line:int,severity:string>>"
EVENT = ("seq long, depth int, kind string, path array<string>, ns string, local string, type string, nil boolean, "
         "attributes array<struct<name:string,lexical:string,canonical:string,from_schema:boolean>>, lexical string, canonical string, from_schema boolean, line int, parent_seq long, declared boolean")


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def validate(df: DataFrame, schemas: SchemaSet, xml_col: str = "xml") -> DataFrame:
    """Each row with ``valid``, ``n_errors`` and ``diagnostics``; the XML column (text or bytes) goes.  A null is malformed."""
    shared = df.sparkSession.sparkContext.broadcast(schemas.serialize())
    own = [c for c in df.columns if c not in (xml_col, "valid", "n_errors", "diagnostics")]
    schema = ", ".join(x for x in (_kinds(df.select(*own)), REPORT) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Validator(SchemaSet.deserialize(shared.value))
        for batch in batches:
            found = [v.run(x) for x in batch.column(xml_col).to_pylist()]
            errors = [sum(d[3] == "error" for d in x) for x in found]
            flat = [d for x in found for d in x]
            parts = list(zip(*flat, strict=True)) or [()] * 4
            ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
            inner = pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["code", "message", "line", "severity"])
            told = {"valid": pa.array([n == 0 for n in errors], pa.bool_()), "n_errors": pa.array(errors, pa.int32()), "diagnostics": pa.ListArray.from_arrays(ends, inner)}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | told)

    return df.select(*own, xml_col).mapInArrow(run, schema)


def events(df: DataFrame, schemas: SchemaSet, id_col: str, xml_col: str = "xml", most: int | None = None, columns: tuple[str, ...] = Events.NAMES) -> DataFrame:
    """The typed events of all documents, each with its document's id.

    ``most`` ends a document's parse after so many events; only ``columns`` are made, as a worker does not see which of them
    a query goes on to read."""
    shared = df.sparkSession.sparkContext.broadcast(schemas.serialize())
    id_kind = _kinds(df.select(id_col))
    kinds = {x.split(" ")[0]: x for x in re.split(r", (?=[a-z_]+ )", EVENT)}
    columns = tuple(c for c in Events.NAMES if c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Events(columns, most)
        v = Validator(SchemaSet.deserialize(shared.value), sink)

        def told(ids: pa.Array, owner: list[tuple[int, int]]) -> pa.RecordBatch:
            rows, counts = zip(*owner, strict=True)
            return pa.RecordBatch.from_pydict({id_col: ids.take(pa.array(np.repeat(rows, counts)))} | sink.arrays(v))

        for batch in batches:
            ids, owner, last = batch.column(0), [], len(batch) - 1
            for i, x in enumerate(batch.column(1)):
                sink.document()
                had = len(sink.rows)
                for _ in v.stream(x.as_py()):
                    if len(sink.rows) >= 50_000:  # a large document's events leave as it is read
                        owner.append((i, len(sink.rows) - had))
                        yield told(ids, owner)
                        sink.clear()
                        owner, had = [], 0
                owner.append((i, len(sink.rows) - had))
                if len(sink.rows) >= 50_000 or i == last:
                    yield told(ids, owner)
                    sink.clear()
                    owner = []

    return df.select(id_col, xml_col).mapInArrow(run, ", ".join([id_kind, *(kinds[c] for c in columns)]))


def _spark(t: Simple) -> str:
    from ..functions.lexical import spark_type

    kind = "string" if t.item or t.members else spark_type(t.builtin)
    return "string" if kind.startswith(("array", "binary")) else kind  # lists and bytes stay canonical text


def shape(schemas: SchemaSet, root: Name, deepest: int = 8) -> tuple[Shape, str]:
    """(columns to fold into, Spark type) that a schema fixes for a root element: children that can repeat are arrays,
    attributes are ``@name``, text beside them is ``$``; names are local ones unless two of a type's differ by namespace only.
    Children that a wildcard admits are JSON texts in the map ``*``, by Clark name.  Below ``deepest`` levels (recursive
    types), and for anyType, the type is a string of JSON."""

    def of(t: object, depth: int) -> tuple[Shape, str]:
        simple = schemas.simple_of(t)
        if isinstance(t, Simple):
            return Shape("scalar"), _spark(t)
        uses, _ = schemas.attributes_of(t)
        if simple is not None and not uses:
            return Shape("scalar"), _spark(simple)
        if depth >= deepest or t.name == (XSD, "anyType"):
            return Shape("raw"), "string"
        out = Shape("struct")
        alike = _ambiguous(uses)
        for n, a in uses.items():
            out.attributes[clark(n)] = out.field("@" + (clark(n) if n[1] in alike else n[1]), _spark(schemas.simple_of(schemas.type_of(a.type)) or Simple()))
        if simple is not None:
            out.text = out.field("$", _spark(simple))
            return out, out.spark()
        found = children(schemas, t)
        alike = _ambiguous(n for n, _, _ in found)
        for n, repeats, _ in found:
            own, kind = of(schemas.type_of(_declared(schemas, t, n)), depth + 1)
            at = out.field(clark(n) if n[1] in alike else n[1], f"array<{kind}>" if repeats else kind)
            out.children[f"{n[0]} {n[1]}" if n[0] else n[1]] = (at, own, repeats)
        if schemas.mixed(t):
            out.text = out.field("$", "string")
        if t.open or any(isinstance(x, Wildcard) for x in automaton(schemas, t).terms):
            out.extra = out.field("*", "map<string,array<string>>")
        return (out, out.spark()) if out.names else (Shape("raw"), "string")

    return of(schemas.type_of(schemas.elements[root].type), 0)


def _ambiguous(names: Iterable[Name]) -> set[str]:
    """Local names that come in two namespaces."""
    locals_ = [n[1] for n in dict.fromkeys(names)]
    return {x for x in locals_ if locals_.count(x) > 1}


def _declared(schemas: SchemaSet, t: Complex, name: Name) -> object:
    return next((m[name].type for m in automaton(schemas, t).names if m.get(name) is not None), None)


def decode(df: DataFrame, schemas: SchemaSet, root: Name, xml_col: str = "xml", mode: str = "PERMISSIVE") -> DataFrame:
    """Each row with ``decoded``, of the type the schema fixes, and ``valid``.  Workers fold documents into Arrow columns of
    canonical text; one cast on the JVM gives values their types.  A document that is no XML, or has another root, is null;
    with ``mode`` FAILFAST the first invalid one ends the job."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(mode)
    fold_, kind = shape(schemas, root)
    plain = fold_.plain()
    shared = df.sparkSession.sparkContext.broadcast(schemas.serialize())
    own = [c for c in df.columns if c not in (xml_col, "decoded", "valid")]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = SchemaSet.deserialize(shared.value)
        fold, _ = shape(s, root)
        sink = Rows(f"{root[0]} {root[1]}" if root[0] else root[1], fold)
        v = Validator(s, sink)
        for batch in batches:
            valid = []
            for x in batch.column(xml_col).to_pylist():
                sink.document()
                diags = v.run(x)
                valid.append(not any(d[3] == "error" for d in diags))
                if not valid[-1] and mode == "FAILFAST":
                    raise ValueError(f"an invalid document: {diags[0][0]}: {diags[0][1]}")
                if any(d[0] in ("XSD1001", "XSD1006", "XSD1007") for d in diags):
                    sink.found[-1] = None
            decoded = fold.array().take(pa.array(sink.found, pa.int32())) if fold.kind == "struct" else pa.array(sink.found, pa.string())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | {"decoded": decoded, "valid": pa.array(valid, pa.bool_())})
            sink.clear()

    out = df.select(*own, xml_col).mapInArrow(run, ", ".join(x for x in (_kinds(df.select(*own)), f"decoded {plain}, valid boolean") if x))
    return out.withColumn("decoded", F.col("decoded").cast(kind))


def diagnostics(report: DataFrame) -> DataFrame:
    """The diagnostics of a validation report, a row each."""
    own = [c for c in report.columns if c not in ("valid", "n_errors", "diagnostics")]
    return report.select(*own, F.explode("diagnostics").alias("d")).select(*own, "d.*")


def accepts(df: DataFrame, schemas: SchemaSet, type_name: Name, names_col: str, out: str = "accepted") -> DataFrame:
    """Whether a type's content model accepts each row's array of child names (local, or Clark)."""
    shared, own = df.sparkSession.sparkContext.broadcast(schemas.serialize()), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = SchemaSet.deserialize(shared.value)
        a = automaton(s, s.types[type_name])
        for batch in batches:
            found = [None if x is None else a.accepts([(n[1:].partition("}")[0], n.partition("}")[2]) if n.startswith("{") else (None, n) for n in x]) for x in batch.column(names_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | {out: pa.array(found, pa.bool_())})

    return df.mapInArrow(run, _kinds(df) + f", `{out}` boolean")


