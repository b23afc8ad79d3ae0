"""Sources and sinks of XML documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(uri, xml): a row a file, as bytes, so that the parser finds the encoding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("uri"), F.col("content").alias("xml"))


def encoding(data: Column) -> Column:
    """The encoding of a document's bytes: its mark, else its declaration, else UTF-8."""
    mark = F.hex(F.substring(data, 1, 4))
    said = F.regexp_extract(F.decode(F.substring(data, 1, 1024), "ISO-8859-1"), r"^<\?xml\s[^>]*?encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)[\"']", 1)
    return F.when(mark.startswith("EFBBBF"), "UTF-8").when(mark.startswith("FFFE"), "UTF-16LE").when(mark.startswith("FEFF"), "UTF-16BE").when(said != "", F.upper(said)).otherwise("UTF-8")


def text(data: Column) -> Column:
    """The text of a document's bytes, by its encoding, without its mark.  Bytes that contradict it end the job, as Spark's
    own decoding does; ``documents.validate`` reports them instead (XSD1006, XSD1007)."""
    name = encoding(data)
    mark = F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", 4).when(F.hex(F.substring(data, 1, 2)).isin("FFFE", "FEFF"), 3).otherwise(1)
    rest = F.substring(data, mark, F.octet_length(data))
    known = ("UTF-8", "UTF-16LE", "UTF-16BE", "UTF-16", "US-ASCII", "ISO-8859-1")
    return F.coalesce(*(F.when(name == k, F.decode(rest, k)) for k in known))


def escaped(c: Column, quotes: bool = False) -> Column:
    """Text as XML character data, or as an attribute's value."""
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def element(name: str, content: Column | str, attributes: dict[str, Column] | None = None) -> Column:
    """An element as text; attributes and content that are null are left out."""
    if not re.fullmatch(r"[A-Za-z_][\w.:-]*", name):
        raise ValueError(name)
    parts = [F.lit(f"<{name}")]
    for k, v in (attributes or {}).items():
        parts.append(F.coalesce(F.concat(F.lit(f' {k}="'), escaped(v.cast("string"), quotes=True), F.lit('"')), F.lit("")))
    content = F.lit(content) if isinstance(content, str) else content
    return F.concat(*parts, F.lit(">"), F.coalesce(content, F.lit("")), F.lit(f"</{name}>"))


def write_documents(df: DataFrame, path: str, xml_col: str = "xml") -> None:
    """One document a line (line ends within a document become references)."""
    df.select(F.regexp_replace(xml_col, "\n", "&#10;").alias("value")).write.text(path)
