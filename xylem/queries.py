"""Registered queries of the XML-Schema engine, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexical
from .functions.builtins import XSD
from .functions.facets import Simple, check, compare, member, with_check
from .operators import catalog, documents, keys
from .plans.model import Model, load_string
from .plans.schema import SchemaSet, Wildcard
from .sources import xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


ORDER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:o="urn:orders" targetNamespace="urn:orders" elementFormDefault="qualified">
  <xs:simpleType name="Flag"><xs:restriction base="xs:string"><xs:pattern value="[ANR]"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="Quantity"><xs:restriction base="xs:int"><xs:minInclusive value="1"/><xs:maxInclusive value="50"/></xs:restriction></xs:simpleType>
  <xs:element name="order"><xs:complexType>
    <xs:sequence>
      <xs:element name="status" type="xs:string" default="N"/>
      <xs:element name="line" minOccurs="0" maxOccurs="unbounded"><xs:complexType>
        <xs:sequence><xs:element name="part" type="xs:long"/><xs:element name="quantity" type="o:Quantity"/><xs:element name="flag" type="o:Flag"/></xs:sequence>
        <xs:attribute name="number" type="xs:int" use="required"/></xs:complexType></xs:element>
    </xs:sequence>
    <xs:attribute name="key" type="xs:long" use="required"/><xs:attribute name="channel" type="xs:token" default="web"/></xs:complexType>
  </xs:element></xs:schema>"""


def orders(spark: SparkSession, d: str, defects: bool = False) -> DataFrame:
    """(o_orderkey, xml): a document an order; with ``defects``, some by their key: a quantity out of range, a missing key, an
    unexpected element, text between elements."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey") % 7
    quantity = F.when(k == 1, q + 100).otherwise(q) if defects else q
    line = xml.element("line", F.concat(xml.element("part", F.col("l_partkey").cast("string")), xml.element("quantity", quantity.cast("string")), xml.element("flag", F.col("l_returnflag"))), {"number": F.col("l_linenumber")})
    # parsing costs far more than its bytes tell, so the partitions of this exchange stay as many as the session asks for
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = t(spark, d, "lineitem").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]), "").alias("lines"))
    o = t(spark, d, "orders").repartition(n, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey") % 7
    body = F.concat(xml.element("status", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus"))), F.coalesce("lines", F.lit("")))
    if defects:
        body = F.concat(body, F.when(k == 3, "<extra/>").when(k == 4, "words").otherwise(""))
    key = F.when(k == 2, None).otherwise(F.col("o_orderkey")) if defects else F.col("o_orderkey")
    channel = F.when(F.col("o_orderkey") % 3 == 0, F.lit("shop"))
    return o.select("o_orderkey", xml.element("order", body, {"xmlns": F.lit("urn:orders"), "key": key, "channel": channel}).alias("xml"))


def order_schema() -> SchemaSet:
    return SchemaSet.from_text(ORDER_XSD, "memory:orders.xsd")


@query("""SELECT l_orderkey AS o_orderkey, l_linenumber::INT AS number, l_partkey AS part, l_quantity::INT AS quantity, l_returnflag AS flag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def decode_lineitem(spark, d):
    out = documents.decode(orders(spark, d), order_schema(), ("urn:orders", "order")).where("valid")
    return out.select("o_orderkey", F.explode("decoded.line").alias("l")).select("o_orderkey", F.col("l.@number").alias("number"), F.col("l.part").alias("part"), F.col("l.quantity").alias("quantity"), F.col("l.flag").alias("flag"))


@query("SELECT o_orderkey, count(l_orderkey)::INT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def decode_repeats_empty(spark, d):
    return documents.decode(orders(spark, d), order_schema(), ("urn:orders", "order")).select("o_orderkey", F.size("decoded.line").alias("n"))


@query("""WITH c AS (SELECT count(*) AS o, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS l FROM orders)
SELECT kind, CASE kind WHEN 'text' THEN o + 3 * l ELSE 2 * o + 4 * l END::BIGINT AS n FROM c, (VALUES ('start'), ('text'), ('end')) v(kind)""")
def psvi_event_counts(spark, d):
    return documents.events(orders(spark, d), order_schema(), "o_orderkey", columns=("kind",)).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
SELECT code, sum(n)::BIGINT AS n, count(*)::BIGINT AS documents FROM (
SELECT o_orderkey, 'XSD2004' AS code, n FROM x WHERE k = 1 AND n > 0 UNION ALL SELECT o_orderkey, 'XSD2006', 1 FROM x WHERE k = 2
UNION ALL SELECT o_orderkey, 'XSD2002', 1 FROM x WHERE k = 3 UNION ALL SELECT o_orderkey, 'XSD2007', 1 FROM x WHERE k = 4) GROUP BY code""")
def validate_report_by_code(spark, d):
    found = documents.diagnostics(documents.validate(orders(spark, d, defects=True), order_schema()))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("documents"))


@query("SELECT valid, count(*)::BIGINT AS n FROM (SELECT NOT (o_orderkey % 7 IN (2, 3, 4) OR o_orderkey % 7 = 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS valid FROM orders) GROUP BY valid")
def validate_verdicts(spark, d):
    return documents.validate(orders(spark, d, defects=True), order_schema()).groupBy("valid").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'shop' ELSE 'web' END AS channel, o_orderkey % 3 <> 0 AS from_schema, CASE WHEN o_orderkey % 5 = 0 THEN 'N' ELSE o_orderstatus END AS status FROM orders""")
def default_supply(spark, d):
    e = documents.events(orders(spark, d), order_schema(), "o_orderkey").where("size(path) <= 2 and (kind = 'start' and depth = 0 or kind = 'text' and local = 'status')")
    channel = F.filter("attributes", lambda a: a["name"] == "channel")[0]
    return e.groupBy("o_orderkey").agg(F.max(F.when(F.col("kind") == "start", channel["canonical"])).alias("channel"), F.max(F.when(F.col("kind") == "start", channel["from_schema"])).alias("from_schema"), F.max(F.when(F.col("kind") == "text", F.col("canonical"))).alias("status"))


CUSTOMER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="customer"><xs:complexType><xs:sequence>
<xs:element name="segment" type="xs:string" nillable="true" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'nil' WHEN 1 THEN 'absent' ELSE 'value' END AS state, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def nil_vs_absent(spark, d):
    k = F.col("c_custkey") % 3
    inner = F.when(k == 0, '<segment xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="true"/>').when(k == 2, xml.element("segment", F.col("c_mktsegment"))).otherwise("")
    e = documents.events(t(spark, d, "customer").select("c_custkey", xml.element("customer", inner).alias("xml")), SchemaSet.from_text(CUSTOMER_XSD), "c_custkey").where("kind = 'start'")
    state = e.groupBy("c_custkey").agg(F.coalesce(F.max(F.when(F.col("local") == "segment", F.when(F.col("nil"), "nil").otherwise("value"))), F.lit("absent")).alias("state"))
    return state.groupBy("state").agg(F.count("*").alias("n"))


PART_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Part"><xs:sequence><xs:element name="size" type="xs:int"/></xs:sequence></xs:complexType>
<xs:complexType name="Big"><xs:complexContent><xs:extension base="Part"><xs:sequence><xs:element name="crate" type="xs:string"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="Other"/><xs:element name="part" type="Part"/></xs:schema>"""


@query("""SELECT CASE WHEN p_size > 25 THEN 'Big' WHEN p_size % 10 = 0 THEN 'XSD2008' ELSE 'Part' END AS outcome, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def xsi_type_dispatch(spark, d):
    p = t(spark, d, "part")
    kind = F.when(F.col("p_size") > 25, "Big").when(F.col("p_size") % 10 == 0, "Other")
    body = F.concat(xml.element("size", F.col("p_size").cast("string")), F.when(F.col("p_size") > 25, "<crate>x</crate>").otherwise(""))
    docs = p.select("p_partkey", xml.element("part", body, {"xmlns:i": F.lit("http://www.w3.org/2001/XMLSchema-instance"), "i:type": kind}).alias("xml"))
    s = SchemaSet.from_text(PART_XSD)
    types = documents.events(docs, s, "p_partkey", most=1).select("p_partkey", "type")
    bad = documents.diagnostics(documents.validate(docs, s)).select("p_partkey", "code")
    return types.join(bad, "p_partkey", "left").groupBy(F.coalesce("code", "type").alias("outcome")).agg(F.count("*").alias("n"))


def facet(spark: SparkSession, d: str, name: str, c: Column, simple: Simple) -> DataFrame:
    return with_check(t(spark, d, name), c, simple, "outcome").groupBy(F.coalesce("outcome", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query(r"SELECT CASE WHEN regexp_full_match(p_brand, 'Brand#[1-3][0-9]') THEN 'ok' ELSE 'pattern' END AS outcome, count(*)::BIGINT AS n FROM part GROUP BY 1")
def facet_pattern_brand(spark, d):
    return facet(spark, d, "part", F.col("p_brand"), Simple().restrict((r"Brand#[1-3]\d",)))


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ok' ELSE 'enumeration' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def facet_enumeration_priority(spark, d):
    return facet(spark, d, "orders", F.col("o_orderpriority"), Simple("token").restrict(enumeration=("1-URGENT", "2-HIGH")))


@query("SELECT CASE WHEN l_quantity < 5 THEN 'minInclusive' WHEN l_quantity >= 40 THEN 'maxExclusive' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def facet_bounds_quantity(spark, d):
    return facet(spark, d, "lineitem", F.col("l_quantity").cast("int").cast("string"), Simple("int").restrict(minInclusive=5).restrict(maxExclusive=40))


@query("SELECT CASE WHEN length(n_name) < 6 THEN 'minLength' WHEN length(n_name) > 8 THEN 'maxLength' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def facet_length_name(spark, d):
    return facet(spark, d, "nation", F.col("n_name"), Simple().restrict(minLength=6, maxLength=8))


@query("""SELECT CASE WHEN length(replace(rtrim(rtrim(v, '0'), '.'), '.', '')) > 7 THEN 'totalDigits' WHEN length(rtrim(split_part(v, '.', 2), '0')) > 1 THEN 'fractionDigits' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n
FROM (SELECT o_totalprice::DECIMAL(18,2)::VARCHAR AS v FROM orders) GROUP BY 1""")
def facet_digits_price(spark, d):
    return facet(spark, d, "orders", F.col("o_totalprice").cast("decimal(18,2)").cast("string"), Simple("decimal").restrict(totalDigits=7, fractionDigits=1))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' '), ' +', ' ', 'g'), ' ')) AS digest FROM documents")
def whitespace_collapse(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(lexical.whitespace(F.col("text"), "collapse"), 256).alias("digest"))


@query("""WITH x AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents)
SELECT CASE WHEN len(list_filter(w, lambda x: length(x) > 18)) > 0 THEN 'item' WHEN len(w) > 300 THEN 'maxLength' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM x GROUP BY 1""".replace("\\\\", "\\"))
def list_items(spark, d):
    return facet(spark, d, "documents", F.col("text"), Simple("string", item=Simple("token").restrict(maxLength=18)).restrict(maxLength=300))


@query("""SELECT m, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_full_match(v, '[0-9]+') THEN 0 WHEN regexp_full_match(v, '[0-9]+\\.[0-9]+') THEN 1 ELSE 2 END::INT AS m
FROM (SELECT CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN user_id::VARCHAR || '.5' ELSE event_type END AS v FROM events)) GROUP BY m""".replace("\\\\", "\\"))
def union_first_match(spark, d):
    k = F.col("event_id") % 3
    v = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(F.col("user_id").cast("string"), F.lit(".5"))).otherwise(F.col("event_type"))
    return t(spark, d, "events").groupBy(member(v, Simple(members=(Simple("integer"), Simple("decimal"), Simple("string")))).alias("m")).agg(F.count("*").alias("n"))


@query("""SELECT sum((o_orderkey BETWEEN -128 AND 127)::INT)::BIGINT AS bytes, sum((o_orderkey <= 32767)::INT)::BIGINT AS shorts, count(*)::BIGINT AS longs, sum((o_orderkey > 0)::INT)::BIGINT AS positive FROM orders""")
def parse_integer_bounds(spark, d):
    c = F.concat(F.lit(" +00"), F.col("o_orderkey").cast("string"), F.lit(" "))
    n = lambda name: F.count(lexical.value(c, name))
    return t(spark, d, "orders").agg(n("byte").alias("bytes"), n("short").alias("shorts"), n("long").alias("longs"), n("positiveInteger").alias("positive"))


@query("""SELECT v, CASE v WHEN '1' THEN true WHEN 'true' THEN true WHEN '0' THEN false END AS b, count(*)::BIGINT AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '0' WHEN 3 THEN 'TRUE' ELSE 't' END AS v FROM events) GROUP BY v""")
def parse_boolean_strict(spark, d):
    v = F.get(F.array(*map(F.lit, ("1", "true", "0", "TRUE", "t"))), (F.col("event_id") % 5).cast("int"))
    return t(spark, d, "events").groupBy(v.alias("v")).agg(F.first(lexical.value(v, "boolean")).alias("b"), F.count("*").alias("n"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || 'Z' AS canonical FROM events")
def parse_datetime_canonical(spark, d):
    c = F.concat(F.lit(" "), F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000+00:00"))
    return t(spark, d, "events").select("event_id", lexical.canonical(c, "dateTime").alias("canonical"))


@query("""SELECT CASE WHEN k < 28 THEN -1 WHEN k > 31 THEN 1 END::INT AS sign, count(*)::BIGINT AS n FROM (SELECT o_orderkey % 60 AS k FROM orders) GROUP BY 1""")
def duration_compare(spark, d):
    a = lexical.duration(F.concat(F.lit("P"), (F.col("o_orderkey") % 60).cast("string"), F.lit("D")))
    return t(spark, d, "orders").groupBy(lexical.compare_durations(a, lexical.duration(F.lit("P1M"))).alias("sign")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, hex(encode(n_name)) AS hex, n_name AS back FROM nation")
def binary_hex_roundtrip(spark, d):
    h = F.lower(F.hex("n_name"))
    return t(spark, d, "nation").select("n_nationkey", lexical.canonical(h, "hexBinary").alias("hex"), lexical.value(h, "hexBinary").cast("string").alias("back"))


@query("SELECT lang, regexp_full_match(lang, '[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*') AS is_language, regexp_full_match(lang, '[A-Za-z_][A-Za-z0-9._-]*') AS is_ncname, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def ncname_language_check(spark, d):
    c = F.col("lang")
    return t(spark, d, "documents").groupBy("lang", lexical.is_valid(c, "language").alias("is_language"), lexical.is_valid(c, "NCName").alias("is_ncname")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN '{urn:r' || n_regionkey || '}N' || n_nationkey END AS name FROM nation")
def qname_resolution(spark, d):
    bound = F.create_map(*(F.lit(x) for i in range(3) for x in (f"r{i}", f"urn:r{i}")))
    c = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(":N"), F.col("n_nationkey").cast("string"))
    return t(spark, d, "nation").select("n_nationkey", lexical.qname(c, bound).alias("name"))


TURNS_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Turns"><xs:sequence><xs:element name="system" minOccurs="0"/>
<xs:sequence maxOccurs="unbounded"><xs:element name="user"/><xs:element name="assistant"/></xs:sequence></xs:sequence></xs:complexType></xs:schema>"""


@query("SELECT conv_id, regexp_full_match(string_agg(role, ' ' ORDER BY turn), '(system )?user assistant( user assistant)*') AS accepted FROM conversations GROUP BY conv_id")
def accepts_turns(spark, d):
    roles = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return documents.accepts(roles, SchemaSet.from_text(TURNS_XSD), (None, "Turns"), "roles").select("conv_id", "accepted")


ALL_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Flags"><xs:all><xs:element name="A" minOccurs="0"/><xs:element name="N"/><xs:element name="R" minOccurs="0"/></xs:all></xs:complexType></xs:schema>"""


@query("""SELECT accepted, count(*)::BIGINT AS n FROM (SELECT l_orderkey, sum((l_returnflag = 'A')::INT) <= 1 AND sum((l_returnflag = 'N')::INT) = 1 AND sum((l_returnflag = 'R')::INT) <= 1 AS accepted FROM lineitem GROUP BY 1) GROUP BY 1""")
def all_group_counts(spark, d):
    flags = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return documents.accepts(flags, SchemaSet.from_text(ALL_XSD), (None, "Flags"), "flags").groupBy("accepted").agg(F.count("*").alias("n"))


@query(r"""SELECT admitted, count(*)::BIGINT AS n FROM (SELECT host IS NOT NULL AND host NOT IN (SELECT min(regexp_extract(url, '^https?://([^/]*)', 1)) FROM pages) AND NOT (page_id % 4 = 0 AND host = 'urn:x') AS admitted
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'urn:x' ELSE regexp_extract(url, '^https?://([^/]*)', 1) END AS host FROM pages)) GROUP BY 1""")
def wildcard_admission(spark, d):
    """notNamespace (one host, and none) with notQName, as a Column over names."""
    p = t(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]*)", 1))
    w = Wildcard("not", (p.agg(F.min("host")).first()[0], None), not_names=(("urn:x", "n0"),))
    ns = F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 7 == 0, "urn:x").otherwise(F.col("host"))
    names = p.select(ns.alias("ns"), F.concat(F.lit("n"), (F.col("page_id") % 4).cast("string")).alias("local"))
    return names.groupBy(w.column(F.col("ns"), F.col("local")).alias("admitted")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem) WHERE n > 1")
def key_duplicates(spark, d):
    return keys.duplicates(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], ["l_returnflag"], ["l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0")
def key_missing_field(spark, d):
    c = t(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")))
    return keys.missing_fields(c, ["c_custkey", "segment"]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def keyref_orphans(spark, d):
    return keys.orphans(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").where("c_acctbal >= 0"), {"o_custkey": "c_custkey"}).select("o_orderkey")


@query("""SELECT lang AS doc, 'XSD2011' AS code, source AS value, count(*) - 1 AS n FROM documents GROUP BY lang, source HAVING count(*) > 1
UNION ALL SELECT d.lang, 'XSD2012', 'src' || (doc_id % 25), count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = d.lang AND e.source = 'src' || (d.doc_id % 25)) GROUP BY 1, 2, 3""")
def id_idref(spark, d):
    x = t(spark, d, "documents").select(F.col("lang").alias("doc"), "source", F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string")).alias("ref"))
    return keys.identifiers(x, x, "doc", "source", "ref")


@query("""WITH RECURSIVE b(name, base) AS (VALUES ('byte','short'),('short','int'),('int','long'),('long','integer'),('integer','decimal'),('decimal','anyAtomicType'),('anyAtomicType','anySimpleType')),
u(member, ancestor, depth) AS (SELECT 'byte', 'byte', 0 UNION ALL SELECT member, base, depth + 1 FROM u JOIN b ON name = ancestor) SELECT * FROM u""")
def base_chain_builtins(spark, d):
    return catalog.closure(catalog.builtin_table(spark).select("name", "base"), "name", "base").where("member = 'byte'")


def schema_of(body: str, **options) -> SchemaSet:
    return SchemaSet.from_text(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{body}</xs:schema>', **options)


@query("""SELECT 'r' AS head, 'R' || r_regionkey AS member FROM region UNION ALL SELECT 'r', 'N' || n_nationkey FROM nation UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation""")
def substitution_closure(spark, d):
    """The compiler's closure, of a schema whose elements are regions and nations."""
    rows = [("R", r[0], "r") for r in t(spark, d, "region").select("r_regionkey").collect()] + [("N", n[0], f"R{n[1]}") for n in t(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]
    s = schema_of('<xs:element name="r" type="xs:string"/>' + "".join(f'<xs:element name="{k}{i}" substitutionGroup="{h}"/>' for k, i, h in rows))
    return catalog.tables(spark, s)["substitutes"].select("head", "member")


@query("SELECT 'r' AS head, 'R' || r_regionkey AS member, r_regionkey % 2 = 0 AS permitted FROM region")
def substitutes_permitted(spark, d):
    """A head that blocks extension lets only members of its own type, or restrictions of it, stand for it."""
    rows = [r[0] for r in t(spark, d, "region").select("r_regionkey").collect()]
    s = schema_of('<xs:complexType name="B"><xs:attribute name="a"/></xs:complexType><xs:complexType name="E"><xs:complexContent><xs:extension base="B"/></xs:complexContent></xs:complexType><xs:element name="r" type="B" block="extension"/>'
                  + "".join(f'<xs:element name="R{i}" type="{"E" if i % 2 else "B"}" substitutionGroup="r"/>' for i in rows))
    return catalog.tables(spark, s)["substitutes"].select("head", "member", "permitted")


@query("SELECT n_nationkey, n_regionkey < 4 AS resolved FROM nation")
def reference_resolution(spark, d):
    """The compiler's resolution, of a schema in which each nation's element refers to its region's type, and one region is missing."""
    nations = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    kinds = "".join(f'<xs:simpleType name="R{r[0]}"><xs:restriction base="xs:int"/></xs:simpleType>' for r in t(spark, d, "region").where("r_regionkey < 4").select("r_regionkey").collect())
    elements = "\n".join(f'<xs:element name="N{k}" type="R{r}"/>' for k, r in nations.collect())
    s = schema_of(f"{kinds}\n{elements}", conformance="lax")
    lines = {f"N{k}": i + 2 for i, (k, _) in enumerate(nations.collect())}
    lost = {x.line for x in s.diagnostics if x.code == "XSD1201"}
    return spark.createDataFrame([(int(n[1:]), line not in lost) for n, line in lines.items()], "n_nationkey int, resolved boolean").join(nations.select(F.col("n_nationkey").cast("int")), "n_nationkey")


@query("""WITH RECURSIVE u(member, ancestor, depth) AS (SELECT n, n, 0 FROM (SELECT DISTINCT o_custkey AS n FROM orders) UNION SELECT member, (ancestor / 2)::BIGINT, depth + 1 FROM (SELECT member, ancestor - ancestor % 2 AS ancestor, depth FROM u) WHERE ancestor > 1)
SELECT depth::INT AS depth, count(*)::BIGINT AS n FROM u GROUP BY depth""")
def closure_depths(spark, d):
    """Ancestors by halving: a forest whose chains are as long as the keys have bits."""
    keys_ = t(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("k")).distinct()
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest("k", F.lit(1)))).cast("int")), lambda i: F.expr("k") / F.pow(F.lit(2.0), i))
    nodes = keys_.select("k", F.explode(F.transform(steps, lambda x: F.floor(x).cast("long"))).alias("m")).select("m").distinct()
    found = catalog.closure(nodes.select("m", F.floor(F.col("m") / 2).cast("long").alias("p")).where("p >= 1").union(nodes.select("m", F.lit(None).cast("long"))), "m", "p")
    return found.join(keys_, F.col("member") == F.col("k"), "left_semi").groupBy("depth").agg(F.count("*").alias("n"))


FLAT_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:attributeGroup name="g"><xs:attribute name="a" use="required"/><xs:attributeGroup ref="h"/></xs:attributeGroup>
<xs:attributeGroup name="h"><xs:attribute name="b"/></xs:attributeGroup><xs:complexType name="T"><xs:attributeGroup ref="g"/></xs:complexType>
<xs:complexType name="U"><xs:complexContent><xs:extension base="T"><xs:sequence><xs:element name="x" minOccurs="0"/><xs:choice><xs:element name="y" maxOccurs="3"/><xs:element name="z"/></xs:choice></xs:sequence><xs:attribute name="c"/></xs:extension></xs:complexContent></xs:complexType></xs:schema>"""


@query("SELECT * FROM (VALUES ('T','a','required'),('T','b','optional'),('U','a','required'),('U','b','optional'),('U','c','optional')) v(type, attribute, use)")
def attribute_flattening(spark, d):
    return catalog.tables(spark, SchemaSet.from_text(FLAT_XSD))["attribute_uses"].select("type", "attribute", "use")


@query("SELECT * FROM (VALUES ('U', 0::INT, 'x', false, true), ('U', 1, 'y', true, true), ('U', 2, 'z', false, true)) v(type, ordinal, child, repeats, optional)")
def children_occurrence(spark, d):
    return catalog.tables(spark, SchemaSet.from_text(FLAT_XSD))["children"]


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
e AS (SELECT 'XSD2004' AS code, n FROM x WHERE k = 1 AND n > 0 UNION ALL SELECT CASE k WHEN 2 THEN 'XSD2006' WHEN 3 THEN 'XSD2002' ELSE 'XSD2007' END, 1 FROM x WHERE k IN (2, 3, 4))
SELECT severity, code, sum(n)::BIGINT AS n FROM (SELECT 'error' AS severity, * FROM e) GROUP BY ROLLUP (severity, code)""")
def diagnostics_rollup(spark, d):
    found = documents.diagnostics(documents.validate(orders(spark, d, defects=True), order_schema()))
    return found.rollup("severity", "code").agg(F.count("*").alias("n"))


@query()
def html_wellformed(spark, d):
    s = SchemaSet.from_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="html"/></xs:schema>')
    return documents.validate(t(spark, d, "pages").select("page_id", F.col("html").alias("xml")), s).select("page_id", "valid", "n_errors", F.transform("diagnostics", lambda x: x["code"]).alias("codes"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16BE' WHEN 2 THEN 'UTF-16LE' ELSE 'UTF-8' END AS encoding, sha256(html) AS digest FROM pages")
def encoding_detect(spark, d):
    """Pages in four encodings, told apart by their marks, and read back."""
    k, html = F.col("page_id") % 4, F.col("html")
    mark = lambda x: F.unhex(F.lit(x))
    data = F.when(k == 0, F.encode(html, "UTF-8")).when(k == 1, F.concat(mark("FEFF"), F.encode(html, "UTF-16BE"))).when(k == 2, F.concat(mark("FFFE"), F.encode(html, "UTF-16LE"))).otherwise(F.concat(mark("EFBBBF"), F.encode(html, "UTF-8")))
    return t(spark, d, "pages").select("page_id", data.alias("data")).select("page_id", xml.encoding(F.col("data")).alias("encoding"), F.sha2(xml.text(F.col("data")), 256).alias("digest"))


@query("""SELECT CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'XSD1006' WHEN 2 THEN 'XSD1007' ELSE 'ok' END AS code, count(*)::BIGINT AS n FROM (SELECT page_id % 4 AS k FROM pages) GROUP BY 1""")
def encoding_errors(spark, d):
    """Documents of bytes: fine, of an unknown encoding, of bytes that are not UTF-8, and of a declared one-byte encoding."""
    k = F.col("page_id") % 4
    data = F.when(k == 0, F.encode(F.lit("<a>é</a>"), "UTF-8")).when(k == 1, F.encode(F.lit('<?xml version="1.0" encoding="x-none"?><a/>'), "UTF-8")).when(k == 2, F.unhex(F.lit("3C613EE93C2F613E"))).otherwise(F.concat(F.encode(F.lit('<?xml version="1.0" encoding="iso-8859-1"?>'), "UTF-8"), F.unhex(F.lit("3C613EE93C2F613E"))))
    found = documents.validate(t(spark, d, "pages").select("page_id", data.alias("xml")), schema_of('<xs:element name="a" type="xs:string"/>'))
    return found.groupBy(F.coalesce(F.get("diagnostics", F.lit(0))["code"], F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderkey % 60 > 31 THEN 'maxInclusive' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def facet_bounds_duration(spark, d):
    """Days against a month: 28 to 31 days are neither more nor less, and pass."""
    return facet(spark, d, "orders", F.concat(F.lit("P"), (F.col("o_orderkey") % 60).cast("string"), F.lit("D")), Simple("duration").restrict(maxInclusive="P1M"))


@query("SELECT CASE WHEN o_orderkey % 7 <> 0 AND o_orderdate::DATE < DATE '1995-06-17' THEN 'minInclusive' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def facet_bounds_date(spark, d):
    """Dates as instants: a year of five digits is late, though its text comes early."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return facet(spark, d, "orders", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("1"), text)).otherwise(text), Simple("date").restrict(minInclusive="1995-06-17"))


@query("SELECT CASE WHEN round(l_discount * 100) IN (5, 10) THEN 'ok' ELSE 'enumeration' END AS outcome, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def enumeration_double(spark, d):
    """Equal values, however written."""
    return facet(spark, d, "lineitem", F.col("l_discount").cast("decimal(4,2)").cast("string"), Simple("double").restrict(enumeration=("5e-2", "0.1")))


@query("SELECT CASE WHEN abs(v) > 100000000000000000000 THEN 'maxInclusive' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 100000000000000000001::HUGEINT ELSE o_orderkey END AS v FROM orders) GROUP BY 1")
def facet_bounds_big_decimal(spark, d):
    """Decimals beyond any machine number, compared exactly."""
    return facet(spark, d, "orders", F.when(F.col("o_orderkey") % 3 == 0, "100000000000000000000.5").otherwise(F.col("o_orderkey").cast("string")), Simple("decimal").restrict(maxInclusive="100000000000000000000"))


KEYS_XSD = """<xs:element name="lines"><xs:complexType><xs:sequence><xs:element name="line" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:attribute name="q" type="xs:double"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:key name="k"><xs:selector xpath="line"/><xs:field xpath="@q"/></xs:key></xs:element>"""


@query("SELECT l_orderkey, count(*) - count(DISTINCT l_quantity) AS twice FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_quantity)")
def key_equal_values(spark, d):
    """Keys that are equal as numbers are duplicates, however written."""
    q = F.col("l_quantity").cast("int").cast("string")
    line = xml.element("line", "", {"q": F.when(F.col("l_linenumber") % 2 == 0, F.concat(q, F.lit(".0"))).otherwise(F.concat(F.lit("0"), q))})
    docs = t(spark, d, "lineitem").groupBy("l_orderkey").agg(xml.element("lines", F.array_join(F.collect_list(line), "")).alias("xml"))
    found = documents.diagnostics(documents.validate(docs, schema_of(KEYS_XSD))).where("code = 'XSD2014'")
    return found.groupBy("l_orderkey").agg(F.count("*").alias("twice"))


TWO_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:a="urn:a" targetNamespace="urn:a" elementFormDefault="unqualified" version="1.1">
<xs:element name="n" type="xs:int"/><xs:element name="row"><xs:complexType><xs:sequence><xs:element ref="a:n"/><xs:element name="n" type="xs:string"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query("SELECT n_nationkey, n_regionkey AS number, n_name AS name FROM nation")
def decode_ambiguous(spark, d):
    """Two children of one local name: the one with a namespace has its Clark name."""
    row = F.concat(xml.element("a:n", F.col("n_regionkey").cast("string")), xml.element("n", F.col("n_name")))
    docs = t(spark, d, "nation").select("n_nationkey", xml.element("a:row", row, {"xmlns:a": F.lit("urn:a")}).alias("xml"))
    out = documents.decode(docs, SchemaSet.from_text(TWO_XSD), ("urn:a", "row"))
    return out.select("n_nationkey", F.col("decoded").getField("{urn:a}n").alias("number"), F.col("decoded").getField("n").alias("name"))


MIXED_XSD = """<xs:element name="p"><xs:complexType mixed="true"><xs:sequence><xs:element name="b" type="xs:string" minOccurs="0" maxOccurs="unbounded"/><xs:any namespace="##other" processContents="lax" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>"""


@query("SELECT r_regionkey, 'see ' || ' and ' || '.' AS text, [r_name, upper(r_name)] AS bold, '\"' || r_name || '\"' AS extra FROM region")
def decode_mixed(spark, d):
    """Text around children is one text; what a wildcard admits comes along by name."""
    body = F.concat(F.lit("see "), xml.element("b", F.col("r_name")), F.lit(" and "), xml.element("b", F.upper("r_name")), xml.element("x:note", F.col("r_name"), {"xmlns:x": F.lit("urn:x")}), F.lit("."))
    out = documents.decode(t(spark, d, "region").select("r_regionkey", xml.element("p", body).alias("xml")), schema_of(MIXED_XSD), (None, "p"))
    return out.select("r_regionkey", F.col("decoded").getField("$").alias("text"), F.col("decoded.b").alias("bold"), F.col("decoded").getField("*")["{urn:x}note"][0].alias("extra"))


@query("SELECT type, facet, value FROM (VALUES ('Small', 'maxInclusive', '50'), ('Small', 'minInclusive', '1'), ('Small', 'whiteSpace', 'collapse'), ('Flag', 'pattern', '[ANR]'), ('Flag', 'enumeration', 'A'), ('Flag', 'enumeration', 'N'), ('Flag', 'whiteSpace', 'preserve')) v(type, facet, value)")
def type_facets(spark, d):
    """Facets in force, of all steps."""
    s = schema_of("""<xs:simpleType name="Big"><xs:restriction base="xs:int"><xs:minInclusive value="1"/><xs:maxExclusive value="99"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Small"><xs:restriction base="Big"><xs:maxInclusive value="50"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Flag"><xs:restriction base="xs:string"><xs:pattern value="[ANR]"/><xs:enumeration value="A"/><xs:enumeration value="N"/></xs:restriction></xs:simpleType>""")
    return catalog.facets(spark, s).where("type <> 'Big'")


@query("SELECT component, n FROM (SELECT 'elements' AS component, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'types', (SELECT count(*) FROM region) UNION ALL SELECT 'local_elements', (SELECT count(*) FROM region))")
def component_counts(spark, d):
    regions, nations = ([r[0] for r in t(spark, d, n).select(c).collect()] for n, c in (("region", "r_regionkey"), ("nation", "n_nationkey")))
    body = "".join(f'<xs:complexType name="T{i}"><xs:sequence><xs:element name="x" type="xs:int"/></xs:sequence></xs:complexType><xs:element name="R{i}" type="T{i}"/>' for i in regions)
    s = schema_of(body + "".join(f'<xs:element name="N{i}" type="xs:string"/>' for i in nations))
    return catalog.counts(spark, s).where("component in ('elements', 'types', 'local_elements')")


@query("""SELECT valid, count(*)::BIGINT AS n FROM (SELECT try_cast(strftime(o_orderdate::DATE, '%Y-%m-') || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS valid FROM orders) GROUP BY valid""")
def parse_date_validity(spark, d):
    """Days 0 to 32 of real months: those that exist are dates."""
    c = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return t(spark, d, "orders").groupBy(lexical.is_valid(c, "date").alias("valid")).agg(F.count("*").alias("n"))


@query("""SELECT valid, count(*)::BIGINT AS n FROM (SELECT try_cast('2000-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS valid FROM orders) GROUP BY valid""")
def parse_month_day_validity(spark, d):
    c = F.concat(F.lit("--"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return t(spark, d, "orders").groupBy(lexical.is_valid(c, "gMonthDay").alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, rtrim(rtrim(o_totalprice::DECIMAL(18,2)::VARCHAR, '0'), '.') AS canonical FROM orders")
def canonical_decimal(spark, d):
    c = F.concat(F.lit("+00"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("000"))
    return t(spark, d, "orders").select("o_orderkey", lexical.canonical(c, "decimal").alias("canonical"))


@query("""SELECT n, CASE WHEN n = 0 THEN 'PT0S' ELSE 'P' || CASE WHEN n >= 1440 THEN (n // 1440) || 'D' ELSE '' END || CASE WHEN n % 1440 > 0 THEN 'T' ELSE '' END || CASE WHEN n // 60 % 24 > 0 THEN (n // 60 % 24) || 'H' ELSE '' END || CASE WHEN n % 60 > 0 THEN (n % 60) || 'M' ELSE '' END END AS canonical
FROM (SELECT DISTINCT o_orderkey % 5000 AS n FROM orders)""")
def canonical_duration(spark, d):
    """Minutes as days, hours and minutes."""
    n = t(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("n")).distinct()
    return n.select("n", lexical.canonical(F.concat(F.lit("PT"), F.col("n").cast("string"), F.lit("M")), "dayTimeDuration").alias("canonical"))


@query("SELECT k, (k * 100)::VARCHAR AS large, CASE WHEN k = 0 THEN '0' ELSE rtrim(printf('%.5f', k / 100000.0), '0') END AS small FROM (SELECT DISTINCT o_orderkey % 1000 AS k FROM orders)")
def canonical_double(spark, d):
    """Numbers with an exponent, spelled without."""
    k = t(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("k")).distinct()
    text = F.col("k").cast("string")
    return k.select("k", lexical.canonical(F.concat(text, F.lit("E2")), "double").alias("large"), lexical.canonical(F.concat(text, F.lit("e-05")), "double").alias("small"))


@query("""SELECT sign, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 3 = 2 AND abs(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-15 12:00:00')) <= 50400 THEN NULL
ELSE sign(epoch(date_trunc('second', ts)) - CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3600 ELSE 0 END - epoch(TIMESTAMP '2024-01-15 12:00:00'))::INT END AS sign FROM events) GROUP BY sign""")
def temporal_order_zones(spark, d):
    """Instants in two zones, and without one, against an instant: without a zone, half a day and two hours are undecided."""
    k = F.col("event_id") % 3
    c = F.concat(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "+01:00").otherwise(""))
    b = F.lit("2024-01-15T12:00:00Z")
    sign = lexical.compare_instants(lexical.instant(c, "dateTime"), lexical.zoned(c), lexical.instant(b, "dateTime"), lexical.zoned(b))
    return t(spark, d, "events").groupBy(sign.alias("sign")).agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'maxScale' WHEN 1 THEN 'ok' WHEN 2 THEN 'minScale' ELSE 'totalDigits' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def precision_decimal_scale(spark, d):
    """Scale and digits as written, not as valued."""
    k = F.col("o_orderkey") % 4
    whole = (F.col("o_orderkey") % 90 + 10).cast("string")
    c = F.when(k == 0, F.concat(whole, F.lit(".500"))).when(k == 1, F.concat(whole, F.lit(".50"))).when(k == 2, F.concat(whole, F.lit("E1"))).otherwise(F.concat(F.lit("123456"), whole, F.lit(".5")))
    return facet(spark, d, "orders", c, Simple("precisionDecimal").restrict(minScale=0, maxScale=2, totalDigits=6))


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'explicitTimezone' ELSE 'value' END AS outcome, count(*)::BIGINT AS n FROM events GROUP BY 1")
def facet_explicit_timezone(spark, d):
    k = F.col("event_id") % 3
    c = F.concat(F.date_format("ts", "HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "").otherwise("+15:00"))
    return facet(spark, d, "events", c, Simple("time").restrict(explicitTimezone="required"))


@query(r"SELECT CASE WHEN regexp_full_match(text, '[\x00-\x7F\x{80}-\x{FF}]*') THEN 'ok' ELSE 'pattern' END AS outcome, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def pattern_blocks(spark, d):
    return facet(spark, d, "documents", F.col("text"), Simple().restrict((r"(\p{IsBasicLatin}|\p{IsLatin-1Supplement})*",)))


@query("SELECT CASE WHEN regexp_full_match(lower(w), '[b-df-hj-np-tv-z][a-z]*') THEN 'ok' ELSE 'pattern' END AS outcome, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def pattern_subtraction(spark, d):
    """A class less another, and an escape that is a class."""
    w = t(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w"))
    return with_check(w, F.lower("w"), Simple().restrict((r"[a-z-[aeiou]]\c*",)), "outcome").groupBy(F.coalesce("outcome", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'enumeration' WHEN o_orderkey % 3 = 1 THEN 'ok' ELSE 'maxLength' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def list_enumeration(spark, d):
    """Lists are compared item by item, as values."""
    k = F.col("o_orderkey") % 3
    c = F.when(k == 0, "1 3").when(k == 1, " 01   2.0 ").otherwise("1 2 3 4")
    return facet(spark, d, "orders", c, Simple("string", item=Simple("decimal")).restrict(maxLength=3).restrict(enumeration=("1 2", "5")))


def verdicts(df: DataFrame, schemas: SchemaSet, key: str) -> DataFrame:
    """How many documents give each list of codes."""
    found = documents.validate(df, schemas)
    return found.groupBy(F.array_join(F.transform("diagnostics", lambda x: x["code"]), " ").alias("codes")).agg(F.count(key).alias("n"))


REFS_XSD = """<xs:element name="o"><xs:complexType><xs:sequence><xs:element name="l" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:attribute name="id" type="xs:ID"/><xs:attribute name="of" type="xs:IDREF"/><xs:attribute name="n" type="xs:int"/><xs:attribute name="to" type="xs:integer"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:key name="k"><xs:selector xpath="l"/><xs:field xpath="@n"/></xs:key><xs:keyref name="r" refer="k"><xs:selector xpath=".//l"/><xs:field xpath="@to"/></xs:keyref></xs:element>"""


@query("SELECT l_orderkey, least(2, count(*))::BIGINT AS lost_keys, 1::BIGINT AS lost_ids FROM lineitem GROUP BY 1")
def keyrefs_in_documents(spark, d):
    """Each line refers to the second next by key and to the next by ID; the last ones lead nowhere."""
    one = lambda n: xml.element("l", "", {"id": F.concat(F.lit("x"), n.cast("string")), "of": F.concat(F.lit("x"), (n + 1).cast("string")), "n": n, "to": n + 2})
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("m"))
    docs = g.select("l_orderkey", xml.element("o", F.array_join(F.transform(F.sequence(F.lit(1), F.col("m")), one), "")).alias("xml"))
    found = documents.diagnostics(documents.validate(docs, schema_of(REFS_XSD)))
    return found.groupBy("l_orderkey").agg(F.count_if(F.col("code") == "XSD2016").alias("lost_keys"), F.count_if(F.col("code") == "XSD2012").alias("lost_ids"))


PAY_XSD = """<xs:element name="paid" type="xs:decimal" abstract="true"/><xs:element name="cash" substitutionGroup="paid"/><xs:element name="points" type="xs:integer" substitutionGroup="paid"/><xs:element name="check" type="xs:decimal"/>
<xs:element name="order"><xs:complexType><xs:sequence><xs:element ref="paid"/></xs:sequence></xs:complexType></xs:element>"""


@query("SELECT CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'XSD2004' WHEN 3 THEN 'XSD2002 XSD2003' ELSE 'XSD2002 XSD2013 XSD2003' END AS codes, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def substitution_in_documents(spark, d):
    """Members of a group in their head's place, one with a value that is not of its narrower type, an outsider, and the abstract head."""
    k = F.col("o_orderkey") % 5
    body = F.when(k == 0, "<cash>1.5</cash>").when(k == 1, "<points>7</points>").when(k == 2, "<points>7.5</points>").when(k == 3, "<check>1</check>").otherwise("<paid>1</paid>")
    return verdicts(t(spark, d, "orders").select("o_orderkey", xml.element("order", body).alias("xml")), schema_of(PAY_XSD), "o_orderkey")


ANY_XSD = """<xs:element name="known" type="xs:int"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="xs:int"/><xs:any namespace="{}" processContents="{}"/></xs:sequence></xs:complexType></xs:element>"""


@query("""SELECT process, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN CASE process WHEN 'skip' THEN '' ELSE 'XSD2004' END ELSE CASE process WHEN 'strict' THEN 'XSD2001' ELSE '' END END AS codes, count(*)::BIGINT AS n
FROM (SELECT o_orderkey % 3 AS k FROM orders), (VALUES ('strict'), ('lax'), ('skip')) v(process) GROUP BY ALL""")
def wildcard_process(spark, d):
    """A declared element with a good and a bad value, and one that is not declared, under each processContents."""
    k = F.col("o_orderkey") % 3
    body = F.concat(F.lit("<a>1</a>"), F.when(k == 0, "<known>1</known>").when(k == 1, "<known>x</known>").otherwise("<other/>"))
    df = t(spark, d, "orders").select("o_orderkey", xml.element("r", body).alias("xml"))
    outs = [verdicts(df, schema_of(ANY_XSD.format("##local", p)), "o_orderkey").select(F.lit(p).alias("process"), "codes", "n") for p in ("strict", "lax", "skip")]
    return outs[0].union(outs[1]).union(outs[2])


@query("""SELECT version, CASE WHEN k = 0 THEN '' WHEN version = '1.1' AND k = 1 THEN '' ELSE CASE k WHEN 1 THEN 'XSD2002' ELSE 'XSD2002' END END AS codes, count(*)::BIGINT AS n FROM (SELECT o_orderkey % 3 AS k FROM orders), (VALUES ('1.0'), ('1.1')) v(version) GROUP BY ALL""")
def open_content(spark, d):
    """A foreign child behind the content, or within it, where the content is open behind: in 1.1 only."""
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, "<a>1</a><b>2</b>").when(k == 1, '<a>1</a><b>2</b><x xmlns="urn:x"/>').otherwise('<a>1</a><x xmlns="urn:x"/><b>2</b>')
    text = '<xs:element name="r"><xs:complexType><xs:openContent mode="suffix"><xs:any namespace="##other" processContents="skip"/></xs:openContent><xs:sequence><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:int"/></xs:sequence></xs:complexType></xs:element>'
    df = t(spark, d, "orders").select("o_orderkey", xml.element("r", body).alias("xml"))
    outs = [verdicts(df, schema_of(text, version=v), "o_orderkey").select(F.lit(v).alias("version"), "codes", "n") for v in ("1.0", "1.1")]
    return outs[0].union(outs[1])


@query("SELECT version, CASE WHEN (k = 0) = (version = '1.0') THEN '' ELSE 'XSD2004' END AS codes, count(*)::BIGINT AS n FROM (SELECT o_orderkey % 2 AS k FROM orders), (VALUES ('1.0'), ('1.1')) v(version) GROUP BY ALL")
def conditional_inclusion(spark, d):
    """One schema, two readings of an element."""
    text = '<xs:element xmlns:v="http://www.w3.org/2007/XMLSchema-versioning" v:maxVersion="1.1" name="r" type="xs:int"/><xs:element xmlns:v="http://www.w3.org/2007/XMLSchema-versioning" v:minVersion="1.1" name="r" type="xs:boolean"/>'
    df = t(spark, d, "orders").select("o_orderkey", xml.element("r", F.when(F.col("o_orderkey") % 2 == 0, "7").otherwise("true")).alias("xml"))
    outs = [verdicts(df, schema_of(text, version=v), "o_orderkey").select(F.lit(v).alias("version"), "codes", "n") for v in ("1.0", "1.1")]
    return outs[0].union(outs[1])


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'XSD2004' ELSE 'XSD2019' END AS codes, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def fixed_values(spark, d):
    """A fixed value as itself, written otherwise, another, and a nil in its place."""
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, "<v>1.50</v>").when(k == 1, "<v> +01.5 </v>").when(k == 2, "<v>1.51</v>").otherwise('<v xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="true"/>')
    text = '<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="v" type="xs:decimal" fixed="1.5" nillable="true"/></xs:sequence></xs:complexType></xs:element>'
    return verdicts(t(spark, d, "orders").select("o_orderkey", xml.element("r", body).alias("xml")), schema_of(text), "o_orderkey")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'XSD2008' ELSE '' END AS codes, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def xsi_type_blocked(spark, d):
    """An extension where only restrictions may stand, against a restriction and the type itself."""
    k = F.col("o_orderkey") % 3
    text = """<xs:complexType name="B" block="extension"><xs:sequence><xs:element name="a" type="xs:int" minOccurs="0"/></xs:sequence></xs:complexType><xs:complexType name="E"><xs:complexContent><xs:extension base="B"/></xs:complexContent></xs:complexType>
<xs:complexType name="R"><xs:complexContent><xs:restriction base="B"><xs:sequence><xs:element name="a" type="xs:byte" minOccurs="0"/></xs:sequence></xs:restriction></xs:complexContent></xs:complexType><xs:element name="r" type="B"/>"""
    body = {"xmlns:i": F.lit("http://www.w3.org/2001/XMLSchema-instance"), "i:type": F.when(k == 0, "E").when(k == 1, "R").otherwise("B")}
    return verdicts(t(spark, d, "orders").select("o_orderkey", xml.element("r", "<a>1</a>", body).alias("xml")), schema_of(text), "o_orderkey")


@query("SELECT o_orderkey, least(5, 5 + count(l_orderkey))::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def events_early_stop(spark, d):
    """Five events of each document; the rest is not parsed."""
    return documents.events(orders(spark, d), order_schema(), "o_orderkey", most=5, columns=("seq", "kind")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT part, line, depth, count(*)::BIGINT AS n FROM (SELECT unnest([{'part': 'start', 'line': 1, 'depth': 0}, {'part': 'start', 'line': 2, 'depth': 1}, {'part': 'text', 'line': 2, 'depth': 1}, {'part': 'end', 'line': 2, 'depth': 1}, {'part': 'end', 'line': 3, 'depth': 0}], recursive := true) FROM region) GROUP BY ALL""")
def event_lines(spark, d):
    docs = t(spark, d, "region").select("r_regionkey", F.concat(F.lit("<r>\n<a>"), xml.escaped(F.col("r_name")), F.lit("</a>\n</r>")).alias("xml"))
    s = schema_of('<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="xs:string"/></xs:sequence></xs:complexType></xs:element>')
    return documents.events(docs, s, "r_regionkey").groupBy(F.col("kind").alias("part"), "line", "depth").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size AS size, CASE WHEN p_partkey % 2 = 0 THEN 'small' ELSE (p_size / 2.0)::DECIMAL(10,1)::VARCHAR END AS either, [p_size, p_size + 1]::VARCHAR[] AS several FROM part")
def decode_lists_and_unions(spark, d):
    """Values of lists and unions stay canonical text; others have their types."""
    text = """<xs:simpleType name="L"><xs:list itemType="xs:int"/></xs:simpleType><xs:simpleType name="U"><xs:union memberTypes="xs:decimal xs:token"/></xs:simpleType>
<xs:element name="p"><xs:complexType><xs:sequence><xs:element name="size" type="xs:int"/><xs:element name="either" type="U"/><xs:element name="several" type="L"/></xs:sequence></xs:complexType></xs:element>"""
    size = F.col("p_size")
    either = F.when(F.col("p_partkey") % 2 == 0, "  small ").otherwise(F.concat((size / 2).cast("decimal(10,1)").cast("string"), F.lit("00")))
    body = F.concat(xml.element("size", size.cast("string")), xml.element("either", either), xml.element("several", F.concat_ws("  ", size.cast("string"), F.concat(F.lit("+"), (size + 1).cast("string")))))
    out = documents.decode(t(spark, d, "part").select("p_partkey", xml.element("p", body).alias("xml")), schema_of(text), (None, "p"))
    one = F.col("decoded.either")
    return out.select("p_partkey", F.col("decoded.size").cast("int").alias("size"), F.when(one.rlike(r"^\d+$"), F.concat(one, F.lit(".0"))).otherwise(one).alias("either"), F.split("decoded.several", " ").alias("several"))


_SIMPLE = '<xs:simpleType name="{n}"><xs:restriction base="{b}">{f}</xs:restriction></xs:simpleType>'


def _simple(base: str, *facets: str, n: str = "t") -> str:
    return _SIMPLE.format(n=n, b=base, f="".join(f'<xs:{k} value="{v}"/>' for k, _, v in (f.partition("=") for f in facets)))


def _derived(method: str, inner: str, base: str) -> str:
    return f'<xs:complexType name="b">{base}</xs:complexType><xs:complexType name="d"><xs:complexContent><xs:{method} base="b">{inner}</xs:{method}></xs:complexContent></xs:complexType>'


_SEQ = '<xs:sequence><xs:element name="x" type="xs:int"/><xs:element name="y" type="xs:int" minOccurs="0"/></xs:sequence>'
#: Schema documents with the one code that each gives (none: valid), by the rule.
RULES: list[tuple[str, str | None, str]] = [
    ("element unknown", "XSD1003", "<xs:thing/>"), ("name missing", "XSD1004", '<xs:element type="xs:int"/>'), ("block token", "XSD1005", '<xs:element name="a" block="never"/>'), ("annotation late", "XSD1008", '<xs:element name="a"><xs:complexType/><xs:annotation/></xs:element>'),
    ("variety missing", "XSD1009", '<xs:simpleType name="t"/>'), ("location", "XSD1101", '<xs:include schemaLocation="none.xsd"/>'), ("new construct", "XSD1104", '<xs:complexType name="t"><xs:sequence><xs:any notNamespace="urn:x" minOccurs="0"/></xs:sequence></xs:complexType>'),
    ("unresolved", "XSD1201", '<xs:element name="a" type="none"/>'), ("twice", "XSD1202", '<xs:element name="a"/><xs:element name="a"/>'), ("by itself", "XSD1203", _simple("t")), ("two varieties", "XSD1301", '<xs:simpleType name="t"><xs:list itemType="xs:int"/><xs:union memberTypes="xs:int"/></xs:simpleType>'),
    ("occurrence", "XSD1302", '<xs:complexType name="t"><xs:sequence minOccurs="3" maxOccurs="2"/></xs:complexType>'), ("two types", "XSD1303", '<xs:element name="a" type="xs:int"><xs:simpleType><xs:restriction base="xs:int"/></xs:simpleType></xs:element>'),
    ("ambiguous", "XSD1304", '<xs:complexType name="t"><xs:choice><xs:element name="a"/><xs:sequence><xs:element name="a"/><xs:element name="b"/></xs:sequence></xs:choice></xs:complexType>'),
    ("length of a duration", "XSD1305", _simple("xs:duration", "length=2")), ("enumerated boolean", "XSD1305", _simple("xs:boolean", "enumeration=true")), ("bound that is none", "XSD1306", _simple("xs:int", "maxInclusive=x")), ("pattern", "XSD1306", _simple("xs:string", "pattern=a{3,1}")),
    ("length beside maxLength", "XSD1307", _simple("xs:string", "length=2", "maxLength=3")), ("digits", "XSD1307", _simple("xs:decimal", "totalDigits=2", "fractionDigits=3")), ("wider length", "XSD1307", _simple("xs:string", "maxLength=3") + _simple("t", "maxLength=4", n="u")),
    ("wider bound", "XSD1307", _simple("xs:date", "minInclusive=2020-01-01") + _simple("t", "minInclusive=2019-12-31", n="u")), ("nothing between", "XSD1307", _simple("xs:duration", "minInclusive=P2D", "maxInclusive=PT47H")),
    ("default", "XSD1308", '<xs:element name="a" type="xs:int" default="x"/>'), ("default and fixed", "XSD1308", '<xs:element name="a" type="xs:int" default="1" fixed="1"/>'), ("default of an ID", "XSD1308", '<xs:element name="a" type="xs:ID" default="i"/>'),
    ("final", "XSD1309", _derived("extension", "", _SEQ).replace('name="b"', 'name="b" final="extension"')), ("final list", "XSD1309", _simple("xs:int").replace('name="t"', 'name="t" final="list"') + '<xs:simpleType name="l"><xs:list itemType="t"/></xs:simpleType>'),
    ("other child", "XSD1310", _derived("restriction", '<xs:sequence><xs:element name="z" type="xs:int"/></xs:sequence>', _SEQ)), ("child missing", "XSD1310", _derived("restriction", '<xs:sequence><xs:element name="y" type="xs:int"/></xs:sequence>', _SEQ)),
    ("more often", "XSD1310", _derived("restriction", '<xs:sequence><xs:element name="x" type="xs:int" maxOccurs="2"/></xs:sequence>', _SEQ)), ("other type", "XSD1310", _derived("restriction", '<xs:sequence><xs:element name="x" type="xs:string"/></xs:sequence>', _SEQ)),
    ("narrower", None, _derived("restriction", '<xs:sequence><xs:element name="x" type="xs:short"/></xs:sequence>', _SEQ)), ("narrower bound", None, _simple("xs:int", "maxExclusive=9") + _simple("t", "maxInclusive=5", n="u")), ("extension", None, _derived("extension", '<xs:sequence><xs:element name="z"/></xs:sequence>', _SEQ)),
    ("left out", None, '<xs:element xmlns:v="http://www.w3.org/2007/XMLSchema-versioning" v:minVersion="1.1" name="a" type="none"/>'),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(n, f"'{c}'" if c else "NULL") for n, c, _ in RULES) + ") v(rule, code)")
def schema_rules_by_code(spark, d):
    """A table of schema documents, each compiled in a worker: the codes it gives."""
    df = spark.createDataFrame([(n, f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{x}</xs:schema>') for n, _, x in RULES], "rule string, xsd string")
    found = catalog.diagnose(df).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("code")), " ").alias("code"))
    return df.select("rule").join(found, "rule", "left")


def _values(rows: list[tuple], *names: str) -> str:
    """SQL for constant rows."""
    def lit(x: object) -> str:
        if x is None or isinstance(x, bool):
            return {None: "NULL", True: "true", False: "false"}[x]
        return f"{x}::INT" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({', '.join(names)})"


#: Lexical forms by type: accepted ones, and refused ones.
LEXICAL = {
    "boolean": ("true false 1 0", "TRUE yes t 2"), "decimal": ("1. .5 +1.00 -0 007", ". 1e3 1,0 INF"), "integer": ("+7 -0 007 99999999999999999999", "1.0 1e3 - 0x1"), "nonNegativeInteger": ("0 -0 5", "-1"), "negativeInteger": ("-1", "0 -0"), "byte": ("127 -128 +5", "128 -129"),
    "unsignedByte": ("255 0", "256 -1"), "short": ("32767", "32768"), "int": ("2147483647 -2147483648", "2147483648"), "long": ("9223372036854775807", "9223372036854775808"), "unsignedLong": ("18446744073709551615", "18446744073709551616 -1"),
    "float": ("1e5 INF -INF NaN .5 -0", "inf Infinity 0x1p3 +INF 1e"), "double": ("1E-300 12.", "1d e5 nan"), "date": ("2024-02-29 2024-12-01Z -0001-01-01 12024-01-01 2024-01-01+14:00", "2023-02-29 24-01-01 2024-1-1 2024-01-01+14:01 0000-01-01 02024-01-01"),
    "time": ("24:00:00 00:00:00.123 23:59:59Z", "24:00:01 23:59:60 7:00:00"), "dateTime": ("2024-12-31T24:00:00 2024-02-29T00:00:00.5-05:00", "2024-12-31 2024-12-31T25:00:00 2024-02-30T00:00:00"), "dateTimeStamp": ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00"),
    "gYear": ("2024 -0044 12024Z", "24 0000"), "gYearMonth": ("2024-02 2024-12Z", "2024-13 2024-2"), "gMonth": ("--02 --12Z", "-02 --13"), "gDay": ("---05 ---31", "---32 --05"), "gMonthDay": ("--02-29 --12-25", "--02-30 --04-31 02-29"),
    "duration": ("P1Y P1Y2M3DT4H5M6.5S PT0S -P1D", "P 1Y PT P1S P1.5D P-1D"), "yearMonthDuration": ("P14M -P1Y", "P1D PT1S"), "dayTimeDuration": ("PT36H P1DT0.5S", "P1M P1Y"), "hexBinary": ("0A ff", "0 0g"), "base64Binary": ("YWJj YWI= YQ==", "YW=j YWJ YR=="),
    "language": ("en en-GB x-klingon", "en_GB toolonglanguage 1a"), "Name": ("a:b _x é", "1a -b"), "NCName": ("a.b-c _1", "a:b 1a"), "NMTOKEN": ("1a -b a:b", "a,b a/b"), "QName": ("p:a a", "a:b:c :a p:"), "anyURI": ("http://x/y?a=1 #", ""), "precisionDecimal": ("1.50 15E-1 INF -INF NaN", "x 1E Inf"),
}
_LEXICAL = [(k, v, ok) for k, both in LEXICAL.items() for ok, vs in zip((True, False), both) for v in vs.split()]


@query(_values(_LEXICAL, "type", "lexical", "valid"))
def lexical_spaces(spark, d):
    """Accepted and refused forms of the built-in types, by the Column checks."""
    df = spark.createDataFrame([x[:2] for x in _LEXICAL], "type string, lexical string")
    parts = [df.where(F.col("type") == k).select("type", "lexical", lexical.is_valid(F.col("lexical"), k).alias("valid")) for k in LEXICAL]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


_CANONICAL = [("decimal", "-0.500", "-0.5"), ("decimal", "+.5", "0.5"), ("integer", "+007", "7"), ("int", "-0", "0"), ("double", "1.5E3", "1500"), ("double", "-INF", "-INF"), ("float", "0.1", "0.1"), ("boolean", "1", "true"), ("dateTime", "2024-01-01T24:00:00", "2024-01-02T00:00:00"),
              ("dateTime", "2024-12-31T24:00:00Z", "2025-01-01T00:00:00Z"), ("dateTime", "2024-01-01T00:00:00.000-00:00", "2024-01-01T00:00:00Z"), ("time", "24:00:00", "00:00:00"), ("time", "13:45:06.50+02:00", "13:45:06.5+02:00"), ("date", "2024-03-01+00:00", "2024-03-01Z"), ("yearMonthDuration", "P14M", "P1Y2M"),
              ("dayTimeDuration", "PT36H", "P1DT12H"), ("duration", "-P0Y400D", "-P400D"), ("duration", "P0D", "PT0S"), ("gMonthDay", "--12-25-00:00", "--12-25Z"), ("hexBinary", "0fb7", "0FB7"), ("base64Binary", "aG Vs bG8=", "aGVsbG8="), ("gYear", "-0044", "-0044")]


@query(_values(_CANONICAL, "type", "lexical", "canonical"))
def canonical_forms(spark, d):
    df = spark.createDataFrame([x[:2] for x in _CANONICAL], "type string, lexical string")
    by = F.coalesce(*(F.when(F.col("type") == k, lexical.canonical(F.col("lexical"), k)) for k in dict.fromkeys(x[0] for x in _CANONICAL)))
    return df.select("type", "lexical", by.alias("canonical"))


_ORDER = [("decimal", "1.0", "1.00", 0), ("decimal", "-0.5", "0.5", -1), ("decimal", "100000000000000000000000000000000000001", "99999999999999999999999999999999999999", 1), ("double", "NaN", "1", None), ("double", "-INF", "INF", -1), ("double", "1.5E3", "1500", 0),
          ("dateTime", "2024-01-01T12:00:00Z", "2024-01-01T13:00:00+01:00", 0), ("dateTime", "2024-01-01T12:00:00", "2024-01-01T12:00:00Z", None), ("dateTime", "2024-01-01T12:00:00", "2025-01-01T12:00:00Z", -1), ("date", "12024-01-01", "2024-01-01", 1), ("gMonthDay", "--12-25", "--12-25Z", None),
          ("gDay", "---05", "---31", -1), ("time", "12:00:00Z", "12:00:00+01:00", 1), ("duration", "P1M", "P30D", None), ("duration", "P1M", "P32D", -1), ("duration", "PT25H", "P1D", 1), ("duration", "P1Y", "P12M", 0), ("gYear", "-0044", "0044", -1)]


@query(_values(_ORDER, "type", "a", "b", "sign"))
def value_order(spark, d):
    """Pairs in order, equal, or not comparable."""
    rows = [spark.createDataFrame([x[:3]], "type string, a string, b string").select("type", "a", "b", compare(F.col("a"), Simple(x[0]), x[2]).cast("int").alias("sign")) for x in _ORDER]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


_PATTERNS = [("a.b$", "axb$", True), ("a.b$", "a\nb$", False), ("[a-z-[aeiou]]+", "xyz", True), ("[a-z-[aeiou]]+", "xay", False), ("[a-z-[^b]]", "b", True), ("[a-z-[^b]]", "c", False), (r"\d{2,3}", "12", True), (r"\d{2,3}", "1234", False), (r"\d", "٣", True), (r"\i\c*", "_a1.", True), (r"\i\c*", "1a", False),
             (r"[\D]+", "ab", True), (r"[\D]+", "a1", False), (r"\p{Lu}\P{Lu}*", "Abc", True), (r"\p{Lu}\P{Lu}*", "ABc", False), (r"\p{IsGreek}+", "αβγ", True), (r"\p{IsGreek}+", "abc", False), (r"\p{IsNowhere}", "x", True), (r"a|b", "ab", False), ("(ab)?c", "abc", True), (r"\s\S", " x", True), (r"\w+", "aé9", True), (r"\w", "-", False), ("", "", True)]


@query(_values(_PATTERNS, "pattern", "value", "matches"))
def pattern_language(spark, d):
    rows = [spark.createDataFrame([(p, v)], "pattern string, value string").withColumn("matches", check(F.col("value"), Simple().restrict((p,))).isNull()) for p, v, _ in _PATTERNS]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


_FILES = {"base.xsd": '<xs:element name="rope" type="Length"/><xs:simpleType name="Length"><xs:restriction base="xs:int"/></xs:simpleType><xs:group name="g"><xs:sequence><xs:element name="a"/></xs:sequence></xs:group>', "far.xsd": None, "loop.xsd": '<xs:include schemaLocation="loop.xsd"/><xs:element name="loop" type="xs:int"/>'}
_COMPOSED = [
    ("include takes on the namespace", '<xs:include schemaLocation="base.xsd"/>', '<rope xmlns="urn:n">5</rope>', "", ""), ("included twice", '<xs:include schemaLocation="base.xsd"/><xs:include schemaLocation="base.xsd"/>', '<rope xmlns="urn:n">x</rope>', "", "XSD2004"), ("includes itself", '<xs:include schemaLocation="loop.xsd"/>', '<loop xmlns="urn:n">1</loop>', "", ""),
    ("override", '<xs:override schemaLocation="base.xsd"><xs:simpleType name="Length"><xs:restriction base="xs:boolean"/></xs:simpleType></xs:override>', '<rope xmlns="urn:n">5</rope>', "", "XSD2004"), ("redefine", '<xs:redefine schemaLocation="base.xsd"><xs:simpleType name="Length"><xs:restriction base="Length"><xs:maxInclusive value="4"/></xs:restriction></xs:simpleType></xs:redefine>', '<rope xmlns="urn:n">5</rope>', "", "XSD2004"),
    ("redefined element", '<xs:redefine schemaLocation="base.xsd"><xs:element name="rope"/></xs:redefine>', '<rope xmlns="urn:n">5</rope>', "XSD1003", ""), ("included from elsewhere", '<xs:include schemaLocation="far.xsd"/>', "<x/>", "XSD1102", "XSD2001"), ("imported as another", '<xs:import namespace="urn:o" schemaLocation="far.xsd"/>', '<f xmlns="urn:far">1</f>', "XSD1103", ""),
    ("imported", '<xs:import namespace="urn:far" schemaLocation="far.xsd"/>', '<f xmlns="urn:far">x</f>', "", "XSD2004"), ("nowhere", '<xs:include schemaLocation="none.xsd"/>', "<x/>", "XSD1101", "XSD2001"), ("import is a hint", '<xs:import namespace="urn:z" schemaLocation="none.xsd"/>', "<x/>", "XSD1101", "XSD2001"),
]


@query(_values([(n, a, b) for n, _, _, a, b in _COMPOSED], "name", "schema_codes", "document_codes"))
def composition(spark, d):
    """Schemas of several documents, by a resolver: what they give, and what a document gets."""
    whole = lambda body, target: f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"{target}>{body}</xs:schema>'

    def resolver(place: str, _: str | None) -> tuple[str, bytes]:
        body = _FILES[place]
        return place, (whole(body, "") if body is not None else whole('<xs:element name="f" type="xs:int"/>', ' targetNamespace="urn:far"')).encode()

    rows = []
    for n, body, doc, _, _ in _COMPOSED:
        model, told = load_string(whole(body, ' xmlns="urn:n" targetNamespace="urn:n"'), resolver=resolver, version="1.1")
        rows.append((n, " ".join(x.code for x in told), " ".join(x.code for x in model.validate(doc).diagnostics)))
    return spark.createDataFrame(rows, "name string, schema_codes string, document_codes string")


_MODELS = [("sequence", "a b? c*", "a c c", True), ("sequence", "a b? c*", "b", False), ("sequence", "a{2,3}", "a a", True), ("sequence", "a{2,3}", "a a a a", False), ("choice", "a b", "b", True), ("choice", "a b", "a b", False), ("all", "a b?", "b a", True), ("all", "a b?", "b", False), ("sequence", "a{0,100} b", "a a a b", True), ("sequence", "", "", True), ("sequence", "", "a", False)]


@query(_values(_MODELS, "kind", "model", "names", "accepted"))
def content_models(spark, d):
    """Children against small content models, by their automata."""
    def item(x: str) -> str:
        name, low, high = x[0], 1, 1
        if x[1:]:
            low, high = {"?": (0, 1), "*": (0, "unbounded"), "+": (1, "unbounded")}.get(x[1:]) or x[2:-1].split(",")
        return f'<xs:element name="{name}" type="xs:int" minOccurs="{low}" maxOccurs="{high}"/>'

    out = None
    for kind, model, names, _ in _MODELS:
        s = schema_of(f'<xs:complexType name="T"><xs:{kind}>{"".join(map(item, model.split()))}</xs:{kind}></xs:complexType>')
        df = spark.createDataFrame([(kind, model, names)], "kind string, model string, names string").withColumn("list", F.filter(F.split("names", " "), lambda x: x != ""))
        one = documents.accepts(df, s, (None, "T"), "list").drop("list")
        out = one if out is None else out.union(one)
    return out


@query("SELECT n_nationkey, n_name AS name, n_regionkey::INT AS region, CASE WHEN n_nationkey % 2 = 0 THEN DATE '2024-01-01' + n_nationkey::INT END AS since, [n_nationkey::INT, n_regionkey::INT] AS numbers, 'n' || n_nationkey AS root FROM nation")
def decode_single_documents(spark, d):
    """One document after the other on the driver, as Python values."""
    model = Model(schema_of('<xs:element name="nation"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="since" type="xs:date" nillable="true"/><xs:element name="n" type="xs:int" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="region" type="xs:byte"/></xs:complexType></xs:element>'))
    rows = []
    for k, name, region in t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        day = (date(2024, 1, 1) + timedelta(days=k)).isoformat() if k % 2 == 0 else None
        text = f'<nation region="{region}"><name>{name}</name>' + (f"<since>{day}</since>" if day else '<since xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="true"/>') + f"<n>{k}</n><n> +{region} </n></nation>"
        ((root, got),) = model.decode(text, root=True).items()
        rows.append((k, got["name"], got["@region"], got["since"], got["n"], root[0] + str(got["n"][0])))
    return spark.createDataFrame(rows, "n_nationkey int, name string, region int, since date, numbers array<int>, root string")


@query("SELECT 'R' || r_regionkey AS type, count(n_nationkey)::INT AS children, min('N' || lpad(n_nationkey::VARCHAR, 2, '0')) AS first, 'B' AS base, true AS accepts_all, count(n_nationkey) <= 1 AS accepts_one, (count(n_nationkey) + 3)::INT AS lines FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def model_of_regions(spark, d):
    """A type a region, a child a nation: what the model tells of them."""
    rows = t(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.format_string("N%02d", F.col("n_nationkey").cast("int")))).alias("names")).collect()
    own = lambda names: "".join(f'<xs:element name="{n}" type="xs:int"/>' for n in names)
    m = Model(schema_of('<xs:complexType name="B"><xs:attribute name="a" use="required"/></xs:complexType>' + "".join(f'<xs:complexType name="R{r}"><xs:complexContent><xs:extension base="B"><xs:sequence>{own(names)}</xs:sequence></xs:extension></xs:complexContent></xs:complexType><xs:element name="e{r}" type="R{r}"/>' for r, names in rows)))
    out = []
    for x in m.types.values():
        if x.local_name != "B":
            names = [c.local_name for c in x]
            out.append((x.local_name, len(x), names[0], x.base.local_name, x.accepts(names), x.accepts(names[:1]), len(m["e" + x.local_name[1:]].tree().splitlines()) + 1 if x.attributes[0].required else -1))
    return spark.createDataFrame(out, "type string, children int, first string, base string, accepts_all boolean, accepts_one boolean, lines int")


@query("SELECT 45::BIGINT AS codes, 9 + 4 + 3 + 10 AS schema_codes, 19::BIGINT AS document_codes")
def diagnostic_codes(spark, d):
    c = catalog.codes(spark)
    return c.agg(F.count("*").alias("codes"), F.count_if(F.col("code") < "XSD2000").cast("int").alias("schema_codes"), F.count_if(F.col("code") > "XSD2000").alias("document_codes"))


@query("""SELECT name, base FROM (VALUES ('token', 'normalizedString'), ('normalizedString', 'string'), ('NCName', 'Name'), ('Name', 'token'), ('ID', 'NCName'), ('byte', 'short'), ('unsignedByte', 'unsignedShort'), ('negativeInteger', 'nonPositiveInteger'), ('positiveInteger', 'nonNegativeInteger'),
('yearMonthDuration', 'duration'), ('dateTimeStamp', 'dateTime'), ('IDREFS', 'anySimpleType'), ('precisionDecimal', 'anyAtomicType'), ('string', 'anyAtomicType'), ('anyAtomicType', 'anySimpleType'), ('anySimpleType', 'anyType')) v(name, base)""")
def builtin_bases(spark, d):
    """Bases as the model's types have them."""
    m = Model(schema_of(""))
    names = ["token", "normalizedString", "NCName", "Name", "ID", "byte", "unsignedByte", "negativeInteger", "positiveInteger", "yearMonthDuration", "dateTimeStamp", "IDREFS", "precisionDecimal", "string", "anyAtomicType", "anySimpleType"]
    return spark.createDataFrame([(n, m.type(XSD, n).base.local_name) for n in names], "name string, base string")
