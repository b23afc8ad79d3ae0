import os

import duckdb
import pytest

from xylem import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for x in os.listdir(SF):
        con.execute(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{SF}/{x}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name in queries.SQL:
        r = duck.execute(queries.SQL[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows == sorted(repr(tuple(x[cols.index(c)] for c in sorted(cols))) for x in r.fetchall())
    else:
        assert rows


def test_streaming(spark, tmp_path):
    from xylem.streaming import documents

    (tmp_path / "in").mkdir()
    for i, body in enumerate(("<a>1</a>", "<a>x</a>", "<a")):
        (tmp_path / "in" / f"{i}.xml").write_text(body)
    s = queries.SchemaSet.from_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a" type="xs:int"/></xs:schema>')
    documents.write(documents.validated(documents.read_stream(spark, str(tmp_path / "in")), s), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    assert sorted(r.valid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, False, True]
