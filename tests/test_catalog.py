from xylem.operators import catalog


def test_closure_of_chains_and_cycles(spark):
    """Least depths, also where a longer way is found first, and a plan that does not grow with the rounds before."""
    chain = [(i, i + 1) for i in range(100)]
    cycle = [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)]
    short = [(0, 40), (2000, 2000), (3000, None), (None, 3001)]
    edges = chain + cycle + short
    on = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            on.setdefault(a, set()).add(b)
    want = set()
    for a in {a for a, _ in edges if a is not None}:
        at, seen, depth = {a}, set(), 0
        while at:
            want |= {(a, x, depth) for x in at}
            seen |= at
            at, depth = {y for x in at for y in on.get(x, ())} - seen, depth + 1
    out = catalog.closure(spark.createDataFrame(edges, "m long, p long"), "m", "p")
    assert len(out._jdf.queryExecution().toString()) < 30_000
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_closure_below_the_checkpoint_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: str(tmp_path))
    out = catalog.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "m string, p string"), "m", "p")
    assert sorted(map(tuple, out.collect())) == sorted((x, "abc"[("abc".index(x) + d) % 3], d) for x in "abc" for d in range(3))
    assert any(tmp_path.glob("closures/*/*.parquet"))
