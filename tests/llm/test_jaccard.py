import random

import numpy as np
import pytest

from xylem.llm import jaccard


def say(n):
    return " ".join(f"word{random.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("block", [3, 2048])
def test_near_duplicates_of_a_mixed_posting(spark, monkeypatch, block):
    """A group of edits of one text, on both sides of the bound: its postings hold many components, and are cut into blocks."""
    monkeypatch.setattr(jaccard.crossing, "__defaults__", (block,))
    r = random.Random(5)
    base = say(80).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:30]) + " " + say(50)) for i in range(40)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, x.lower().split()) for i, x in rows)}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if root[j] < root[i] and 100 * len(a & b) >= 75 * len(a | b):
                    root[i], changed = root[j], True
    out = {x.doc_id: x.component_id for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert out == root and len(set(root.values())) > 41


def test_bitmaps():
    """The bits apart never exceed the n-grams apart, whatever the lengths of the two bitmaps."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    sets = [r.integers(0, 2**63, k).astype(np.uint64) for k in (1, 5, 100, 140, 400, 3000, 9000)]
    sets += [np.concatenate([s[: len(s) // 2], r.integers(0, 2**63, 30).astype(np.uint64)]) for s in sets]
    size = np.array([len(s) for s in sets])
    maps = jaccard.Bitmaps(pa.array(jaccard.bitmaps(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), size), pa.binary()))
    x, y = (k.ravel() for k in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = maps.apart(x, y)
    exact = np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(x, y, strict=True)])
    assert (apart <= exact).all() and (apart[x == y] == 0).all() and (apart[exact > 100] > 50).all()
