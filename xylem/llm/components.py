"""Connected components of a link table, without collecting links or labels.

Links may come twice, in either direction, or lead from an id to itself; ids in no other
link are in no component.  Links with a null end join nothing.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id that each linked id reaches.

    Minimum labels travel along the links, with one pointer jump a round; each round's labels are written to the
    shared folder.  Ends when no label changes, so results hold for any graph; long chains take about log2 rounds.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = written(both.union(both.select("y", "x")).distinct())
    labels = written(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("y"), "root"), "y").groupBy(F.col("x").alias("id")).agg(F.min("root").alias("m"))
        low = labels.join(near, "id").select("id", F.least("root", "m").alias("next"), "root")
        up = labels.select(F.col("id").alias("next"), F.col("root").alias("top"))
        # the root of the new label is a label of this round too, so one jump halves the way
        new = written(low.join(up, "next").select("id", F.least("next", "top").alias("root"), (F.col("root") != F.least("next", "top")).alias("moved")))
        labels = new.select("id", "root")
        if new.where("moved").isEmpty():
            return labels
