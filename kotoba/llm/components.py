"""Connected components of a graph given by its edges, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b): root is the smallest id of its component. Labels pass along edges
    and then jump to the label of their label, so the rounds are few; each is written, so its joins split skew."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        passed = written(labels.join(near, "id", "left").select("id", F.col("root").alias("was"), F.least("root", "near").alias("now")), "passed")
        if passed.where("now < was").isEmpty():
            return labels
        jump = passed.select(F.col("id").alias("now"), F.col("now").alias("there"))
        labels = written(passed.join(jump, "now", "left").select("id", F.least("now", "there").alias("root")), "labels")
