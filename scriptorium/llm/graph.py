"""Connected components of an edge table, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scratch


def _targets(edges: DataFrame) -> DataFrame:
    """``u`` of every node of hi > lo edges, and the least (``m``) and largest (``high``) of what it hangs on: the other end
    of edges whose ``hi`` it is, itself where it is a ``lo``."""
    ends = F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("lo").alias("v"))))
    return edges.select(ends.alias("e")).groupBy("e.u").agg(F.min("e.v").alias("m"), F.max("e.v").alias("high"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node that has an edge (columns a, b); the component is its smallest node.

    Each round joins every node's neighbours to the smallest of them; rounds grow with the logarithm of the nodes.  They
    end when every node hangs on one node only, which hangs on itself.  Edges with a null end and loops are ignored;
    repeated edges count once; no edges give no rows.
    """
    with scratch(edges.sparkSession):
        now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "edges")
        while True:
            least = durable(_targets(now), "targets")
            if least.where("m <> high").isEmpty():
                return durable(least.select(F.col("u").alias("id"), F.col("m").alias("component")), "components", keep=True)
            # Only from its smaller end does an edge take its larger end to that end's least neighbour.
            large = durable(now.join(least.select("u", "m"), now["lo"] == least["u"]).select("hi", F.col("m").alias("lo")), "large-stars")
            smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
            moved = large.join(smallest, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            now = durable(moved.select("e.hi", "e.lo").where("hi <> lo").distinct(), "stars")
