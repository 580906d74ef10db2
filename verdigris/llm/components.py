"""Connected components of a table of edges, by alternating large-star and
small-star steps: each is one aggregation and one join, so no component has to
fit in a task.  Nodes with a large share of all edges are joined by broadcast,
as there can only be few of them, and their edges stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import stored

#: A hub has more than this share of a table's ends of edges (and more ends than ``HUB_ENDS``), so there are less than
#: 1 / HUB_SHARE hubs, whose broadcast takes a few MB at any size.
HUB_SHARE, HUB_ENDS = 1 / 50_000, 256


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Stored (node, root) for every node of ``edges`` (a, b; any orderable
    type, loops allowed); the root is the component's least node."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    loops, now = now.where("a = b"), now.where("a != b")
    while not _is_forest_of_stars(now):
        busy = max(HUB_ENDS, int(2 * now.count() * HUB_SHARE))
        now = stored(_star(_star(now, True, busy), False, busy).distinct(), name)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stored(now.toDF("node", "root").unionByName(roots).unionByName(loops.toDF("node", "root"))
                  .groupBy("node").agg(F.min("root").alias("root")), name)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """No node has two edges down, and none both an edge down and one up."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")),
                                         F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return each.where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _star(edges: DataFrame, larger_only: bool, busy: int) -> DataFrame:
    """Edges a > b in, edges a > b out.  Large-star joins each node's larger
    neighbours to its least neighbour; small-star its smaller ones and itself.
    Nodes with more than ``busy`` edges are hubs."""
    both = edges
    if larger_only:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = (both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
             .select(F.col("a").alias("u"), F.least("a", "least").alias("m"), "n"))
    hubs, here = F.broadcast(least.where(F.col("n") > busy)), F.col("a") == F.col("u")
    others = both.join(hubs, here, "left_anti").join(least.where(F.col("n") <= busy), here)
    moved = both.join(hubs, here).unionByName(others)
    if larger_only:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b")
