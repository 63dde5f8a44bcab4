"""Connected components by repeated contraction along random minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Component roots of an undirected graph given as long columns ``a``, ``b``.

    Each round every node joins the neighbour (or itself) with the smallest
    hash, the hash changing per round, and edges are rewritten between the
    chosen nodes. A constant fraction of the nodes goes per round in
    expectation whatever the shape of the graph (chains, stars), so the number
    of rounds is logarithmic. The choice is a partial ``min`` aggregate and the
    rewrites are equi-joins, so no neighbourhood is ever gathered in one task.
    Only the emptiness of the remaining edges reaches the driver.

    Returns one row (node, root) per node that has an edge; the root is some
    node of the component. Self loops and repeated edges are allowed. An empty
    edge table gives an empty result.
    """
    live = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct())
    maps = []
    for round_no in range(max_rounds):
        if live.isEmpty():
            break

        def rank(c, r=round_no):
            return F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("id"))

        both = live.select("a", rank("b").alias("to")).union(live.select(F.col("b").alias("a"), rank("a").alias("to")))
        chosen = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("to").alias("to"))
                             .select("node", F.least(F.col("to"), rank("node"))["id"].alias("parent")))
        maps.append(chosen)
        pa = chosen.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = chosen.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        live = cut_lineage(live.join(pa, "a").join(pb, "b").where("pa <> pb")
                           .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = maps[-1].select("node", F.col("parent").alias("root"))
    for chosen in reversed(maps[:-1]):
        nxt = root.select(F.col("node").alias("parent"), "root")
        root = chosen.join(nxt, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return root
