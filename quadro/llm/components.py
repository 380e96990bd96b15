"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadro.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of links (u, v) the smallest node of its component.

    Each round hooks every node to its smallest neighbour if that is smaller, follows
    the hooks to their ends by pointer jumping, and keeps the links between different
    ends. Every round at least halves the nodes that still have links; no component is
    ever gathered in one place. Null ends are ignored.
    """
    links = links.where("u is not null and v is not null and u <> v")
    links = stage(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    known: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = stage(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stage(hooks.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        u = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        v = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        links = stage(links.join(u, "u").join(v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        if known is None:
            known = hooks
        else:
            on = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            known = stage(known.join(on, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
    return known if known is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))
