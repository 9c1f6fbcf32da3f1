"""Connected components over a table of links, by minimum labels with pointer jumping.

Labels live in tables of the shared folder, never on the driver. Each pass costs joins on the links that still
connect different labels, so later passes shrink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import Workspace


def label_components(ws: Workspace, nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, component) with the smallest node of each component.

    ``nodes`` has ``node`` and may have ``component`` from earlier links; ``links`` has ``a`` and ``b``.
    """
    has = "component" in nodes.columns
    labels = nodes.select("node", F.col("component") if has else F.col("node").alias("component")).distinct()
    if not has:
        labels = ws.save(labels, f"{name}-start")
    to = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    edges = links.join(to("a"), "a").join(to("b"), "b").where("ca != cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct()
    edges = ws.save(edges, f"{name}-edges")
    if edges.isEmpty():
        return labels
    both = edges.union(edges.select("y", "x"))
    roots = ws.save(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("root")), f"{name}-r0")
    step = 0
    while True:
        step += 1
        at = roots.select(F.col("x").alias("y"), F.col("root").alias("other"))
        seen = both.join(at, "y").groupBy("x").agg(F.min("other").alias("m"))
        lower = roots.join(seen, "x").select("x", "root", F.least("root", "m").alias("low"))
        up = roots.select(F.col("x").alias("low"), F.col("root").alias("above"))
        new = ws.save(lower.join(up, "low", "left").select("x", F.coalesce(F.least("low", "above"), "low").alias("root"), (F.col("root") != F.coalesce(F.least("low", "above"), "low")).alias("moved")), f"{name}-r{step}")
        changed = not new.where("moved").isEmpty()
        ws.drop(f"{name}-r{step - 1}")
        roots = new.select("x", "root")
        if not changed:
            break
    joined = labels.join(roots.select(F.col("x").alias("component"), "root"), "component", "left")
    return ws.save(joined.select("node", F.coalesce("root", "component").alias("component")), name)
