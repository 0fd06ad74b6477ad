"""Connected components of a table of links, by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.workspace import Workspace, files_of

#: Labels that move in a round are broadcast up to this number of rows (16 bytes each), and joined beyond it over
#: SALTS copies, so that no label's members lie in one task.
BROADCAST_ROWS, SALTS = 100_000, 16


def spread(table: DataFrame, key: str, moves: DataFrame, to: str, by: str = "id") -> DataFrame:
    """table with the column `to` of moves (root, to) where key is root; key may be one value in most rows,
    which `by` tells apart."""
    if moves.count() <= BROADCAST_ROWS:
        return table.join(F.broadcast(moves), F.col(key) == F.col("root"), "left").drop("root")
    salted = table.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = moves.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
    return salted.join(copies, (F.col(key) == F.col("root")) & (F.col("salt") == F.col("copy")), "left").drop("root", "salt", "copy")


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id of its component.

    Each round takes the least label among the neighbours of the ids that carry a label, gives it
    to that label, and lets every id jump to the label of its label; rounds are few, as distances
    to the root shrink by half. The links themselves are never rewritten, so a node has no more rows
    than links, and all aggregates combine before their exchange. Only labels that moved are joined by
    component; links to one id of very many are split by adaptive execution's skew join.
    """
    files = files_of(links.count())

    def save(table: DataFrame, step: str) -> DataFrame:
        return work.save(table, f"{name}-{step}", small=True, files=files)

    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = save(both, "links")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "0")
    n = 0
    while True:
        n += 1
        there = labels.select(F.col("id").alias("b"), F.col("component").alias("lb"))
        least = both.join(there, "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("near"))
        seen = save(labels.join(least, "id").select("id", "component", "near"), f"{n}-near")
        hooks = save(seen.where("near < component").groupBy(F.col("component").alias("root")).agg(F.min("near").alias("to")), f"{n}-hooks")
        if hooks.isEmpty():
            return labels
        moved = spread(seen, "component", hooks, "to").select("id", F.least("component", F.coalesce("to", "component"), "near").alias("component"))
        moved = save(moved, f"{n}-moved")
        roots = moved.where("id != component").select(F.col("id").alias("root"), F.col("component").alias("to"))
        used = moved.where("id != component").select(F.col("component").alias("root")).distinct()
        roots = save(roots.join(used, "root", "left_semi"), f"{n}-roots")
        labels = save(spread(moved, "component", roots, "to").select("id", F.coalesce("to", "component").alias("component")), f"{n}")
