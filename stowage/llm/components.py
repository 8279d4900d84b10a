"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, forget


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node that links reach.

    In each round a node moves to the smallest of itself and its neighbours, and the links move
    with their ends; those that become loops or repeat go. Every node beside a smaller one moves,
    so that a chain of n links needs about log n rounds and a star one, and what is left of the
    links shrinks from round to round. A node with very many links is pre-aggregated before the
    shuffle, and few moves are broadcast to the links. Links with a null end and loops are dropped;
    an empty table gives an empty table. The links must be cheap to read several times.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    labels, old = None, []
    while edges.limit(1).count():
        both = edges.union(edges.select("v", "u"))
        moves = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to")))
        step = bounded(moves)
        moved = edges.join(step.select(F.col("node").alias("u"), F.col("to").alias("to_u")), "u").select("v", "to_u").join(step.select(F.col("node").alias("v"), F.col("to").alias("to_v")), "v").where("to_u <> to_v")
        nearer = cut(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
            labels.cut_path = moves.cut_path
        else:
            found = cut(labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            old += [moves, labels]
            labels = found
        forget(*old)
        edges, old = nearer, [nearer]
    forget(*old)
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component"))) if labels is None else labels


def relabelled(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows, whose column comp moves to the component that ``of`` (node, component) has for it."""
    found = rows.join(bounded(of), rows["comp"] == of["node"], "left")
    return found.select(*(F.coalesce("component", "comp").alias(c) if c == "comp" else c for c in rows.columns))
