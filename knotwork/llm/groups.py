"""Consolidating pairwise decisions into groups.

Method: the component of the highest-degree vertex is peeled off by frontier breadth-first joins and anti-joined away;
the remaining components are labelled by minimum propagation. Propagation works on a graph that shrinks: each round a
vertex takes the least vertex of its closed neighbourhood in a round-dependent pseudo-random order, one pointer jump
follows, and links are rewritten to labels, so a chain of n vertices needs a number of rounds in the order of log n.
A peeled component deeper than ``peel_depth`` is contracted to one vertex and finished by propagation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import squeeze
from knotwork.operators.components import both_ways, label_components, simple_links
from knotwork.session import Scratch


def live_links(decisions: DataFrame) -> DataFrame:
    """Pairs (a < b) whose last live decision is positive.

    Live rows have no ``deleted_at``. Of all live rows on a pair, in either direction, the greatest ``created_at``
    decides (null is least; decisions of one moment: the greater word in byte order). Rows with a null end and links of
    an id to itself are left out; repeated rows change nothing; other columns are ignored.
    """
    live = decisions.where(F.col("deleted_at").isNull() & (F.col("source") != F.col("target")))
    word = F.lower(squeeze(F.col("judgement")))
    keyed = live.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("created_at").cast("string").alias("at"), word.alias("judgement"))
    return keyed.groupBy("a", "b").agg(F.max_by("judgement", F.struct("at", "judgement")).alias("judgement")).where(F.col("judgement") == "positive").select("a", "b")


def components(links: DataFrame, peel_depth: int = 16) -> DataFrame:
    """(node, label) of every vertex of an undirected graph (a, b): vertices share a label exactly if linked.

    Only counts and one vertex reach the driver. Loops and repeated links are allowed; an empty graph gives no rows.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "groups")
    links = scratch.keep(simple_links(links))
    top = both_ways(links).groupBy("u").count().orderBy(F.desc("count"), "u").select("u").head()
    if top is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label"))

    # peel the component of the highest-degree vertex
    reached = frontier = spark.createDataFrame([(top.u,)], "node string")
    ended = False
    for _ in range(peel_depth):
        beyond = both_ways(links).join(frontier, F.col("u") == F.col("node"), "left_semi").select(F.col("v").alias("node")).distinct()
        frontier, fresh = scratch.keep_counted(beyond.join(reached, "node", "left_anti"))
        if not fresh:
            ended = True
            break
        reached = reached.unionByName(frontier)
    reached = scratch.keep(reached)
    if ended:
        rest = links.join(reached.select(F.col("node").alias("a")), "a", "left_anti")
    else:
        at = lambda end: F.when(F.col(f"in_{end}"), F.lit(top.u)).otherwise(F.col(end))
        marked = links
        for end in "ab":
            marked = marked.join(reached.select(F.col("node").alias(end), F.lit(True).alias(f"in_{end}")), end, "left")
        rest = marked.select(at("a").alias("a"), at("b").alias("b"))
    labels = reached.select("node", F.lit(top.u).alias("label"))

    # label what is left by minimum propagation over contracted links
    mapping = label_components(rest, finish=0)
    if ended:
        return labels.unionByName(mapping)
    moved = mapping.where(F.col("node") == top.u).select("label").head()
    merged = labels.withColumn("label", F.lit(moved.label if moved else top.u))
    return merged.unionByName(mapping.where(F.col("node") != top.u))


def consolidate(decisions: DataFrame, peel_depth: int = 16) -> DataFrame:
    """(node_id, group_id): every id with a positive link to another id, and the least id of its group in byte order."""
    found = components(live_links(decisions), peel_depth)
    least = found.groupBy("label").agg(F.min("node").alias("group_id"))
    return found.join(least, "label").select(F.col("node").alias("node_id"), "group_id")
