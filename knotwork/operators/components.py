"""Connected components by minimum propagation over a shrinking graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.session import Scratch


def both_ways(links: DataFrame) -> DataFrame:
    """(u, v) of an undirected (a, b), once for each direction."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return links.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def simple_links(links: DataFrame) -> DataFrame:
    """Links as a < b, each once, without loops."""
    return links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Links that one task can label by itself.
FINISH = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, l) of the ends of links (a, b) that are all in this task: l is the least vertex that is connected with u."""
    parent: dict = {}

    def root(v):  # noqa: ANN001, ANN202
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(v) for v in parent], kind)], names=["u", "l"])


def label_components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, label) of every vertex with a link to another: vertices share a label exactly if they are connected.

    Each round a vertex takes the least vertex of its closed neighbourhood, in an order that a hash draws anew every round,
    one pointer jump follows, and links are rewritten to labels. The graph shrinks by a factor each round, so a chain of n
    vertices takes a number of rounds in the order of log n. Minima are combined before each shuffle, and a vertex with very
    many links is split by the adaptive skew join. What is left of at most ``finish`` links, counted, is labelled in one task.
    An empty graph gives no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    rest, left = scratch.keep_counted(simple_links(links))
    if not left:
        return rest.select(F.col("a").alias("node"), F.col("a").alias("label"))
    moves: list[DataFrame] = []
    while left > finish:
        order = _order(len(moves))
        least = both_ways(rest).groupBy("u").agg(F.min(order("v")).alias("m"))
        least = least.select("u", F.least(F.col("m"), order("u"))["v"].alias("l"))
        jump = scratch.keep(least.join(least.select(F.col("u").alias("l"), F.col("l").alias("to")), "l").select("u", F.col("to").alias("l")))
        moves.append(jump)
        ends = rest
        for end in "ab":
            ends = ends.join(jump.select(F.col("u").alias(end), F.col("l").alias(f"l{end}")), end)
        after, left = scratch.keep_counted(simple_links(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))))
        scratch.drop(rest)
        rest = after
    # each round moved the labels of the one before it; the last rounds are the smallest tables
    if left:
        kind = rest.schema["a"].dataType.simpleString()
        moves.append(scratch.keep(rest.coalesce(1).mapInArrow(_united, f"u {kind}, l {kind}")))
    mapping = moves[-1]
    for move in reversed(moves[:-1]):
        mapping = move.join(mapping.select(F.col("u").alias("l"), F.col("l").alias("to")), "l", "left").select("u", F.coalesce("to", "l").alias("l"))
    return mapping.select(F.col("u").alias("node"), F.col("l").alias("label"))


def _order(turn: int):
    def order(vertex: str) -> Column:
        return F.struct(F.xxhash64(vertex, F.lit(turn)).alias("h"), F.col(vertex).alias("v"))

    return order
