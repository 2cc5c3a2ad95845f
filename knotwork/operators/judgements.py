"""The graph of match decisions.

An edge row is (target, source, judgement, score, user, created_at, deleted_at); a row without ``deleted_at`` is live.
Operations return new edge tables or change sets; nothing is changed in place. Timestamps are ISO strings, compared as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions.text import squeeze
from knotwork.operators.components import label_components

POSITIVE, NEGATIVE, UNSURE, UNDECIDED = "positive", "negative", "unsure", "no_judgement"
COLUMNS = ["target", "source", "judgement", "score", "user", "created_at", "deleted_at"]


def weight(identifier: Column) -> Column:
    """3 for a Wikidata item, 2 for a minted canonical id, 1 for any other id."""
    return F.when(identifier.rlike(r"^Q\d+$"), 3).when(identifier.startswith("NK-"), 2).otherwise(1)


def rank(identifier: Column) -> Column:
    """Order of identifiers: by weight, then by the string."""
    return F.struct(weight(identifier).alias("weight"), identifier.alias("id"))


def order(identifier: Column) -> Column:
    """The same order as one string, which is cheap to compare."""
    return F.concat(weight(identifier).cast("string"), identifier)


def is_canonical(identifier: Column) -> Column:
    return weight(identifier) > 1


def merge(left: Column, right: Column) -> Column:
    """The judgement on a chain of two: positive twice is positive, positive and negative is negative, else unsure."""
    both = F.array_sort(F.array(left, right))
    return F.when((left == POSITIVE) & (right == POSITIVE), POSITIVE).when(both == F.array(F.lit(NEGATIVE), F.lit(POSITIVE)), NEGATIVE).otherwise(UNSURE)


def paired(edges: DataFrame) -> DataFrame:
    """Edges with the greater end as target, judgements in lower case, without loops and repeated rows."""
    swap = order(F.col("source")) > order(F.col("target"))
    ends = edges.where(F.col("source") != F.col("target")).select(
        F.when(swap, F.col("source")).otherwise(F.col("target")).alias("target"),
        F.when(swap, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.lower(squeeze(F.col("judgement"))).alias("judgement"),
        *COLUMNS[3:],
    )
    return ends.distinct()


def live(edges: DataFrame) -> DataFrame:
    """One row per pair: of its live rows the last created (equal times: the greater judgement, score and user)."""
    rows = paired(edges).where("deleted_at IS NULL").drop("deleted_at")
    last = F.max(F.struct("created_at", "judgement", "score", "user"))
    return rows.groupBy("target", "source").agg(last.alias("e")).select("target", "source", "e.judgement", "e.score", "e.user", "e.created_at")


def clusters(edges: DataFrame) -> DataFrame:
    """(node, label): the groups of live positive edges."""
    return label_components(live(edges).where(F.col("judgement") == POSITIVE).select(F.col("source").alias("a"), F.col("target").alias("b")))


def linker(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(node, canonical_id, head): canonical_id is the greatest member if that is canonical, else the node itself; head is
    the greatest member in any case. found: the clusters of the edges, if they are known."""
    found = clusters(edges) if found is None else found
    heads = found.groupBy("label").agg(F.max(rank(F.col("node"))).alias("top"))
    joined = found.join(heads, "label")
    return joined.select("node", F.when(F.col("top.weight") > 1, F.col("top.id")).otherwise(F.col("node")).alias("canonical_id"), F.col("top.id").alias("head"))


def canonicals(links: DataFrame) -> DataFrame:
    """(canonical_id) of clusters that have one."""
    return links.where(is_canonical(F.col("head"))).select(F.col("head").alias("canonical_id")).distinct()


def referents(links: DataFrame, *, with_canonicals: bool = True) -> DataFrame:
    """(canonical_id, referent): the other members of each canonical's cluster."""
    rows = links.where(is_canonical(F.col("head")) & (F.col("node") != F.col("head")))
    if not with_canonicals:
        rows = rows.where(~is_canonical(F.col("node")))
    return rows.select(F.col("head").alias("canonical_id"), F.col("node").alias("referent"))


def _labelled(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (left, right) with the labels (ll, rl) of their clusters; an id without links is its own."""
    out = pairs
    for side in ("left", "right"):
        out = out.join(found.select(F.col("node").alias(side), F.col("label").alias(side[0] + "l")), side, "left").withColumn(side[0] + "l", F.coalesce(side[0] + "l", side))
    return out


def spanning(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Live edges with the labels of the clusters of their ends, lesser first."""
    rows = _labelled(live(edges).withColumnsRenamed({"source": "left", "target": "right"}), found)
    return rows.withColumnsRenamed({"left": "source", "right": "target"}).withColumns({"x": F.least("ll", "rl"), "y": F.greatest("ll", "rl")}).drop("ll", "rl")


def judge(pairs: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(left, right, judgement) of pairs with the decisions between their clusters taken in.

    One id or one cluster: positive; two Wikidata items: negative; else a negative or unsure edge between the clusters
    (the least word, if there are several); else no judgement. found: the clusters of the edges, if they are known.
    """
    found = clusters(edges) if found is None else found
    blockers = spanning(edges, found).where(F.col("judgement").isin(NEGATIVE, UNSURE) & (F.col("x") != F.col("y"))).groupBy("x", "y").agg(F.min("judgement").alias("blocker"))
    rows = _labelled(pairs.select("left", "right").distinct(), found).withColumns({"x": F.least("ll", "rl"), "y": F.greatest("ll", "rl")}).join(blockers, ["x", "y"], "left")
    two_items = (weight(F.col("left")) == 3) & (weight(F.col("right")) == 3)
    verdict = F.when((F.col("left") == F.col("right")) | (F.col("ll") == F.col("rl")), POSITIVE).when(two_items, NEGATIVE).otherwise(F.coalesce("blocker", F.lit(UNDECIDED)))
    return rows.select("left", "right", verdict.alias("judgement"))


def resolved_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(left, right, target, source, judgement): some live edge between the clusters of each pair, the least by ends."""
    found = clusters(edges)
    least = spanning(edges, found).groupBy("x", "y").agg(F.min(F.struct("target", "source", "judgement")).alias("e"))
    rows = _labelled(pairs.select("left", "right").distinct(), found).withColumns({"x": F.least("ll", "rl"), "y": F.greatest("ll", "rl")})
    return rows.join(least, ["x", "y"]).select("left", "right", "e.target", "e.source", "e.judgement")


def suggestions(edges: DataFrame) -> DataFrame:
    return live(edges).where(F.col("judgement") == UNDECIDED)


def candidates(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(target, source, score): suggestions on which there is no judgement yet, best first."""
    open_ = judge(suggestions(edges).select(F.col("source").alias("left"), F.col("target").alias("right")), edges).where(F.col("judgement") == UNDECIDED)
    rows = suggestions(edges).join(open_.select(F.col("left").alias("source"), F.col("right").alias("target")), ["source", "target"], "left_semi")
    ordered = rows.select("target", "source", "score").orderBy(F.desc_nulls_last("score"), "target", "source")
    return ordered if limit is None else ordered.limit(limit)


def next_pair(edges: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """The best suggestion to review next; ignored: pairs (target, source), in either order, that a reviewer has put off."""
    rows = candidates(edges)
    if ignored is not None:
        put_off = ignored.select("target", "source").unionByName(ignored.select(F.col("source").alias("target"), F.col("target").alias("source"))).distinct()
        rows = rows.join(put_off, ["target", "source"], "left_anti")
    return rows.orderBy(F.desc_nulls_last("score"), "target", "source").limit(1)


def recent(edges: DataFrame, limit: int) -> DataFrame:
    """The last decisions."""
    return live(edges).where(F.col("judgement") != UNDECIDED).orderBy(F.desc("created_at"), "target", "source").limit(limit)


def suggest(edges: DataFrame, scored: DataFrame, *, now: str, user: str) -> DataFrame:
    """The live edges after suggesting pairs (left, right, score): decided pairs stay, open ones get the score."""
    swap = order(F.col("left")) > order(F.col("right"))
    ends = scored.where("left <> right").select(F.when(swap, F.col("left")).otherwise(F.col("right")).alias("target"), F.when(swap, F.col("right")).otherwise(F.col("left")).alias("source"), F.col("score").alias("new"))
    fresh = ends.groupBy("target", "source").agg(F.max("new").alias("new"))
    joined = live(edges).join(fresh, ["target", "source"], "full")
    open_ = F.col("judgement").isNull() | (F.col("judgement") == UNDECIDED)
    return joined.select(
        "target",
        "source",
        F.coalesce("judgement", F.lit(UNDECIDED)).alias("judgement"),
        F.when(open_ & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("score")).alias("score"),
        F.coalesce("user", F.lit(user)).alias("user"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
    )


def minted(identifier: Column) -> Column:
    """A canonical id that the least member of a group always gets."""
    return F.concat(F.lit("NK-"), F.substring(F.sha2(identifier, 256), 1, 22))


def _write(edges: DataFrame, fresh: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """All rows: live rows of the pairs in ``gone`` or ``fresh`` are closed, then ``fresh`` is added."""
    fresh = fresh.where("target <> source").groupBy("target", "source").agg(F.max(F.struct("judgement", "score", "user", "created_at")).alias("e"))
    fresh = fresh.select("target", "source", "e.judgement", "e.score", "e.user", "e.created_at", F.lit(None).cast("string").alias("deleted_at"))
    closed = gone.select("target", "source").unionByName(fresh.select("target", "source")).distinct().withColumn("closed", F.lit(True))
    kept = paired(edges).join(closed, ["target", "source"], "left")
    kept = kept.withColumn("deleted_at", F.when(F.col("closed") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at"))).select(*COLUMNS)
    return kept.unionByName(fresh)


def _ends(left: Column, right: Column) -> list[Column]:
    swap = order(left) > order(right)
    return [F.when(swap, left).otherwise(right).alias("target"), F.when(swap, right).otherwise(left).alias("source")]


def decide(edges: DataFrame, decisions: DataFrame, *, now: str, user: str) -> DataFrame:
    """All rows after a batch of decisions (left, right, judgement).

    A positive decision whose merged group has a canonical id is written as it is; else one is minted for the group and both
    ends are linked to it in place of each other. Any written pair supersedes its live row.
    """
    rows = decisions.where("left <> right").select("left", "right", "judgement").distinct()
    positive = rows.where(F.col("judgement") == POSITIVE)
    before = live(edges).where(F.col("judgement") == POSITIVE).select(F.col("source").alias("a"), F.col("target").alias("b"))
    found = label_components(before.unionByName(positive.select(F.col("left").alias("a"), F.col("right").alias("b"))))
    group = found.groupBy("label").agg(F.max(rank(F.col("node"))).alias("top"), F.min("node").alias("least"))
    head = found.join(group, "label").select(F.col("node").alias("left"), F.when(F.col("top.weight") > 1, F.lit(None)).otherwise(minted(F.col("least"))).alias("mint"))
    placed = positive.join(head, "left")
    stamp = [F.lit(None).cast("double").alias("score"), F.lit(user).alias("user"), F.lit(now).alias("created_at")]
    direct = placed.where("mint IS NULL").select(*_ends(F.col("left"), F.col("right")), F.lit(POSITIVE).alias("judgement"), *stamp)
    through = placed.where("mint IS NOT NULL")
    linked = through.select(F.explode(F.array("left", "right")).alias("end"), "mint").select(*_ends(F.col("end"), F.col("mint")), F.lit(POSITIVE).alias("judgement"), *stamp)
    other = rows.where(F.col("judgement") != POSITIVE).select(*_ends(F.col("left"), F.col("right")), "judgement", *stamp)
    return _write(edges, direct.unionByName(linked).unionByName(other), through.select(*_ends(F.col("left"), F.col("right"))), now)


def remove(edges: DataFrame, nodes: DataFrame, *, now: str) -> DataFrame:
    """All rows after closing every live edge that touches a node (node)."""
    ids = nodes.select("node").distinct()
    touching = paired(edges).where("deleted_at IS NULL")
    gone = touching.join(ids.withColumnRenamed("node", "target"), "target", "left_semi").unionByName(touching.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").select(*touching.columns))
    return _write(edges, gone.select("target", "source", "judgement", "score", "user", "created_at").limit(0), gone, now)


def explode(edges: DataFrame, nodes: DataFrame, *, now: str) -> tuple[DataFrame, DataFrame]:
    """All rows after dissolving the clusters of nodes, and the ids affected (node)."""
    found = clusters(edges)
    labels = found.join(nodes.select("node"), "node", "left_semi").select("label").distinct()
    affected = found.join(labels, "label", "left_semi").select("node").unionByName(nodes.select("node")).distinct()
    return remove(edges, affected, now=now), affected


def rename(edges: DataFrame, old: str, new: str, *, now: str) -> tuple[DataFrame, int]:
    """All rows after giving an id another name, and the number of live edges changed; an edge of the two vanishes."""
    if old == new:
        return paired(edges), 0
    touching = live(edges).where((F.col("target") == old) | (F.col("source") == old))
    name = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    named = touching.select(name("target").alias("target"), name("source").alias("source"), "judgement", "score", "user").distinct()
    fresh = named.select(*_ends(F.col("target"), F.col("source")), "judgement", "score", "user", F.lit(now).alias("created_at"))
    return _write(edges, fresh, touching, now), touching.count()


def prune(edges: DataFrame, *, now: str, cutoff: str) -> DataFrame:
    """The live edges after pruning, with the same groups.

    Suggestions are dropped. A positive edge whose target is not canonical is replaced by links of both ends to the group's
    canonical id, if it has one. A positive edge between two canonical ids created before ``cutoff`` is dropped, and the
    other edges of its source go to the group's canonical id.
    """
    rows = live(edges).where(F.col("judgement") != UNDECIDED)
    links = linker(edges).select("node", "canonical_id")
    attached = rows.join(links.withColumnRenamed("node", "target"), "target", "left")
    loose = (F.col("judgement") == POSITIVE) & ~is_canonical(F.col("target")) & is_canonical(F.coalesce("canonical_id", F.lit("")))
    loose = F.coalesce(loose, F.lit(False))
    stamp = ["judgement", "score", "user", F.lit(now).alias("created_at")]
    straight = attached.where(loose).select(F.explode(F.array("target", "source")).alias("end"), "canonical_id", "judgement", "score", "user")
    straight = straight.where("end <> canonical_id").select(*_ends(F.col("end"), F.col("canonical_id")), *stamp)
    kept = attached.where(~loose).drop("canonical_id").unionByName(straight.select("target", "source", "judgement", "score", "user", "created_at"))
    kept = kept.groupBy("target", "source").agg(F.max(F.struct("created_at", "judgement", "score", "user")).alias("e")).select("target", "source", "e.*")

    old = (F.col("judgement") == POSITIVE) & is_canonical(F.col("source")) & is_canonical(F.col("target")) & (F.col("created_at") < cutoff)
    merges = kept.where(old)
    moved = merges.select("source").distinct().join(links.select(F.col("node").alias("source"), "canonical_id"), "source").where("source <> canonical_id").withColumnsRenamed({"source": "node", "canonical_id": "to"})
    rest = kept.where(~old)
    for end in ("target", "source"):
        rest = rest.join(moved.withColumnsRenamed({"node": end, "to": f"{end}_to"}), end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).withColumn("moved" + end, F.col(f"{end}_to").isNotNull()).drop(f"{end}_to")
    changed = F.col("movedtarget") | F.col("movedsource")
    rest = rest.where("target <> source").select(*_ends(F.col("target"), F.col("source")), "judgement", "score", "user", F.when(changed, F.lit(now)).otherwise(F.col("created_at")).alias("created_at"))
    return rest.groupBy("target", "source").agg(F.max(F.struct("created_at", "judgement", "score", "user")).alias("e")).select("target", "source", "e.judgement", "e.score", "e.user", "e.created_at")


def refreshed(found: DataFrame, edges: DataFrame, since: str) -> DataFrame:
    """(node, label): clusters brought up to date after changes since a time: only groups that a change touches are rebuilt.

    Labels of untouched groups stay; groups with a changed edge, on either side, are labelled anew from live edges.
    """
    changed = paired(edges).where((F.col("created_at") > since) | (F.col("deleted_at") > since))
    touched = changed.select(F.explode(F.array("target", "source")).alias("node")).distinct()
    stale = found.join(touched, "node", "left_semi").select("label").distinct()
    affected = found.join(stale, "label", "left_semi").select("node").unionByName(touched).distinct()
    positive = live(edges).where(F.col("judgement") == POSITIVE).select(F.col("source").alias("a"), F.col("target").alias("b"))
    redo = positive.join(affected.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(positive.join(affected.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
    return found.join(stale, "label", "left_anti").select("node", "label").unionByName(label_components(redo))


def conflicting_matches(scores: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(candidate, left, right): ids that match two ids judged negative with each other.

    scores: (left, right, score). The two are joined through live negative edges, not by pairing all matches of an id.
    """
    strong = scores.where(F.col("score") > threshold)
    both = strong.select(F.col("left").alias("candidate"), F.col("right").alias("match")).unionByName(strong.select(F.col("right").alias("candidate"), F.col("left").alias("match"))).distinct()
    found = clusters(edges)
    label = lambda side: found.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    named = both.join(label("match"), "match", "left").withColumn("match_label", F.coalesce("match_label", "match"))
    walls = spanning(edges, found).where(F.col("judgement") == NEGATIVE).select("x", "y").where("x <> y").distinct()
    left = named.select("candidate", F.col("match").alias("left"), F.col("match_label").alias("x"))
    right = named.select("candidate", F.col("match").alias("right"), F.col("match_label").alias("y"))
    met = left.join(walls, "x").join(right, ["candidate", "y"])
    return met.select("candidate", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def history(edges: DataFrame) -> DataFrame:
    """Every row with its number among the rows of its pair, oldest first."""
    window = W.partitionBy("target", "source").orderBy("created_at", "judgement", F.asc_nulls_first("deleted_at"))
    return paired(edges).withColumn("step", F.row_number().over(window))
