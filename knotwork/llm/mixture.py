"""Mixing sources to target weights.

Method: hierarchical budgeting. Documents lie in a tree of domain, source and language; the token budget goes down the tree
by weights, a node that cannot use its budget (its tokens times its permitted repeats) passes the shortage to its siblings
first, and only what a whole family cannot use goes to the parent's siblings. By default the budget is the greatest with which
every source reaches its target, so that no source is short; a greater one may be asked for, and then sources with a cap fall
below their targets and the others rise above them, siblings first. Each leaf's budget becomes whole epochs and a prefix of one
more, in an order seeded per epoch. Prefixes are cut on sums per range of the order, then per part of the one range that holds
the cut, and only the last part is looked at document by document.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.session import Scratch, spread

#: Where the vocabulary of a public tokenizer lies.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The word pattern that byte-level vocabularies of this kind are made for. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges of the seeded order per leaf, and parts of the range that holds a cut.
RANGES = 4096
#: Languages by the codes in use. Fixed values.
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "ell": "el", "gre": "el", "ara": "ar", "hin": "hi", "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th"}


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str, most: int = 20_000) -> Iterator[str]:
    """A text in pieces that end before white space, so that very long texts take linear time and little memory."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end > at + most // 2 and not (text[end].isspace() and not text[end - 1].isspace()):
            end -= 1
        yield text[at:end]
        at = end
    yield text[at:]


def _counter(path: str):
    """path: the vocabulary as sent with the job, by its name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(path)).encode_ordinary
        for batch in batches:
            sizes = [sum(len(encode(p)) for p in _pieces(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return count


def language(code: F.Column | str):  # noqa: ANN201
    """A language code as two lower-case letters, ``und`` where it is none."""
    plain = F.lower(F.trim(F.col(code) if isinstance(code, str) else code))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(plain.isin(*set(LANGUAGES.values())), plain).otherwise(F.coalesce(known[plain], F.lit("und")))


@dataclass
class Node:
    """A node of the tree: its weight among its siblings and, for a leaf, the tokens it can give."""

    weight: float
    tokens: int = 0
    repeats: int = 1
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children.values()) if self.children else float(self.tokens * self.repeats)

    def spread(self, budget: float) -> float:
        """Give a budget to the subtree; what it cannot use comes back."""
        if not self.children:
            self.budget = min(budget, self.capacity())
            return budget - self.budget
        given = dict.fromkeys(self.children, 0.0)
        open_ = {k for k, c in self.children.items() if c.weight > 0 and c.capacity() > 0}
        left = budget
        while left > 1e-9 and open_:
            total = sum(self.children[k].weight for k in open_)
            want = {k: given[k] + left * self.children[k].weight / total for k in open_}
            full = {k for k in open_ if want[k] >= self.children[k].capacity() - 1e-9}
            if not full:
                given.update(want)
                left = 0.0
                break
            for k in full:
                left -= self.children[k].capacity() - given[k]
                given[k] = self.children[k].capacity()
            open_ -= full
        for k, c in self.children.items():
            c.spread(given[k])
        return max(0.0, left)


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, tokens) of documents with a source and a text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.where("source IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", language("lang").alias("lang"), "text")
    documents.sparkSession.sparkContext.addFile(tokenizer)  # so that no executor needs the folder
    return spread(rows).mapInArrow(_counter(os.path.basename(tokenizer)), f"doc_id {kind}, source string, lang string, tokens bigint")


def budgets(leaves: list[tuple[str, str, int]], targets: list[tuple[str, str, float, int]], total: float | None, temperature: float = 1.0) -> dict[tuple[str, str], float]:
    """Tokens for each (source, language). leaves: (source, language, tokens); targets: (domain, source, share, repeats).

    total: tokens of the mixture; by default the most with which each source that has any reaches its share of it.
    temperature: languages of a source have their tokens to this power as weights; below 1 rare languages count more.
    """
    root = Node(1.0)
    by_source: dict[str, dict[str, int]] = {}
    for source, lang, tokens in leaves:
        by_source.setdefault(source, {})[lang] = by_source.get(source, {}).get(lang, 0) + tokens
    for domain, source, share, repeats in targets:
        node = Node(share, repeats=repeats)
        node.children = {lang: Node(float(tokens) ** temperature, tokens, repeats) for lang, tokens in by_source.get(source, {}).items()}
        if node.capacity() <= 0:
            continue
        family = root.children.setdefault(domain, Node(0.0))
        family.weight += share
        family.children[source] = node
    sources = [node for family in root.children.values() for node in family.children.values() if node.weight > 0]
    weights = sum(node.weight for node in sources)
    root.spread(total if total is not None else min((node.capacity() * weights / node.weight for node in sources), default=0.0))
    return {(source, lang): leaf.budget for family in root.children.values() for source, node in family.children.items() for lang, leaf in node.children.items()}


def _cut(rows: DataFrame, part: str, before: str) -> DataFrame:
    """(source, lang, part, before) of the part of each leaf's order in which its prefix ends, from one sum per leaf and part."""
    sums = rows.groupBy("source", "lang", part).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first(before).alias("b"))
    through = F.expr(f"b + SUM(t) OVER (PARTITION BY source, lang ORDER BY {part} ROWS UNBOUNDED PRECEDING)")
    ends = sums.withColumn("through", through).where("through > rest").groupBy("source", "lang").agg(F.min_by(F.struct(part, (F.col("through") - F.col("t")).alias("before")), part).alias("c"))
    return F.broadcast(ends.select("source", "lang", F.col(f"c.{part}").alias(f"cut_{part}"), F.col("c.before").alias(f"before_{part}")))  # one row per leaf


def mixture(documents: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER, domain: str | None = None, temperature: float = 1.0) -> DataFrame:
    """(doc_id, source, lang, tokens, copies): how often each document is used; documents not used are left out.

    targets: (source, target_share, max_repeats), shares in any unit; domain: a column of it that groups sources; total and
    temperature: see ``budgets``; a total of ``math.inf`` is that of all documents of the sources. A leaf gets the documents of the seeded order as long as at least half of each fits its budget. Defined cases: documents without a source, text
    or doc_id belong to none; sources without target are not used; null ``max_repeats`` is one, null or negative shares are
    none; a source given twice counts with its greatest share; a repeated doc_id counts as several documents; equal places
    in the order: the lesser doc_id; an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixture")
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"),
        F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"),
        F.min(F.col(domain).cast("string") if domain else F.lit("all")).alias("domain"),
    )
    goal_rows = [(r.domain, r.source, r.share, r.repeats) for r in goals.collect()]  # one row per source with a target
    wanted = F.broadcast(goals.select("source"))
    docs = scratch.keep(sized(documents.join(wanted, "source", "left_semi"), tokenizer).where("tokens > 0"))
    leaf = docs.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()  # sources with a target times known languages
    whole = float(sum(r.tokens for r in leaf)) if total == math.inf else total
    budget = budgets([(r.source, r.lang, r.tokens) for r in leaf], goal_rows, whole, temperature)
    plan = []
    for r in leaf:
        b = budget.get((r.source, r.lang), 0.0)
        epochs = min(int(b // r.tokens), 10**6) if r.tokens else 0
        plan.append((r.source, r.lang, epochs, float(b - epochs * r.tokens)))
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("epochs", T.IntegerType()), T.StructField("rest", T.DoubleType())])
    leaves = F.broadcast(spark.createDataFrame(plan, schema))
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    bits = int(math.log2(RANGES))
    placed = docs.join(leaves, ["source", "lang"]).withColumn("order", order).withColumn("range", F.shiftrightunsigned("order", 64 - bits)).withColumn("before", F.lit(0.0))
    marked = placed.join(_cut(placed, "range", "before"), ["source", "lang"], "left")
    inside = marked.where("range = cut_range").withColumn("part", F.shiftrightunsigned("order", 64 - 2 * bits) % RANGES)
    inside = inside.join(_cut(inside, "part", "before_range"), ["source", "lang"], "left")
    last = inside.where("part = cut_part").withColumn("through", F.expr("before_part + SUM(tokens) OVER (PARTITION BY source, lang ORDER BY `order`, doc_id ROWS UNBOUNDED PRECEDING)"))
    out = ["doc_id", "source", "lang", "tokens"]
    once = lambda chosen: (F.col("epochs") + F.when(F.col("rest") > 0, F.when(chosen, 1).otherwise(0)).otherwise(0)).alias("copies")
    used = marked.where("cut_range IS NULL OR range <> cut_range").select(*out, once(F.col("cut_range").isNull() | (F.col("range") < F.col("cut_range"))))
    used = used.unionByName(inside.where("cut_part IS NULL OR part <> cut_part").select(*out, once(F.col("cut_part").isNull() | (F.col("part") < F.col("cut_part")))))
    return used.unionByName(last.select(*out, once(F.col("through") - F.col("tokens") / 2 <= F.col("rest")))).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share) that a mixture reaches."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = got.agg(F.sum("tokens")).scalar()
    joined = targets.select("source", "target_share").join(got, "source", "left")
    return joined.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("share"))
