"""Command line: thin functions over the DataFrame operators. Files are Parquet unless a name says otherwise."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import blocking as B
from knotwork.operators import enrich as E
from knotwork.operators import judgements as J
from knotwork.operators import matching as M
from knotwork.operators import statements as S
from knotwork.operators import tokens as T
from knotwork.operators import training as R
from knotwork.sources import formats


def _session() -> SparkSession:
    return SparkSession.builder.appName("knotwork").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _edges(spark: SparkSession, path: str) -> DataFrame:
    return formats.load_edges(spark, path) if path.endswith((".ijson", ".json", ".jsonl", ".txt")) else spark.read.parquet(path)


def xref(args: argparse.Namespace) -> None:
    """Score candidate pairs of statements and write suggestions and merges."""
    spark = _session()
    rows = formats.read_statements(spark, args.statements, args.format)
    found = M.xref(S.assemble(rows), T.tokenise(rows), _edges(spark, args.edges), scorer=M.algorithm(args.algorithm), limit=args.limit, auto_threshold=args.auto_threshold, focus=args.focus, schema=args.schema)
    found.write.mode("overwrite").parquet(args.out)


def prune(args: argparse.Namespace) -> None:
    """Simplify decisions."""
    spark = _session()
    J.prune(_edges(spark, args.edges), now=args.now, cutoff=args.cutoff).write.mode("overwrite").parquet(args.out)


def apply(args: argparse.Namespace) -> None:
    """Statements with canonical ids."""
    spark = _session()
    rows = S.canonicalise(formats.read_statements(spark, args.statements, args.format), J.linker(_edges(spark, args.edges)))
    formats.write_statements(rows, args.out, args.format)


def aggregate(args: argparse.Namespace) -> None:
    """Statements as merged entities in JSON lines."""
    spark = _session()
    formats.write_entities(S.assemble(formats.read_statements(spark, args.statements, args.format)), args.out)


def match(args: argparse.Namespace) -> None:
    """Candidates of subjects in an index of statements, scored."""
    spark = _session()
    subjects, index = (formats.read_statements(spark, p, args.format) for p in (args.subjects, args.statements))
    found = B.subject_matches(T.tokenise(subjects), T.tokenise(index))
    source = E.TableSource(found.select(F.col("matching_id").alias("subject"), F.col("matches_id").alias("candidate")), S.assemble(index))
    E.match(source, S.assemble(subjects), _edges(spark, args.edges), M.algorithm(args.algorithm), threshold=args.threshold).write.mode("overwrite").parquet(args.out)


def enrich(args: argparse.Namespace) -> None:
    """What is linked to records that subjects are judged to be."""
    spark = _session()
    subjects, index = (formats.read_statements(spark, p, args.format) for p in (args.subjects, args.statements))
    pairs = J.live(_edges(spark, args.edges)).select(F.explode(F.array(F.struct(F.col("source").alias("subject"), F.col("target").alias("candidate")), F.struct(F.col("target").alias("subject"), F.col("source").alias("candidate")))).alias("p")).select("p.*")
    source = E.TableSource(pairs, S.assemble(index))
    E.enrich(source, S.assemble(subjects), _edges(spark, args.edges), S.outbound(index), args.depth).write.mode("overwrite").parquet(args.out)


def candidates(args: argparse.Namespace) -> None:
    """The next suggestions to decide on."""
    J.candidates(_edges(_session(), args.edges), args.limit).show(args.limit, truncate=False)


def load(args: argparse.Namespace) -> None:
    """Decisions of a text dump as Parquet."""
    formats.load_edges(_session(), args.dump).write.mode("overwrite").parquet(args.out)


def dump(args: argparse.Namespace) -> None:
    """Decisions as a text dump."""
    formats.dump_edges(J.live(_edges(_session(), args.edges))).coalesce(1).write.mode("overwrite").text(args.out)


def train(args: argparse.Namespace) -> None:
    """Fit a regression scorer on judged pairs in JSON lines and print its coefficients."""
    spark = _session()
    features = M.REGRESSION_V1 if args.model == "regression-v1" else M.ENTITY_REGRESSION
    judged = formats.read_pairs(spark, args.pairs).withColumnsRenamed({"left": "l", "right": "r"})
    data = R.vectors(R.dataset(R.scan(judged)), features)
    model = R.fit(data, args.model, features) if args.model == "regression-v1" else R.choose(data, args.model, features)[0]
    print(model.intercept, model.coefficients)
    R.losses(R.apply(model, data.where("partition = 'test'"))).show()


def reconcile(args: argparse.Namespace) -> None:
    """The best candidate of each subject in scores (left, right, score): taken over above the threshold, else for review."""
    spark = _session()
    E.reconcile(spark.read.parquet(args.scores), float(args.threshold)).write.mode("overwrite").parquet(args.out)


def make_sortable(args: argparse.Namespace) -> None:
    """Statements in the order of their canonical ids, so that those of an entity stand together."""
    rows = formats.read_statements(_session(), args.statements, args.format)
    rows = rows.withColumn("canonical_id", F.coalesce("canonical_id", "entity_id"))
    formats.write_statements(rows.orderBy("canonical_id", "entity_id", "prop", "id"), args.out, args.format)


def dedupe(args: argparse.Namespace) -> None:
    """Show the next pair to review, both sides by property; with a judgement, record it and write the decisions."""
    spark = _session()
    edges = _edges(spark, args.edges)
    pair = J.next_pair(edges).select(F.col("source").alias("left"), F.col("target").alias("right"))
    rows = E.comparison(pair, S.assemble(formats.read_statements(spark, args.statements, args.format)))
    rows.orderBy("order", "prop").drop("order").show(100, truncate=False)
    if args.judgement:
        decided = pair.withColumn("judgement", F.lit(args.judgement))
        J.decide(edges, decided, now=args.now, user=args.user).write.mode("overwrite").parquet(args.out)


def bench(args: argparse.Namespace) -> None:
    """Time a scorer over judged pairs."""
    judged = formats.read_pairs(_session(), args.pairs).withColumnsRenamed({"left": "l", "right": "r"})
    for name in args.algorithm.split(","):
        began = time.time()
        M.algorithm(name).score(judged).write.format("noop").mode("overwrite").save()
        print(f"{name}: {time.time() - began:.2f} s")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="knotwork", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(function, *options: str, **more: object) -> None:  # noqa: ANN001
        one = sub.add_parser(function.__name__, help=(function.__doc__ or "").strip())
        for option in options:
            one.add_argument(f"--{option}", required=option not in more, default=more.get(option), type=type(more[option]) if more.get(option) is not None else str)
        one.set_defaults(run=function)

    command(xref, "statements", "edges", "out", "format", "algorithm", "limit", "auto_threshold", "focus", "schema", format="parquet", algorithm="logic-v1", limit=5000, auto_threshold=None, focus=None, schema=None)
    command(prune, "edges", "out", "now", "cutoff")
    command(apply, "statements", "edges", "out", "format", format="parquet")
    command(aggregate, "statements", "out", "format", format="parquet")
    command(match, "subjects", "statements", "edges", "out", "format", "algorithm", "threshold", format="parquet", algorithm="logic-v1", threshold=0.0)
    command(enrich, "subjects", "statements", "edges", "out", "format", "depth", format="parquet", depth=1)
    command(candidates, "edges", "limit", limit=20)
    command(load, "dump", "out")
    command(dump, "edges", "out")
    command(train, "pairs", "model", model="regression-v1")
    command(reconcile, "scores", "out", "threshold", threshold=0.96)
    command(make_sortable, "statements", "out", "format", format="parquet")
    command(dedupe, "statements", "edges", "format", "judgement", "now", "user", "out", format="parquet", judgement=None, now="", user="review", out="decisions")
    command(bench, "pairs", "algorithm", algorithm="logic-v1")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if getattr(args, "focus", None):
        args.focus = args.focus.split(",")
    if getattr(args, "auto_threshold", None) is not None:
        args.auto_threshold = float(args.auto_threshold)
    args.run(args)


if __name__ == "__main__":
    main()
