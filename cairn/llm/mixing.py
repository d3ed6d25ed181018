"""Mixing sources to target weights (8): hierarchical budgeting over a domain-language-source tree.

The token budget goes down the tree by weight. Where a child holds fewer tokens than its share (``max_epochs`` times its
text), its shortage goes to its siblings; only what a whole subtree lacks goes to the subtree's siblings, and so on up.
A leaf with a budget of e whole epochs and r tokens gives its documents e times, then the longest prefix, in the seeded
order of epoch e, that has at most r tokens.

Budgets are computed level by level in tables of one row a node, however many there are: among siblings in the order of
room by weight, those are full whose room is at most their share of what is left. Running totals of documents are not
taken over whole leaves: the order keys are cut into buckets of about ``BUCKET`` documents, totals are kept by bucket,
and only the bucket in which the budget ends is sorted. The result is one cut key a leaf, and documents are then chosen
as they are read: Spark broadcasts the cuts where their size allows it, texts shuffle only beyond.

The order of epoch e is that of the MD5 of ``doc_id/seed/e``, which SQL has too: ``SQL`` is the registered query.

Edge cases: a null text has no tokens; null domain, language or source are a value of their own (``?``); rows of one
doc_id follow by a hash of their texts, and repeated rows stay or go together; a null doc_id counts as an empty one; a
leaf without tokens is taken once; an empty table gives an empty table; a budget beyond all capacity takes everything
``max_epochs`` times; further columns are kept, whatever their names, but for one named as ``epoch``, which gives way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import base

#: Documents of a leaf that one bucket of order keys holds about.
BUCKET = 1 << 11
PATHS = ["p0", "p1", "p2"]
#: Hexadecimal digits of an order key, and the number of their values.
DIGITS, SPAN = 13, float(1 << 52)


@dataclass(frozen=True)
class Mix:
    """``weights`` by path: ``("d0",)``, ``("d0", "en")``, ``("d0", "en", "src4")``; a path without one weighs 1."""

    weights: dict = field(default_factory=dict)
    fraction: float = 0.6  # of all tokens
    max_epochs: int = 1
    seed: int = 7


def domain_of(source: Column) -> Column:
    """A source's domain by rule: ``d`` and its number modulo 4; ``d?`` without a number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1)
    return F.when(number == "", F.lit("d?")).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def count_tokens(text: Column) -> Column:
    """Tokens as the mix counts them: runs of other bytes than space, tab, line feed and carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent, name, room, weight, amount) with ``got``: each parent's amount split by weight in whole tokens.

    What a child has no room for goes to its siblings; what rounding leaves goes to the heaviest with room, none is lost.
    """
    own = Window.partitionBy(*parent)
    near = own.orderBy(F.col("room") / F.col("weight"), name)
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    amount = nodes.withColumn("amount", F.least("amount", F.sum("room").over(own)))
    can = (F.col("room") > 0) & (F.col("weight") > 0)
    none = amount.filter(~can).withColumn("got", F.lit(0).cast("long"))
    left = F.col("amount") - F.coalesce(F.sum("room").over(before), F.lit(0))
    heavy = F.sum("weight").over(near.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = amount.filter(can).withColumn("full", F.col("room") * heavy <= left * F.col("weight"))
    rest = full.withColumn("left", F.col("amount") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(own)).withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(own))
    part = rest.withColumn("part", F.when(F.col("full"), F.col("room")).otherwise(F.floor(F.col("left") * F.col("weight") / F.col("open"))))
    cap = part.withColumn("cap", F.col("room") - F.col("part")).withColumn("spare", F.col("left") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("part"))).over(own))
    ahead = F.coalesce(F.sum("cap").over(own.orderBy(F.col("weight").desc(), name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least("cap", F.col("spare") - ahead))
    return cap.withColumn("got", (F.col("part") + more).cast("long")).select(*nodes.columns, "got").unionByName(none.select(*nodes.columns, "got"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (p0, p1, p2, tokens, ...) with ``budget``: the tokens that each gives."""
    path = lambda names: F.concat_ws("\0", *names)
    weights = F.create_map(*(F.lit(x) for p, w in mix.weights.items() for x in ("\0".join(p), float(w)))) if mix.weights else None
    got = None
    for level in range(len(PATHS)):
        own, parent = PATHS[: level + 1], PATHS[:level]
        nodes = leaves.groupBy(*own).agg(F.sum("tokens").alias("tokens")).withColumn("room", F.col("tokens") * mix.max_epochs)
        nodes = nodes.withColumn("weight", F.coalesce(weights[path(own)], F.lit(1.0)) if weights is not None else F.lit(1.0))
        if got is None:
            # the children of the root: one row a domain
            nodes = nodes.withColumn("amount", F.floor(F.lit(float(mix.fraction)) * F.sum("tokens").over(Window.partitionBy())))
        else:
            nodes = nodes.join(got.select(*parent, F.col("got").alias("amount")), parent)
        got = share(nodes.select(*own, "room", "weight", "amount"), parent, PATHS[level])
    return leaves.join(got.select(*PATHS, F.col("got").alias("budget")), PATHS)


def _keyed(docs: DataFrame, domain: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns by place, ``doc_id`` as id, and beside them the path, a tie by text and the tokens."""
    whole, _ = base.by_place(docs.select("*", (domain if domain is not None else domain_of(F.col("source"))).alias("domain")))
    places = dict(zip(docs.columns, whole.columns))
    text = F.coalesce(F.col(places["text"]), F.lit(""))
    path = [F.col(whole.columns[-1]), F.col(places["lang"]), F.col(places["source"])]
    paths = (F.coalesce(p.cast("string"), F.lit("?")).alias(c) for c, p in zip(PATHS, path))
    return whole.select("*", *paths, F.col(places["doc_id"]).cast("long").alias("id"), F.xxhash64(text).alias("tie"), count_tokens(text).alias("n")), places


def _digits(epoch: Column, seed: int) -> Column:
    """The order key of a document in an epoch."""
    return F.substring(F.md5(F.encode(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(str(seed)), epoch.cast("string")), "UTF-8")), 1, DIGITS)


def _order(epoch: Column, seed: int) -> list[Column]:
    return [_digits(epoch, seed).alias("k"), F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("i"), F.col("tie").alias("t")]


def cuts(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """Per leaf: whole epochs, and the order key (k, i, t) before which documents of the next epoch are taken."""
    lean = base.durable(_keyed(docs, domain)[0].select("id", *PATHS, "tie", "n"), "mix", small=True)
    leaves = base.durable(lean.groupBy(*PATHS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "leaves")
    some = F.col("tokens") > 0
    whole = F.when(some, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1)
    plan = budgets(leaves, mix).select(*PATHS, F.least(whole, F.lit(mix.max_epochs)).cast("int").alias("whole"), F.when(some & (whole < mix.max_epochs), F.col("budget") % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long").alias("rest"), F.ceil(F.col("docs") / BUCKET).alias("buckets"))
    plan = base.durable(plan, "budgets")
    at = F.floor(F.conv("k", 16, 10).cast("double") / F.lit(SPAN) * F.col("buckets"))
    keyed = lean.join(plan.filter("rest > 0"), PATHS).select(*PATHS, "n", "rest", "buckets", *_order(F.col("whole"), mix.seed)).withColumn("b", at).drop("buckets")
    totals = keyed.groupBy(*PATHS, "b").agg(F.sum("n").alias("s"), F.first("rest").alias("rest"))
    up = Window.partitionBy(*PATHS).orderBy("b")
    ends = totals.select(*PATHS, "b", "rest", (F.sum("s").over(up) - F.col("s")).alias("before"), F.sum("s").over(up).alias("upto")).filter("before <= rest and upto > rest").select(*PATHS, "b", "before")
    inner = Window.partitionBy(*PATHS).orderBy("k", "i", "t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = keyed.join(ends, [*PATHS, "b"]).select(*PATHS, "k", "i", "t", "rest", (F.col("before") + F.sum("n").over(inner)).alias("run")).filter("run > rest")
    first = edge.groupBy(*PATHS).agg(F.min(F.struct("k", "i", "t")).alias("cut"))
    out = base.durable(plan.join(first, PATHS, "left").select(*PATHS, "whole", "rest", "cut"), "cuts")
    for done in (lean, leaves, plan):
        base.drop_durable(done)
    return out


def mix(docs: DataFrame, spec: Mix, domain: Column | None = None, epoch: str | None = None) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with all their columns; an epoch number in the column ``epoch`` if asked for.

    ``docs`` is read twice (for totals, then to choose): it should be a table, not a long plan.
    """
    table = cuts(docs, spec, domain)
    keyed, places = _keyed(docs, domain)
    before = F.struct(*_order(F.col("whole"), spec.seed)) < F.col("cut")
    times = F.col("whole") + F.when((F.col("rest") > 0) & before, 1).otherwise(0)
    out = keyed.join(table, PATHS).withColumn("times", times).filter("times > 0")
    names = [c for c in docs.columns if c != epoch]
    if spec.max_epochs > 1 or epoch:
        out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.select(*(F.col(places[c]).alias(c) for c in names), *([F.col("epoch").alias(epoch)] if epoch else []))


#: The weights of the registered query and of the pipeline.
WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0} | {(d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}

SPEC = Mix(WEIGHTS, fraction=0.8, max_epochs=2)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, SPEC, epoch="epoch")
    return out.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", count_tokens(F.col("text")).alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"))


def _sql(spec: Mix) -> str:
    """The registered query in DuckDB's SQL: budgets level by level, then each leaf's running totals in one window."""
    weights = ", ".join(f"('{'/'.join(p)}', {float(w)}::DOUBLE)" for p, w in spec.weights.items())
    steps = []
    for k, name in enumerate(PATHS):
        own, parent = ", ".join(PATHS[: k + 1]), ", ".join(PATHS[:k])
        by, path = f"PARTITION BY {parent}" if parent else "", " || '/' || ".join(PATHS[: k + 1])
        amount = f"JOIN got{k - 1} USING ({parent})" if parent else f"CROSS JOIN (SELECT floor({spec.fraction}::DOUBLE * sum(tokens))::BIGINT AS amount FROM leaves)"
        steps.append(f"""rooms{k} AS (
  SELECT r.*, least(amount, sum(room) OVER ({by})) AS a FROM (
    SELECT n.*, coalesce(w.w, 1.0::DOUBLE) AS w FROM (SELECT {own}, sum(tokens) * {spec.max_epochs} AS room FROM leaves GROUP BY {own}) n
    LEFT JOIN weights w ON w.path = {path}) r {amount}
), full{k} AS (
  SELECT *, room * sum(w) OVER ({by} ORDER BY room / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (a - coalesce(sum(room) OVER ({by} ORDER BY room / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS whole
  FROM rooms{k} WHERE room > 0 AND w > 0
), left{k} AS (
  SELECT *, a - coalesce(sum(room) FILTER (WHERE whole) OVER ({by}), 0) AS rest, sum(w) FILTER (WHERE NOT whole) OVER ({by}) AS ws FROM full{k}
), part{k} AS (
  SELECT *, CASE WHEN whole THEN room ELSE floor(rest * w / ws) END AS part FROM left{k}
), spare{k} AS (
  SELECT *, rest - coalesce(sum(part) FILTER (WHERE NOT whole) OVER ({by}), 0) AS spare,
    coalesce(sum(room - part) OVER ({by} ORDER BY w DESC, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM part{k}
), got{k} AS (
  SELECT {own}, (part + greatest(0, least(room - part, spare - ahead)))::BIGINT AS amount FROM spare{k}
  UNION ALL SELECT {own}, 0 FROM rooms{k} WHERE NOT (room > 0 AND w > 0)
)""")
    return f"""
WITH weights(path, w) AS (VALUES {weights}), docs AS (
  SELECT doc_id, lang, source, coalesce(lang, '?') AS p1, coalesce(source, '?') AS p2, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n,
    CASE WHEN regexp_matches(source, '[0-9]') THEN 'd' || regexp_extract(source, '([0-9]{{1,9}})', 1)::BIGINT % 4 ELSE 'd?' END AS p0
  FROM documents
), leaves AS (
  SELECT p0, p1, p2, sum(n)::BIGINT AS tokens FROM docs GROUP BY p0, p1, p2
), {", ".join(steps)}, plan AS (
  SELECT p0, p1, p2, CASE WHEN tokens = 0 THEN 1 ELSE least(amount // tokens, {spec.max_epochs}) END AS whole,
    CASE WHEN tokens = 0 OR amount // tokens >= {spec.max_epochs} THEN 0 ELSE amount % tokens END AS rest
  FROM leaves JOIN got2 USING (p0, p1, p2)
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY p0, p1, p2 ORDER BY substr(md5(doc_id || '/{spec.seed}/' || whole), 1, {DIGITS}), doc_id) AS run FROM docs JOIN plan USING (p0, p1, p2)
)
SELECT doc_id, p0 AS domain, lang, source, n::BIGINT AS n_tokens, unnest(range(whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END))::INTEGER AS epoch FROM placed
"""


SQL = _sql(SPEC)
