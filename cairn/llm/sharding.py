"""Sharding (7): a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards; a node's weight is the sum of its shards'. A row goes down level by level: every
child of the node it has reached draws ``-ln(u) / weight`` from a hash of ``doc_id`` and the child's path, and the least
draw is taken. So only the children of the nodes on a row's way are hashed, and a node is chosen with probability
proportional to its weight.

A change of one shard's weight alters the draws of that shard and of the nodes above it, nothing else. Where it grows,
rows come into its region from others, within the region into its rack, within the rack into the shard; where it
shrinks, the other way round. Rows that stay in a subtree whose weights are as before stay where they are in it.
``grow`` adds a shard as a subtree of its own, in a region and a rack of its own, and so takes rows only into itself.
Law: ``key``.

``slot`` numbers the rows of a shard from 0 without gaps, in the order of a hash, by ranges of the rows in this order and
running sums over the ranges' sizes. Rows that are equal in all of it, however many, are told apart by their place in the
table and so spread over ranges too. No task holds a whole shard, and slots do not depend on the number of ranges.

Hashes are the first 52 bits of MD5 of a text, which SQL has too: ``SQL`` is the registered query.

Edge cases: a null text has size 1 and the crc of the empty text; a null ``doc_id`` is a key like any other; repeated
rows share a shard and get slots of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import base

LAW = "key"
#: Hexadecimal digits of a hash that are used, and the number of their values.
DIGITS, SPAN = 13, float(1 << 52)


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0

    @property
    def paths(self) -> tuple[str, str, str]:
        """The names of the shard's region, rack and own node."""
        return f"{self.region}", f"{self.region}.{self.rack}", f"{self.region}.{self.rack}.{self.shard}"


def tree(n_shards: int, fanout: int = 4) -> list[Leaf]:
    """Leaves of equal weight: ``fanout`` shards a rack, ``fanout // 2`` racks a region."""
    racks = max(1, fanout // 2)
    return [Leaf(s, s // (fanout * racks), s // fanout) for s in range(n_shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``leaves`` and one more shard, in a region and a rack of its own."""
    nxt = lambda xs: max(xs) + 1
    return [*leaves, Leaf(nxt(x.shard for x in leaves), nxt(x.region for x in leaves), nxt(x.rack for x in leaves), weight)]


def _hash(text: Column) -> tuple[Column, Column]:
    """The first digits of the MD5 of a text, and their value as a double (exact)."""
    digits = F.substring(F.md5(F.encode(text, "UTF-8")), 1, DIGITS)
    return digits, F.conv(digits, 16, 10).cast("double")


def draw(key: Column, path: Column, weight: Column) -> Column:
    """Exponential draw of a node for a key, with the node's weight as rate, from 52 bits of a hash of both."""
    _, h = _hash(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), path))
    return -F.log((h + F.lit(0.5)) / F.lit(SPAN)) / weight


def _least(key: Column, children: Column) -> Column:
    """The ``place`` of the child (path, weight, place) of least draw; of equal draws that of the least place."""
    return F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["place"].alias("place"))))["place"]


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: down the tree by the least draw among the children of each node."""
    if len({leaf.shard for leaf in leaves}) != len(leaves) or not leaves or any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("shards have to be different and their weights positive")
    weight: dict[str, float] = {}
    for leaf in leaves:
        for path in leaf.paths:
            weight[path] = weight.get(path, 0.0) + leaf.weight
    regions, racks = (sorted({leaf.paths[k] for leaf in leaves}) for k in (0, 1))

    def node(path: str, place: int) -> Column:
        return F.struct(F.lit(path).alias("path"), F.lit(weight[path]).alias("weight"), F.lit(place).alias("place"))

    def below(parents: list[str], names: dict[str, int], level: int) -> Column:
        own = lambda p: sorted({leaf.paths[level] for leaf in leaves if leaf.paths[level - 1] == p}, key=names.get)
        return F.array(*(F.array(*(node(c, names[c]) for c in own(p))) for p in parents))

    region = _least(key, F.array(*(node(p, k) for k, p in enumerate(regions))))
    rack = _least(key, below(regions, {p: k for k, p in enumerate(racks)}, 1)[region])
    return _least(key, below(racks, {leaf.paths[2]: leaf.shard for leaf in leaves}, 2)[rack])


def assign(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard) of every row; ``grown_shard`` by the leaves ``grown``, else null."""
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), descend(key, leaves).alias("shard"), (descend(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))


def number(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 within a shard."""
    digits, _ = _hash(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    order = ["digits", "doc_id", "text_crc32", "size", "row"]
    keyed = base.durable(rows.withColumn("digits", digits).withColumn("row", F.monotonically_increasing_id()), "keyed", small=True)
    dealt = base.durable(keyed.repartitionByRange(ranges, "shard", *order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # one small row a shard and range
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = Window.partitionBy("shard", "part").orderBy(*order)
    placed = dealt.withColumn("place", F.row_number().over(place) - 1)
    return placed.join(bases, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).withColumn("slot", F.col("before") + F.col("place")).drop("s", "p", "digits", "row", "part", "before", "place")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = tree(16)
    rows = assign(docs, leaves, grow(leaves))
    return number(rows, base.scan_parts(docs)).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: The query in DuckDB's SQL. CRC-32 by chunks of 512 bytes, the shorter one first: ``far`` has what 512 zero bytes make
#: of each byte of a state. The tree: two regions of two racks of four shards, and a region of its own for shard 16.
SQL = """
WITH tab AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), far AS (
  SELECT list(list_reduce(list_prepend(i << (8 * b), range(512)), lambda a, x: xor(a >> 8, t[(a & 255) + 1])) ORDER BY b, i) AS m
  FROM range(4) x(b), range(256) y(i), tab
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), chunks AS (
  SELECT r, c, CASE WHEN c = 0 THEN 0 ELSE n % 512 + 512 * (c - 1) END AS head, CASE WHEN c = 0 THEN n % 512 ELSE 512 END AS len
  FROM (SELECT r, n, unnest(range(n // 512 + 1)) AS c FROM docs)
), states AS (
  SELECT r, c, list_reduce(list_prepend(CASE WHEN c = 0 THEN 4294967295 ELSE 0 END, list_transform(range(len), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) AS state
  FROM (SELECT chunks.*, substr(hex(encode(text)), 2 * head + 1, 2 * len) AS h FROM chunks JOIN docs USING (r)), tab
), sums AS (
  SELECT r, xor(list_reduce(list(state ORDER BY c), lambda a, x: xor(x, xor(xor(m[(a & 255) + 1], m[((a >> 8) & 255) + 257]), xor(m[((a >> 16) & 255) + 513], m[(a >> 24) + 769])))), 4294967295)::BIGINT AS text_crc32
  FROM states, (SELECT any_value(m) AS m FROM far) GROUP BY r, m
), nodes AS (
  SELECT 1 AS level, i AS id, NULL AS parent, i::VARCHAR AS path, CASE WHEN i < 2 THEN 8.0 ELSE 1.0 END::DOUBLE AS w FROM range(3) x(i)
  UNION ALL SELECT 2, i, i // 2, i // 2 || '.' || i, 4.0 FROM range(4) x(i)
  UNION ALL SELECT 3, i, i // 4, i // 8 || '.' || i // 4 || '.' || i, 1.0 FROM range(16) x(i)
), draws AS (
  SELECT r, level, id, parent, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || path), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS d FROM docs, nodes
), regions AS (
  SELECT r, arg_min(id, d) FILTER (WHERE id < 2) AS region, arg_min(id, d) = 2 AS moved FROM draws WHERE level = 1 GROUP BY r
), racks AS (
  SELECT r, arg_min(id, d) AS rack, any_value(moved) AS moved FROM draws JOIN regions USING (r) WHERE level = 2 AND parent = region GROUP BY r
), placed AS (
  SELECT r, arg_min(id, d)::INTEGER AS shard, CASE WHEN any_value(moved) THEN 16 ELSE arg_min(id, d) END::INTEGER AS grown_shard
  FROM draws JOIN racks USING (r) WHERE level = 3 AND parent = rack GROUP BY r
)
SELECT doc_id, (n + 1)::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || text_crc32 || '/' || (n + 1)), 1, 13), doc_id, text_crc32, n) - 1 AS slot, grown_shard
FROM docs JOIN sums USING (r) JOIN placed USING (r)
"""
