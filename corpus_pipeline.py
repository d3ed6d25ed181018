"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. ``quality``: a factorisation machine scores whole texts; documents below the threshold go.
2. ``near_dedup``: groups of texts whose sets of five-word runs have a Jaccard likeness of 0.8 or more; the document of
   smallest doc_id of each group stays. Candidates come from operator 3's SimHash by deletion variants and from bands for
   pairs that it misses; the exact likeness decides.
3. ``repeats``: strings of 100 bytes that start earlier elsewhere are cut out of the texts; all documents stay.
4. ``mix``: documents are chosen by token budgets down the domain-language-source tree.
5. ``bpe``: texts as token ids, with digests of the ids and of what they decode to (lower-cased pieces, not the text).

Null texts count as empty; null doc_ids and repeated rows have the results that the operators' modules state; empty
tables give empty tables; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, minhash, mixing, quality, suffix
from cairn.plans.durable import drop_durable, durable, scratch
from cairn.plans.ship import ship

#: Share of the tokens that the mix takes.
FRACTION = 0.8
#: Near copies share 0.8 of their runs of five words, checked exactly. SimHashes of these runs link at 4 or fewer differing
#: bits, complete by deletion variants; at 0.8 many differ in more, and of such pairs 32 bands find all but 5 in 10^8.
NEAR = minhash.MinHash(perms=128, bands=32, shingle=5, threshold=0.8, bits=4)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.one_of_each(docs, NEAR)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix.without_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs, mixing.Mix(mixing.WEIGHTS, FRACTION))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    vocab = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.round_trip(docs, vocab)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("repeats", repeats_stage), ("mix", mix_stage), ("bpe", bpe_stage)]

#: Models and tokenizers are beyond SQL. tests/llm/test_pipeline.py holds every stage, and run() as a whole, against plain
#: Python: scores by all pairs of features, all pairs of documents, every window, prefix sums, the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table, and whatever else it wrote, goes once the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), name, stay=True)
        if before is not None:
            drop_durable(before)
        before = docs
    return docs
