"""Exact duplicates by deterministic block naming (DataFrame operations only).

A text is cut into blocks of a fixed number of bytes. Every distinct block gets an integer name, its
place in the sorted order of its bucket; then adjacent pairs of names get names the same way, level by
level, until one name is left for each document. Names are injective at each level and the shape of the
reduction depends on the number of bytes alone, so two texts have the same (n_bytes, name) exactly if
they are equal.

Blocks travel once, under a 128-bit address; the bytes that meet under an address are compared (least
against greatest), and if two blocks ever share an address the naming starts again with other address
seeds. So the address decides where a block goes, never whether two blocks are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, release, row_key, table

#: Bytes of a block.
BLOCK_BYTES = 2048
#: Buckets in which names are ranked, at least, and blocks of each where there are many; a name is bucket * 2^40 + rank.
NAME_BUCKETS = 4096
BUCKET_BLOCKS = 1 << 17


def _addresses(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _named(keys: DataFrame, a: str, b: str, blocks: int) -> DataFrame:
    """Adds `name`: bucket and rank in the sorted order of the distinct (a, b), of which there are at most `blocks`."""
    bucket = F.pmod(F.xxhash64(a, b), F.lit(max(NAME_BUCKETS, blocks // BUCKET_BLOCKS))).cast("long")
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(a, b)).cast("long")
    return keys.withColumn("bucket", bucket).withColumn("name", F.shiftleft("bucket", 40) + rank).drop("bucket")


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: rid (a number for the row), k_id, k_hash, doc_id, text_sha256, n_bytes, name.

    (n_bytes, name) is the identity of the text: null counts as empty. Rows may repeat; a null id is kept.
    Only the two named columns are read, so other columns may have any names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    count = F.greatest(F.ceil(F.col("n_bytes") / block_bytes), F.lit(1)).cast("int")

    def blocks(f):
        return F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: f(F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes))))

    seed = 0
    while True:
        cut = rows.select("doc_id", *row_key(), bytes_.alias("bytes")).withColumn("n_bytes", F.octet_length("bytes").cast("long")).withColumn("n_blocks", count)
        base = materialize(
            cut.select(
                F.monotonically_increasing_id().alias("rid"), "k_id", "k_hash", "doc_id", F.sha2("bytes", 256).alias("text_sha256"), "n_bytes", "n_blocks",
                blocks(lambda x: F.struct(*(c.alias(n) for c, n in zip(_addresses(x, seed), "ab", strict=True)))).alias("at"),
            ),
            "exact-base",
        )
        met = cut.select(F.explode(blocks(lambda x: x)).alias("block")).select(*(c.alias(n) for c, n in zip(_addresses(F.col("block"), seed), "ab", strict=True)), "block")
        met = met.groupBy("a", "b").agg((F.min("block") != F.max("block")).alias("clash"))
        total = base.agg(F.sum("n_blocks")).first()[0] or 0
        names = materialize(_named(met, "a", "b", total), "exact-names")
        if not names.where("clash").limit(1).count():
            break
        release(base, names)
        seed += 1

    single = base.where("n_blocks = 1").select("rid", F.col("at")[0]["a"].alias("a"), F.col("at")[0]["b"].alias("b")).join(names, ["a", "b"]).select("rid", "name")
    most = base.agg(F.max("n_blocks")).first()[0] or 1
    ends, level = [single], None
    if most > 1:
        long_at = base.where("n_blocks > 1").select("rid", F.posexplode("at").alias("pos", "at")).select("rid", "pos", "at.a", "at.b")
        level = materialize(_gather(long_at.join(names, ["a", "b"])), "exact-level")
    while most > 1:
        most = (most + 1) // 2
        halves = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")),
        )
        pairs = level.select("rid", F.posexplode(halves).alias("pos", "at")).select("rid", "pos", "at.a", "at.b")
        pair_names = materialize(_named(pairs.select("a", "b").distinct(), "a", "b", total), "exact-pairs")
        level_up = materialize(_gather(pairs.join(pair_names, ["a", "b"])), "exact-level")
        release(level, pair_names)
        ends.append(level_up.where(F.size("names") == 1).select("rid", F.col("names")[0].alias("name")))
        level = level_up.where(F.size("names") > 1)
    ids = ends[0]
    for e in ends[1:]:
        ids = ids.union(e)
    return materialize(base.drop("at", "n_blocks").join(ids, "rid"), "exact-ids")


def _gather(rows: DataFrame) -> DataFrame:
    """(rid, names in order); a group holds the blocks of one document."""
    return rows.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, k_id, k_hash.

    Of equal texts (null: empty) the row with the largest id stays; a null id is less than any other. Of rows
    that repeat both id and text one stays. An empty table gives an empty result. Groups are counted by
    partial aggregation and met again in a join of two written tables, so that a group with a third of the
    rows is split by Spark.
    """
    ids = block_identities(docs, id_col, text_col)
    groups = materialize(
        ids.groupBy("n_bytes", "name").agg(F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("top")), "exact-groups"
    )
    met = ids.join(groups, ["n_bytes", "name"])
    return met.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256", "k_id", "k_hash")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that `exact_duplicates` keeps, with all their columns."""
    kept = materialize(exact_duplicates(docs).where("kept").select("k_id", "k_hash"), "exact-kept")
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    first = F.row_number().over(W.partitionBy("k_id", "k_hash").orderBy(F.lit(1)))
    return rows.join(kept, ["k_id", "k_hash"]).withColumn("nth", first).where("nth = 1").select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("k_id", "k_hash")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
