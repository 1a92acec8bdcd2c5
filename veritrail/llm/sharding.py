"""Sharding by balanced label propagation (DataFrame operations only).

Rows with equal texts are linked. Linked rows start in shards dealt out evenly; then, for a number of rounds,
every row asks to move to the open shard that holds most of its neighbours, and a shard admits as many as its
capacity (its row quota and some slack) leaves room for; what is above the quota in the end leaves again. A neighbourhood is a group's row count per shard, so a group of n copies costs n
rows and never n * n pairs. Rows without links have no preference and fill what is left of the quotas, so that
the shards' row counts differ by one at most (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, release, table

SHARDS = 24
#: Rounds of moves, at most; it stops earlier when a round admits none.
ROUNDS = 8
#: Part of a quota that a shard may be above it between rounds, so that rows can change places in full shards.
SLACK = 0.25
#: Rows of a group that are ranked in one window, about; the group stays one neighbourhood.
RANK_ROWS = 50_000
#: Buckets in which moves are admitted, and rows ranked; of the latter there are more for more rows, up to MOST_BUCKETS in
#: all, which is what a table of counts by bucket has.
BUCKETS = 1024
MOST_BUCKETS = 1 << 20


def _bucket(*cols: str, salt: int = 0, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(buckets)).cast("int")


def _rank_buckets(total: int, parts: int) -> int:
    """Buckets in each of `parts` parts of the rows, with about RANK_ROWS rows each where there are many."""
    return int(min(max(BUCKETS, total // RANK_ROWS // parts), MOST_BUCKETS // parts))


def _ranked(rows: DataFrame, by: str | None, order: list[str], name: str, buckets: int, together: int = 1, pieces: bool = False) -> DataFrame:
    """Adds `rank`: gapless from 0 (within each `by`), in an order of hash buckets of the first
    `together` columns and then `order`.

    Only counts per bucket are summed in order; rows are ranked within their buckets. With `pieces`, a group (g2) for
    which that column is above 1 follows the others of its bucket in as many pieces.
    """
    rows, at = rows.withColumn("b", _bucket(*order[:together], buckets=buckets)), ["b"]
    if pieces:
        rows = rows.withColumn("own", F.when(F.col("pieces") > 1, F.col("g2")).otherwise(0)).withColumn("piece", F.pmod(F.xxhash64(F.lit(7), "doc_id"), "pieces"))
        at = ["b", "own", "piece"]
    keys = ([by] if by else []) + at
    counts = materialize(rows.groupBy(*keys).count(), f"{name}-counts")
    before = W.partitionBy(*([by] if by else [F.lit(0)])).orderBy(*at).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).join(F.broadcast(offsets), keys).withColumn("rank", F.col("offset") + F.col("nth") - 1).drop(*at, "nth", "offset")


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, name: str = "shard") -> DataFrame:
    """rows: doc_id, g1, g2 (the group's address) and other columns but `shard`. Adds `shard` (0 to shards - 1)."""
    total = rows.count()
    many, each = _rank_buckets(total, 1), _rank_buckets(total, shards)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = rows.groupBy("g1", "g2").agg(F.count("*").alias("members")).where("members > 1")
    sizes = materialize(sizes, f"{name}-groups")
    # a group that no shard can hold is cut into parts of about half a quota, which are then neighbourhoods of their own
    part = max(1, total // shards // 2)
    parts = F.when(F.col("members") > 2 * part, F.ceil(F.col("members") / part)).otherwise(1).cast("int")
    linked = rows.join(sizes, ["g1", "g2"]).withColumn("g2", F.xxhash64("g2", F.pmod(F.xxhash64(F.lit(5), "doc_id"), parts)))
    linked = linked.withColumn("pieces", F.ceil(F.col("members") / RANK_ROWS).cast("int")).drop("members")
    loners = rows.join(sizes, ["g1", "g2"], "left_anti").withColumn("pieces", F.lit(1))
    state = _ranked(linked, None, ["doc_id", "g1", "g2"], name, many).withColumn("shard", F.pmod(F.col("rank"), F.lit(shards)).cast("int")).drop("rank")
    state = materialize(state, f"{name}-state")
    for turn in range(rounds):
        held = dict(state.groupBy("shard").count().collect())  # one row per shard
        room = [int(quota[s] * (1 + SLACK)) - held.get(s, 0) for s in range(shards)]
        free = F.array(*[F.lit(r) for r in room])
        near = state.groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
        near = near.withColumn("h", F.xxhash64("g1", "g2", "shard")).withColumn("open", free[F.col("shard")] > 0)
        best = near.groupBy("g1", "g2").agg(F.max(F.when(F.col("open"), F.struct("n", "h", "shard"))).alias("top")).where("top is not null")
        # a neighbourhood moves from the shards in which it has fewer rows; of equals, from a full one or the one of the lesser hash
        fewer = (F.col("n") < F.col("top.n")) | ((F.col("n") == F.col("top.n")) & (F.col("shard") != F.col("top.shard")) & (~F.col("open") | (F.col("h") < F.col("top.h"))))
        asks = near.join(best, ["g1", "g2"]).where(fewer).select("g1", "g2", "shard", "n", F.col("top.shard").alias("target"))
        asks = materialize(asks.withColumn("b", _bucket("g1", "g2", salt=turn + 1)), f"{name}-asks")
        per = asks.groupBy("target", "b").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("target").orderBy("b"))
        admitted = per.withColumn("upto", upto).where(F.col("upto") <= free[F.col("target")]).select("target", "b")
        moves = materialize(asks.join(F.broadcast(admitted), ["target", "b"]).select("g1", "g2", "shard", "target"), f"{name}-moves")
        release(asks)
        if not moves.limit(1).count():
            break
        moved = state.join(moves, ["g1", "g2", "shard"], "left").withColumn("shard", F.coalesce("target", "shard")).drop("target")
        moved = materialize(moved.select(*state.columns), f"{name}-state")
        release(state, moves)
        state = moved
    ordered = _ranked(state, "shard", ["g1", "g2", "doc_id"], f"{name}-over", each, together=2, pieces=True)
    quotas = F.array(*[F.lit(q) for q in quota])
    ordered = materialize(ordered.withColumn("fits", F.col("rank") < quotas[F.col("shard")]).drop("rank"), f"{name}-fits")
    state, over = ordered.where("fits").drop("fits"), ordered.where("not fits").drop("fits", "shard")
    held = dict(state.groupBy("shard").count().collect())
    bounds, upto = [], 0
    for s in range(shards):
        upto += quota[s] - held.get(s, 0)
        bounds.append(upto)
    to = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("rank"))).cast("int")
    filled = _ranked(loners.unionByName(over), None, ["g1", "g2", "doc_id"], f"{name}-fill", many, together=2, pieces=True).withColumn("shard", to).drop("rank")
    return materialize(state.unionByName(filled.select(*state.columns)).drop("pieces"), f"{name}-all")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text (null: none) plus 8. Equal texts (null and empty alike) are linked. Rows may
    repeat: each takes a slot. A null id is kept. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"),
    )
    rows = materialize(rows, "shard-rows")
    placed = balanced_shards(rows, shards)
    ranked = _ranked(placed, "shard", ["doc_id", "g1", "g2"], "shard-slot", _rank_buckets(rows.count(), shards))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


BALANCE_SQL = f"""SELECT s::INTEGER AS shard, n // {SHARDS} + (s < n % {SHARDS})::BIGINT AS rows, n // {SHARDS} + (s < n % {SHARDS})::BIGINT AS slots, n // {SHARDS} + (s < n % {SHARDS})::BIGINT - 1 AS last_slot
    FROM (SELECT count(*) AS n FROM documents), range(0, {SHARDS}) AS r(s)"""


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard's rows, different slots and last slot."""
    rows = op3_sharding(spark, sf_dir).groupBy("shard")
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last_slot"))
