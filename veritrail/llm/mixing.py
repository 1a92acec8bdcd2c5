"""Mixing sources to target word counts by pivotal dependent rounding.

Every document of a source is to be copied target / source size times. The whole part of that number is taken;
the fraction left is a probability, and pivotal rounding turns the probabilities of a source into zeros and
ones: two documents with fractional probabilities meet, words are moved at random from one to the other until
one of them is 0 or 1, and the other goes on. Moving words (size times probability) keeps the source's expected
words as they are, so a source misses its target by less than one document. A group of documents leaves one
fractional document; these residuals meet in groups again, up a tree, until each source has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, row_key, table

#: Weights of the sources by code point (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a part of all words.
SHARE = 1.5
#: A target stops at so many times its source's words.
CEILING = 2.0
#: Documents that one rounding task pairs, about.
GROUP_ROWS = 4096
#: Residuals that meet in a group on each level of the tree.
FAN_IN = 256
_WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """sizes: source, source_size (one row per source). Adds target.

    Targets share `share` of all words by weight; a target above `ceiling` times its source's words stops
    there and the excess is shared again by weight. Solved at once: sources are taken in ascending order of
    ceiling / weight, and the level at which the rest is not capped is found from running sums.
    """
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = ranked.withColumn("weight", cycle[F.pmod(F.col("nth") - 1, F.lit(len(weights)))]).withColumn("cap", F.col("source_size") * float(ceiling))
    by_level = W.orderBy((F.col("cap") / F.col("weight")).asc(), "nth")
    up = by_level.rowsBetween(W.unboundedPreceding, -1)
    w = w.select(
        "*", F.coalesce(F.sum("cap").over(up), F.lit(0.0)).alias("cap_before"), F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("weight_left"),
        (F.sum("source_size").over(everything) * float(share)).alias("all"),
    )
    w = w.withColumn("level", (F.col("all") - F.col("cap_before")) / F.col("weight_left"))
    # the first source, in that order, that stays under its ceiling sets the level of all that follow
    first = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(first * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(seed: int, level: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(f"{seed},{level},{a},{b}", 0) / 2.0**64


def _pivot(ids: list[int], sizes: list[int], probs: list[float], seed: int, level: int) -> tuple[list[float], int]:
    """Rounds all but one of the probabilities; returns them and the position of the one left (-1: none).

    Documents come largest first: the many small ones then move a large one to 0 or 1 in small steps, and the
    one that is left in the end, whose rounding is the source's error, is seldom large.
    """
    probs, held = list(probs), -1
    for k, q in enumerate(probs):
        if not 0.0 < q < 1.0:
            continue
        if held < 0:
            held = k
            continue
        p, a, b = probs[held], float(sizes[held]), float(sizes[k])
        # words can go from the held document to this one, or back
        to_this, to_held = min(p * a, (1 - q) * b), min((1 - p) * a, q * b)
        if _uniform(seed, level, ids[held], ids[k]) * (to_this + to_held) < to_held:
            done_p, done_q = p * a <= (1 - q) * b, (1 - q) * b <= p * a
            p, q = (0.0 if done_p else p - to_this / a), (1.0 if done_q else q + to_this / b)
        else:
            done_p, done_q = (1 - p) * a <= q * b, q * b <= (1 - p) * a
            p, q = (1.0 if done_p else p + to_held / a), (0.0 if done_q else q - to_held / b)
        probs[held], probs[k] = p, q
        held = held if 0.0 < p < 1.0 else k if 0.0 < q < 1.0 else -1
    return probs, held


_SCHEMA = "k_id long, k_hash long, nth int, doc_id long, size long, source_key long, source string, source_size long, target double, whole int, prob double, cell long, open boolean"


def _round(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k_hash", "k_id", "nth"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        keys = (pdf["k_hash"] ^ pdf["nth"]).tolist()
        probs, held = _pivot(keys, pdf["size"].tolist(), pdf["prob"].tolist(), seed, level)
        if held >= 0 and last:
            probs[held] = 1.0 if _uniform(seed, -1, keys[held], 0) < probs[held] else 0.0
            held = -1
        pdf["prob"] = probs
        pdf["open"] = pdf.index == held
        pdf["cell"] = pdf["cell"] // FAN_IN
        return pdf

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, group_rows: int = GROUP_ROWS, name: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies (0 to 2), taken, k_id, k_hash, nth.

    size: words of the text (null: 0). A document without words is not fractional: it is taken once if its
    source's target is at least its words (else never), which adds no words. A null source is a source, the
    last one. Rows that repeat both id and text are told apart by nth. Random numbers come from ids and texts,
    so reruns agree. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "source", size.alias("size"), *row_key())
    rows = materialize(rows.withColumn("nth", F.row_number().over(W.partitionBy("k_id", "k_hash").orderBy("source"))), f"{name}-sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), f"{name}-sources")
    targets = source_targets(sizes.select("source", "source_size")).join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = materialize(targets, f"{name}-targets")
    most = targets.agg(F.max("rows")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CEILING))).otherwise(F.lit(1.0))
    cells = F.ceil(F.col("rows") / group_rows).cast("long")
    met = (
        rows.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(F.col("source"))).withColumn("ratio", ratio)
        .select(
            "k_id", "k_hash", "nth", "doc_id", "size", F.xxhash64(F.coalesce("source", F.lit("")), F.isnull("source")).alias("source_key"), "source", "source_size", "target",
            F.when(F.col("size") > 0, F.floor("ratio")).otherwise(F.least(F.floor(F.col("ratio")), F.lit(1))).cast("int").alias("whole"),
            F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0).alias("prob"),
            F.pmod(F.xxhash64(F.lit(seed), "k_id", "k_hash", "nth"), cells).alias("cell"),
        ).withColumn("open", F.col("prob") > 0)
    )
    met = materialize(met, f"{name}-met")
    done, open_ = met.where("not open"), met.where("open")
    width, level = max(1, -(-most // group_rows)), 0
    while True:
        last = width <= 1
        out = materialize(open_.groupBy("source_key", "cell").applyInPandas(_round(seed, level, last), _SCHEMA), f"{name}-level")
        done = done.unionByName(out.where("not open"))
        if last:
            break
        open_, width, level = out.where("open"), -(-width // FAN_IN), level + 1
    copies = (F.col("whole") + F.col("prob")).cast("int")
    return done.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "k_id", "k_hash", "nth", "source")


def mixed_rows(docs: DataFrame, **options: int) -> DataFrame:
    """docs with each row as often as the mix takes it, with all their columns."""
    mix = materialize(mix_sources(docs, **options).where("copies > 0").select("k_id", "k_hash", "nth", "copies"), "mix-copies")
    rows = docs.select(F.struct("*").alias("row"), *row_key(), F.col("source").cast("string").alias("by_source"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("k_id", "k_hash").orderBy("by_source")))
    return rows.join(mix, ["k_id", "k_hash", "nth"]).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op7_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


TARGETS_SQL = r"""WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY 1),
    w AS (SELECT *, [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
    -- the level at which all sources that stay under their caps take their weight's part of what the others leave
    l AS (SELECT (any_value(total) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.level), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.level) AS level, a.level AS cut FROM (SELECT DISTINCT cap / weight AS level FROM w) a, w b GROUP BY a.level)
    SELECT source, source_size, round(least(cap, coalesce((SELECT arg_min(level, cut) FROM l WHERE level <= cut) * weight, cap)), 6) AS target FROM w"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' words and targets, as the mix has them."""
    rows = mix_sources(table(spark, sf_dir, "documents"), name="mix-targets")
    return rows.select("source", "source_size", F.round("target", 6).alias("target")).distinct()
