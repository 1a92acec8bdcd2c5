"""Claims: validation, batches, cache, clustering, cross-source themes, statistics, relationship replies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritrail.functions import text as T
from veritrail.sources.store import written

# fixed values: what a claim and a relationship may be
CLAIM_TYPES = ("recommendation", "opinion", "fact", "prediction", "warning")
STANCES = ("support", "oppose", "neutral", "mixed")
RELATIONSHIPS = ("single_source", "agreement", "partial_agreement", "contradiction", "different_context", "independent")
WITHIN_MERGE = 0.87
#: Vectors of a block that meets another, about, and pivots at most.
BLOCK_ROWS, MOST_CELLS = 2048, 512
#: A whole claim, as it is cached.
CLAIM = "struct<claim:string,claim_type:string,stance:string,evidence:array<struct<chunk_id:string,evidence_text:string>>,topics:array<string>>"
_REPLY = "array<struct<video_id:string,claim:string,claim_type:string,stance:string,evidence:array<struct<chunk_id:string,evidence_text:string>>,topics:array<string>>>"


def validate_claims(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """replies: reply_id (unique), raw. chunks: chunk_id. One row per claim, whole, with `reason` (null: accepted), the
    first check that fails of type, stance, evidence present, every cited chunk known; a reply that is not a JSON array
    is one rejection. Each reply is parsed once."""
    body = T.strip_fence(F.col("raw"))
    parsed = replies.select("reply_id", "raw", F.when(body.startswith("["), F.from_json(body, _REPLY)).alias("claims"))
    rows = parsed.select("reply_id", F.col("claims").isNull().alias("bad"), F.when(F.col("claims").isNull(), F.substring("raw", 1, 200)).alias("raw"), F.posexplode_outer("claims").alias("pos", "c")).where("bad or pos is not null")
    rows = rows.select("reply_id", F.coalesce("pos", F.lit(0)).alias("pos"), "bad", "raw", "c", F.explode_outer("c.evidence").alias("e")).withColumn("cited", F.col("e.chunk_id"))
    known = chunks.select(F.col("chunk_id").alias("cited"), F.lit(True).alias("known")).distinct()
    one = rows.join(known, "cited", "left").groupBy("reply_id", "pos").agg(
        F.first("bad").alias("bad"), F.first("raw").alias("raw"), F.first("c").alias("c"), F.bool_and(F.col("e").isNull() | F.coalesce("known", F.lit(False))).alias("sound")
    )
    is_one_of = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    reason = (
        F.when(F.col("bad"), "invalid_json").when(~is_one_of("c.claim_type", CLAIM_TYPES), "invalid_claim_type").when(~is_one_of("c.stance", STANCES), "invalid_stance")
        .when(F.coalesce(F.size("c.evidence"), F.lit(0)) <= 0, "no_evidence").when(~F.col("sound"), "unknown_chunk")
    )
    return one.select("reply_id", "pos", F.col("c.claim").alias("claim"), reason.alias("reason"), "raw", "c.claim_type", "c.stance", "c.evidence", "c.topics")


def batches(chunks: DataFrame, by: str, order: str, size: int = 5) -> DataFrame:
    """Adds batch_no: runs of `size` chunks within each `by`."""
    return chunks.withColumn("batch_no", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select("content_hash"), "content_hash", "left_anti")


def claims_from_cache(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached claims of the chunks, texts or whole ones, with ids numbered within a chunk; order is (ord, pos)."""
    rows = chunks.join(cache, "content_hash").select("ord", "chunk_id", "content_hash", F.posexplode("claims").alias("pos", "claim"))
    return rows.withColumn("claim_id", F.format_string("%s_claim%d", "chunk_id", "pos"))


def cluster_greedy(claims: DataFrame, threshold: float = WITHIN_MERGE) -> DataFrame:
    """claims: workspace_id, ord, claim_id, video, vector. Adds cluster_no within the workspace.

    In order, a claim joins the cluster with the nearest centroid (the first of equals) if that has its video and
    the cosine reaches the threshold; else it founds one. The fold is one workspace's, as its semantics are sequential.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        centroids, sizes, videos, out = np.zeros_like(x), [], [], []
        for v, video in zip(x, pdf["video"], strict=True):
            n = len(sizes)
            best = -1
            if n:
                with np.errstate(invalid="ignore", divide="ignore"):
                    near = centroids[:n] @ v / (np.linalg.norm(centroids[:n], axis=1) * np.linalg.norm(v))
                near = np.nan_to_num(near, nan=-2.0)
                best = int(near.argmax())
                if not (video in videos[best] and near[best] >= threshold):
                    best = -1
            if best < 0:
                centroids[n], best = v, n
                sizes.append(1)
                videos.append({video})
            else:
                centroids[best] = (centroids[best] * sizes[best] + v) / (sizes[best] + 1)
                sizes[best] += 1
                videos[best].add(video)
            out.append(best)
        return pdf.assign(cluster_no=out)[["workspace_id", "ord", "claim_id", "cluster_no"]]

    kinds = dict(claims.dtypes)
    schema = f"workspace_id {kinds['workspace_id']}, ord {kinds['ord']}, claim_id {kinds['claim_id']}, cluster_no long"
    return claims.select("workspace_id", "ord", "claim_id", "video", "vector").groupBy("workspace_id").applyInPandas(fold, schema)


def _units(column: pd.Series) -> np.ndarray:
    v = np.array(column.tolist(), np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def theme_pairs(claims: DataFrame, floor: float) -> DataFrame:
    """claims: ord, video, vector. Pairs i < j of different videos whose cosine reaches the floor; zero vectors have none.

    Vectors go to the cell of the nearest of some pivots, and as visitors to those later cells that can hold a partner:
    a vector within an angle t of another is within t plus a cell's radius of that cell's pivot, if the other lies in it.
    Cells meet their visitors in blocks, each one matrix product, so no row is made that does not pass the floor.
    """
    n = claims.count()
    rows = claims.select(F.col("ord").alias("i"), "video", F.col("vector").cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x != 0))
    picked = rows.orderBy(F.xxhash64(F.lit(1), "i"), "i").limit(int(np.clip(-(-n // BLOCK_ROWS), 1, MOST_CELLS))).select("vector").toPandas()
    kinds = f"i {dict(rows.dtypes)['i']}, video {dict(rows.dtypes)['video']}, vector array<double>"
    if not len(picked):
        return claims.sparkSession.createDataFrame([], "i long, j long, cosine double")
    pivots, angle = claims.sparkSession.sparkContext.broadcast(_units(picked["vector"])), float(np.arccos(np.clip(floor, -1, 1)))
    apart = lambda u: np.arccos(np.clip(u @ pivots.value.T, -1, 1))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = apart(_units(pdf["vector"]))
                yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

    at_home = written(rows.mapInPandas(settle, f"{kinds}, cell int, far double"), "cells")
    cells = at_home.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).toPandas()  # MOST_CELLS rows at most
    radius = np.full(len(picked), -np.inf)
    radius[cells["cell"]] = cells["radius"]
    blocks = dict(zip(cells["cell"].tolist(), cells["blocks"].tolist(), strict=True))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, to = np.nonzero((apart(_units(pdf["vector"])) <= radius + angle + 1e-7) & (np.arange(len(radius)) >= pdf["cell"].to_numpy()[:, None]))
                yield pdf.drop(columns="far").iloc[row].rename(columns={"cell": "own"}).assign(cell=to.astype(np.int32))

    of = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("cell")]
    visitors = at_home.mapInPandas(visit, f"{kinds}, own int, cell int")
    left = visitors.select("cell", F.explode(F.sequence(F.lit(0), of - 1)).alias("blk"), F.pmod(F.xxhash64(F.lit(2), "i"), of).cast("int").alias("part"), F.col("i").alias("i1"), F.col("video").alias("video1"), F.col("vector").alias("vector1"), "own")
    right = at_home.select("cell", F.pmod(F.xxhash64(F.lit(3), "i"), of).cast("int").alias("blk"), F.explode(F.sequence(F.lit(0), of - 1)).alias("part"), "i", "video", "vector")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"i": [], "j": [], "cosine": []}).astype({"i": "int64", "j": "int64"})
        near = _units(x["vector1"]) @ _units(y["vector"]).T
        p, q = np.nonzero((near >= floor) & (x["video1"].to_numpy()[:, None] != y["video"].to_numpy()[None]))
        i, j, once = x["i1"].to_numpy()[p], y["i"].to_numpy()[q], x["own"].to_numpy()[p] != y["cell"].iloc[0]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "cosine": near[p, q]})[once | (i < j)]

    keys = ["cell", "blk", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "i long, j long, cosine double")
    return met.select("i", "j", F.round("cosine", 6).alias("cosine"))


def theme_match(pairs: DataFrame, top_k: int = 10) -> DataFrame:
    """Greedy disjoint pairs by cosine descending, then (i, j). The fold stops at top_k themes; a pair can only be
    among them if fewer than 2 * top_k better pairs share its first claim, and its second (each of them would need a
    matched claim of its own), which bounds what is gathered: top_k picks and what touches their claims."""
    nth = lambda c: F.row_number().over(W.partitionBy(c).orderBy(F.desc("cosine"), "i", "j"))
    best = pairs.withColumn("ni", nth("i")).withColumn("nj", nth("j")).where((F.col("ni") <= 2 * top_k) & (F.col("nj") <= 2 * top_k))
    best = best.orderBy(F.desc("cosine"), "i", "j").limit(8 * top_k * top_k + top_k).agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "i", "j"))).alias("p"))
    none = F.filter("p", lambda _: F.lit(False))
    taken = F.aggregate("p", none, lambda k, c: F.when((F.size(k) >= top_k) | F.exists(k, lambda x: (x["i"] == c["i"]) | (x["j"] == c["i"]) | (x["i"] == c["j"]) | (x["j"] == c["j"])), k).otherwise(F.concat(k, F.array(c))))
    return best.select(F.posexplode(taken).alias("pos", "t")).select((F.col("pos") + 1).alias("theme_no"), F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.round(-F.col("t.c"), 3).alias("cosine"))


def cluster_stats(claims: DataFrame) -> DataFrame:
    """claims: cluster_id, video_id, stance, n_evidence. Videos, stances and evidence by cluster."""
    count = lambda *s: F.count_if(F.col("stance").isin(*s))
    return claims.groupBy("cluster_id").agg(
        F.array_join(F.array_sort(F.collect_set("video_id")), ",").alias("videos"), F.count_distinct("video_id").alias("unique_videos"), F.count_distinct("video_id").alias("unique_channels"),
        count("support").alias("support_count"), count("oppose").alias("oppose_count"), count("neutral", "mixed").alias("neutral_count"), F.sum("n_evidence").alias("total_evidence"), F.count("*").alias("size"),
    )


def relationship_status(raw: Column, members: Column) -> Column:
    """'ok', or why a relationship reply is refused."""
    reply = F.from_json(T.strip_fence(raw), "relationship string, synthesis_note string")
    toks = F.split(F.translate(F.coalesce(reply["synthesis_note"], F.lit("")), ",)", "  "), r"\s+")
    named = F.filter(F.transform(toks, lambda t: F.regexp_replace(t, r"^[.:]+|[.:]+$", "")), lambda t: F.contains(t, F.lit("_claim")))
    return F.when(reply["relationship"].isNull(), "invalid_json").when(~reply["relationship"].isin(*RELATIONSHIPS), "unknown_relationship").when(~F.forall(named, lambda t: F.array_contains(members, t)), "unknown_claim").otherwise("ok")
