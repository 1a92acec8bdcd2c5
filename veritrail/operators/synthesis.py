"""Claims by a model: extraction with a cache, adjudicated clustering, synthesis of clusters and labels of themes."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritrail.functions import text as T
from veritrail.operators import claims as C
from veritrail.sources.models import Client, complete
from veritrail.sources.store import written

#: Cosines from which a claim may join the nearest cluster: of its own video at once, or if a model agrees; of another
#: video only if a model agrees.
GRAY_ZONE, CROSS_FLOOR = 0.80, 0.75
Adjudicator = Callable[[str, str, str, str], bool]  # a claim, a cluster's first claim, and the texts around them


def claim_prompts(chunks: DataFrame, batch_size: int = 5) -> DataFrame:
    """chunks: video_id, ord, chunk_id, text. One prompt per batch of a video's chunks: video_id, batch_no, prompt."""
    block = F.concat(F.lit("["), "chunk_id", F.lit("]\n"), F.coalesce("text", F.lit("")))
    rows = C.batches(chunks, "video_id", "ord", batch_size).groupBy("video_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))).alias("l"))
    rules = f"List the claims of these transcript parts as a JSON array of objects with claim, claim_type ({', '.join(C.CLAIM_TYPES)}), stance ({', '.join(C.STANCES)}), topics, and evidence (chunk_id and evidence_text, quoted). No other text.\n\n"
    return rows.select("video_id", "batch_no", F.concat(F.lit(rules), F.array_join(F.transform("l", lambda x: x["b"]), "\n\n")).alias("prompt"))


def extract_claims(chunks: DataFrame, cache: DataFrame, make_client: Callable[[], Client], batch_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """chunks: video_id, ord, chunk_id, content_hash, text. cache: content_hash, claims (array of whole claims).

    Asks a model for the chunks that the cache lacks, once for each prompt: the replies are written before anything
    reads them. Checks its claims against the ids of all chunks, and returns (new cache rows, rejections). A chunk that
    was answered without claims gets an empty list, so that it is not asked again; one whose batch failed gets no row.
    A claim counts for the chunk of its first evidence.
    """
    missing = C.cache_misses(chunks, cache)
    numbered = C.batches(missing, "video_id", "ord", batch_size)
    prompts = claim_prompts(missing, batch_size).withColumn("reply_id", F.to_json(F.struct("video_id", "batch_no")))
    replies = written(complete(prompts, make_client, "reply_id"), "replies").where("raw is not null")
    checked = C.validate_claims(replies, chunks)
    claim = F.struct("claim", "claim_type", "stance", "evidence", "topics").alias("c")
    good = checked.where("reason is null").select("reply_id", "pos", claim, F.get("evidence", F.lit(0))["chunk_id"].alias("chunk_id")).join(chunks.select("chunk_id", "content_hash"), "chunk_id")
    per = good.groupBy("content_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("reply_id", "pos", "c"))), lambda x: x["c"]).alias("claims"))
    read = replies.where(T.strip_fence(F.col("raw")).startswith("[")).select("reply_id")
    answered = numbered.select("content_hash", F.to_json(F.struct("video_id", "batch_no")).alias("reply_id")).join(read, "reply_id", "left_semi").select("content_hash")
    hashes = answered.unionByName(good.select("content_hash")).distinct()
    fresh = hashes.join(per, "content_hash", "left").select("content_hash", F.coalesce("claims", F.array().cast(f"array<{C.CLAIM}>")).alias("claims"))
    return fresh.join(cache.select("content_hash"), "content_hash", "left_anti"), checked.where("reason is not null")


def merge_prompt(claim: str, other: str, context: str = "", other_context: str = "") -> str:
    said = lambda name, text, around: f"Claim {name}: {text}" + (f"\nSaid in: {around}" if around else "")
    return (
        "Do these two claims state the same checkable thing: same subject, population, place, time and units? Likeness of topic is not enough. "
        f"Answer with a JSON object: merge (true or false) and reason. No other text.\n\n{said('A', claim, context)}\n{said('B', other, other_context)}"
    )


def merges(reply: str) -> bool:
    """A merge reply's verdict; a reply that is no JSON object is an error."""
    reply = reply.strip()
    if reply.startswith("```"):
        reply = reply.split("```")[1].removeprefix("json")
    got = json.loads(reply)
    if not isinstance(got, dict):
        raise ValueError("a merge reply is a JSON object")
    return bool(got.get("merge", False))


def asking(make_client: Callable[[], Client]) -> Callable[[], Adjudicator]:
    """An adjudicator that asks a text model."""

    def make() -> Adjudicator:
        client = make_client()
        return lambda *claims: merges(client(merge_prompt(*claims)))

    return make


def cluster_adjudicated(claims: DataFrame, make_adjudicator: Callable[[], Adjudicator], within: float = C.WITHIN_MERGE, gray: float = GRAY_ZONE, cross: float = CROSS_FLOOR) -> DataFrame:
    """claims: workspace_id, ord, claim_id, video, claim, vector, and perhaps context, the text around the claim. Adds
    cluster_id, and on each row whether the claim joined a cluster at once, whether a model was asked, about a cluster of
    the own video or of others only, and failed.

    As `cluster_greedy`; below the threshold of the own video, or for another video, the claim joins if the cosine
    reaches that case's floor and the model, shown the cluster's first claim, agrees. A failed model is no agreement.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        agrees = make_adjudicator()
        pdf = pdf.sort_values("ord", kind="stable")
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        centroids, sizes, videos, firsts, out = np.zeros_like(x), [], [], [], []
        for v, video, claim, context in zip(x, pdf["video"], pdf["claim"], pdf["context"], strict=True):
            n, best, auto, own, ask, failed, join = len(sizes), -1, 0, False, 0, 0, False
            if n:
                with np.errstate(invalid="ignore", divide="ignore"):
                    near = np.nan_to_num(centroids[:n] @ v / (np.linalg.norm(centroids[:n], axis=1) * np.linalg.norm(v)), nan=-2.0)
                best = int(near.argmax())
                own = video in videos[best]
                join = bool(own and near[best] >= within)
                auto = int(join)
                if not join and near[best] >= (gray if own else cross):
                    ask = 1
                    try:
                        join = bool(agrees(claim, firsts[best][0], context, firsts[best][1]))
                    except Exception:
                        failed = 1
            if join:
                centroids[best] = (centroids[best] * sizes[best] + v) / (sizes[best] + 1)
                sizes[best] += 1
                videos[best].add(video)
            else:
                centroids[n], best = v, n
                sizes.append(1)
                videos.append({video})
                firsts.append((claim, context))
            out.append((f"cluster_{best:04d}", auto, ask, int(ask and own), int(ask and not own), int(bool(ask and not own and join)), failed))
        told = pd.DataFrame(out, columns=["cluster_id", "auto", "asked", "asked_within", "asked_across", "joined_across", "errors"], index=pdf.index)
        return pd.concat([pdf[["workspace_id", "ord", "claim_id"]], told], axis=1)

    kinds = dict(claims.dtypes)
    schema = f"workspace_id {kinds['workspace_id']}, ord {kinds['ord']}, claim_id {kinds['claim_id']}, cluster_id string, auto int, asked int, asked_within int, asked_across int, joined_across int, errors int"
    context = F.coalesce("context", F.lit("")) if "context" in claims.columns else F.lit("")
    return claims.select("workspace_id", "ord", "claim_id", "video", "claim", "vector", context.alias("context")).groupBy("workspace_id").applyInPandas(fold, schema)


def clustering_counts(clustered: DataFrame) -> DataFrame:
    """The five counters of an adjudicated clustering, by workspace."""
    total = lambda c, name: F.sum(c).alias(name)
    return clustered.groupBy("workspace_id").agg(
        total("auto", "within_auto_merges"), total("asked_within", "within_adjudications"), total("asked_across", "cross_adjudications"), total("joined_across", "cross_merges"), total("errors", "adjudication_errors")
    )


def relationship_prompt(lines: Column) -> Column:
    """lines: array of `claim_id: claim`."""
    kinds = ", ".join(k for k in C.RELATIONSHIPS if k != "single_source")
    return F.concat(F.lit(f"How do these claims of several sources relate? Answer with a JSON object: relationship ({kinds}) and synthesis_note, which may name claims by these ids only.\n\n"), F.array_join(lines, "\n"))


def synthesize_clusters(claims: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """claims: cluster_id, ord, claim_id, claim, video_id, stance, n_evidence. The statistics of `cluster_stats`, with
    relationship, synthesis_note and status ('ok', or why the reply is refused). Clusters of one video ask no model."""
    stats = C.cluster_stats(claims)
    item = F.struct("ord", "claim_id", F.concat("claim_id", F.lit(": "), F.coalesce("claim", F.lit(""))).alias("line"))
    many = claims.join(stats.where("unique_videos >= 2").select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    asked = many.select("cluster_id", F.transform("m", lambda x: x["claim_id"]).alias("members"), relationship_prompt(F.transform("m", lambda x: x["line"])).alias("prompt"))
    got = written(complete(asked, make_client, "cluster_id").select("cluster_id", "raw"), "replies").join(asked.select("cluster_id", "members"), "cluster_id")
    reply = F.from_json(T.strip_fence(F.col("raw")), "relationship string, synthesis_note string")
    got = got.select("cluster_id", C.relationship_status(F.col("raw"), F.col("members")).alias("status"), reply.alias("r"))
    rows, one, ok = stats.join(got, "cluster_id", "left"), F.col("unique_videos") < 2, F.col("status") == "ok"
    return rows.select(*stats.columns, F.when(one, "single_source").when(ok, F.col("r.relationship")).alias("relationship"), F.when(ok, F.col("r.synthesis_note")).alias("synthesis_note"), F.when(one, "ok").otherwise(F.coalesce("status", F.lit("no_reply"))).alias("status"))


def label_themes(themes: DataFrame, claims: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """themes: theme_no, i, j, cosine. claims: ord, claim_id, claim, video_id. A relationship for each theme; a model that
    fails or answers amiss leaves it "related", without a note."""
    side = lambda at, n: claims.select(F.col("ord").alias(at), F.col("claim_id").alias(f"c{n}"), F.concat("claim_id", F.lit(": "), F.coalesce("claim", F.lit(""))).alias(f"l{n}"), F.col("video_id").alias(f"v{n}"))
    rows = themes.join(side("i", 1), "i").join(side("j", 2), "j").select("theme_no", "cosine", F.array("c1", "c2").alias("member_claim_ids"), F.array_sort(F.array_distinct(F.array("v1", "v2"))).alias("videos"), relationship_prompt(F.array("l1", "l2")).alias("prompt"))
    got = written(complete(rows, make_client, "theme_no").select("theme_no", "raw"), "replies")
    rows = rows.join(got, "theme_no", "left")
    ok = F.coalesce(C.relationship_status(F.col("raw"), F.col("member_claim_ids")) == "ok", F.lit(False)) & F.col("raw").isNotNull()
    reply = F.from_json(T.strip_fence(F.col("raw")), "relationship string, synthesis_note string")
    return rows.select("theme_no", "member_claim_ids", "videos", F.round("cosine", 3).alias("cosine"), F.when(ok, reply["relationship"]).otherwise("related").alias("relationship"), F.when(ok, reply["synthesis_note"]).otherwise("").alias("synthesis_note"))


def members(clustered: DataFrame) -> DataFrame:
    """cluster_id, size, member_claim_ids in order, for each workspace."""
    rows = clustered.groupBy("workspace_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("ord", "claim_id"))).alias("m"))
    return rows.select("workspace_id", "cluster_id", F.size("m").alias("size"), F.transform("m", lambda x: x["claim_id"]).alias("member_claim_ids"))


def emphasised(clusters: DataFrame) -> DataFrame:
    """Clusters with more than one claim, the largest first: adds place within the workspace."""
    return clusters.where("size > 1").withColumn("place", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc("size"), "cluster_id")))
