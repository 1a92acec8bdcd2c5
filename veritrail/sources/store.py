"""Scans, sinks and workspace tables.

Tables of a workspace are Parquet folders partitioned by workspace_id. A new version of a partition is written whole
beside the table, where no reader looks, and then takes the old one's place by renaming.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql import Window as W

RAW = (
    "metadata STRUCT<video_id STRING, title STRING, channel STRING, channel_url STRING, subscriber_count BIGINT, duration_seconds BIGINT, view_count BIGINT, like_count BIGINT, comment_count BIGINT, "
    "upload_date STRING, tags ARRAY<STRING>, categories ARRAY<STRING>, thumbnail_url STRING, is_live BOOLEAN, language STRING, description STRING>, transcript STRING"
)


_made: list[tuple[SparkSession, str]] = []

#: Bytes of a table for each core up to which it is dealt out again.
SPREAD_BYTES = 64 << 20


def checked_workspace(workspace_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", workspace_id):
        raise ValueError(f"not a workspace id: {workspace_id!r}")
    return workspace_id


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def spread(df: DataFrame, path: str) -> DataFrame:
    """df, a table at path, over all cores. Files of one row group are read by one task each; a table that leaves each
    core at most SPREAD_BYTES is dealt out again, and a larger one if one of its tasks has over 1.5 times a core's share."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    cores = spark.sparkContext.defaultParallelism
    size = fs.getContentSummary(at).getLength()
    if size > cores * SPREAD_BYTES:
        most, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()  # reads footers only
        if (most or 0) * cores <= 1.5 * (rows or 0):
            return df
    return df.repartition(cores * max(1, -(-size // (cores * SPREAD_BYTES))))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; what it holds goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'veritrail-shared')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.append((spark, path))
    return path


def _remove_made() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            try:
                fs, at = _fs(spark, path)
                fs.delete(at, True)
            except Exception:  # noqa: BLE001, S112  the JVM may be gone at exit; the folder is then left
                continue


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written into the shared folder, and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {metadata, transcript}; anything else at the root is an error. Videos without a transcript go."""
    fs, at = _fs(spark, path)
    files = [x.getPath() for x in fs.listStatus(at) if x.isFile() and x.getPath().getName()[0] not in "._"] if fs.getFileStatus(at).isDirectory() else [at]
    for file in files:  # few: a video file is written by hand or by one transcription
        stream = fs.open(file)
        try:
            c = stream.read()
            while c in (0x20, 0x09, 0x0A, 0x0D, 0xEF, 0xBB, 0xBF):
                c = stream.read()
        finally:
            stream.close()
        if c != ord("["):
            raise ValueError("the root of a video file must be a JSON array")
    raw = spark.read.schema(RAW).option("multiLine", True).json(path).where("length(transcript) > 0")
    m = lambda k, d="": F.coalesce(F.col(f"metadata.{k}"), F.lit(d)).alias(k)
    return raw.select(m("video_id"), m("title", "Untitled"), m("channel", "Unknown"), F.coalesce("metadata.duration_seconds", F.lit(0)).alias("duration_seconds"), m("upload_date"), F.coalesce("metadata.tags", F.array().cast("array<string>")).alias("tags"), m("description"), "transcript")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON file; a missing or corrupt file has none."""
    schema = "role STRING, content STRING, mode STRING"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and comments go."""
    url = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(url.alias("url")).where("url <> '' and not startswith(url, '#')")


def overwrite_workspace(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the workspaces that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)


def replace_workspace(df: DataFrame, path: str, workspace_id: str) -> None:
    """df, without workspace_id, becomes this workspace's partition, also where it has no rows. A plan that reads the
    old one may make it: nothing is replaced before the new one is whole."""
    checked_workspace(workspace_id)
    fs, new = _fs(df.sparkSession, f"{path}/_new-{uuid.uuid4().hex}")
    place = lambda p: _fs(df.sparkSession, p)[1]
    df.write.parquet(new.toString())
    old, at = place(f"{path}/_old-{uuid.uuid4().hex}"), place(f"{path}/workspace_id={workspace_id}")
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{new} can't be renamed to {at}")
    fs.delete(old, True)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(table: DataFrame, changes: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """One row per key: the newest of both."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(*[F.expr(c.split()[0]).desc() if c.endswith(" desc") else F.expr(c) for c in newest]))
    return table.unionByName(changes).withColumn("nth", nth).where("nth = 1").drop("nth")


def without_workspace(table: DataFrame, column: str, value) -> DataFrame:
    return table.where(~F.col(column).eqNullSafe(F.lit(value)))


def delete_workspace(spark: SparkSession, path: str, workspace_id: str) -> int:
    """Deletes a workspace's partition; returns its rows, 0 for a table or partition that is not there."""
    checked_workspace(workspace_id)
    if not exists(spark, path):
        return 0
    n = spark.read.parquet(path).where(F.col("workspace_id") == workspace_id).count()
    fs, at = _fs(spark, f"{path}/workspace_id={workspace_id}")
    fs.delete(at, True)
    return n


def last_messages(messages: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    cols = [F.expr(c.split()[0]).desc() if c.endswith(" desc") else F.expr(c) for c in order]
    return messages.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*cols))).where(F.col("n") <= n)


def workspace_counts(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    c = chunks.groupBy("workspace_id").agg(F.count_distinct("video_id").alias("videos"), F.count("*").alias("chunks"))
    m = messages.groupBy("workspace_id").agg(F.count("*").alias("messages"))
    zero = lambda k: F.coalesce(k, F.lit(0).cast("long"))
    return c.join(m, "workspace_id", "full").select("workspace_id", zero("videos").alias("videos"), zero("chunks").alias("chunks"), F.floor(zero("messages") / 2).alias("exchanges"))


def status(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Records of each artefact; null: not there."""
    out = None
    for name, path in tables.items():
        row = spark.read.parquet(path).agg(F.count("*").alias("records")) if exists(spark, path) else spark.range(1).select(F.lit(None).cast("long").alias("records"))
        row = row.select(F.lit(name).alias("artefact"), "records")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], S.StructType().add("artefact", "string").add("records", "long"))


def signatures(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """A hash of each group's rows in order, to see whether inputs changed."""
    line = F.concat(F.col(order).cast("string"), F.lit(":"), F.col(value))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), ",")
    return rows.groupBy(by).agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("signature"))


def fingerprint(rows: DataFrame, *settings) -> str:
    """A short hash of a step's input rows, in any order, and its settings: whether the step would see anything new."""
    h = F.xxhash64(F.lit(1), F.to_json(F.struct("*"))), F.xxhash64(F.lit(2), F.to_json(F.struct("*")))
    seen = rows.select(h[0].alias("a"), h[1].alias("b")).agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b"), F.sum(F.col("a") % 1_000_003)).first()
    return hashlib.sha256(repr((tuple(seen), settings)).encode()).hexdigest()[:16]


def read_signature(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    return spark.read.text(path).first()[0] if fs.exists(at) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in place of another."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
