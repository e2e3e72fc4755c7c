"""Session transcripts: JSON lines with their order kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.session import stored

USAGE = "struct<input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>"
LINE = f"type string, sessionId string, uuid string, parentUuid string, requestId string, timestamp string, version string, subtype string, message struct<role:string,model:string,content:string,usage:{USAGE}>"


def read_transcripts(spark: SparkSession, paths: str | list[str], names: str = "*.jsonl") -> DataFrame:
    """One row for each well-formed line of the files so named: file, pos, and the line's fields. A file is one task, so many files run in parallel."""
    raw = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "raw"))
    parsed = raw.filter("trim(raw) <> ''").withColumn("line", F.from_json("raw", LINE, {"mode": "PERMISSIVE"}))
    return parsed.filter("line.type is not null").select("file", "pos", "line.*")


def transcript_requests(lines: DataFrame, keep: str = "last") -> DataFrame:
    """One row for each request: the last (or first) usage row wins, the turn is its first appearance; synthetic models go.

    Cache writes come by tier (cache_write_5m, cache_write_1h, 0 where a row does not say); ``cache_write`` is their sum, or the row's total where
    that is 0.
    """
    rows = lines.filter("message.usage is not null and requestId is not null and coalesce(message.model, '') <> '<synthetic>'")
    pick = F.max_by if keep == "last" else F.min_by
    one = rows.groupBy("sessionId", "requestId").agg(F.min("pos").alias("first_pos"), pick(F.struct(F.col("message.model").alias("model"), "timestamp", "message.usage", "version"), F.col("pos")).alias("r"))
    w = Window.partitionBy("sessionId").orderBy("first_pos")
    u = "r.usage"
    tier = lambda c: F.coalesce(F.col(f"{u}.cache_creation.ephemeral_{c}_input_tokens"), F.lit(0))
    written = F.coalesce(F.nullif(tier("5m") + tier("1h"), F.lit(0)), F.col(f"{u}.cache_creation_input_tokens"))
    return one.select(F.col("sessionId").alias("session"), F.col("requestId").alias("id"), (F.row_number().over(w) - 1).cast("bigint").alias("turn"), "r.model", F.try_to_timestamp("r.timestamp").alias("ts"), F.col(f"{u}.input_tokens").alias("input"), F.col(f"{u}.cache_read_input_tokens").alias("cache_read"), written.alias("cache_write"), F.col(f"{u}.output_tokens").alias("output"), F.col("r.version").alias("version"), tier("5m").alias("cache_write_5m"), tier("1h").alias("cache_write_1h"))


def transcript_lineage(lines: DataFrame) -> DataFrame:
    """(id, session, parent, usage, boundary, request) of every line with an id: the rows of a lineage. A request's first line has its usage; its
    later lines lead to that one, whatever their own parent. Boundaries are compactions."""
    rows = lines.filter("uuid is not null").withColumn("asks", (F.col("type") == "assistant") & F.col("message.usage").isNotNull() & (F.coalesce("message.model", F.lit("")) != "<synthetic>"))
    key = F.when(F.col("asks") & F.col("requestId").isNotNull(), F.col("requestId"))
    first = Window.partitionBy("sessionId", key).orderBy("pos")
    r = rows.withColumn("first", F.when(key.isNotNull(), F.first("uuid").over(first))).withColumn("again", F.coalesce(F.col("first") != F.col("uuid"), F.lit(False)))
    return r.select(F.col("uuid").alias("id"), F.col("sessionId").alias("session"), F.when(F.col("again"), F.col("first")).otherwise(F.col("parentUuid")).alias("parent"), (F.col("asks") & ~F.col("again")).alias("usage"), ((F.col("type") == "system") & (F.coalesce("subtype", F.lit("")) == "compact_boundary")).alias("boundary"), "pos", key.alias("request"))


def replace_sessions(df: DataFrame, path: str, by: str = "session", buckets: int = 64) -> None:
    """Idempotent re-ingest: each session in ``df`` replaces its own rows and no other's. Sessions share ``buckets`` folders by a hash, so many
    sessions make few files; only the folders of the sessions at hand are written again, with the rows of their other sessions."""
    spark = df.sparkSession
    new = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        old = None
    if old is not None:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        stay = old.filter(F.col("bucket").isin(touched)).join(df.select(by).distinct(), by, "left_anti")
        new = stored(new.unionByName(stay, allowMissingColumns=True), "sessions")  # read before its folders are replaced
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def require_version(rows: DataFrame, version: str, column: str = "schema_version") -> DataFrame:
    """``rows``, which fail where they are read if any row carries another schema version, or none."""
    fits = F.col(column).eqNullSafe(F.lit(version))
    return rows.filter(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("unexpected schema version "), F.coalesce(F.col(column).cast("string"), F.lit("none")))).cast("boolean")))
