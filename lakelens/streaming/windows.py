"""Event streams: routing, windows with watermarks, idempotent sinks and expiring state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def route(kind: Column) -> Column:
    return F.when(kind == "signup", "installation").when(kind == "purchase", "push").when(kind.isin("view", "click"), "pull_request").otherwise("ignored")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with event time as a real timestamp, which watermarks ask for."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if not name.endswith(".parquet") or _is_folder(spark, path) else name).parquet(path if _is_folder(spark, path) else folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days by event time; rows later than the watermark are left to a repair run."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def gated(events: DataFrame, repositories: DataFrame) -> DataFrame:
    """events(event_id, route, action, ref, repo_id) -> what each of them leads to: status, action or reason.

    A stream or a table of events meets the table of repositories on its key; deleted ones count as not
    connected. Pushes to the default branch queue an index run, opened or updated pull requests of an indexed
    repository a review, the end of an installation takes its repositories away. A null key or ref is ignored.
    """
    r = repositories.where("deleted_at IS NULL").select("repo_id", "default_branch", "index_status", F.lit(True).alias("connected"))
    j = events.join(r, "repo_id", "left")
    push, pull, kind = F.col("route") == "push", F.col("route") == "pull_request", F.col("route")
    reason = (
        F.when(push & F.col("repo_id").isNull(), "no repository id").when(push & F.col("connected").isNull(), "repository not connected")
        .when(push & ~F.coalesce(F.col("ref").endswith(F.concat(F.lit("/"), F.col("default_branch"))), F.lit(False)), "not default branch")
        .when(pull & ~F.coalesce(F.col("action").isin("opened", "synchronize"), F.lit(False)), F.concat(F.lit("action "), F.coalesce("action", F.lit("none")), F.lit(" not handled")))
        .when(pull & F.col("repo_id").isNull(), "no repository id").when(pull & F.col("connected").isNull(), "repository not connected")
        .when(pull & ~F.coalesce(F.col("index_status") == "ready", F.lit(False)), "repository not indexed")
        .when((kind == "installation") & ~F.coalesce(F.col("action").isin("created", "deleted"), F.lit(False)), F.concat(F.lit("action "), F.coalesce("action", F.lit("none"))))
        .when(~kind.isin("push", "pull_request", "installation", "ping"), "ignored")
    )
    done = F.when(push, "reindex_queued").when(pull, "review_queued").when((kind == "installation") & (F.col("action") == "deleted"), "uninstalled").when(kind == "installation", "installed").otherwise("pong")
    return j.select("event_id", "route", "repo_id", F.when(reason.isNull(), "ok").otherwise("ignored").alias("status"), F.when(reason.isNull(), done).alias("outcome"), reason.alias("reason"))


def run_router(events: DataFrame, repositories: DataFrame, folder: str) -> None:
    """A stream of events through the gates into one table for each outcome; a batch that is repeated overwrites itself."""

    def keep(batch: DataFrame, number: int) -> None:
        gated(batch, repositories).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "outcome").parquet(f"{folder}/outcomes")

    events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def without_deleted(repositories: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Repositories with those marked as deleted whose installation ended; earlier marks stay."""
    gone = outcomes.where("outcome = 'uninstalled'").select("repo_id").distinct().withColumn("gone", F.lit(True))
    marked = repositories.join(gone, "repo_id", "left")
    return marked.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("gone"), at))).drop("gone").select(*repositories.columns)


def run_daily(spark: SparkSession, path: str, late: str = "365 days") -> DataFrame:
    """Counts per day of all events: a stream in update form, merged in foreachBatch into a table in the shared folder. Days close, and leave the state, when the newest event is so much later."""
    base = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    counts = read_events(spark, path).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("day"), "event_type", "events", "total").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number:08d}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return got.groupBy("day", "event_type").agg(F.max_by(F.struct("events", "total"), "batch").alias("x")).select("day", "event_type", "x.events", "x.total")


def append_new(batch: DataFrame, path: str, keys: list[str], part: str | None = None) -> None:
    """Idempotent sink for foreachBatch: rows whose key is already stored are left out. With `part`, a column of the key that the table is partitioned by, only the partitions of the batch are read."""
    spark = batch.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        if part:
            old = old.join(batch.select(part).distinct(), part, "left_semi")
        batch = batch.join(old.select(*keys), keys, "left_anti")
    out = batch.dropDuplicates(keys).write.mode("append")
    (out.partitionBy(part) if part else out).parquet(path)


def latest_with_ttl(rows: DataFrame, keys: list[str], stamp: str, ttl: str, as_of: Column) -> DataFrame:
    """The newest entry of each key that has not expired at a given time: what a cache with a time to live holds."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), stamp).alias("x")).select(*keys, "x.*")
    return best.where(F.col(stamp) + F.expr(f"INTERVAL {ttl}") > as_of)
