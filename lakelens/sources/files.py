"""File trees in, tables and documents out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import kept


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders below a root that may hold sources, found without going into the others."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [top]
    while todo:
        at = todo.pop()
        out.append(at.toString())
        todo += [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName() not in X.SKIP_DIRS]
    return out


def read_tree(spark: SparkSession, root: str, repo_id: str, most: int = 1024 * 1024) -> DataFrame:
    """Files below a folder with relative paths; bytes that are no UTF-8 are replaced. Folders that hold no sources are not read, and of files over `most` bytes only their size is."""
    raw = spark.read.format("binaryFile").load(folders(spark, root))
    base = root.rstrip("/").removeprefix("file://") + "/"
    rel = F.regexp_replace("path", r"^(?:\w+:/{0,2}(?=/))?" + re.escape(base), "")
    plain = [F.lit(repo_id).alias("repo_id"), rel.alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    small = raw.where(F.col("length") <= most).select(*plain, F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return small.unionAll(raw.where(F.col("length") > most).select(*plain, F.lit(None).cast("string").alias("content")))


def loadable(files: DataFrame) -> DataFrame:
    """Files that are loaded for analysis: unknown languages stay, everything else with a skip reason goes."""
    reason = X.path_skip_reason(F.col("file_path"), F.col("size_bytes"))
    return files.where(reason.isNull() | (reason == "unsupported_language"))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Changed files of a pull request, one JSON object a line; only added and modified files are analysed."""
    return spark.read.schema("filename string, status string, patch string").json(path).where(F.col("status").isin("added", "modified"))


def append(df: DataFrame, path: str, by: str = "scan_run_id") -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str = "repo_id") -> None:
    """Rows of the keys in df replace what is stored under them; other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def chunk_ids(df: DataFrame) -> DataFrame:
    """Stable ids for an index: a digest of place and text in the form of a UUID."""
    h = F.md5(F.concat_ws(":", "repo_id", "file_path", F.col("line_start").cast("string"), "content"))
    return df.withColumn("point_id", F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def context_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON record per key with all other columns, keys in alphabetical order."""
    rest = sorted(c for c in df.columns if c != key)
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in rest])).alias("json"))


def write_documents(docs: DataFrame, path: str) -> None:
    """docs(name, body): a folder for each name with the body in it, lines as they are."""
    docs.select("name", F.col("body").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def upsert(df: DataFrame, path: str, key: str = "point_id", by: str = "repo_id") -> None:
    """Rows replace stored rows of the same key; partitions without a row in df are not touched."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.dropDuplicates([key]).write.partitionBy(by).parquet(path)
        return
    touched = old.join(df.select(by).distinct(), by, "left_semi").join(df.select(key), key, "left_anti")
    whole = kept(touched.unionByName(df.dropDuplicates([key])))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_where(spark: SparkSession, path: str, condition: str, by: str = "repo_id") -> None:
    """Drops the stored rows that meet a condition; only partitions that hold one are written anew."""
    old = spark.read.parquet(path)
    hit = old.where(condition).select(by).distinct()
    rest = kept(old.join(hit, by, "left_semi").where(f"NOT coalesce({condition}, false)"))
    emptied = [r[0] for r in hit.join(rest.select(by).distinct(), by, "left_anti").collect()]  # keys of a partition, as a listing of folders has them
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    jvm = spark.sparkContext._jvm
    for value in emptied:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
