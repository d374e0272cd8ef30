"""Sources and sinks: transcripts, stage tables, vectors, media listings, and incremental work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "job_id string, merged_text string, chunks array<struct<chunk_id:string,start:double,end:double,text:string,confidence:double>>"
MEDIA = ("mp4", "mov", "mkv", "webm", "m4v")


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per chunk of nested transcript JSON documents."""
    return scan_transcripts(spark, path, multi_line)[0]


def scan_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, bad): one row per chunk, and (path, raw) of each document that is no readable transcript."""
    raw = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_path"))
    t = raw.select("_path", F.from_json("value", f"{TRANSCRIPT}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("t")).select("_path", "t.*")
    c = t.where("_bad is null").select("job_id", F.posexplode("chunks").alias("chunk_idx", "c"))
    chunks = c.select("job_id", "chunk_idx", "c.chunk_id", F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"), "c.text", F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"))
    return chunks, t.where("_bad is not null").select(F.col("_path").alias("path"), F.col("_bad").alias("raw"))


def write_transcripts(chunks: DataFrame, merged: DataFrame, path: str) -> None:
    row = F.struct(F.col("chunk_idx"), F.struct("chunk_id", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).alias("c"))
    nested = chunks.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("chunks"))
    nested.join(merged, "job_id", "left").select(F.col("job_id").cast("string").alias("job_id"), "merged_text", "chunks").write.mode("overwrite").json(path)


def write_stage(df: DataFrame, path: str, stage: str, buckets: int | None = None) -> DataFrame:
    """Writes one dataset of a stage; Spark's commit puts it in place whole. Reads it back."""
    out = f"{path}/{stage}"
    (df.repartition(buckets, "job_id") if buckets else df).write.mode("overwrite").parquet(out)
    return df.sparkSession.read.parquet(out)


def replace_partitions(df: DataFrame, path: str, stage: str, by: str) -> DataFrame:
    """Writes a stage's dataset in partitions of `by`; partitions that `df` has take the place of those there, all others
    stay. Reads the whole dataset back, so that filters on `by` read their partitions only."""
    out = f"{path}/{stage}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).withColumn(column, F.col(column).cast("array<double>"))


def write_synopses(df: DataFrame, path: str) -> None:
    """Synopses and excerpts of blocks as JSON lines, one object a block."""
    df.write.mode("overwrite").json(path)


def read_synopses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("job_id string, block_idx int, synopsis string, representative_excerpt string").json(path)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose keys are not done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_batches(batches: DataFrame, done: DataFrame, batch: list[str], key: str) -> DataFrame:
    """All rows of the batches that have at least one key that is not done."""
    marked = batches.join(done.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    open_ = marked.groupBy(*batch).agg(F.bool_and(F.coalesce("_d", F.lit(False))).alias("_all")).where(~F.col("_all")).select(*batch)
    return batches.join(open_, batch, "left_semi")


def allowed_media(files: DataFrame, most: int = 2 << 30) -> DataFrame:
    """Files (path, length) with a video extension and a size above 0 and at most 2 GiB."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.where(ext.isin(*MEDIA) & (F.col("length") > 0) & (F.col("length") <= most))


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir).

    A temporary folder stands in only where that setting is unset and all of Spark runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/clipgraph-" + spark.sparkContext.applicationId
    return f"{base}/clipgraph/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Removes what materialize() and the other users of work_path() wrote in this application. Results that are still
    to be read from there must be written elsewhere first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_path(spark, "x")).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Removes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage. The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path, before = work_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
