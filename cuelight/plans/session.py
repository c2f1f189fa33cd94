"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cuelight") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(REPEATED_KEYS, "true")
        .getOrCreate()
    )


# What a large cluster should set; pass to spark-submit or a session builder.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    REPEATED_KEYS: "true",
}


def last_key_counts(spark: SparkSession) -> None:
    """Let JSON objects with a repeated key be read, the last value counting. Spark refuses them unless its session says
    otherwise, so the readers of documents and replies set it in the session of their input."""
    spark.conf.set(REPEATED_KEYS, "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: what the cluster names in
    ``spark.checkpoint.dir``. Only a local master falls back to a temporary
    folder; on a cluster a missing setting is an error."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cuelight-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Like ``checkpointed``, but as Parquet: readers fetch only the columns that they use."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_listings(spark: SparkSession) -> None:
    """Let a few tasks list the files of many folders, or look up many files, where Spark starts one task for each, up to 10,000. Readers
    of many small files set it in the session of their input: a stream looks its files up in every batch."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.set(key, str(min(int(spark.conf.get(key)), 4 * spark.sparkContext.defaultParallelism)))


def _folder(name: str, value: str | None) -> str:
    """The folder of a partition value, as Spark names it."""
    shown = "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value or "")
    return f"{name}={shown or '__HIVE_DEFAULT_PARTITION__'}"


class FilesWriter:
    """A writer of text files like Spark's, for a few rows a file. To folders of a file system the tasks write their files with plain calls:
    Spark's own access to one starts a process for every file and folder, to set its rights. To any other store Spark's writer writes."""

    def __init__(self, df: DataFrame):
        self.df, self.keys, self.overwrite, self.options = df, [], False, {}

    def option(self, key: str, value: object) -> FilesWriter:
        self.options[key] = value
        return self

    def mode(self, mode: str) -> FilesWriter:
        self.overwrite = mode == "overwrite"
        return self

    def partitionBy(self, *keys: str) -> FilesWriter:
        self.keys = list(keys)
        return self

    def text(self, path: str) -> None:
        spark = self.df.sparkSession
        store, place = _files(spark, path)
        if store.getScheme() != "file" or set(self.options) - {"maxRecordsPerFile"} or store.exists(place) and not self.overwrite:
            writer = self.df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").options(**self.options)
            return writer.mode("overwrite" if self.overwrite else "errorifexists").partitionBy(*self.keys).text(path)
        store.delete(place, True)
        store.mkdirs(place)
        root, keys, most, name = place.toUri().getPath(), self.keys, int(self.options.get("maxRecordsPerFile", 0)), uuid.uuid4().hex

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, seen, out, now, rows, number = TaskContext.get().partitionId(), set(), None, None, 0, 0

            def close() -> None:
                if out:
                    out.close()
                    if out.name != final:
                        os.replace(out.name, final)

            for batch in batches:
                for at in range(0, len(batch), 256):
                    *values, texts = (c.slice(at, 256).to_pylist() for c in batch.columns)
                    for key, line in zip(zip(*values) if values else [()] * len(texts), texts):
                        if out is None or key != now or most and rows == most:
                            close()
                            number, rows, now = number + 1 if most else 0, 0, key
                            folder = "/".join([root, *map(_folder, keys, key)])
                            final = f"{folder}/part-{task:05d}-{name}-c{number:03d}.txt"
                            if final in seen:  # the value came before
                                out = open(final, "ab")
                            else:
                                seen.add(final)
                                os.makedirs(folder, exist_ok=True)
                                out = open(f"{folder}/.{task:05d}-{name}", "wb")
                        out.write((line or "").encode() + b"\n")
                        rows += 1
            close()
            yield pa.RecordBatch.from_arrays([pa.array([len(seen)])], names=["files"])

        lines = [c for c in self.df.columns if c not in keys]
        self.df.select(*[F.col(k).cast("string") for k in keys], *lines).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def many_files(df: DataFrame) -> FilesWriter:
    """A writer for as many files as there are rows: every task puts its own files in place, where the driver would
    otherwise move them one by one at the end. A write that fails leaves the files of the tasks that were done."""
    return FilesWriter(df)


def at_once(spark: SparkSession, tasks: Sequence[Callable[[], object]]) -> list:
    """The results of a few independent steps whose Spark jobs may run side by side: a small job is mostly waiting."""
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def _files(spark: SparkSession, path: str):
    """Spark's own access to the store that holds ``path``, and the path in its form."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, in any store that Spark reaches; nothing happens if it is not there."""
    store, place = _files(spark, path)
    store.delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``; none if it is not there."""
    store, place = _files(spark, path)
    if not store.exists(place):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.isDirectory())


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy, so
    that both readers of it see the same rows and a lost executor costs no
    recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
