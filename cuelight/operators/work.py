"""Content-keyed work tables: skip what is done, retry only what failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip

DONE_SCHEMA = "namespace string, key string, payload string"


def content_key(*parts: Column) -> Column:
    """SHA-1 of the JSON of all inputs that decide a result."""
    return F.sha1(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))


def stage_key(stage: str, *inputs: Column) -> Column:
    """The key of a stage's work from the keys and settings that it depends on. A key that goes into another carries
    whatever it stands for on, so a change reaches all that depends on it and nothing else."""
    return content_key(F.lit(stage), *inputs)


def list_key(rows: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "list_key") -> DataFrame:
    """``by`` and the key of each group's rows, whatever their order: their number and the sum of their hashes. Groups of any
    size are added up part by part."""
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.sha1(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string"))).alias(name))


def analysis_keys(sources: DataFrame, cuts: DataFrame, chunks: DataFrame, settings: Sequence[str]) -> DataFrame:
    """``chunks`` with the chained ``key`` of their analysis: it holds the key of the source's segments, which holds its
    fingerprint, its segmenter and its cut list.

    ``sources``: ``source_id, fingerprint, segmenter``; ``cuts``: ``source_id, start, end`` where sources have a cut list;
    ``chunks``: ``source_id, start, end`` and the columns ``settings``.
    """
    listed = list_key(cuts, ["source_id"], ["start", "end"], "_cuts")
    segments = sources.join(listed, "source_id", "left").select("source_id", stage_key(
        "segments", F.col("fingerprint"), F.col("segmenter"), F.coalesce("_cuts", F.lit(""))).alias("_segments"))
    return chunks.join(segments, "source_id").withColumn("key", stage_key(
        "analysis", F.col("_segments"), F.bround("start", 3), F.bround("end", 3), *[F.col(c) for c in settings])).drop("_segments")


def context_key(intro: Column, characters: Column) -> Column:
    """Short digest of a context; ``characters``: array of name, description, images."""
    people = F.transform(characters, lambda c: F.concat_ws(
        "\u0001", F.concat_ws("\u0000", c["name"], strip(c["description"])), F.concat_ws("\u0001", c["images"])))
    digest = F.substring(F.sha2(F.concat_ws("\u0000", strip(intro), F.concat_ws("\u0000", people)), 256), 1, 16)
    empty = (strip(intro) == "") & (F.size(characters) == 0)
    return F.when(empty, "no-context").otherwise(digest)


def pending(tasks: DataFrame, done: DataFrame, namespace: str) -> DataFrame:
    """Tasks whose ``key`` has no recorded result."""
    return tasks.join(done.filter(F.col("namespace") == namespace).select("key"), "key", "left_anti")


def recorded(tasks: DataFrame, done: DataFrame, namespace: str) -> DataFrame:
    """Tasks with their recorded ``payload``."""
    return tasks.join(done.filter(F.col("namespace") == namespace).select("key", "payload"), "key")


def record(done: DataFrame, results: DataFrame, namespace: str) -> DataFrame:
    """Add the successful results (``key, payload, error``); failures stay open."""
    fresh = results.filter("error IS NULL").select(F.lit(namespace).alias("namespace"), "key", "payload")
    kept = done.join(fresh.select("namespace", "key").distinct(), ["namespace", "key"], "left_anti")
    return kept.select("namespace", "key", "payload").unionByName(fresh.dropDuplicates(["key"]))


def plan_tasks(chunks: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Add the content key of every chunk: source, rounded times and ``inputs``."""
    return chunks.withColumn("key", content_key(
        F.col("source_id"), F.bround("start", 3), F.bround("end", 3), *[F.col(c) for c in inputs]
    ))
