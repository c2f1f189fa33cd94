"""Readers and writers for the file formats around the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import parse_timestamp, strip
from ..plans.rows import computed
from ..plans.scan import last_known, ordered_scan
from ..plans.session import many_files
from .documents import parse_documents, plain_path, read_texts, with_defaults, write_documents


def scan_manifests(spark: SparkSession, root: str, name: str = "manifest.json") -> tuple[DataFrame, DataFrame]:
    """All manifests below ``root`` as (documents with ``manifest_path``, rejects)."""
    texts = read_texts(spark, root, name).withColumnRenamed("path", "manifest_path")
    return parse_documents(texts, "text", schemas.MANIFEST)


def parse_manifests(texts: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    return parse_documents(texts, column, schemas.MANIFEST)


def build_manifests(sources: DataFrame, extracts: DataFrame, clips: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One manifest row per extract from flat tables.

    ``clips`` has ``extract_id`` and the clip fields of a manifest; a manifest is
    one document, so its clips are gathered into that one row. ``summaries`` has
    ``source_id`` and the fields of a summary; a source without one has null.
    """
    fields = [F.col(f.name) for f in schemas.CLIP]
    gathered = clips.groupBy("extract_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("clips")
    )
    told = summaries if summaries is not None else sources.select("source_id").limit(0)
    parts = [F.col(f.name) if f.name in told.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SUMMARY]
    told = told.select("source_id", F.struct(*parts).alias("summary"))
    return (
        extracts.join(sources, "source_id")
        .join(gathered, "extract_id", "left")
        .join(told, "source_id", "left")
        .select(
            "manifest_path",
            F.lit(schemas.MANIFEST_VERSION).alias("schema_version"),
            F.struct(F.col("file_path").alias("file"), "duration", "resolution", "fps").alias("source"),
            F.struct("segmenter", "analyzer", "game_profile", "created_at").alias("extract"),
            "taxonomy", "clips", "summary",
        )
    )


def manifest_json(manifests: DataFrame, keep: Sequence[str] = ("manifest_path",)) -> DataFrame:
    """The columns ``keep`` and ``text``: the document as JSON, signals as an object again. Missing optional fields are written as
    their defaults, so that the text can be read strictly."""
    clip = lambda c: F.struct(*[
        (F.parse_json(c[f.name]) if f.name == "game_signals" else c[f.name]).alias(f.name) for f in schemas.CLIP
    ])
    known = StructType([f for f in schemas.MANIFEST if f.name in manifests.columns])
    full = manifests.select(*keep, F.struct(*known.names).alias("_doc")).select(
        *keep, F.expr(with_defaults("_doc", known)).alias("_full"))
    return full.select(*keep, "_full.*").withColumn("clips", F.transform("clips", clip)).select(
        *keep, F.to_json(F.struct(*known.names), {"ignoreNullFields": "false"}).alias("text")
    )


def write_manifests(manifests: DataFrame, path: str, partition: str | None = None) -> None:
    """One document per line, as ``scan_manifests`` reads it; ``partition`` gives each value, such as the stem of a source,
    a folder of its own, and with one manifest per value every file is a manifest."""
    writer = many_files(manifest_json(manifests, [partition] if partition else [])).mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def scan_edls(spark: SparkSession, root: str, name: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Edit documents below ``root`` with ``edl_id`` (their path), and rejects."""
    texts = read_texts(spark, root, name).withColumnRenamed("path", "edl_id")
    return parse_edls(texts)


def parse_edls(texts: DataFrame, column: str = "text", **kwargs) -> tuple[DataFrame, DataFrame]:
    return parse_documents(texts, column, schemas.EDL, schemas.EDL_CHOICES, **kwargs)


def write_edls(edls: DataFrame, path: str) -> None:
    write_documents(edls, path)


def scan_cut_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``path, start, end`` from CSV cut lists, and the unusable lines."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), strip("value").alias("line")
    )
    return parse_cut_lines(lines)


def parse_cut_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut-list lines to ranges; blank lines and ``#`` comments are skipped."""
    used = lines.filter(F.length(F.regexp_replace("line", r"[\s,]", "")) > 0).filter(~strip("line").startswith("#"))
    fields = F.split("line", ",")
    timed = computed(used, {
        "start": F.when(F.size(fields) >= 2, parse_timestamp(fields[0])),
        "end": F.when(F.size(fields) >= 2, parse_timestamp(fields[1])),
    })
    good = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    return timed.filter(good).drop("line"), timed.filter(~good)


def scan_subtitle_files(spark: SparkSession, path: str, name: str = "*.{srt,vtt}") -> DataFrame:
    """``path, content`` of subtitle files; bad bytes replaced, byte-order mark removed."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", name).load(path)
    )
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        plain_path(F.col("path")).alias("path"), F.regexp_replace(text, "^﻿", "").alias("content")
    )


def scan_context(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Intro and characters of context files, and rejects."""
    return parse_documents(read_texts(spark, path, name), "text", schemas.CONTEXT)


def scan_loudness_log(spark: SparkSession, path: str, name: str | None = None, **kwargs) -> DataFrame:
    """``path, t, db`` from level-meter logs, read line by line: a long log is many rows, in the order of its parts and of the
    lines in them."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", name) if name else reader).text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return parse_log_lines(lines, "path", ["part", "line_no"], **kwargs)


def parse_loudness_log(logs: DataFrame, key: str = "path", **kwargs) -> DataFrame:
    """The levels of logs that are at hand as whole texts (``key, text``)."""
    lines = logs.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return parse_log_lines(lines, key, ["line_no"], **kwargs)


def parse_log_lines(lines: DataFrame, key: str, order: Sequence[str], **kwargs) -> DataFrame:
    """Pair each level line with the latest time line before it.

    ``lines``: ``key``, the columns of ``order``, and ``line``. A time that cannot be read blanks the current time;
    a level that cannot be read is skipped.
    """
    line = strip(F.regexp_replace(strip("line"), r"^\[[^\]]*\]", ""))
    is_time = line.contains("pts_time:")
    stamp = F.regexp_extract(line, r"(?:^|\s)pts_time:(\S*)", 1).try_cast("double")
    is_level = ~is_time & line.contains("lavfi.astats.Overall.RMS_level=")
    level = F.element_at(F.split(line, "=", 2), 2)
    level = F.when(F.lower(strip(level)).isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(
        level.try_cast("double")
    )
    marked = lines.select(
        key, *order, F.when(is_time, F.struct(stamp.alias("t"))).alias("clock"),
        F.when(is_level, level).alias("db"),
    ).filter("clock IS NOT NULL OR db IS NOT NULL")
    timed = ordered_scan(marked, [key], order, [last_known("now", F.col("clock"))], **kwargs)
    return timed.filter("db IS NOT NULL AND now.t IS NOT NULL").select(key, F.col("now.t").alias("t"), "db")


def fingerprint_files(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``path, fingerprint`` from path, size and whole-second change time, without
    reading any content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name:
        reader = reader.option("pathGlobFilter", name)
    files = reader.load(path).select("path", "length", "modificationTime")
    return files.select(
        plain_path(F.col("path")).alias("path"),
        fingerprint(plain_path(F.col("path")), F.col("length"), F.unix_seconds("modificationTime")).alias("fingerprint"),
    )


def fingerprint(path, length, seconds):
    return F.sha1(F.concat(path, length.cast("string"), seconds.cast("string")))


def scan_alignments(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``utterance_id, characters, start_times, end_times`` from JSON files, and rejects: unknown keys, missing or wrong
    fields, and arrays of unequal length."""
    return parse_alignments(read_texts(spark, path, name).withColumnRenamed("path", "utterance_id"))


def parse_alignments(texts: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Alignments from JSON texts beside the other columns, and rejects with a ``problems`` array."""
    good, bad = parse_documents(texts.withColumn("_raw", F.col(column)), column, schemas.ALIGNMENT)
    sizes = [F.size(n) for n in ("characters", "start_times", "end_times")]
    equal = (sizes[0] == sizes[1]) & (sizes[1] == sizes[2])
    others = [c for c in texts.columns if c != column]
    unequal = good.filter(~equal).select(*others, F.col("_raw").alias("text"), F.array(F.concat(
        F.lit("unequal lengths: "), F.concat_ws(", ", *[s.cast("string") for s in sizes]))).alias("problems"))
    return good.filter(equal).drop("_raw"), bad.drop("_raw").unionByName(unequal)


def alignment_characters(alignments: DataFrame) -> DataFrame:
    """One row per character: ``utterance_id, pos, ch, start, end``."""
    zipped = F.arrays_zip(F.col("characters").alias("ch"), F.col("start_times").alias("start"),
                          F.col("end_times").alias("end"))
    return alignments.select("utterance_id", F.posexplode(zipped).alias("pos", "c")).select(
        "utterance_id", "pos", F.col("c.ch").alias("ch"), F.col("c.start").alias("start"), F.col("c.end").alias("end")
    )


def resolve_sidecars(videos: DataFrame, files: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """The subtitle file of each video: ``video, subtitle`` (null when none).

    ``videos``: ``video``; ``files``: ``path``; ``explicit``: ``video, path``.
    Order: explicit, ``<stem>.srt``, ``<stem>.vtt``, then the first of
    ``<stem>.*.srt``, then of ``<stem>.*.vtt``. A file offers itself under every
    stem it can serve, so the match is an equi-join.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*/)?[^/]*$", 1)
    leaf = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    stems = videos.select(
        "video", folder(F.col("video")).alias("folder"),
        F.regexp_replace(leaf(F.col("video")), r"(?<=.)\.[^.]*$", "").alias("stem"),
    )
    kind = F.regexp_extract(F.col("path"), r"\.(srt|vtt)$", 1)
    parts = F.split(F.regexp_replace(leaf(F.col("path")), r"\.(srt|vtt)$", ""), r"\.")
    usable = files.filter(kind != "").withColumn("late", F.when(kind == "srt", 0).otherwise(1))
    offers = usable.select(
        "path", folder(F.col("path")).alias("folder"), "late",
        F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))).alias("depth", "stem"),
    ).withColumn("rank", F.col("late") + F.when(F.col("depth") > 0, 2).otherwise(0))
    best = (
        stems.join(offers, ["folder", "stem"], "left")
        .groupBy("video")
        .agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.struct("rank", "path"))).alias("found"))
    )
    if explicit is None:
        return best.select("video", F.col("found").alias("subtitle"))
    given = explicit.select("video", F.col("path").alias("given"))
    return best.join(given, "video", "left").select("video", F.coalesce("given", "found").alias("subtitle"))


def write_report(df: DataFrame, path: str) -> None:
    """A result as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
