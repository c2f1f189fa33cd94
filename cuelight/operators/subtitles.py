"""Subtitle text to timed cues, and cues to scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import seconds
from ..functions.text import MAX_CUE_SECONDS, clean_cue, squeeze, stamp_seconds, stamps
from ..plans.groups import shuffled
from ..plans.intervals import interval_join

# Fixed value: how much of a clip is looked at by default.
PROBE_SECONDS = 60.0

_WIDTH = 60.0


def parse_subtitles(files: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """Cues of SRT and WebVTT texts: ``key, cue_no, start, end, text``.

    Blocks are separated by blank lines; the first line with an arrow times the
    block, the lines below it are its text. Blocks without two stamps, without
    text, inverted or longer than 30 s are left out.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), "\r\n", "\n"), "\r", "\n")
    blocks = files.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("cue_no", "block"))
    lines = F.filter(F.split("block", "\n"), lambda ln: F.trim(F.regexp_replace(ln, r"(?U)\s+", " ")) != "")
    blocks = blocks.withColumn("lines", lines)
    at = F.array_position(F.transform("lines", lambda ln: ln.contains("-->")), True)
    blocks = blocks.withColumn("at", F.when(at > 0, at.cast("int")))
    blocks = blocks.withColumn("stamps", stamps(F.try_element_at(F.col("lines"), F.col("at")))).filter(F.size("stamps") >= 2)
    rest = F.slice("lines", F.col("at") + 1, F.size("lines"))
    cues = blocks.select(
        key, "cue_no", stamp_seconds(F.col("stamps")[0]).alias("start"), stamp_seconds(F.col("stamps")[1]).alias("end"),
        clean_cue(F.concat_ws(" ", rest)).alias("text"),
    )
    return cues.filter(
        (F.col("text") != "") & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("start") + MAX_CUE_SECONDS)
    )


def cues_for_videos(chosen: DataFrame, sidecar_cues: DataFrame, embedded_cues: DataFrame) -> DataFrame:
    """Cues of each video from its chosen subtitle file, else from its embedded
    text. ``chosen``: ``video, subtitle``; cue frames have ``path`` or ``video``."""
    beside = chosen.join(sidecar_cues.withColumnRenamed("path", "subtitle"), "subtitle").drop("subtitle")
    other = embedded_cues.join(beside.select("video").distinct(), "video", "left_anti")
    return beside.unionByName(other.select(*beside.columns))


def _overlaps(ranges: DataFrame, cues: DataFrame, width: float) -> DataFrame:
    timed = cues.select(
        "source_id", F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), "cue_no", "text"
    )
    return interval_join(
        timed, ranges, ["source_id"], left_span=("cue_start", "cue_end"), right_span=("start", "end"), width=width
    )


def dialogue_for_ranges(ranges: DataFrame, cues: DataFrame, id_column: str, width: float = _WIDTH) -> DataFrame:
    """Add ``dialogue``: the text of all cues that overlap each range, in order."""
    spans = ranges.select(id_column, "source_id", "start", "end").filter("end > start")
    said = _overlaps(spans, cues, width).groupBy(id_column).agg(
        F.array_sort(F.collect_list(F.struct("cue_start", "cue_no", "text"))).alias("_said")
    )
    text = squeeze(F.concat_ws(" ", F.transform("_said", lambda c: c["text"])))
    return ranges.join(shuffled(said), id_column, "left").withColumn("dialogue", F.coalesce(text, F.lit(""))).drop("_said")


def cues_for_clips(clips: DataFrame, cues: DataFrame, id_column: str = "clip_id",
                   max_seconds: float = PROBE_SECONDS, width: float = _WIDTH) -> DataFrame:
    """Cues inside each clip's window, timed from the clip's start: ``id, cue_no,
    start, end, text``."""
    window = clips.select(
        id_column, "source_id", F.col("source_in").alias("start"),
        (F.col("source_in") + F.least("duration", F.lit(float(max_seconds)))).alias("end"),
    ).filter("end > start")
    inside = _overlaps(window, cues, width)
    return inside.select(
        id_column, "cue_no",
        seconds(F.greatest(F.lit(0.0), F.col("cue_start") - F.col("start"))).alias("start"),
        seconds(F.least(F.col("end") - F.col("start"), F.col("cue_end") - F.col("start"))).alias("end"),
        "text",
    )
