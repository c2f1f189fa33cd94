"""Placing cues: clip lookup, footage, joins, audio placement, rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import scale_factor, scaled, scaled_even
from ..plans.intervals import interval_join
from ..plans.rows import computed
from ..plans.scan import ordered_scan, running

# Levels and limits that results depend on.
CLIP_AUDIO_DB = -18.0
MIN_SPEED, MAX_SPEED, DEFAULT_SPEED = 0.05, 1.0, 0.5
MIN_FREEZE_SECONDS = 0.05
EPS = 1e-3
CATALOG_PREFIX = "catalog:"

_WIDTH = 30.0


def resolve_cues(video: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues with their clip's file and the source position they start from;
    cues of unknown clips are left out (see ``dangling_cues``)."""
    known = clips.select("clip_id", "file", "clip_local_id", F.col("source_in").alias("_from"))
    return video.join(known, "clip_id").withColumn(
        "source_in", F.coalesce("source_in", "_from", F.lit(0.0))
    ).drop("_from")


def dangling_cues(video: DataFrame, clips: DataFrame) -> DataFrame:
    return video.join(clips.select("clip_id"), "clip_id", "left_anti")


def resolve_music(music: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edl_id, file`` to playable paths: ``catalog:<id>`` through the catalog,
    others as given. Also returns the references that do not resolve."""
    ref = F.startswith(F.col("file"), F.lit(CATALOG_PREFIX))
    named = music.withColumn(
        "clip_id", F.when(ref, F.substr(F.col("file"), F.lit(len(CATALOG_PREFIX) + 1)).try_cast("bigint"))
    )
    found = named.join(clips.select("clip_id", F.col("file").alias("_clip_file")), "clip_id", "left").withColumn(
        "path", F.when(ref, F.col("_clip_file")).otherwise(F.col("file"))
    )
    keep = ["edl_id", "file", "path"]
    return found.filter("path IS NOT NULL").select(*keep), found.filter("path IS NULL").select("edl_id", "file")


def footage_consumed(effect: Column, length: Column, speed: Column, fps: Column) -> Column:
    """Seconds of source footage a cue needs under its effect."""
    slow = F.greatest(F.lit(MIN_SPEED), F.least(F.lit(MAX_SPEED), F.coalesce(speed, F.lit(DEFAULT_SPEED))))
    return (
        F.when(effect == "freeze_first", F.greatest(2.0 / fps, F.lit(MIN_FREEZE_SECONDS)))
        .when(effect == "slow_mo", F.greatest(length * slow, 1.0 / fps))
        .otherwise(length)
    )


def join_offsets(video: DataFrame, **kwargs) -> DataFrame:
    """Where each cue joins the running program: crossfades overlap by their
    duration, the first cue never does. ``video``: ``edl_id, pos, length,
    transition_in, transition_duration``."""
    fades = (F.col("transition_in") == "crossfade") & (F.col("transition_duration") > 0) & (F.col("pos") > 0)
    shared = F.when(fades, F.col("transition_duration")).otherwise(0.0)
    laid = ordered_scan(
        video.withColumn("_shared", shared), ["edl_id"], ["pos"],
        [running("_length", "sum", F.col("length") - F.col("_shared"))], **kwargs,
    )
    before = F.coalesce("_length", F.lit(0.0))
    return laid.withColumn("offset", F.greatest(F.lit(0.0), before - F.col("_shared"))).drop("_shared", "_length")


def place_clip_audio(audio: DataFrame, video: DataFrame) -> DataFrame:
    """Audio cues on the first video cue under their start: offset into the
    footage, position, length and level. Cues over no footage are dropped."""
    points = audio.select("edl_id", F.col("pos").alias("audio_pos"), "start", "end", "level_db",
                          F.col("start").alias("point"))
    cues = video.select("edl_id", F.col("pos").alias("video_pos"), F.col("start").alias("cue_start"),
                        F.col("end").alias("cue_end"))
    under = interval_join(
        points, cues, ["edl_id"], left_span=("start", "point"), right_span=("cue_start", "cue_end"),
        width=_WIDTH, closed=True,
    ).filter((F.col("cue_start") <= F.col("start")) & (F.col("start") < F.col("cue_end")))
    first = under.groupBy("edl_id", "audio_pos").agg(
        F.min_by(F.struct("video_pos", "cue_start", "cue_end", "start", "end", "level_db"), "video_pos").alias("c")
    ).select("edl_id", "audio_pos", "c.*")
    begin = F.greatest("start", "cue_start")
    return first.select(
        "edl_id", "audio_pos", "video_pos",
        F.greatest(F.lit(0.0), F.col("start") - F.col("cue_start")).alias("segment_offset"),
        begin.alias("timeline_offset"),
        (F.least("end", "cue_end") - begin).alias("length"),
        F.coalesce("level_db", F.lit(CLIP_AUDIO_DB)).alias("level_db"),
    ).filter("length > 0")


def only_cue(video: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen video cue of each document (``edl_id, pos``), moved to time 0
    with a plain cut."""
    cue = video.join(chosen.select("edl_id", "pos"), ["edl_id", "pos"], "left_semi")
    return cue.withColumns({
        "end": F.col("end") - F.col("start"), "start": F.lit(0.0),
        "transition_in": F.lit("cut"), "transition_duration": F.lit(0.0),
    })


def cues_within(track: DataFrame, video: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cues of another track that overlap the chosen video cue, moved and limited
    to its window; slivers are dropped."""
    window = video.join(chosen.select("edl_id", "pos"), ["edl_id", "pos"], "left_semi").select(
        "edl_id", F.col("start").alias("_from"), F.col("end").alias("_to")
    )
    inside = track.join(window, "edl_id").filter((F.col("end") > F.col("_from")) & (F.col("start") < F.col("_to")))
    moved = inside.withColumns({
        "start": F.greatest(F.lit(0.0), F.col("start") - F.col("_from")),
        "end": F.least(F.col("_to") - F.col("_from"), F.col("end") - F.col("_from")),
    })
    return moved.filter(F.col("end") - F.col("start") > EPS).drop("_from", "_to")


def rescale(edls: DataFrame, factor: Column) -> DataFrame:
    """Scale every pixel field of nested edit documents; a factor of 1 changes nothing."""
    edls = computed(edls, {"_factor": factor})
    factor = F.col("_factor")

    def changed(old: Column, new: Column) -> Column:
        return F.when(factor == 1.0, old).otherwise(new)

    out = F.col("output")
    mark = out["watermark"]
    new_out = out.withField("width", scaled_even(out["width"], factor)).withField(
        "height", scaled_even(out["height"], factor)
    ).withField("watermark", F.when(
        mark.isNotNull(), mark.withField("font_size", scaled(mark["font_size"], factor, 1))
    ))
    geometry = {"x": 0, "y": 0, "radius": 0, "width": 0, "height": 0, "stroke_width": 1}

    def drawn(a: Column) -> Column:
        for name, least in geometry.items():
            a = a.withField(name, scaled(a[name], factor, least))
        return a

    captions = F.col("captions")
    sized = F.when(
        captions["font_size"].isNotNull(), captions.withField("font_size", scaled(captions["font_size"], factor, 1))
    ).otherwise(captions)
    return edls.withColumns({
        "output": changed(out, new_out),
        "video": changed(F.col("video"), F.transform(
            "video", lambda c: c.withField("reframe_offset", scaled(c["reframe_offset"], factor)))),
        "annotations": changed(F.col("annotations"), F.transform("annotations", drawn)),
        "captions": changed(captions, sized),
    }).drop("_factor")


def rescale_to(edls: DataFrame, preset: str) -> DataFrame:
    return rescale(edls, scale_factor(F.col("output.width"), F.col("output.height"), F.lit(preset)))


def caption_offset(audio: DataFrame, edls: DataFrame) -> DataFrame:
    """``edl_id, offset``: start of the first voiceover cue, 0 without one."""
    first = audio.filter(F.col("kind") == "voiceover").groupBy("edl_id").agg(F.min_by("start", "pos").alias("first"))
    return edls.select("edl_id").join(first, "edl_id", "left").select("edl_id", F.coalesce("first", F.lit(0.0)).alias("offset"))


def shift_captions(phrases: DataFrame, offsets: DataFrame) -> DataFrame:
    """Phrases of each document moved by its caption offset."""
    return phrases.join(offsets, "edl_id").withColumns({
        "start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")
    }).drop("offset")
