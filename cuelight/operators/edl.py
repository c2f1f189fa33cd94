"""Validation of edit documents in bulk.

``explode_edls`` turns nested documents into one table per track; every rule
then works on all documents at once and yields ``edl_id, severity, path,
message``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_hex_colour, strip
from ..plans.scan import number, ordered_scan, previous, running
from ..schemas import EDL_VERSION

# Tolerance, effect defaults and message formats that results depend on.
EPS = 1e-3
SLOW_MO_SPEED = 0.5
ZOOM_FROM = 1.0
ZOOM_TO = 1.15
MESSAGES = {
    "version": "unsupported schema_version %d, expected %d",
    "positive": "must be > 0",
    "size": "width/height must be > 0",
    "unit": "must be in [0.0, 1.0]",
    "empty": "must not be empty",
    "not_negative": "must be >= 0",
    "start": "start %.3fs < 0",
    "end": "end %.3fs exceeds output.duration %.3fs",
    "inverted": "end <= start (%.3f, %.3f)",
    "gap": "gap in video track: %.3fs..%.3fs uncovered",
    "overlap": "overlaps previous video cue (prev ends at %.3fs, this starts at %.3fs)",
    "coverage": "video track ends at %.3fs but output.duration is %.3fs",
    "crossfade": "must be > 0 when transition_in='crossfade'",
    "first_crossfade": "first cue has crossfade; will fade in from black",
    "long_crossfade": "%.3fs exceeds half the shorter neighbor cue (%.3fs)",
    "speed": "slow_mo speed must be in [0.05, 1.0]; got %s",
    "zoom": "zoom_from/zoom_to must be > 0",
    "outside": "%d outside [0, %d]",
    "circle": "circle annotation requires radius > 0",
    "box": "box annotation requires width > 0 and height > 0",
    "arrow": "arrow annotation requires width > 0 (length in pixels)",
    "no_voiceover": "audio track references voiceover but edl.voiceover is unset",
    "unused_voiceover": "voiceover defined but no audio cue uses it",
    "captions": "captions require a voiceover to derive timing from, or explicit cues",
    "colour": "must be a hex color like '#FFD600'; got '%s'",
    "scale": "must be >= 1.0 (the active word scales up, not down)",
    "duck": "duck=true requires a voiceover to duck under; will be ignored",
    "missing_clip": "clip_id=%d not found in catalog",
    "footage": "cue duration %.3fs exceeds available clip footage (%.3fs from source_in=%.3f)",
}

ERROR, WARNING = "error", "warning"

# Broken when, severity, path, message.
Rule = tuple[Column, str, Column, Column]


@dataclass(frozen=True)
class Tracks:
    """Exploded documents: one ``head`` row per document, one row per cue elsewhere.

    Cue tables have ``edl_id, pos`` and the cue fields, plus the document's
    ``duration`` as ``total``.
    """

    head: DataFrame
    video: DataFrame
    audio: DataFrame
    ost: DataFrame
    annotations: DataFrame
    caption_cues: DataFrame


def explode_edls(edls: DataFrame) -> Tracks:
    def track(column: str, *extra: str) -> DataFrame:
        return edls.select(
            "edl_id", F.col("output.duration").alias("total"), *extra, F.posexplode(column).alias("pos", "cue")
        ).select("edl_id", "total", *[e.split(".")[-1] for e in extra], "pos", "cue.*")

    sized = edls.withColumns({"out_width": F.col("output.width"), "out_height": F.col("output.height")})
    annotations = sized.select(
        "edl_id", F.col("output.duration").alias("total"), "out_width", "out_height",
        F.posexplode("annotations").alias("pos", "cue"),
    ).select("edl_id", "total", "out_width", "out_height", "pos", "cue.*")
    head = edls.select(
        "edl_id", "schema_version", "output.*", "voiceover", "captions", "music",
    )
    return Tracks(head, track("video"), track("audio"), track("ost"), annotations, track("captions.cues"))


def _message(name: str, *values: Column) -> Column:
    text = MESSAGES[name]
    return F.format_string(text, *values) if values else F.lit(text)


def _issues(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All broken rules of every row in one pass."""
    found = F.array(*[
        F.when(broken, F.struct(F.lit(severity).alias("severity"), path.alias("path"), message.alias("message")))
        for broken, severity, path, message in rules
    ])
    return df.select("edl_id", F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select("edl_id", "i.*")


def _at(track: str, suffix: str = "") -> Column:
    return F.format_string(f"{track}[%d]{suffix}", F.col("pos"))


def _range_rules(path: Column) -> list[Rule]:
    start, end, total = F.col("start"), F.col("end"), F.col("total")
    return [
        (start < -EPS, ERROR, path, _message("start", start)),
        (end - total > EPS, ERROR, path, _message("end", end, total)),
        (end - start <= EPS, ERROR, path, _message("inverted", start, end)),
    ]


def range_issues(cues: DataFrame, track: str) -> DataFrame:
    """Cues that start too early, end too late or have no length."""
    return _issues(cues, _range_rules(_at(track)))


def _head_rules() -> list[Rule]:
    mark = F.col("watermark")
    has = mark.isNotNull()
    path = F.lit
    return [
        (F.col("schema_version") != EDL_VERSION, ERROR, path("schema_version"),
         _message("version", F.col("schema_version"), F.lit(EDL_VERSION))),
        (F.col("duration") <= 0, ERROR, path("output.duration"), _message("positive")),
        ((F.col("width") <= 0) | (F.col("height") <= 0), ERROR, path("output"), _message("size")),
        (F.col("fps") <= 0, ERROR, path("output.fps"), _message("positive")),
        (has & ~mark["opacity"].between(0.0, 1.0), ERROR, path("output.watermark.opacity"), _message("unit")),
        (has & (mark["font_size"] <= 0), ERROR, path("output.watermark.font_size"), _message("positive")),
        (has & (strip(mark["text"]) == ""), ERROR, path("output.watermark.text"), _message("empty")),
    ]


def head_issues(head: DataFrame) -> DataFrame:
    """Version, output and watermark rules."""
    return _issues(head, _head_rules())


def ost_issues(ost: DataFrame) -> DataFrame:
    wrong = ~F.col("animate_duration").between(0.0, 1.0)
    return _issues(ost, [*_range_rules(_at("ost")), (wrong, ERROR, _at("ost", ".animate_duration"), _message("unit"))])


def ordered_video(video: DataFrame, **kwargs) -> DataFrame:
    """Video cues with what lies before them: ``reach`` (latest end so far, at
    least 0), ``before_length`` and ``nth``."""
    length = F.col("end") - F.col("start")
    scanned = ordered_scan(
        video, ["edl_id"], ["start", "pos"],
        [running("reach", "max", F.col("end")), previous("before_length", length), number("nth")], **kwargs,
    )
    return scanned.withColumn("reach", F.greatest(F.coalesce("reach", F.lit(0.0)), F.lit(0.0)))


def _gap_rules() -> list[Rule]:
    start, reach = F.col("start"), F.col("reach")
    return [
        (start - reach > EPS, ERROR, _at("video"), _message("gap", reach, start)),
        (reach - start > EPS, ERROR, _at("video"), _message("overlap", reach, start)),
    ]


def gap_issues(scanned: DataFrame) -> DataFrame:
    """Uncovered stretches and overlaps of the video track."""
    return _issues(scanned, _gap_rules())


def coverage_issues(video: DataFrame) -> DataFrame:
    """Video tracks that do not end where the output ends."""
    ends = video.groupBy("edl_id").agg(
        F.greatest(F.max("end"), F.lit(0.0)).alias("reach"), F.first("total").alias("total"),
        F.max_by("pos", F.struct("start", "pos")).alias("pos"),
    )
    off = F.abs(F.col("reach") - F.col("total")) > EPS
    return _issues(ends, [(off, ERROR, _at("video"), _message("coverage", F.col("reach"), F.col("total")))])


def _transition_rules() -> list[Rule]:
    fade = F.col("transition_in") == "crossfade"
    d, first = F.col("transition_duration"), F.col("nth") == 1
    most = F.least(F.col("end") - F.col("start"), F.col("before_length")) / 2
    return [
        (fade & (d <= 0), ERROR, _at("video", ".transition_duration"), _message("crossfade")),
        (fade & (d > 0) & first, WARNING, _at("video", ".transition_in"), _message("first_crossfade")),
        (fade & (d > 0) & ~first & (d - most > EPS), ERROR, _at("video", ".transition_duration"),
         _message("long_crossfade", d, most)),
    ]


def transition_issues(scanned: DataFrame) -> DataFrame:
    """Crossfades without length, on the first cue, or longer than half a neighbour."""
    return _issues(scanned, _transition_rules())


def _effect_rules() -> list[Rule]:
    param = lambda name, default: F.coalesce(F.try_element_at("effect_params", F.lit(name)), F.lit(default))
    speed, effect = param("speed", SLOW_MO_SPEED), F.col("effect")
    zoom = (param("zoom_from", ZOOM_FROM) <= 0) | (param("zoom_to", ZOOM_TO) <= 0)
    return [
        ((effect == "slow_mo") & ~speed.between(0.05, 1.0), ERROR, _at("video", ".effect_params.speed"),
         _message("speed", speed.cast("string"))),
        (effect.isin("ken_burns_in", "ken_burns_out") & zoom, ERROR, _at("video", ".effect_params"), _message("zoom")),
    ]


def effect_issues(video: DataFrame) -> DataFrame:
    """Slow-motion speed and zoom parameters."""
    return _issues(video, _effect_rules())


def annotation_issues(annotations: DataFrame) -> DataFrame:
    x, y, w, h = F.col("x"), F.col("y"), F.col("out_width"), F.col("out_height")
    shape, at = F.col("shape"), lambda s="": _at("annotations", s)
    return _issues(annotations, [
        *_range_rules(at()),
        (~x.between(0, w), ERROR, at(".x"), _message("outside", x, w)),
        (~y.between(0, h), ERROR, at(".y"), _message("outside", y, h)),
        ((shape == "circle") & (F.col("radius") <= 0), ERROR, at(".radius"), _message("circle")),
        ((shape == "box") & ((F.col("width") <= 0) | (F.col("height") <= 0)), ERROR, at(), _message("box")),
        ((shape == "arrow") & (F.col("width") <= 0), ERROR, at(".width"), _message("arrow")),
    ])


def voiceover_issues(head: DataFrame, audio: DataFrame) -> DataFrame:
    """Voiceover cues without a voiceover, and the reverse."""
    used = audio.filter(F.col("kind") == "voiceover").select("edl_id").distinct().withColumn("_used", F.lit(True))
    both = head.select("edl_id", "voiceover").join(used, "edl_id", "left")
    has, cue = F.col("voiceover").isNotNull(), F.col("_used").isNotNull()
    return _issues(both, [
        (cue & ~has, ERROR, F.lit("voiceover"), _message("no_voiceover")),
        (has & ~cue, WARNING, F.lit("voiceover"), _message("unused_voiceover")),
    ])


def _caption_rules() -> list[Rule]:
    c = F.col("captions")
    given = c.isNotNull()
    at = lambda name: F.lit(f"captions.{name}")
    below = lambda name, least: given & (c[name] < least)
    return [
        (given & F.col("voiceover").isNull() & (F.size(c["cues"]) == 0), ERROR, F.lit("captions"), _message("captions")),
        (given & (c["max_words"] <= 0), ERROR, at("max_words"), _message("positive")),
        (given & (c["max_chars"] <= 0), ERROR, at("max_chars"), _message("positive")),
        (below("min_chunk_duration", 0), ERROR, at("min_chunk_duration"), _message("not_negative")),
        (given & (c["font_size"] <= 0), ERROR, at("font_size"), _message("positive")),
        (given & (c["highlight"] != "none") & ~is_hex_colour(c["highlight_color"]), ERROR, at("highlight_color"),
         _message("colour", c["highlight_color"])),
        (below("animate_overshoot", 0), ERROR, at("animate_overshoot"), _message("not_negative")),
        (given & ~c["animate_duration"].between(0.0, 1.0), ERROR, at("animate_duration"), _message("unit")),
        (below("fade_ms", 0), ERROR, at("fade_ms"), _message("not_negative")),
        (given & ~is_hex_colour(c["active_word_bg"]), ERROR, at("active_word_bg"), _message("colour", c["active_word_bg"])),
        (below("active_word_bg_radius", 0), ERROR, at("active_word_bg_radius"), _message("not_negative")),
        (below("active_word_scale", 1.0), ERROR, at("active_word_scale"), _message("scale")),
    ]


def caption_issues(head: DataFrame) -> DataFrame:
    """Caption source and options of every document that has captions."""
    return _issues(head, _caption_rules())


def caption_cue_issues(cues: DataFrame) -> DataFrame:
    blank = strip(F.regexp_replace("text", r"(?U)\s+", " ")) == ""
    return _issues(cues, [
        *_range_rules(_at("captions.cues")),
        (blank, ERROR, _at("captions.cues", ".text"), _message("empty")),
    ])


def _music_rules() -> list[Rule]:
    unheard = F.col("music").isNotNull() & F.col("music.duck") & F.col("voiceover").isNull()
    return [(unheard, WARNING, F.lit("music.duck"), _message("duck"))]


def music_issues(head: DataFrame) -> DataFrame:
    """Music that should duck under a voiceover that is not there."""
    return _issues(head, _music_rules())


def _with_clips(video: DataFrame, clips: DataFrame) -> DataFrame:
    known = clips.select("clip_id", F.col("duration").alias("_long"), F.col("source_in").alias("_from"))
    return video.join(known, "clip_id", "left")


def _clip_rules() -> list[Rule]:
    length = F.col("end") - F.col("start")
    begin = F.coalesce(F.col("source_in"), F.col("_from"))
    left = F.col("_long") - (begin - F.col("_from"))
    missing = F.col("_long").isNull()
    return [
        (missing, ERROR, _at("video", ".clip_id"), _message("missing_clip", F.col("clip_id"))),
        (~missing & (length - left > EPS), ERROR, _at("video"), _message("footage", length, left, begin)),
    ]


def clip_issues(video: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues whose clip is unknown or too short. ``clips``: ``clip_id, duration, source_in``."""
    return _issues(_with_clips(video, clips), _clip_rules())


def validate(tracks: Tracks, clips: DataFrame | None = None, **kwargs) -> DataFrame:
    """Every rule over every document, one pass per track; ``clips`` adds the
    catalog checks."""
    video = ordered_video(tracks.video, **kwargs)
    video_rules = [*_range_rules(_at("video")), *_gap_rules(), *_transition_rules(), *_effect_rules()]
    if clips is not None:
        video, video_rules = _with_clips(video, clips), [*video_rules, *_clip_rules()]
    parts = [
        _issues(tracks.head, [*_head_rules(), *_caption_rules(), *_music_rules()]), _issues(video, video_rules),
        coverage_issues(tracks.video), range_issues(tracks.audio, "audio"), ost_issues(tracks.ost),
        annotation_issues(tracks.annotations), voiceover_issues(tracks.head, tracks.audio),
        caption_cue_issues(tracks.caption_cues),
    ]
    issues = parts[0]
    for more in parts[1:]:
        issues = issues.unionByName(more)
    return issues


def verdicts(head: DataFrame, issues: DataFrame) -> DataFrame:
    """``edl_id, ok`` for every document: ok when it has no error."""
    errors = issues.groupBy("edl_id").agg(F.count_if(F.col("severity") == ERROR).alias("errors"))
    return head.select("edl_id").join(errors, "edl_id", "left").select(
        "edl_id", (F.coalesce("errors", F.lit(0)) == 0).alias("ok")
    )
