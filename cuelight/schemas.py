"""Document and table schemas. A non-nullable field is required in a document;
optional fields name their default in the metadata."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType,
    StructField, StructType,
)

MANIFEST_VERSION = 3
CATALOG_VERSION = 3
EDL_VERSION = 1

_TEXTS = ArrayType(StringType())
_NUMBERS = MapType(StringType(), DoubleType())


def need(name: str, kind: DataType) -> StructField:
    return StructField(name, kind, nullable=False)


def opt(name: str, kind: DataType, default=None, **notes: bool) -> StructField:
    """``never_null`` refuses an explicit null where there is no default; ``object`` is a JSON object kept as text."""
    return StructField(name, kind, nullable=True, metadata={**({} if default is None else {"default": default}), **notes})


SOURCE = StructType([
    need("file", StringType()), need("duration", DoubleType()),
    need("resolution", StringType()), need("fps", DoubleType()),
])
EXTRACT = StructType([
    need("segmenter", StringType()), need("analyzer", StringType()),
    need("game_profile", StringType()), need("created_at", StringType()),
])
AUDIO = StructType([opt("peak_loudness_db", DoubleType()), opt("cues", _TEXTS)])
# game_signals has no fixed schema; it travels as JSON text.
CLIP = StructType([
    need("id", StringType()), need("file", StringType()), need("source_in", DoubleType()),
    need("source_out", DoubleType()), need("duration", DoubleType()),
    need("resolution", StringType()), need("fps", DoubleType()), need("description", StringType()),
    opt("dialogue", StringType(), ""), opt("categories", _TEXTS), need("score", IntegerType()),
    opt("game_signals", StringType(), "{}", object=True), opt("audio", AUDIO, never_null=True), opt("keyframes", _TEXTS),
    need("segment_source", StringType()),
])
CHARACTER = StructType([need("name", StringType()), opt("role", StringType(), "")])
BEAT = StructType([
    need("title", StringType()), need("start", DoubleType()), need("end", DoubleType()),
    opt("summary", StringType(), ""),
])
SUMMARY = StructType([
    opt("synopsis", StringType(), ""), opt("themes", _TEXTS), opt("tone", StringType(), ""),
    opt("characters", ArrayType(CHARACTER)), opt("beats", ArrayType(BEAT)),
    opt("generated_by", StringType(), ""),
])
MANIFEST = StructType([
    opt("schema_version", IntegerType(), MANIFEST_VERSION), need("source", SOURCE),
    need("extract", EXTRACT), opt("taxonomy", _TEXTS), opt("clips", ArrayType(CLIP)),
    opt("summary", SUMMARY),
])

CONTEXT_CHARACTER = StructType([
    need("name", StringType()), opt("images", _TEXTS), opt("description", StringType(), ""),
])
CONTEXT = StructType([opt("intro", StringType(), ""), opt("characters", ArrayType(CONTEXT_CHARACTER))])

ALIGNMENT = StructType([
    need("characters", _TEXTS), need("start_times", ArrayType(DoubleType())), need("end_times", ArrayType(DoubleType())),
])

PROFILE_SIGNAL = StructType([
    need("key", StringType()), need("type", StringType()), need("description", StringType()),
])
PROFILE = StructType([
    need("name", StringType()), opt("subject", StringType(), "video"), opt("taxonomy", _TEXTS),
    opt("signals", ArrayType(PROFILE_SIGNAL)), opt("prompt_hints", StringType(), ""),
    opt("boundary_rules", StringType(), ""), opt("example_json", StringType(), ""),
    opt("prompt_template_video", StringType()), opt("prompt_template_frames", StringType()),
])

# The types a signal of a profile may have.
PROFILE_CHOICES = {"signals.type": ["int", "float", "str", "list[str]", "bool"]}

WATERMARK = StructType([
    need("text", StringType()), opt("opacity", DoubleType(), 0.5), opt("font_size", IntegerType(), 36),
    opt("position", StringType(), "bottom"),
])
OUTPUT = StructType([
    opt("width", IntegerType(), 1080), opt("height", IntegerType(), 1920), opt("fps", IntegerType(), 60),
    need("duration", DoubleType()), opt("watermark", WATERMARK),
])
VOICEOVER = StructType([
    opt("backend", StringType(), "elevenlabs"), need("voice_id", StringType()),
    opt("settings", _NUMBERS), need("script", StringType()),
])
VIDEO_CUE = StructType([
    need("start", DoubleType()), need("end", DoubleType()), need("clip_id", LongType()),
    opt("source_in", DoubleType()), opt("reframe", StringType(), "crop_center"),
    opt("reframe_offset", IntegerType(), 0), opt("effect", StringType(), "none"),
    opt("effect_params", _NUMBERS), opt("transition_in", StringType(), "cut"),
    opt("transition_duration", DoubleType(), 0.0),
])
AUDIO_CUE = StructType([
    need("start", DoubleType()), need("end", DoubleType()), need("kind", StringType()),
    opt("level_db", DoubleType()), opt("duck", BooleanType(), False),
])
OST_CUE = StructType([
    need("start", DoubleType()), need("end", DoubleType()), need("text", StringType()),
    opt("style", StringType(), "dark"), opt("position", StringType(), "bottom"),
    opt("animate_in", StringType(), "none"), opt("animate_out", StringType(), "none"),
    opt("animate_duration", DoubleType(), 0.18),
])
CAPTION_CUE = StructType([need("start", DoubleType()), need("end", DoubleType()), need("text", StringType())])
CAPTIONS = StructType([
    opt("style", StringType(), "clean_white"), opt("position", StringType(), "lower_third"),
    opt("max_words", IntegerType(), 4), opt("max_chars", IntegerType(), 28),
    opt("min_chunk_duration", DoubleType(), 0.4), opt("font_size", IntegerType()),
    opt("highlight", StringType(), "none"), opt("highlight_color", StringType(), "#FFD600"),
    opt("cues", ArrayType(CAPTION_CUE)), opt("animate", StringType(), "none"),
    opt("animate_overshoot", DoubleType(), 0.12), opt("animate_duration", DoubleType(), 0.12),
    opt("active_word_bg", StringType()), opt("active_word_bg_radius", IntegerType(), 12),
    opt("active_word_scale", DoubleType()), opt("fade_ms", IntegerType(), 0),
])
ANNOTATION = StructType([
    need("start", DoubleType()), need("end", DoubleType()), need("shape", StringType()),
    need("x", IntegerType()), need("y", IntegerType()), opt("radius", IntegerType(), 0),
    opt("width", IntegerType(), 0), opt("height", IntegerType(), 0),
    opt("color", StringType(), "#ff3b30"), opt("stroke_width", IntegerType(), 8),
])
MUSIC = StructType([need("file", StringType()), opt("level_db", DoubleType(), -22.0), opt("duck", BooleanType(), True)])
EDL = StructType([
    opt("schema_version", IntegerType(), EDL_VERSION), need("title", StringType()), need("output", OUTPUT),
    opt("voiceover", VOICEOVER), opt("video", ArrayType(VIDEO_CUE)), opt("audio", ArrayType(AUDIO_CUE)),
    opt("ost", ArrayType(OST_CUE)), opt("captions", CAPTIONS),
    opt("annotations", ArrayType(ANNOTATION)), opt("music", MUSIC),
])

# The choices an edit document may use, by path.
EDL_CHOICES = {
    "output.watermark.position": ["top", "middle", "bottom"],
    "voiceover.backend": ["elevenlabs", "google"],
    "video.reframe": ["crop_center", "crop_left", "crop_right", "letterbox"],
    "video.effect": ["none", "freeze_first", "ken_burns_in", "ken_burns_out", "slow_mo"],
    "video.transition_in": ["cut", "crossfade"],
    "audio.kind": ["voiceover", "clip_audio", "silence"],
    "ost.style": [
        "dark", "light", "yellow_punch", "red_alert", "pink_reveal",
        "yellow_punch_shadow", "gradient_dark", "accent_bar",
    ],
    "ost.position": ["top", "middle", "bottom"],
    "ost.animate_in": ["none", "pop", "slide_up", "fade"],
    "ost.animate_out": ["none", "pop", "slide_up", "fade"],
    "captions.style": ["clean_white", "boxed_dark", "karaoke_yellow"],
    "captions.position": ["top", "middle", "bottom", "lower_third"],
    "captions.highlight": ["none", "karaoke_fill", "active_word"],
    "captions.animate": ["none", "pop", "fade"],
    "annotations.shape": ["circle", "box", "arrow"],
}

SOURCES_TABLE = (
    "source_id bigint, file_path string, fingerprint string, duration double, resolution string, "
    "fps double, has_audio int"
)
EXTRACTS_TABLE = (
    "extract_id bigint, source_id bigint, segmenter string, analyzer string, game_profile string, "
    "taxonomy array<string>, created_at string, manifest_path string"
)
CLIPS_TABLE = (
    "clip_id bigint, extract_id bigint, source_id bigint, clip_local_id string, file string, "
    "source_in double, source_out double, duration double, resolution string, fps double, "
    "description string, dialogue string, score int, segment_source string, game_signals string, "
    "peak_loudness_db double, audio_cues array<string>, keyframes array<string>, categories array<string>"
)
CATEGORIES_TABLE = "clip_id bigint, extract_id bigint, source_id bigint, category string"
SUMMARIES_TABLE = (
    "source_id bigint, synopsis string, themes array<string>, tone string, "
    "characters array<struct<name:string,role:string>>, "
    "beats array<struct<title:string,start:double,end:double,summary:string>>, generated_by string"
)
POSTINGS_TABLE = "term string, clip_id bigint, extract_id bigint, source_id bigint, field string, pos int"
LENGTHS_TABLE = "clip_id bigint, extract_id bigint, source_id bigint, length bigint"
