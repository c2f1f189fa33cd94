"""Content profiles: allowed categories and signal keys, as small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from .documents import parse_documents, read_texts

# The built-in profiles' subject, category tags and typed signal keys.
BUILTIN = {
    "gta": (
        "Grand Theft Auto gameplay",
        ["police_chase", "shootout", "stunt", "crash", "npc_chaos", "cruising", "mission", "fail"],
        {"wanted_level": "int", "vehicles": "list[str]", "events": "list[str]", "location": "str", "npcs": "str"},
    ),
    "game_trailer": (
        "video game trailer",
        ["logo_reveal", "cinematic", "gameplay", "combat", "boss_reveal", "character_reveal", "world_reveal",
         "cutscene", "title_card", "release_date", "credits"],
        {"shot_type": "str", "on_screen_text": "list[str]", "characters": "list[str]", "setting": "str",
         "action_intensity": "str", "music_cue": "str"},
    ),
    "movie_trailer": (
        "movie trailer",
        ["studio_logo", "cold_open", "dialogue", "action", "montage", "title_card", "needle_drop", "release_date",
         "cast_card", "credits_block"],
        {"shot_type": "str", "on_screen_text": "list[str]", "characters": "list[str]", "setting": "str",
         "mood": "str", "dialogue_snippet": "str"},
    ),
    "movie": (
        "film scene",
        ["establishing", "dialogue", "action", "chase", "fight", "romance", "montage", "flashback", "comedy_beat",
         "emotional_beat", "credits"],
        {"shot_type": "str", "characters": "list[str]", "setting": "str", "dialogue_snippet": "str", "mood": "str",
         "key_action": "str"},
    ),
    "sports": (
        "sports broadcast",
        ["play", "goal", "score", "foul", "replay", "celebration", "commentary", "crowd", "highlight"],
        {"sport": "str", "teams": "list[str]", "scoreboard": "str", "key_event": "str", "players": "list[str]",
         "is_replay": "bool"},
    ),
    "podcast": (
        "podcast or interview",
        ["intro", "monologue", "interview", "debate", "joke", "story", "ad_read", "outro"],
        {"speakers": "list[str]", "topic": "str", "quote": "str", "mood": "str", "is_ad": "bool"},
    ),
    "vlog": (
        "vlog or lifestyle video",
        ["intro", "to_camera", "b_roll", "activity", "reaction", "food", "travel", "outro"],
        {"creator_visible": "bool", "location": "str", "activity": "str", "on_screen_text": "list[str]",
         "mood": "str"},
    ),
    "tutorial": (
        "tutorial or instructional video",
        ["intro", "explanation", "demo", "code", "diagram", "step", "warning", "summary"],
        {"topic": "str", "visual_type": "str", "on_screen_text": "list[str]", "step": "str", "key_takeaway": "str"},
    ),
}

PROFILE_ROWS = (
    "profile string, subject string, taxonomy array<string>, "
    "signals array<struct<key:string,type:string,description:string>>, hints string, rules string, "
    "example string, template string"
)


def builtin_profiles(spark: SparkSession) -> DataFrame:
    rows = [
        (name, subject, tags, [(k, t, k.replace("_", " ")) for k, t in keys.items()], "", "", "", None)
        for name, (subject, tags, keys) in BUILTIN.items()
    ]
    return spark.createDataFrame(rows, PROFILE_ROWS)


def scan_profiles(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Custom profiles from JSON files, and rejects."""
    return parse_profiles(read_texts(spark, path, name))


def parse_profiles(texts: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    found, rejects = parse_documents(texts, column, schemas.PROFILE, schemas.PROFILE_CHOICES)
    return found.select(
        F.col("name").alias("profile"), "subject", "taxonomy", "signals", F.col("prompt_hints").alias("hints"),
        F.col("boundary_rules").alias("rules"), F.col("example_json").alias("example"),
        F.col("prompt_template_frames").alias("template"),
    ), rejects


def load_profiles(spark: SparkSession, names: list[str], custom: DataFrame | None = None) -> DataFrame:
    """The named profiles; an unknown name is an error."""
    found = builtin_profiles(spark)
    if custom is not None:
        found = found.unionByName(custom)
    found = found.filter(F.col("profile").isin(names))
    known = {r[0] for r in found.select("profile").distinct().limit(len(names)).collect()}
    missing = sorted(set(names) - known)
    if missing:
        raise ValueError(f"unknown profiles {missing}; built in are {sorted(BUILTIN)}")
    return found


def taxonomy_rows(profiles: DataFrame) -> DataFrame:
    """``profile, pos, category``."""
    return profiles.select("profile", F.posexplode("taxonomy").alias("pos", "category"))


def signal_rows(profiles: DataFrame) -> DataFrame:
    """``profile, key, type, description``."""
    return profiles.select("profile", F.explode("signals").alias("s")).select("profile", "s.*")


def whitelists(profiles: DataFrame) -> DataFrame:
    """``profile, taxonomy, signal_keys``: what model replies may use."""
    return profiles.select("profile", "taxonomy", F.transform("signals", lambda s: s["key"]).alias("signal_keys"))
