"""Tolerant reading of semi-structured model replies.

Replies are parsed to VARIANT and coerced leaf by leaf: a bad leaf falls back to
a default, it never fails the row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Limits and placeholder texts that results depend on.
MIN_EVENT_SECONDS = 2.0
FENCE = r"(?i)^```(?:json)?\s*|\s*```$"
NO_DESCRIPTION = "(no description)"
BAD_SHAPE = "(analyzer returned unexpected JSON shape)"
NO_USABLE_EVENTS = "(analyzer returned no usable events)"
BAD_JSON = "(analyzer failed to return valid JSON)"
UNTITLED = "Untitled beat"


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return get(value, "$", "struct<_:variant>").isNotNull()


def is_list(value: Column) -> Column:
    return get(value, "$", "array<variant>").isNotNull()


def tolerant_json(text: Column) -> Column:
    """VARIANT of a reply: code fences removed, else the outermost braces, else null."""
    bare = strip(F.regexp_replace(strip(text), FENCE, ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def _as_text(leaf: Column) -> Column:
    return strip(F.try_variant_get(leaf, "$", "string"))


def number(leaf: Column, default: Column) -> Column:
    """A float leaf given as number or text: ``default`` when it is absent, null
    when it is present but not a number."""
    return F.when(leaf.isNull(), default).otherwise(_as_text(leaf).try_cast("double"))


def text(leaf: Column) -> Column:
    """A trimmed text leaf; empty when absent or null."""
    return F.coalesce(_as_text(leaf), F.lit(""))


def whole(leaf: Column) -> Column:
    """An integer leaf: numbers are truncated, text must be a whole number, else 0."""
    as_text = _as_text(leaf)
    parsed = F.when(kind_of(leaf) == "STRING", as_text.try_cast("bigint")).otherwise(
        F.coalesce(as_text.try_cast("double").cast("bigint"), F.try_variant_get(leaf, "$", "boolean").cast("bigint"))
    )
    return F.coalesce(parsed, F.lit(0))


def _items(leaf: Column) -> Column:
    return F.coalesce(F.try_variant_get(leaf, "$", "array<variant>"), F.array().cast("array<variant>"))


def string_items(leaf: Column) -> Column:
    """List items as text, without nulls, empty texts, empty lists and objects, false and zero; the texts ``"0"`` and
    ``"false"`` are kept."""
    def said(v: Column) -> Column:
        word = F.try_variant_get(v, "$", "string")
        empty = F.when(kind_of(v) == "STRING", word == "").otherwise(
            word.isin("false", "[]", "{}") | F.coalesce(word.try_cast("double") == 0, F.lit(False)))
        return word.isNotNull() & ~empty

    return F.transform(F.filter(_items(leaf), said), lambda v: F.try_variant_get(v, "$", "string"))


def allowed_strings(leaf: Column, allowed: Column) -> Column:
    """String items that are in ``allowed``, input order kept."""
    words = F.transform(
        F.filter(_items(leaf), lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    return F.filter(words, lambda w: F.array_contains(allowed, w))


def allowed_keys(leaf: Column, allowed: Column) -> Column:
    """JSON text of an object, restricted to the keys in ``allowed``."""
    entries = F.try_variant_get(leaf, "$", "map<string,variant>")
    kept = F.map_filter(entries, lambda k, v: F.array_contains(allowed, k))
    return F.coalesce(F.to_json(kept), F.lit("{}"))


EVENT_LEAVES = (
    "struct<start:variant,end:variant,description:variant,categories:variant,base_interest:variant,"
    "game_signals:variant,audio_cues:variant>"
)


def event_leaves(raw: Column, allowed_tags: Column, allowed_signals: Column, end_default: Column) -> Column:
    """The coerced leaves of one raw event; times are still unchecked."""
    description = text(raw["description"])
    return F.struct(
        number(raw["start"], F.lit(0.0)).alias("start"), number(raw["end"], end_default).alias("end"),
        F.when(description == "", NO_DESCRIPTION).otherwise(description).alias("description"),
        allowed_strings(raw["categories"], allowed_tags).alias("categories"),
        F.greatest(F.lit(0), F.least(F.lit(100), whole(raw["base_interest"]))).cast("int").alias("base_interest"),
        allowed_keys(raw["game_signals"], allowed_signals).alias("game_signals"),
        string_items(raw["audio_cues"]).alias("audio_cues"),
    )


def timed_event(leaves: Column, duration: Column, window: bool) -> Column:
    """Leaves with their times limited to the window. With ``window`` an unusable
    span becomes the whole window; without it the event is null."""
    start = F.greatest(F.lit(0.0), F.least(leaves["start"], duration))
    end = F.greatest(F.lit(0.0), F.least(leaves["end"], duration))
    usable = leaves["start"].isNotNull() & leaves["end"].isNotNull() & (end > start)
    if window:
        return leaves.withField("start", F.when(usable, F.bround(start, 3)).otherwise(F.lit(0.0))).withField(
            "end", F.when(usable, F.bround(end, 3)).otherwise(F.bround(duration, 3))
        )
    event = leaves.withField("start", F.bround(start, 3)).withField("end", F.bround(end, 3))
    return F.when(usable & (end - start >= MIN_EVENT_SECONDS), event)


def placeholder_event(duration: Column, message: str) -> Column:
    return F.struct(
        F.lit(0.0).alias("start"),
        duration.alias("end"),
        F.lit(message).alias("description"),
        F.array().cast("array<string>").alias("categories"),
        F.lit(0).alias("base_interest"),
        F.lit("{}").alias("game_signals"),
        F.array().cast("array<string>").alias("audio_cues"),
    )


def coerced_beats(value: Column, duration: Column) -> Column:
    """Story beats: limited to the source, inverted ones dropped, ordered by start."""
    raw = F.filter(F.transform(_items(value), lambda v: F.try_variant_get(
        v, "$", "struct<start:variant,end:variant,title:variant,summary:variant>")), lambda b: b.isNotNull())
    numbered = F.transform(raw, lambda b, i: F.struct(
        number(b["start"], F.lit(0.0)).alias("start"), number(b["end"], duration).alias("end"), i.alias("i"),
        text(b["title"]).alias("title"), text(b["summary"]).alias("summary")))

    def beat(b: Column) -> Column:
        start = F.greatest(F.lit(0.0), F.least(b["start"], duration))
        end = F.greatest(F.lit(0.0), F.least(b["end"], duration))
        usable = b["start"].isNotNull() & b["end"].isNotNull() & (end > start)
        return F.when(usable, F.struct(
            F.bround(start, 3).alias("start"), b["i"].alias("i"), F.bround(end, 3).alias("end"),
            F.when(b["title"] == "", UNTITLED).otherwise(b["title"]).alias("title"), b["summary"].alias("summary")))

    ordered = F.array_sort(F.filter(F.transform(numbered, beat), lambda b: b.isNotNull()))
    return F.transform(ordered, lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), b["title"].alias("title"), b["summary"].alias("summary")))


def coerced_characters(value: Column) -> Column:
    """Named characters with their role, trimmed."""
    people = F.transform(_items(value), lambda v: F.try_variant_get(v, "$", "struct<name:variant,role:variant>"))
    named = F.transform(F.filter(people, lambda p: p.isNotNull()), lambda p: F.struct(
        text(p["name"]).alias("name"), text(p["role"]).alias("role")))
    return F.filter(named, lambda p: p["name"] != "")


def text_list(value: Column) -> Column:
    """Trimmed, non-blank items of a list."""
    words = F.transform(_items(value), lambda v: strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("None"))))
    return F.filter(words, lambda w: w != "")
