"""From raw model replies to clean, scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import semi
from ..functions.numeric import blend_score, seconds
from ..plans.fold import ordered_fold
from ..plans.groups import broadcast_if_small, has_hot_group
from ..plans.rows import computed
from ..plans.scan import islands, number, ordered_scan, previous, running
from ..plans.session import checkpointed, last_key_counts
from .signal import score_audio

# Limits that results depend on.
MIN_CLIP_SECONDS = 10.0
OVERLAP_SHARE = 0.5
MAX_SOURCE_SECONDS = 5400.0

EVENT_TYPE = (
    "struct<start:double,end:double,description:string,categories:array<string>,"
    "base_interest:int,game_signals:string,audio_cues:array<string>>"
)


def _pruned(events: Column) -> Column:
    """Overlap pruning inside one reply, by its sorted event array."""

    def keep(kept: Column, ev: Column) -> Column:
        prev = F.element_at(kept, -1)
        shared = F.least(prev["end"], ev["end"]) - F.greatest(prev["start"], ev["start"])
        shorter = F.least(prev["end"] - prev["start"], ev["end"] - ev["start"])
        trimmed = ev.withField("start", prev["end"])
        head = F.slice(kept, 1, F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (ev["start"] >= prev["end"]), F.concat(kept, F.array(ev)))
            .when(
                (shorter > 0) & (shared / shorter > OVERLAP_SHARE),
                F.when(ev["base_interest"] > prev["base_interest"], F.concat(head, F.array(ev)))
                .otherwise(kept),
            )
            .when(ev["end"] - prev["end"] >= semi.MIN_EVENT_SECONDS, F.concat(kept, F.array(trimmed)))
            .otherwise(kept)
        )

    return F.aggregate(events, F.array().cast(f"array<{EVENT_TYPE}>"), keep)


def coerce_replies(replies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Events of every reply, at least one per reply.

    ``replies``: ``chunk_id, profile, duration, text``; ``profiles``: ``profile,
    taxonomy, signal_keys`` (arrays). Returns ``chunk_id, event_no`` and the event
    fields. A reply is one row, so all its events are handled inside that row.
    """
    last_key_counts(replies.sparkSession)
    rows = computed(replies.join(broadcast_if_small(profiles), "profile", "left"), {
        "_allowed": F.coalesce("taxonomy", F.array().cast("array<string>")),
        "_keys": F.coalesce("signal_keys", F.array().cast("array<string>")),
        "_doc": semi.tolerant_json(F.col("text")),
    })
    doc, duration = F.col("_doc"), F.col("duration")
    as_event = lambda c: c.cast(EVENT_TYPE)
    items = F.coalesce(semi.get(doc, "$", "array<variant>"), semi.get(doc, "$.events", "array<variant>"))
    rows = computed(rows, {
        "_items": items, "_flat": semi.get(doc, "$", semi.EVENT_LEAVES), "_listed": semi.is_list(doc),
    })
    leaves = lambda raw, end: semi.event_leaves(raw, F.col("_allowed"), F.col("_keys"), end)
    objects = F.filter(F.transform("_items", lambda v: semi.get(v, "$", semi.EVENT_LEAVES)), lambda v: v.isNotNull())
    rows = computed(rows, {"_found": F.transform(objects, lambda v: leaves(v, F.lit(0.0)))})
    usable = F.filter(F.transform("_found", lambda v: semi.timed_event(v, duration, False)), lambda e: e.isNotNull())
    ordered = F.transform(
        F.array_sort(F.transform(usable, lambda e, i: F.struct(e["start"].alias("at"), i.alias("i"), as_event(e).alias("e")))),
        lambda x: x["e"],
    )
    rows = computed(rows, {"_ordered": ordered})
    rows = computed(rows, {"_events": _pruned(F.col("_ordered"))})
    nothing = semi.get(F.parse_json(F.lit("{}")), "$", semi.EVENT_LEAVES)
    flat = semi.timed_event(leaves(F.coalesce("_flat", nothing), duration), duration, True)
    salvaged = (
        F.element_at("_found", 1).withField("start", F.lit(0.0)).withField("end", F.bround(duration, 3))
    )
    one = lambda e: F.array(as_event(e))
    events = (
        F.when(doc.isNull(), one(semi.placeholder_event(duration, semi.BAD_JSON)))
        .when(~F.col("_listed") & F.col("_flat").isNull(), one(semi.placeholder_event(duration, semi.BAD_SHAPE)))
        .when(F.col("_items").isNull() | (F.size("_items") == 0), one(flat))
        .when(F.size("_events") > 0, F.col("_events"))
        .when(F.size("_found") > 0, one(salvaged))
        .otherwise(one(semi.placeholder_event(duration, semi.NO_USABLE_EVENTS)))
    )
    return rows.select("chunk_id", F.posexplode(events).alias("event_no", "event")).select(
        "chunk_id", "event_no", "event.*"
    )


def refine_events(given: DataFrame, results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Events of every source as a model has reworked them, or as they were given.

    ``given``: ``source_id`` and the event fields; ``results``: what ``call_model`` made of one task per source,
    ``source_id, profile, duration, payload, error``. A source keeps its own events where the call failed, where its
    reply holds no JSON, where there was no call, and where there is nothing to rework: fewer than two events.
    """
    last_key_counts(given.sparkSession)
    # Written once: results stem from calls that must not be made again for the second reader.
    results = checkpointed(results.select("source_id", "profile", "duration", "payload", "error"))
    several = given.groupBy("source_id").count().filter("count > 1").select("source_id")
    told = results.filter(F.col("error").isNull() & semi.tolerant_json(F.col("payload")).isNotNull()).join(several, "source_id", "left_semi")
    refined = coerce_replies(told.select(F.col("source_id").alias("chunk_id"), "profile", "duration", F.col("payload").alias("text")), profiles)
    kept = given.join(told.select("source_id"), "source_id", "left_anti")
    fields = [c for c in refined.columns if c not in ("chunk_id", "event_no")]
    return refined.select(F.col("chunk_id").alias("source_id"), *fields).unionByName(kept.select("source_id", *fields))


def shift_events(events: DataFrame, offset: Column, *, rounded: bool = False) -> DataFrame:
    """Move events to another origin by adding ``offset`` to both ends."""
    move = (lambda c: seconds(c)) if rounded else (lambda c: c)
    return events.withColumns({
        "start": move(F.col("start") + offset), "end": move(F.col("end") + offset)
    })


class _Prune:
    """Against the last kept event: a mostly covered event survives only by higher
    interest, any other overlap is trimmed away."""

    def start(self, row):
        return None

    def step(self, kept, row):
        start, end, interest = row[:3]
        if kept is None:
            return row, []
        if start >= kept[1]:
            return row, [kept]
        shared = min(kept[1], end) - max(kept[0], start)
        shorter = min(kept[1] - kept[0], end - start)
        if shorter > 0 and shared / shorter > OVERLAP_SHARE:
            return (row if interest > kept[2] else kept), []
        if end - kept[1] >= semi.MIN_EVENT_SECONDS:
            return (kept[1], *row[1:]), [kept]
        return kept, []

    def finish(self, kept):
        return [kept] if kept is not None else []


def prune_overlaps(events: DataFrame, key: str = "source_id", id_column: str = "event_id", **kwargs) -> DataFrame:
    """Remove overlaps between consecutive events of a source, by (start, id).

    Returns ``key, start, end, base_interest, id``.
    """
    names = ["start", "end", "base_interest", id_column]
    schema = StructType([events.schema[n] for n in names])
    return ordered_fold(events, [key], ["start", id_column], names, _Prune(), schema, **kwargs)


class _Stretch:
    """Short events take time before (from the last kept end) and after (to the
    source end), in closed form of the missing length and the two rooms; those
    whose rooms together are too small are dropped."""

    def __init__(self, shortest: float):
        self.shortest = shortest

    def start(self, row):
        return 0.0

    def step(self, kept_end, row):
        start, end, duration = row[:3]
        lack, free_left, free_right = self.shortest - (end - start), start - kept_end, duration - end
        if lack <= 0:
            return end, [row]
        if free_left + free_right < lack:
            return kept_end, []
        # the left side gives half, or what the right side can't, and never more than it has
        left = min(free_left, max(lack / 2.0, lack - free_right))
        stretched = (round(start - left, 3), round(end + lack - left, 3))
        return stretched[1], [(*stretched, *row[2:])]

    def finish(self, kept_end):
        return []


def enforce_min_duration(events: DataFrame, shortest: float = MIN_CLIP_SECONDS, id_column: str = "event_id",
                         **kwargs) -> DataFrame:
    """Extend or drop events below ``shortest``; events carry their source's
    ``duration``. Returns ``source_id, start, end, duration, id``."""
    names = ["start", "end", "duration", id_column]
    schema = StructType([events.schema[n] for n in names])
    return ordered_fold(
        events, ["source_id"], ["start", "end", id_column], names, _Stretch(float(shortest)), schema, **kwargs
    )


def merge_events(events: DataFrame, gap: float = 0.0, *, max_group_rows: int | None = None) -> DataFrame:
    """Merge back-to-back events of one situation.

    A new situation starts after a pause longer than ``gap`` or when main
    category, vehicle, wanted level or location changes. Each situation keeps
    the union of its lists, the highest interest and wanted level, the longest
    location and description, and the hull of its times. ``events``: ``source_id,
    event_id, start, end, description, categories, base_interest, wanted_level,
    vehicles, location, taxonomy``.
    """
    mark = F.struct(
        F.get("categories", F.lit(0)).alias("c"), F.get("vehicles", F.lit(0)).alias("v"),
        F.col("wanted_level").alias("w"), F.col("location").alias("l"),
    )
    order = ["start", "end", "event_id"]
    hot = has_hot_group(events, ["source_id"], max_group_rows)
    seen = ordered_scan(
        events.withColumn("_mark", mark), ["source_id"], order,
        [running("_reach", "max", F.col("end")), previous("_before", F.col("_mark"))], hot=hot,
    )
    fresh = (
        F.col("_reach").isNull()
        | (F.col("start") > F.col("_reach") + gap)
        | ~F.col("_mark").eqNullSafe(F.col("_before"))
    )
    runs = islands(seen, ["source_id"], order, fresh, "run_no", hot=hot)
    key = ["source_id", "run_no"]
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("event_id")))
    spans = runs.groupBy(*key).agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.count("*").cast("bigint").alias("merged"),
        F.max("base_interest").alias("base_interest"), F.max("wanted_level").alias("wanted_level"),
        longest("location").alias("location"), longest("description").alias("description"),
    )
    tags = (
        runs.select(*key, F.explode("categories").alias("tag"), "taxonomy")
        .filter(F.array_contains("taxonomy", F.col("tag")))
        .groupBy(*key).agg(F.array_sort(F.collect_set("tag")).alias("categories"))
    )
    cars = runs.select(*key, F.explode("vehicles").alias("car")).groupBy(*key).agg(
        F.array_sort(F.collect_set("car")).alias("vehicles")
    )
    none = F.array().cast("array<string>")
    return (
        spans.join(tags, key, "left").join(cars, key, "left")
        .withColumns({"categories": F.coalesce("categories", none), "vehicles": F.coalesce("vehicles", none)})
    )


def build_clips(events: DataFrame, samples: DataFrame, **kwargs) -> DataFrame:
    """Number, limit and score events: one clip row per usable event.

    ``events``: ``source_id, event_id, start, end, base_interest`` and the
    source's ``duration``. Numbers follow event order and are used up by dropped
    events too.
    """
    placed = ordered_scan(events, ["source_id"], ["start", "end", "event_id"], [number("_no")], **kwargs)
    inside = placed.withColumns({
        "start": F.greatest(F.lit(0.0), F.least("start", "duration")),
        "end": F.greatest(F.lit(0.0), F.least("end", "duration")),
    }).filter("end > start")
    scored = score_audio(inside, samples, "event_id")
    return scored.select(
        "source_id", "event_id",
        F.format_string("clip_%02d", F.col("_no")).alias("clip_local_id"),
        seconds(F.col("start")).alias("source_in"), seconds(F.col("end")).alias("source_out"),
        seconds(F.col("end") - F.col("start")).alias("duration"),
        blend_score(F.col("base_interest"), F.col("audio_factor")).alias("score"),
        F.col("peak_db").alias("peak_loudness_db"),
    )


def cap_sources(sources: DataFrame, max_seconds: float = MAX_SOURCE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Sources within the length limit, and the rejected rest."""
    fits = F.col("duration") <= float(max_seconds)
    return sources.filter(fits), sources.filter(~fits)
