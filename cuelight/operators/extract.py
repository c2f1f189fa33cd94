"""From analysis replies to manifests: the whole way for all recordings in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.groups import shuffled
from ..plans.session import written
from ..sources.files import build_manifests
from .events import MIN_CLIP_SECONDS, build_clips, coerce_replies, enforce_min_duration, prune_overlaps, refine_events, shift_events
from .subtitles import dialogue_for_ranges

_FIELDS = ["description", "categories", "base_interest", "game_signals"]
#: Events of one reply that an event's number has room for.
_ROOM = 20


def source_events(chunks: DataFrame, results: DataFrame, profiles: DataFrame) -> DataFrame:
    """The events of all answered chunks in the time of their recordings: ``source_id, start, end`` and the event fields.

    ``chunks``: ``chunk_id, source_id, start, end, profile``; ``results``: ``chunk_id, payload, error`` of ``call_model``. A chunk
    whose call failed has no events, and is open for another run.
    """
    told = results.filter("error IS NULL").select("chunk_id", F.col("payload").alias("text"))
    answered = chunks.join(shuffled(told), "chunk_id")
    read = coerce_replies(answered.select("chunk_id", "profile", (F.col("end") - F.col("start")).alias("duration"), "text"), profiles)
    places = chunks.select("chunk_id", "source_id", F.col("start").alias("_from"))
    return shift_events(read.join(shuffled(places), "chunk_id"), F.col("_from")).drop("_from")


def finished_clips(events: DataFrame, sources: DataFrame, samples: DataFrame, cues: DataFrame, shortest: float = MIN_CLIP_SECONDS) -> DataFrame:
    """Clips of all recordings from their events: overlaps pruned, short ones stretched or dropped, numbered, scored, and
    with the dialogue that is heard in them.

    ``events``: ``source_id, event_id, start, end`` and the event fields; ``sources``: ``source_id, duration``; ``samples`` and
    ``cues`` as everywhere, empty for recordings without sound or subtitles.
    """
    lengths = sources.select("source_id", "duration")
    kept = prune_overlaps(events).select("source_id", "event_id", "start", "end").join(lengths, "source_id")
    fitted = enforce_min_duration(kept, shortest)
    fields = events.select("event_id", *_FIELDS)
    full = written(fitted.join(shuffled(fields), "event_id"), "fitted")
    clips = build_clips(full.select("source_id", "event_id", "start", "end", "base_interest", "duration"), samples)
    spans = full.select("event_id", "source_id", F.greatest(F.lit(0.0), F.least("start", "duration")).alias("start"),
                        F.greatest(F.lit(0.0), F.least("end", "duration")).alias("end"))
    said = dialogue_for_ranges(spans, cues, "event_id").select("event_id", "dialogue")
    told = full.select("event_id", "description", "categories", "game_signals")
    return clips.join(shuffled(told), "event_id").join(shuffled(said), "event_id")


def extract_manifests(sources: DataFrame, extracts: DataFrame, chunks: DataFrame, results: DataFrame, profiles: DataFrame,
                      samples: DataFrame, cues: DataFrame, refined: DataFrame | None = None, summaries: DataFrame | None = None,
                      shortest: float = MIN_CLIP_SECONDS) -> DataFrame:
    """A manifest row per extract, from the replies for its chunks.

    ``sources``: ``source_id, file_path, duration, resolution, fps``; ``extracts``: ``extract_id, source_id, manifest_path, segmenter,
    analyzer, game_profile, created_at, taxonomy``, one per source; ``chunks`` and ``results`` as in ``source_events``.
    ``refined``: the replies of a model that reworked the events of whole sources (as in ``refine_events``); a source
    without one keeps its events. ``summaries``: the summaries of sources, where there are any. A source whose replies
    give no clip has a manifest without clips.
    """
    events = source_events(chunks, results, profiles)
    numbered = F.shiftleft(F.col("chunk_id"), _ROOM) + F.col("event_no")
    if refined is not None:
        events = refine_events(events, refined, profiles).withColumn("event_id", F.xxhash64("source_id", "start", "end", *_FIELDS))
        events = events.dropDuplicates(["event_id"])
    else:
        events = events.withColumn("event_id", numbered)
    events = written(events.select("source_id", "event_id", "start", "end", *_FIELDS), "events")
    clips = finished_clips(events, sources, samples, cues, shortest)
    named = clips.join(extracts.select("extract_id", "source_id", "segmenter"), "source_id").join(
        sources.select("source_id", "file_path", "resolution", "fps"), "source_id")
    rows = named.select(
        "extract_id", F.col("clip_local_id").alias("id"), F.col("file_path").alias("file"), "source_in", "source_out", "duration",
        "resolution", "fps", "description", "dialogue", "categories", "score", "game_signals",
        F.struct("peak_loudness_db", F.array().cast("array<string>").alias("cues")).alias("audio"),
        F.array().cast("array<string>").alias("keyframes"), F.col("segmenter").alias("segment_source"))
    return build_manifests(sources, extracts, rows, summaries)
