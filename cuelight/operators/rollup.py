"""Per-source roll-ups: scene documents, windows, casts, beats, run totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import semi
from ..functions.numeric import frame_count, grid_columns, grid_rows, token_estimate
from ..functions.text import strip
from ..plans.intervals import interval_join
from ..plans.scan import number, ordered_scan, running
from ..plans.session import last_key_counts, written

# Window size and limits that results depend on.
WINDOW_SCENES = 30
FALLBACK_CHARS = 2000
BEAT_MIN_SECONDS = 30.0
BEAT_MAX_SECONDS = 60.0

_WIDTH = 300.0


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)


def scene_line(start: Column, end: Column, description: Column, dialogue: Column) -> Column:
    """One scene as a bullet with its time, description and spoken text."""
    spoken = strip(F.coalesce(dialogue, F.lit("")))
    head = F.concat(F.lit("- ["), _one_decimal(start), F.lit("-"), _one_decimal(end), F.lit("s] "),
                    strip(F.coalesce(description, F.lit(""))))
    return F.when(spoken == "", head).otherwise(F.concat(head, F.lit(' | dialogue: "'), spoken, F.lit('"')))


def event_line(start: Column, end: Column, interest: Column, categories: Column, signals: Column,
               description: Column) -> Column:
    """One event as a bullet for the merge step; ``signals`` is a map of texts."""
    pairs = F.concat_ws(", ", F.transform(F.map_entries(signals), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    shown = F.when(F.size(signals) > 0, F.concat(F.lit("signals={"), pairs, F.lit("} "))).otherwise("")
    return F.concat(
        F.lit("- ["), _one_decimal(start), F.lit("-"), _one_decimal(end), F.lit("s] interest="),
        interest.cast("string"), F.lit(" cats=["), F.concat_ws(", ", categories), F.lit("] "), shown,
        F.lit('"'), strip(F.coalesce(description, F.lit(""))), F.lit('"'),
    )


def scene_windows(scenes: DataFrame, line: Column, size: int = WINDOW_SCENES, id_column: str = "clip_id",
                  **kwargs) -> DataFrame:
    """Scene bullets of each source in windows of ``size``: ``source_id,
    window_no, scenes, start, end, text``. A window never gathers more than
    ``size`` lines, however long its source is."""
    placed = ordered_scan(
        scenes.withColumn("_line", line), ["source_id"], ["start", id_column], [number("_n")], **kwargs
    ).withColumn("window_no", F.floor((F.col("_n") - 1) / size).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    return placed.groupBy("source_id", "window_no").agg(
        F.count("*").cast("int").alias("scenes"), F.min("start").alias("start"),
        F.max_by("end", "_n").alias("end"), F.concat_ws("\n", F.transform(lines, lambda x: x["_line"])).alias("text"),
    )


def join_parts(parts: DataFrame, separator: str = "\n") -> DataFrame:
    """One document per source from its window texts, in order."""
    texts = F.array_sort(F.collect_list(F.struct("window_no", "text")))
    return parts.groupBy("source_id").agg(
        F.concat_ws(separator, F.transform(texts, lambda x: x["text"])).alias("text")
    )


def write_documents(parts: DataFrame, path: str) -> None:
    """Write the parts of documents (``source_id, window_no, text``) as JSON lines, in the order of sources and windows over
    the files: a document of any length is read on from file to file."""
    order = ["source_id", "window_no"]
    parts.select(*order, "text").repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def read_window_summaries(replies: DataFrame) -> DataFrame:
    """Window replies (``source_id, window_no, duration, text``) as ``synopsis``,
    ``characters`` and ``beats``; replies that are not objects are left out."""
    last_key_counts(replies.sparkSession)
    doc = semi.tolerant_json(F.col("text"))
    rows = replies.withColumn("_doc", doc).filter(semi.is_object(F.col("_doc")))
    leaf = lambda name: semi.get(F.col("_doc"), f"$.{name}", "variant")
    return rows.select(
        "source_id", "window_no", semi.text(leaf("synopsis")).alias("synopsis"),
        semi.text_list(leaf("themes")).alias("themes"), semi.text(leaf("tone")).alias("tone"),
        semi.coerced_characters(leaf("characters")).alias("characters"),
        semi.coerced_beats(leaf("beats"), F.col("duration")).alias("beats"),
    )


def roster(windows: DataFrame) -> DataFrame:
    """Characters of each source by lower-case name, first mention wins:
    ``source_id, name, role, window_no, pos``."""
    people = windows.select("source_id", "window_no", F.posexplode("characters").alias("pos", "c"))
    first = people.groupBy("source_id", F.lower("c.name").alias("_key")).agg(
        F.min(F.struct("window_no", "pos", "c")).alias("m")
    )
    return first.select("source_id", "m.c.name", "m.c.role", "m.window_no", "m.pos")


def source_cast(windows: DataFrame, **kwargs) -> DataFrame:
    """The roster of each source as rows with a place from 0 on: ``source_id, pos, name, role``."""
    people = roster(windows).withColumnRenamed("pos", "_pos")
    placed = ordered_scan(people, ["source_id"], ["window_no", "_pos"], [number("_n")], **kwargs)
    return placed.select("source_id", (F.col("_n") - 1).alias("pos"), "name", "role")


def source_beats(windows: DataFrame, **kwargs) -> DataFrame:
    """All beats of each source as rows with a place from 0 on, in the order of time: ``source_id, pos, start, end, title,
    summary``."""
    each = windows.select("source_id", F.explode("beats").alias("b")).select("source_id", "b.*")
    placed = ordered_scan(each, ["source_id"], ["start", "end", "title", "summary"], [number("_n")], **kwargs)
    return placed.select("source_id", (F.col("_n") - 1).alias("pos"), "start", "end", "title", "summary")


def summary_levels(windows: DataFrame, size: int = WINDOW_SCENES, limit: int = FALLBACK_CHARS,
                   combine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The window synopses of each source reduced level by level until one is left: ``source_id, level, window_no, parts,
    synopsis``.

    Level 0 are the windows that say something. A window of the next level stands for up to ``size`` windows of the one
    before, so no row ever gathers more. Its synopsis is theirs joined and cut to ``limit`` characters (the same as cutting all
    of them joined), or what ``combine`` makes of ``source_id, level, window_no, parts, texts``: those rows with a
    ``synopsis``.
    """
    columns = ["source_id", "level", "window_no", "parts", "synopsis"]
    rows = windows.filter("synopsis <> ''").select("source_id", F.lit(0).alias("level"), "window_no", F.lit(1).alias("parts"), "synopsis")
    now, levels = written(rows, "level"), []
    while True:
        levels.append(now)
        long = now.groupBy("source_id").agg(F.max("window_no").alias("last")).filter("last > 0").select("source_id")
        if long.isEmpty():
            break
        texts = F.array_sort(F.collect_list(F.struct("window_no", "synopsis")))
        grouped = now.join(long, "source_id", "left_semi").groupBy(
            "source_id", (F.col("level") + 1).alias("level"), F.floor(F.col("window_no") / size).cast("int").alias("above")).agg(
            F.count(F.lit(1)).cast("int").alias("parts"), F.transform(texts, lambda x: x["synopsis"]).alias("texts"))
        grouped = grouped.withColumnRenamed("above", "window_no")
        if combine is None:
            reduced = grouped.withColumn("synopsis", F.substring(F.concat_ws(" ", "texts"), 1, limit))
        else:
            reduced = combine(grouped)
        now = written(reduced.select(*columns), "level")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def joined_synopsis(windows: DataFrame, limit: int = FALLBACK_CHARS, **kwargs) -> DataFrame:
    """The window synopses of each source joined and cut to ``limit`` characters.

    Only the windows that can reach into the result are gathered: those that
    begin before the limit.
    """
    told = windows.filter("synopsis <> ''")
    placed = ordered_scan(
        told.select("source_id", "window_no", "synopsis"), ["source_id"], ["window_no"],
        [running("_at", "sum", F.length("synopsis") + 1)], **kwargs,
    ).filter(F.coalesce("_at", F.lit(0)) < limit)
    texts = F.array_sort(F.collect_list(F.struct("window_no", "synopsis")))
    return placed.groupBy("source_id").agg(
        F.substring(F.concat_ws(" ", F.transform(texts, lambda x: x["synopsis"])), 1, limit).alias("synopsis")
    )


@dataclass(frozen=True)
class Summaries:
    """What is told of sources: one row of texts each (``source_id, synopsis, themes, tone``), and rows with a place for
    their cast (``source_id, pos, name, role``) and their beats (``source_id, pos, start, end, title, summary``)."""

    texts: DataFrame
    cast: DataFrame
    beats: DataFrame


def summarize_sources(windows: DataFrame, reduced: DataFrame | None = None) -> Summaries:
    """The summaries of sources from their windows' summaries.

    ``reduced`` (``source_id, synopsis, themes, tone``) holds the texts of a final
    pass where there was one; elsewhere the joined synopses stand in, without
    themes and tone. Sources with one window (number 0) keep that window's texts. Sources
    without synopsis and beats get no row. Cast and beats stay rows, however many a source has.
    """
    sizes = windows.groupBy("source_id").agg(
        F.max("window_no").alias("_last"), F.min_by("themes", "window_no").alias("_themes"),
        F.min_by("tone", "window_no").alias("_tone"), F.min_by("synopsis", "window_no").alias("_one"),
        F.max(F.size("beats") > 0).alias("_beats"),
    )
    rows = sizes.join(joined_synopsis(windows), "source_id", "left")
    none = F.array().cast("array<string>")
    if reduced is None:
        rows = rows.withColumns({"_r_syn": F.lit(None).cast("string"), "_r_th": none, "_r_tone": F.lit("")})
    else:
        rows = rows.join(reduced.select(
            "source_id", F.col("synopsis").alias("_r_syn"), F.col("themes").alias("_r_th"),
            F.col("tone").alias("_r_tone")), "source_id", "left")
    single = F.col("_last") == 0
    told = F.coalesce("_r_syn", F.lit("")) != ""
    synopsis = F.when(told, F.col("_r_syn")).when(single, F.col("_one")).otherwise(F.coalesce("synopsis", F.lit("")))
    texts = rows.select(
        "source_id", synopsis.alias("synopsis"),
        F.when(told, F.col("_r_th")).when(single, F.col("_themes")).otherwise(none).alias("themes"),
        F.when(told, F.col("_r_tone")).when(single, F.col("_tone")).otherwise("").alias("tone"), "_beats",
    ).filter((F.col("synopsis") != "") | F.col("_beats")).drop("_beats")
    return Summaries(texts, source_cast(windows), source_beats(windows))


def merge_cast(entries: DataFrame) -> DataFrame:
    """Cast entries by name: images in first-seen order, first non-empty
    description. ``entries``: ``source_id, pos, name, images, description``."""
    images = entries.select("source_id", "name", "pos", F.posexplode("images").alias("i", "image"))
    first = images.groupBy("source_id", "name", "image").agg(F.min(F.struct("pos", "i")).alias("at"))
    lists = first.groupBy("source_id", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "image"))), lambda x: x["image"]).alias("images")
    )
    told = F.when(F.col("description") != "", F.col("pos"))
    people = entries.groupBy("source_id", "name").agg(
        F.min("pos").alias("pos"), F.coalesce(F.min_by("description", told), F.lit("")).alias("description")
    )
    return people.join(lists, ["source_id", "name"], "left").withColumn(
        "images", F.coalesce("images", F.array().cast("array<string>"))
    )


def scenes_of_beats(beats: DataFrame, clips: DataFrame) -> DataFrame:
    """Pairs of story beats and the clips that overlap them. ``beats``:
    ``source_id, beat_no, beat_start, beat_end``; ``clips``: ``source_id, clip_id,
    source_in, source_out``."""
    return interval_join(
        clips, beats, ["source_id"], left_span=("source_in", "source_out"),
        right_span=("beat_start", "beat_end"), width=_WIDTH,
    )


def top_clip_per_beat(beats: DataFrame, clips: DataFrame, shortest: float = BEAT_MIN_SECONDS,
                      longest: float = BEAT_MAX_SECONDS) -> DataFrame:
    """The best long-enough clip of every beat, cut to ``longest``. The best is
    found by a combining aggregate, not by sorting a beat's clips."""
    fit = clips.filter(F.col("source_out") - F.col("source_in") >= float(shortest))
    pairs = scenes_of_beats(beats, fit)
    best = pairs.groupBy("source_id", "beat_no").agg(
        F.max_by(F.struct("clip_id", "source_in", "source_out", "score"), F.struct("score", -F.col("clip_id"))).alias("c")
    )
    return best.select(
        "source_id", "beat_no", "c.clip_id", "c.score", "c.source_in",
        F.least("c.source_out", F.col("c.source_in") + float(longest)).alias("source_out"),
    )


def size_requests(chunks: DataFrame, prompt: Column) -> DataFrame:
    """Frames, grid and token estimate of every analysis chunk."""
    frames = frame_count(F.col("end") - F.col("start"))
    return chunks.withColumn("frames", frames).withColumns({
        "grid_columns": grid_columns(F.col("frames")), "grid_rows": grid_rows(F.col("frames")),
        "tokens": token_estimate(prompt, F.col("frames")),
    })


def run_totals(requests: DataFrame) -> DataFrame:
    """Chunks, frames and tokens per source."""
    return requests.groupBy("source_id").agg(
        F.count("*").alias("chunks"), F.sum("frames").alias("frames"), F.sum("tokens").alias("tokens")
    )


def audio_totals(ranges: DataFrame, samples: DataFrame, peaks: DataFrame, id_column: str = "seg_no") -> DataFrame:
    """Usable samples and peaks inside each range."""
    from .signal import samples_in_ranges

    key = ["source_id", id_column]
    spans = ranges.select(*key, "start", "end")
    heard = samples_in_ranges(spans, samples).groupBy(*key).agg(F.count("*").alias("samples"))
    points = peaks.select("source_id", "t", F.col("intensity").alias("db"))
    tops = samples_in_ranges(spans, points).groupBy(*key).agg(F.count("*").alias("peaks"))
    zero = F.lit(0).cast("bigint")
    return spans.join(heard, key, "left").join(tops, key, "left").select(
        *key, F.coalesce("samples", zero).alias("samples"), F.coalesce("peaks", zero).alias("peaks")
    )


PROMPT = (
    "{context}A {duration}-second piece of {subject} is shown as {frames} frames.\n{hints}\n"
    "Allowed categories: {taxonomy}\nSplit it into situations. {rules}\n{example}"
    "Answer in JSON: events with start, end, description, categories, base_interest and game_signals:\n{signals}"
)


RULES = (
    "Every event is one thing that happens, from its first visible moment to its last. Events are in order and do not share time. "
    "Leave out stretches where nothing happens, and do not end an event only because the camera cuts."
)


def context_preamble(intro: Column, characters: Column) -> Column:
    """What is known of a recording before its pieces are shown: the introduction and the people, with how many pictures of each follow.
    ``characters``: array of name, description, images. Empty if nothing is known."""
    def person(c: Column) -> Column:
        told = strip(F.coalesce(c["description"], F.lit("")))
        seen = F.size(F.coalesce(c["images"], F.array().cast("array<string>")))
        return F.concat(F.lit("- "), c["name"], F.when(told == "", "").otherwise(F.concat(F.lit(": "), told)),
                        F.when(seen > 0, F.concat(F.lit(" (pictures: "), seen.cast("string"), F.lit(")"))).otherwise(""))

    given = strip(F.coalesce(intro, F.lit("")))
    people = F.concat_ws("\n", F.transform(F.coalesce(characters, F.array().cast(
        "array<struct<name:string,description:string,images:array<string>>>")), person))
    parts = F.concat_ws("\n", F.when(given != "", F.concat(F.lit("About this recording: "), given)),
                        F.when(people != "", F.concat(F.lit("People in it:\n"), people)))
    return F.when(parts == "", "").otherwise(F.concat(parts, F.lit("\n\n")))


def render_prompts(chunks: DataFrame, profiles: DataFrame, template: str = PROMPT) -> DataFrame:
    """Fill a prompt template for every chunk from its profile row.

    ``profiles``: ``profile, subject, taxonomy, hints, rules, example`` and
    ``signals`` (array of key, type, description). A profile's own ``template``
    column, where set, wins. ``chunks`` may carry a ``context`` text (``context_preamble``). A profile without
    rules gets ``RULES``.
    """
    from ..plans.groups import broadcast_if_small

    joined = chunks.join(broadcast_if_small(profiles), "profile", "left")
    length = F.col("end") - F.col("start")
    none = F.array().cast("array<string>")
    lines = F.transform("signals", lambda s: F.concat(
        F.lit("      - "), s["key"], F.lit(" ("), s["type"], F.lit("): "), s["description"]))
    tags = F.concat_ws(", ", F.coalesce("taxonomy", none))
    blank = F.lit("")
    example = strip(F.coalesce("example", blank))
    values = {
        "context": F.coalesce(F.col("context"), blank) if "context" in joined.columns else blank,
        "duration": F.format_string("%.1f", length),
        "subject": F.coalesce("subject", F.lit("video")),
        "frames": frame_count(length).cast("string"),
        "columns": grid_columns(frame_count(length)).cast("string"),
        "rows": grid_rows(frame_count(length)).cast("string"),
        "hints": F.coalesce("hints", blank),
        "rules": F.when(strip(F.coalesce("rules", blank)) == "", F.lit(RULES)).otherwise(F.col("rules")),
        "taxonomy": F.when(tags == "", "(none)").otherwise(tags),
        "signals": F.concat_ws("\n", F.coalesce(lines, none)),
        "example": F.when(example == "", "").otherwise(F.concat(example, F.lit("\n\n"))),
    }
    text = F.coalesce(F.col("template"), F.lit(template)) if "template" in joined.columns else F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return joined.select(*chunks.columns, text.alias("prompt"))
