"""Generating, limiting, merging and splitting time ranges of many sources.

``ranges`` frames have ``source_id, start, end``; ``sources`` frames have
``source_id, duration``.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from ..functions.numeric import audible, seconds
from ..plans.fold import ordered_fold
from ..plans.groups import has_hot_group
from ..plans.intervals import interval_join
from ..plans.scan import following, number, ordered_scan, previous, running
from ..plans.session import checkpointed

# Chunking limits that results depend on.
TARGET_SECONDS = 30.0
MAX_SECONDS = 45.0
OVERLAP_SECONDS = 5.0
SEARCH_SHARE = 0.4
EDGE_SECONDS = 0.5
TILE_OVERLAP = 5.0
DEDUP_IOU = 0.6
SAMPLE_BUCKET = 60.0


def clamp_ranges(ranges: DataFrame, min_clip: float, max_clip: float) -> DataFrame:
    """Limit to [0, duration], drop empty, cut to ``max_clip``, drop short ones.

    ``ranges`` carries its source's ``duration``.
    """
    inside = ranges.withColumns({
        "start": F.greatest(F.lit(0.0), F.least("start", "duration")),
        "end": F.greatest(F.lit(0.0), F.least("end", "duration")),
    }).filter("end > start")
    cut = inside.withColumn("end", F.least(F.col("end"), F.col("start") + float(max_clip)))
    return cut.filter(F.col("end") - F.col("start") >= float(min_clip))


def _tiles(ranges: DataFrame, step: float, length: float) -> DataFrame:
    span = F.col("end") - F.col("start")
    count = F.ceil(span / step).cast("int")
    tiled = ranges.filter("end > start").withColumn(
        "tile_no", F.explode(F.sequence(F.lit(0), count - 1))
    )
    begin = F.col("start") + F.col("tile_no") * step
    return tiled.withColumns({"start": begin, "end": F.least(F.col("end"), begin + length)})


def interval_segments(sources: DataFrame, interval: float, overlap: float = TILE_OVERLAP) -> DataFrame:
    """Overlapping tiles over each source; the last one is cut at the end."""
    step = max(1.0, float(interval) - float(overlap))
    whole = file_segments(sources) if interval > 0 else file_segments(sources).limit(0)
    return _tiles(whole, step, float(interval))


def split_ranges(ranges: DataFrame, max_length: float) -> DataFrame:
    """Consecutive tiles of at most ``max_length`` without overlap."""
    if max_length <= 0:
        return ranges.withColumn("tile_no", F.lit(0)).limit(0)
    return _tiles(ranges, float(max_length), float(max_length))


def file_segments(sources: DataFrame) -> DataFrame:
    return sources.filter("duration > 0").select(
        "source_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"), "duration"
    )


def scene_segments(frames: DataFrame, threshold: float) -> DataFrame:
    """Ranges between change points of a per-frame feature.

    ``frames`` has ``source_id, t, feature``. A new range starts where the
    feature moves by more than ``threshold``; the last ends with the last frame.
    """
    hot = has_hot_group(frames, ["source_id"])
    moved = ordered_scan(frames, ["source_id"], ["t"], [previous("before", F.col("feature"))], hot=hot)
    cuts = moved.filter(
        F.col("before").isNull() | (F.abs(F.col("feature") - F.col("before")) > threshold)
    ).select("source_id", F.col("t").alias("start"))
    ends = frames.groupBy("source_id").agg(F.max("t").alias("last_t"))
    ranged = ordered_scan(cuts, ["source_id"], ["start"], [following("next_start", F.col("start"))], hot=hot)
    return (
        ranged.join(ends, "source_id")
        .select("source_id", "start", F.coalesce("next_start", "last_t").alias("end"))
        .filter("end > start")
    )


class _Merge:
    """One pass of the growing union: each range joins the first open union whose
    overlap with it reaches the threshold, else it opens one. A union closes when
    no later start can reach the threshold any more."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def start(self, row):
        return []

    def step(self, unions, row):
        start, end, pos = row
        still_open, closed = [], []
        for u in unions:
            reachable = u[1] > start and (u[1] - start) / (u[1] - u[0]) >= self.threshold
            (still_open if reachable else closed).append(u)
        for u in still_open:
            shared = min(u[1], end) - max(u[0], start)
            hull = max(u[1], end) - min(u[0], start)
            if end > start and shared > 0 and shared / hull >= self.threshold:
                u[1], u[3] = max(u[1], end), True
                break
        else:
            still_open.append([start, end, pos, False])
        return still_open, [tuple(u) for u in closed]

    def finish(self, unions):
        return [tuple(u) for u in unions]


class _Settled:
    """All passes of the growing union over one island, which is held meanwhile, until one changes nothing."""

    def __init__(self, threshold: float):
        self.once = _Merge(threshold)

    def start(self, row):
        return []

    def step(self, held, row):
        held.append(row)
        return held, []

    def finish(self, held):
        while True:
            unions, done = [], []
            for row in held:
                unions, closed = self.once.step(unions, row)
                done += closed
            done += self.once.finish(unions)
            held = sorted((u[:3] for u in done), key=lambda u: (u[0], u[2]))
            if not any(u[3] for u in done):
                return [(*u, False) for u in held]


def merge_overlapping(
    ranges: DataFrame, threshold: float = DEDUP_IOU, *, max_group_rows: int | None = None
) -> DataFrame:
    """Merge ranges whose IoU reaches ``threshold`` until nothing changes.

    Ranges are taken by start, then ``pos`` (their given order). Only ranges that share time can merge, so ranges that
    overlap no other pass through, and the others are taken island by island, wherever their source is: an island is settled
    by one task that holds it. Only where an island is too big for that, passes run one after another over islands that are split, and
    those in which a pass merged nothing are final and leave the loop.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    schema = StructType([
        StructField("start", DoubleType()), StructField("end", DoubleType()),
        StructField("pos", LongType()), StructField("merged", BooleanType()),
    ])
    key, order, columns = ["source_id", "_island"], ["start", "pos"], ["source_id", "start", "end", "pos"]
    given = ranges.select("source_id", "start", "end", F.col("pos").cast("bigint").alias("pos"))
    hot = has_hot_group(given, ["source_id"], max_group_rows)
    reach = ordered_scan(given, ["source_id"], order, [running("_reach", "max", F.col("end"))], hot=hot)
    opens = reach.withColumn("_opens", F.coalesce(F.col("start") >= F.col("_reach"), F.lit(True)))
    placed = checkpointed(ordered_scan(opens, ["source_id"], order, [
        running("_island", "sum", F.col("_opens").cast("bigint"), inclusive=True), following("_closes", F.col("_opens")),
    ], hot=hot).select(*columns, "_island", (F.col("_opens") & F.coalesce("_closes", F.lit(True))).alias("_alone")))
    finished = placed.filter("_alone").select(*columns)
    todo = placed.filter("not _alone").drop("_alone")
    if not has_hot_group(todo, key, max_group_rows):
        settled = ordered_fold(todo, key, order, ["start", "end", "pos"], _Settled(threshold), schema, hot=False)
        return finished.unionByName(settled.select(*columns))
    while True:
        merged = checkpointed(
            ordered_fold(
                todo, key, order, ["start", "end", "pos"], _Merge(threshold), schema, max_group_rows=max_group_rows,
            )
        )
        changed = merged.filter("merged").select(*key).distinct()
        out = merged.drop("merged")
        finished = finished.unionByName(out.join(changed, key, "left_anti").select(*columns))
        if changed.isEmpty():
            return finished
        todo = out.join(changed, key, "left_semi")


class _Cut:
    """Walks the samples of a segment and cuts at the quietest one in the search window after the previous cut.

    The state is the previous cut and the samples that can still be the quietest of the coming window, nothing older,
    so walks that begin apart soon agree. How many cuts a segment may have is not its business.
    """

    def __init__(self, target: float, longest: float):
        self.target, self.longest = target, longest

    def start(self, row):
        begin, end, t = row[:3]
        # Without a head row this is a walk that begins amid a segment: any guess will do, it is corrected later.
        return {"begin": begin, "end": end, "prev": begin if t is None else max(begin, t - self.target), "quiet": deque()}

    def _window(self, s):
        ideal, reach = s["prev"] + self.target, self.target * SEARCH_SHARE
        return (ideal, max(s["prev"] + EDGE_SECONDS, ideal - reach),
                min(s["end"] - EDGE_SECONDS, ideal + reach))

    def _open(self, s):
        return s["end"] - s["prev"] > self.target

    def _row(self, s, at, last):
        return (at, round(at, 3), last, s["begin"], s["end"], round(s["begin"], 3), round(s["end"], 3))

    def _cut(self, s):
        ideal, low, high = self._window(s)
        quiet = s["quiet"]
        at = quiet[0][0] if quiet and low < high else ideal
        at = min(at, s["prev"] + self.longest)
        if s["end"] - at < self.target * SEARCH_SHARE:
            s["prev"] = s["end"]
            quiet.clear()
            return []
        s["prev"] = at
        self._forget(s)
        return [self._row(s, at, False)]

    def _forget(self, s):
        low, quiet = self._window(s)[1], s["quiet"]
        while quiet and quiet[0][0] < low:
            quiet.popleft()

    def step(self, s, row):
        t, db = row[2], row[3]
        done = []
        if t is None:
            return s, done
        while self._open(s) and t > self._window(s)[2]:
            done += self._cut(s)
        if self._open(s):
            quiet = s["quiet"]
            while quiet and quiet[-1][1] > db:
                quiet.pop()
            quiet.append((t, db))
            self._forget(s)
        return s, done

    def finish(self, s):
        done = []
        while self._open(s):
            done += self._cut(s)
        return done + [self._row(s, s["end"], True)]


def chunk_segments(
    segments: DataFrame,
    samples: DataFrame,
    target: float = TARGET_SECONDS,
    longest: float = MAX_SECONDS,
    overlap: float = OVERLAP_SECONDS,
    *,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Split segments at quiet points into padded chunks.

    ``segments``: ``source_id, seg_no, start, end``; ``samples``: ``source_id, t,
    db``. Returns ``source_id, seg_no, chunk_no, start, end``.
    """
    spans = segments.select("source_id", F.col("seg_no").cast("int").alias("seg_no"), "start", "end")
    short = spans.filter(F.col("end") - F.col("start") <= longest)
    long = spans.filter(F.col("end") - F.col("start") > longest)
    # A segment without samples still needs its cuts, so each gets one head row.
    heads = long.select("*", F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("db"))
    points = samples.filter(audible(F.col("db"))).select(
        "source_id", "t", "db", F.col("t").alias("t_end")
    )
    inside = interval_join(
        points, long, ["source_id"], left_span=("t", "t_end"), right_span=("start", "end"),
        width=SAMPLE_BUCKET, closed=True,
    ).filter((F.col("t") > F.col("start")) & (F.col("t") < F.col("end")))
    rows = heads.unionByName(inside.select(*heads.columns))
    schema = StructType([
        StructField("at", DoubleType()), StructField("edge", DoubleType()), StructField("last", BooleanType()),
        StructField("begin", DoubleType()), StructField("stop", DoubleType()),
        StructField("begin_ms", DoubleType()), StructField("stop_ms", DoubleType()),
    ])
    # A segment holds at most its source's samples, so those are counted, not the pairs.
    hot = has_hot_group(samples, ["source_id"], max_group_rows)
    key = ["source_id", "seg_no"]
    cuts = ordered_fold(rows, key, ["t", "db"], ["start", "end", "t", "db"], _Cut(float(target), float(longest)), schema, hot=hot)
    cuts = checkpointed(cuts) if hot else cuts
    # Where the cuts are does not depend on how many are allowed: later ones are dropped afterwards.
    allowed = F.greatest(F.lit(1), F.floor((F.col("stop") - F.col("begin")) / float(target))) - 1
    counted = ordered_scan(cuts, key, ["last", "at"], [number("_no")], hot=hot).filter(F.col("last") | (F.col("_no") <= allowed))
    linked = ordered_scan(counted, key, ["last", "at"], [number("_place"), previous("_edge", F.col("edge"))], hot=hot)
    early, late = F.col("_edge") - float(overlap), F.col("edge") + float(overlap)
    chunks = linked.select(
        *key, (F.col("_place") - 1).cast("int").alias("chunk_no"),
        F.when(early > F.col("begin"), seconds(early)).otherwise(F.col("begin_ms")).alias("start"),
        F.when(~F.col("last") & (late < F.col("stop")), seconds(late)).otherwise(F.col("stop_ms")).alias("end"),
    )
    whole = short.select("source_id", "seg_no", F.lit(0).alias("chunk_no"), "start", "end")
    return chunks.unionByName(whole)


def auto_segments(sources: DataFrame, samples: DataFrame, max_clip: float, **kwargs) -> DataFrame:
    """Quiet-point segments per source; even tiles where a source has no samples."""
    usable = sources.filter("duration > 0")
    heard = samples.select("source_id").distinct()
    spans = file_segments(usable.join(heard, "source_id", "left_semi")).withColumn("seg_no", F.lit(0))
    cut = chunk_segments(spans, samples, **kwargs).select(
        "source_id", F.col("chunk_no").alias("tile_no"), "start", "end"
    )
    tiles = interval_segments(usable.join(heard, "source_id", "left_anti"), max_clip)
    return cut.unionByName(tiles.select(*cut.columns))


def segment_sources(
    sources: DataFrame,
    samples: DataFrame,
    *,
    manual: DataFrame | None = None,
    frames: DataFrame | None = None,
    interval: float = 60.0,
    min_clip: float = 15.0,
    max_clip: float = 60.0,
    scene_threshold: float = 27.0,
    dedup_iou: float | None = DEDUP_IOU,
) -> DataFrame:
    """Candidate ranges of every source by its ``segmenter``: generated, limited,
    merged and numbered. ``file`` sources stay whole; ``dedup_iou=None`` skips
    merging."""
    columns = ["source_id", "start", "end"]
    of = lambda name: sources.filter(F.col("segmenter") == name)
    found = [
        interval_segments(of("interval"), interval).select(*columns),
        auto_segments(of("auto"), samples, max_clip).select(*columns),
    ]
    if manual is not None:
        found.append(manual.join(of("manual"), "source_id", "left_semi").select(*columns))
    if frames is not None:
        shots = scene_segments(frames.join(of("scene"), "source_id", "left_semi"), scene_threshold)
        found.append(shots.select(*columns))
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    limited = clamp_ranges(
        ranges.join(sources.select("source_id", "duration"), "source_id"), min_clip, max_clip
    ).select(*columns)
    if dedup_iou is not None:
        placed = ordered_scan(limited, ["source_id"], ["start", "end"], [number("pos")])
        limited = merge_overlapping(placed, dedup_iou).select(*columns)
    ranges = limited.unionByName(file_segments(of("file")).select(*columns))
    return ordered_scan(ranges, ["source_id"], ["start", "end"], [number("seg_no")])


def sample_times(ranges: DataFrame, count: int) -> DataFrame:
    """Midpoints of ``count`` equal slices of each range."""
    if count <= 0:
        return ranges.withColumns({"slice_no": F.lit(0), "t": F.lit(0.0)}).limit(0)
    spread = ranges.filter("end > start").withColumn(
        "slice_no", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    )
    span = F.col("end") - F.col("start")
    return spread.withColumn("t", F.col("start") + span * (F.col("slice_no") + 0.5) / count)
