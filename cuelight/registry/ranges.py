"""Range generation, limiting, merging, pruning and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import iou
from ..operators import events as ev
from ..operators import segments as seg
from ..operators import work
from ..plans import views
from ..plans.scan import number, ordered_scan
from . import query

_CLIPS = views.with_views("clips")
_SRC = views.with_views("clips", "sources")


def ranges(spark, sf):
    c = views.clips(spark, sf)
    return c.select("source_id", F.col("clip_id").alias("pos"), F.col("source_in").alias("start"), F.col("source_out").alias("end"))


def events(spark, sf):
    c = views.clips(spark, sf)
    return c.select("source_id", F.col("clip_id").alias("event_id"), F.col("source_in").alias("start"),
                    F.col("source_out").alias("end"), F.col("score").alias("base_interest"), "category", "game_signals")


@query("range_clamp", _SRC + """, r AS (
  SELECT clip_id, source_in - 3 AS s, source_out + 20 AS e, duration * 0 + 700.0 AS limit_at FROM v_clips),
i AS (SELECT clip_id, greatest(0.0, least(s, 700.0)) AS s, greatest(0.0, least(e, 700.0)) AS e FROM r),
k AS (SELECT clip_id, s, CASE WHEN e - s > 60 THEN s + 60 ELSE e END AS e FROM i WHERE e > s)
SELECT clip_id AS pos, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end" FROM k WHERE e - s >= 30""")
def range_clamp(spark, sf):
    r = ranges(spark, sf).withColumns({
        "start": F.col("start") - 3, "end": F.col("end") + 20, "duration": F.lit(700.0)
    })
    return seg.clamp_ranges(r, 30, 60).select("pos", "start", "end")


@query("interval_tiles", _SRC + """ SELECT source_id, CAST(n AS INTEGER) AS tile_no, CAST(n * 55.0 AS DOUBLE) AS "start",
  CAST(least(duration, n * 55.0 + 60.0) AS DOUBLE) AS "end"
FROM v_sources, unnest(range(0, CAST(ceil(duration / 55.0) AS BIGINT))) t(n)""")
def interval_tiles(spark, sf):
    return seg.interval_segments(views.sources(spark, sf), 60.0).select("source_id", "tile_no", "start", "end")


@query("split_ranges", _SRC + """ SELECT source_id, CAST(n AS INTEGER) AS tile_no, CAST(n * 480.0 AS DOUBLE) AS "start",
  CAST(least(duration, n * 480.0 + 480.0) AS DOUBLE) AS "end"
FROM v_sources, unnest(range(0, CAST(ceil(duration / 480.0) AS BIGINT))) t(n)""")
def split_ranges(spark, sf):
    return seg.split_ranges(seg.file_segments(views.sources(spark, sf)), 480.0).select("source_id", "tile_no", "start", "end")


@query("whole_files", _SRC + ' SELECT source_id, CAST(0.0 AS DOUBLE) AS "start", duration AS "end" FROM v_sources')
def whole_files(spark, sf):
    return seg.file_segments(views.sources(spark, sf)).select("source_id", "start", "end")


@query("cut_lists", _CLIPS + ", " + """lines AS (
  SELECT source_id, clip_id, CAST(source_in AS BIGINT) AS s, CAST(source_out AS BIGINT) AS e FROM v_clips)
SELECT source_id, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end", count(*) AS n
FROM lines WHERE clip_id % 5 < 3 GROUP BY ALL""")
def cut_lists(spark, sf):
    """Cut-list lines in all three time formats, with comments, blanks and bad rows."""
    from ..sources.files import parse_cut_lines

    s, e = F.col("source_in").cast("bigint"), F.col("source_out").cast("bigint")
    k = F.col("clip_id") % 5
    minutes = lambda t: F.format_string("%d:%02d", F.floor(t / 60), t % 60)
    hours = lambda t: F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)
    line = (
        F.when(k == 0, F.concat(s.cast("string"), F.lit(","), e.cast("string")))
        .when(k == 1, F.concat(minutes(s), F.lit(" , "), minutes(e)))
        .when(k == 2, F.concat(hours(s), F.lit(","), hours(e)))
        .when(k == 3, F.concat(F.lit("# "), s.cast("string"), F.lit(","), e.cast("string")))
        .otherwise(F.concat(e.cast("string"), F.lit(","), s.cast("string")))
    )
    good, _ = parse_cut_lines(views.clips(spark, sf).select("source_id", line.alias("line")))
    return good.groupBy("source_id", "start", "end").agg(F.count("*").alias("n"))


@query("cut_list_rejects", _CLIPS + " SELECT source_id, count(*) AS n FROM v_clips WHERE clip_id % 2 = 0 GROUP BY source_id")
def cut_list_rejects(spark, sf):
    from ..sources.files import parse_cut_lines

    bad = F.when(F.col("clip_id") % 4 == 0, F.concat(F.col("source_out").cast("string"), F.lit(",1")))
    line = bad.when(F.col("clip_id") % 4 == 2, "one column").otherwise("0:10,0:20")
    _, rejects = parse_cut_lines(views.clips(spark, sf).select("source_id", line.alias("line")))
    return rejects.groupBy("source_id").agg(F.count("*").alias("n"))


@query("scene_ranges", views.with_views("samples") + """, moved AS (
  SELECT source_id, t, db, lag(db) OVER (PARTITION BY source_id ORDER BY t) AS b, max(t) OVER (PARTITION BY source_id) AS last_t FROM v_samples),
cuts AS (SELECT source_id, t, last_t FROM moved WHERE b IS NULL OR abs(db - b) > 6.0),
r AS (SELECT source_id, t AS s, coalesce(lead(t) OVER (PARTITION BY source_id ORDER BY t), last_t) AS e FROM cuts)
SELECT source_id, round(s, 6) AS "start", round(e, 6) AS "end" FROM r WHERE e > s""")
def scene_ranges(spark, sf):
    frames = views.samples(spark, sf).withColumnRenamed("db", "feature")
    out = seg.scene_segments(frames, 6.0)
    return out.select("source_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("slice_midpoints", _CLIPS + """ SELECT clip_id AS pos, CAST(n AS INTEGER) AS slice_no,
  round(source_in + duration * (n + 0.5) / 4, 6) AS t FROM v_clips, unnest(range(0, 4)) x(n)""")
def slice_midpoints(spark, sf):
    return seg.sample_times(ranges(spark, sf), 4).select("pos", "slice_no", F.round("t", 6).alias("t"))


@query("neighbour_iou", _CLIPS + """, n AS (
  SELECT clip_id, source_in AS a0, source_out AS a1,
         lag(source_in) OVER w AS b0, lag(source_out) OVER w AS b1
  FROM v_clips WINDOW w AS (PARTITION BY source_id ORDER BY source_in, clip_id))
SELECT clip_id, round(greatest(0.0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)), 6) AS iou
FROM n WHERE b0 IS NOT NULL""")
def neighbour_iou(spark, sf):
    from ..plans.scan import previous

    c = views.clips(spark, sf)
    near = ordered_scan(c, ["source_id"], ["source_in", "clip_id"],
                        [previous("b0", F.col("source_in")), previous("b1", F.col("source_out"))])
    return near.filter("b0 IS NOT NULL").select(
        "clip_id", F.round(iou(F.col("source_in"), F.col("source_out"), F.col("b0"), F.col("b1")), 6).alias("iou")
    )


def _merge_walk(source: str) -> str:
    """Growing unions over lists, pass after pass until nothing merges. ``source``
    has source_id, s, e, p; the result is the CTE ``merged``."""
    hull = "(greatest(u.e, r.e) - least(u.s, r.s))"
    shared = "(least(u.e, r.e) - greatest(u.s, r.s))"
    return f"""mw AS (
  SELECT source_id, list(struct_pack(s := s, e := e, p := p) ORDER BY s, p) AS todo, CAST(1 AS BIGINT) AS i,
         CAST([] AS STRUCT(s DOUBLE, e DOUBLE, p BIGINT)[]) AS done, FALSE AS hit, FALSE AS fin FROM {source} GROUP BY source_id
  UNION ALL
  SELECT source_id, CASE WHEN turn AND hit THEN done ELSE todo END, CASE WHEN turn THEN 1 ELSE i + 1 END,
    CASE WHEN turn AND hit THEN CAST([] AS STRUCT(s DOUBLE, e DOUBLE, p BIGINT)[]) WHEN turn THEN done
         WHEN j IS NULL THEN list_append(done, r)
         ELSE list_concat(list_concat(done[1:j - 1], [struct_pack(s := least(done[j].s, r.s), e := greatest(done[j].e, r.e), p := done[j].p)]), done[j + 1:]) END,
    CASE WHEN turn THEN FALSE ELSE hit OR j IS NOT NULL END, turn AND NOT hit
  FROM (SELECT *, CASE WHEN NOT turn THEN nullif(list_position(list_transform(done, lambda u: {shared} > 0 AND {shared} / {hull} >= CAST(0.6 AS DOUBLE)), TRUE), 0) END AS j
    FROM (SELECT *, i > len(todo) AS turn, todo[i] AS r FROM mw WHERE NOT fin) t1) t2),
merged AS (SELECT source_id, x.s AS s, x.e AS e, x.p AS p FROM (SELECT source_id, unnest(done) AS x FROM mw WHERE fin) t)
"""


@query("merge_overlapping", "WITH RECURSIVE " + views.SQL["clips"] + ", mr AS (SELECT source_id, source_in AS s, source_out AS e, clip_id AS p FROM v_clips), "
       + _merge_walk("mr") + 'SELECT source_id, s AS "start", e AS "end", p AS pos FROM merged')
def merge_overlapping(spark, sf):
    return seg.merge_overlapping(ranges(spark, sf)).select("source_id", "start", "end", "pos")


_RECURSE = """, o AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_in, clip_id) AS n FROM v_clips)"""


@query("prune_overlaps", "WITH RECURSIVE " + views.SQL["clips"] + _RECURSE + """,
walk AS (
  SELECT source_id, n, clip_id, source_in AS s, source_out AS e, score AS i, CAST(NULL AS BIGINT) AS out_id,
         CAST(NULL AS DOUBLE) AS out_s, CAST(NULL AS DOUBLE) AS out_e, CAST(NULL AS INTEGER) AS out_i FROM o WHERE n = 1
  UNION ALL
  SELECT source_id, n, CASE WHEN act IN ('new', 'swap', 'trim') THEN nid ELSE clip_id END,
         CASE act WHEN 'new' THEN ns WHEN 'swap' THEN ns WHEN 'trim' THEN e ELSE s END,
         CASE WHEN act IN ('new', 'swap', 'trim') THEN ne ELSE e END,
         CASE WHEN act IN ('new', 'swap', 'trim') THEN ni ELSE i END,
         CASE WHEN act IN ('new', 'trim') THEN clip_id END, CASE WHEN act IN ('new', 'trim') THEN s END,
         CASE WHEN act IN ('new', 'trim') THEN e END, CASE WHEN act IN ('new', 'trim') THEN i END
  FROM (
    SELECT w.source_id, o.n, w.clip_id, w.s, w.e, w.i, o.clip_id AS nid, o.source_in AS ns, o.source_out AS ne, o.score AS ni,
      CASE WHEN o.source_in >= w.e THEN 'new'
           WHEN (least(w.e, o.source_out) - greatest(w.s, o.source_in)) / least(w.e - w.s, o.duration) > 0.5
             THEN CASE WHEN o.score > w.i THEN 'swap' ELSE 'drop' END
           WHEN o.source_out - w.e >= 2 THEN 'trim' ELSE 'drop' END AS act
    FROM walk w JOIN o ON o.source_id = w.source_id AND o.n = w.n + 1) t)
SELECT source_id, out_id AS event_id, out_s AS "start", out_e AS "end", out_i AS base_interest FROM walk WHERE out_id IS NOT NULL
UNION ALL
SELECT source_id, clip_id, s, e, i FROM walk w WHERE n = (SELECT max(n) FROM o WHERE o.source_id = w.source_id)""")
def prune_overlaps(spark, sf):
    return ev.prune_overlaps(events(spark, sf)).select("source_id", "event_id", "start", "end", "base_interest")


@query("minimum_duration", "WITH RECURSIVE " + views.SQL["clips"] + ", " + views.SQL["sources"] + """,
o AS (
  SELECT c.source_id, clip_id, CAST(source_in AS DOUBLE) AS s, CAST(source_in + c.duration / 4 AS DOUBLE) AS e, v.duration AS total,
    row_number() OVER (PARTITION BY c.source_id ORDER BY source_in, source_in + c.duration / 4, clip_id) AS n
  FROM v_clips c JOIN v_sources v USING (source_id)),
walk AS (
  SELECT source_id, CAST(0 AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS kept, CAST(NULL AS BIGINT) AS event_id,
         CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS e FROM v_sources
  UNION ALL
  SELECT source_id, n,
         CASE WHEN need <= 0 THEN e WHEN len + b2 + a1 < 10 THEN kept ELSE round_even(e + a1, 3) END,
         CASE WHEN need > 0 AND len + b2 + a1 < 10 THEN NULL ELSE clip_id END,
         CASE WHEN need <= 0 THEN s ELSE round_even(s - b2, 3) END, CASE WHEN need <= 0 THEN e ELSE round_even(e + a1, 3) END
  FROM (SELECT *, least(need - a1, s - kept) AS b2 FROM (
    SELECT *, least(need - least(need / 2.0, s - kept), total - e) AS a1 FROM (
      SELECT o.source_id, o.n, w.kept, o.clip_id, o.s, o.e, o.total, o.e - o.s AS len, 10.0 - (o.e - o.s) AS need
      FROM walk w JOIN o ON o.source_id = w.source_id AND o.n = w.n + 1) t1) t2) t3)
SELECT source_id, event_id, round(s, 3) AS "start", round(e, 3) AS "end" FROM walk WHERE event_id IS NOT NULL""")
def minimum_duration(spark, sf):
    c = views.clips(spark, sf).withColumnRenamed("duration", "length").join(views.sources(spark, sf), "source_id")
    e = c.select("source_id", F.col("clip_id").alias("event_id"), F.col("source_in").alias("start"),
                 (F.col("source_in") + F.col("length") / 4).alias("end"), "duration")
    out = ev.enforce_min_duration(e)
    return out.select("source_id", "event_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _segments(spark, sf):
    return seg.file_segments(views.sources(spark, sf)).withColumn("seg_no", F.lit(0))


_CHUNKS = "WITH RECURSIVE " + ", ".join(views.SQL[n] for n in ("clips", "sources", "samples")) + """,
walk AS (
  SELECT source_id, duration AS stop, CAST(0.0 AS DOUBLE) AS prev, CAST(0.0 AS DOUBLE) AS edge,
         greatest(1, CAST(floor(duration / 30.0) AS BIGINT)) - 1 AS cuts, CAST(0 AS BIGINT) AS no FROM v_sources
  UNION ALL
  SELECT source_id, stop, cut_at, round_even(cut_at, 3), cuts - 1, no + 1 FROM (
    SELECT w.*, least(coalesce((
        SELECT arg_min(t, struct_pack(db := db, t := t)) FROM v_samples s
        WHERE s.source_id = w.source_id AND t > 0 AND t < w.stop
          AND t BETWEEN greatest(w.prev + 0.5, w.prev + 30.0 - 12.0) AND least(w.stop - 0.5, w.prev + 30.0 + 12.0)
          AND greatest(w.prev + 0.5, w.prev + 30.0 - 12.0) < least(w.stop - 0.5, w.prev + 30.0 + 12.0)),
        w.prev + 30.0), w.prev + 45.0) AS cut_at
    FROM walk w WHERE cuts > 0 AND stop - prev > 30.0) c
  WHERE stop - cut_at >= 12.0),
cores AS (
  SELECT source_id, no, stop, edge AS s, lead(edge) OVER (PARTITION BY source_id ORDER BY no) AS e FROM walk)
"""


@query("quiet_chunks", _CHUNKS + """SELECT source_id, CAST(no AS INTEGER) AS chunk_no,
  CASE WHEN stop <= 45 THEN 0.0 ELSE round(greatest(0.0, s - CASE WHEN no > 0 THEN 5.0 ELSE 0.0 END), 3) END AS "start",
  CASE WHEN stop <= 45 THEN stop ELSE round(least(stop, coalesce(e + 5.0, stop)), 3) END AS "end"
FROM cores WHERE stop > 45 OR no = 0""")
def quiet_chunks(spark, sf):
    out = seg.chunk_segments(_segments(spark, sf), views.samples(spark, sf))
    return out.select("source_id", "chunk_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("auto_segments", _CHUNKS + """SELECT source_id, CAST(no AS INTEGER) AS tile_no,
  CASE WHEN stop <= 45 THEN 0.0 ELSE round(greatest(0.0, s - CASE WHEN no > 0 THEN 5.0 ELSE 0.0 END), 3) END AS "start",
  CASE WHEN stop <= 45 THEN stop ELSE round(least(stop, coalesce(e + 5.0, stop)), 3) END AS "end"
FROM cores WHERE (stop > 45 OR no = 0) AND source_id % 4 <> 0
UNION ALL
SELECT source_id, CAST(n AS INTEGER), CAST(n * 55.0 AS DOUBLE), CAST(least(duration, n * 55.0 + 60.0) AS DOUBLE)
FROM v_sources, unnest(range(0, CAST(ceil(duration / 55.0) AS BIGINT))) t(n) WHERE source_id % 4 = 0""")
def auto_segments(spark, sf):
    """Every fourth source is silent and falls back to even tiles."""
    heard = views.samples(spark, sf).filter("source_id % 4 <> 0")
    out = seg.auto_segments(views.sources(spark, sf), heard, 60.0)
    return out.select("source_id", "tile_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_DISPATCH = _CHUNKS.rstrip() + """,
mv AS (SELECT source_id, t, db, lag(db) OVER (PARTITION BY source_id ORDER BY t) AS b, max(t) OVER (PARTITION BY source_id) AS last_t FROM v_samples),
sc AS (SELECT source_id, t, last_t FROM mv WHERE b IS NULL OR abs(db - b) > 6.0),
gen AS (
  SELECT source_id, CAST(n * 55.0 AS DOUBLE) AS s, CAST(least(duration, n * 55.0 + 60.0) AS DOUBLE) AS e
  FROM v_sources, unnest(range(0, CAST(ceil(duration / 55.0) AS BIGINT))) t(n) WHERE source_id % 5 = 0
  UNION ALL
  SELECT source_id, CAST(CASE WHEN stop <= 45 THEN 0.0 ELSE round_even(greatest(0.0, s - CASE WHEN no > 0 THEN 5.0 ELSE 0.0 END), 3) END AS DOUBLE),
    CAST(CASE WHEN stop <= 45 THEN stop ELSE round_even(least(stop, coalesce(e + 5.0, stop)), 3) END AS DOUBLE)
  FROM cores WHERE (stop > 45 OR no = 0) AND source_id % 5 = 1
  UNION ALL SELECT source_id, source_in, source_out FROM v_clips WHERE source_id % 5 = 3
  UNION ALL SELECT * FROM (SELECT source_id, t, coalesce(lead(t) OVER (PARTITION BY source_id ORDER BY t), last_t) AS e FROM sc) z WHERE e > t AND source_id % 5 = 4),
lim AS (SELECT source_id, greatest(0.0, least(s, duration)) AS s, greatest(0.0, least(e, duration)) AS e FROM gen JOIN v_sources USING (source_id)),
fit AS (SELECT source_id, s, least(e, s + 60.0) AS e FROM lim WHERE e > s AND least(e, s + 60.0) - s >= 15.0),
mr AS (SELECT source_id, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, row_number() OVER (PARTITION BY source_id ORDER BY s, e) AS p FROM fit),
""" + _merge_walk("mr") + """, all_ranges AS (SELECT source_id, s, e FROM merged UNION ALL SELECT source_id, 0.0, duration FROM v_sources WHERE source_id % 5 = 2)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, e) AS INTEGER) AS seg_no, round(s, 6) AS "start", round(e, 6) AS "end" FROM all_ranges"""


@query("segment_dispatch", _DISPATCH)
def segment_dispatch(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("interval", "auto", "file", "manual", "scene")]),
                         (F.col("source_id") % 5 + 1).cast("int"))
    sources = views.sources(spark, sf).withColumn("segmenter", kinds)
    manual = ranges(spark, sf).select("source_id", "start", "end")
    frames = views.samples(spark, sf).withColumnRenamed("db", "feature")
    out = seg.segment_sources(sources, views.samples(spark, sf), manual=manual, frames=frames, scene_threshold=6.0)
    return out.select("source_id", "seg_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _tiles(spark, sf):
    return seg.interval_segments(views.sources(spark, sf), 60.0)


@query("chunk_plan", _SRC + """, tiles AS (
  SELECT source_id, n, CAST(n * 55.0 AS DOUBLE) AS s, CAST(least(duration, n * 55.0 + 60.0) AS DOUBLE) AS e
  FROM v_sources, unnest(range(0, CAST(ceil(duration / 55.0) AS BIGINT))) t(n))
SELECT source_id, CAST(n AS INTEGER) AS tile_no, s AS "start", e AS "end",
  sha1('{"p0":' || source_id || ',"p1":' || round_even(s, 3) || ',"p2":' || round_even(e, 3) || ',"p3":"gta","p4":"v1"}') AS key FROM tiles WHERE n % 3 <> 0""")
def chunk_plan(spark, sf):
    """Chunks with content keys, without those already done (every third)."""
    tasks = work.plan_tasks(_tiles(spark, sf).withColumns({"profile": F.lit("gta"), "version": F.lit("v1")}),
                            ["profile", "version"])
    done = tasks.filter("tile_no % 3 = 0").select(F.lit("analysis").alias("namespace"), "key", F.lit("[]").alias("payload"))
    return work.pending(tasks, done, "analysis").select("source_id", "tile_no", "start", "end", "key")


@query("source_cap", _SRC + " SELECT source_id, duration, duration <= 1480 AS kept FROM v_sources")
def source_cap(spark, sf):
    kept, rejected = ev.cap_sources(views.sources(spark, sf), 1480.0)
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


@query("shift_to_source", _CLIPS + ' SELECT clip_id AS event_id, round(source_in + duration, 3) AS "start", round(source_out + duration, 3) AS "end" FROM v_clips')
def shift_to_source(spark, sf):
    e = views.clips(spark, sf).select(F.col("clip_id").alias("event_id"), F.col("source_in").alias("start"),
                                      F.col("source_out").alias("end"), "duration")
    return ev.shift_events(e, F.col("duration"), rounded=True).select("event_id", "start", "end")


@query("reassembled_order", _CLIPS + """ SELECT source_id, clip_id AS event_id, CAST(row_number() OVER (
  PARTITION BY source_id ORDER BY source_in, clip_id) AS INTEGER) AS place FROM v_clips""")
def reassembled_order(spark, sf):
    """Events back in (segment, chunk, event) order, whatever order they finished in."""
    shuffled = events(spark, sf).repartition(7, "event_id").withColumns({
        "seg_no": F.floor(F.col("start") / 55), "chunk_no": F.floor(F.col("start") % 55)
    })
    out = ordered_scan(shuffled, ["source_id"], ["seg_no", "chunk_no", "event_id"], [number("place")])
    return out.select("source_id", "event_id", "place")


@query("merged_situations", _CLIPS + """, e AS (
  SELECT *, max(source_out) OVER (PARTITION BY source_id ORDER BY source_in, source_out, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
    lag(category) OVER (PARTITION BY source_id ORDER BY source_in, source_out, clip_id) AS before FROM v_clips),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR source_in > reach + 10 OR category <> before THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id ORDER BY source_in, source_out, clip_id) AS run FROM e)
SELECT source_id, CAST(run AS BIGINT) AS run_no, min(source_in) AS "start", max(source_out) AS "end", count(*) AS merged,
  max(score) AS base_interest, string_agg(DISTINCT CASE WHEN category IN ('view', 'click', 'error') THEN category END, ',') AS categories,
  arg_max(category || ' ' || clip_id, struct_pack(n := length(category || ' ' || clip_id), c := -clip_id)) AS description
FROM r GROUP BY ALL""")
def merged_situations(spark, sf):
    e = events(spark, sf).select(
        "source_id", "event_id", "start", "end", F.concat("category", F.lit(" "), "event_id").alias("description"),
        F.array("category").alias("categories"), "base_interest", F.lit(0).alias("wanted_level"),
        F.array(F.lit("car")).alias("vehicles"), F.lit("here").alias("location"),
        F.array(F.lit("view"), F.lit("click"), F.lit("error")).alias("taxonomy"),
    )
    out = ev.merge_events(e, gap=10.0)
    tags = F.array_join("categories", ",")
    return out.select("source_id", F.col("run_no").cast("bigint").alias("run_no"), "start", "end", "merged", "base_interest",
                      F.when(tags != "", tags).alias("categories"), "description")
