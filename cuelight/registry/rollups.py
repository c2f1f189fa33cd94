"""Per-source roll-ups and streaming replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup as ru
from ..plans import views
from . import query

_C = views.with_views("clips")
_SRC = views.with_views("clips", "sources")


def _scenes(spark, sf):
    c = views.clips(spark, sf)
    return c.select("source_id", "clip_id", F.col("source_in").alias("start"), F.col("source_out").alias("end"),
                    F.concat("category", F.lit(" "), "clip_id").alias("description"),
                    F.when(F.col("clip_id") % 2 == 0, F.concat(F.lit("line "), "clip_id")).otherwise("").alias("dialogue"))


_LINES = """, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_in, clip_id) AS n FROM v_clips),
ln AS (SELECT source_id, n, (n - 1) // 30 AS w, source_in, source_out,
  printf('- [%.1f-%.1fs] %s', source_in, source_out, category || ' ' || clip_id) || CASE WHEN clip_id % 2 = 0 THEN ' | dialogue: "line ' || clip_id || '"' ELSE '' END AS line FROM n)
"""


@query("scene_windows", _C + _LINES + """SELECT source_id, CAST(w AS INTEGER) AS window_no, CAST(count(*) AS INTEGER) AS scenes, min(source_in) AS "start",
  arg_max(source_out, n) AS "end", string_agg(line, chr(10) ORDER BY n) AS text FROM ln GROUP BY source_id, w""")
def scene_windows(spark, sf):
    line = ru.scene_line(F.col("start"), F.col("end"), F.col("description"), F.col("dialogue"))
    return ru.scene_windows(_scenes(spark, sf), line)


@query("event_documents", _C + """, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_in, clip_id) AS n FROM v_clips)
SELECT source_id, string_agg(printf('- [%.1f-%.1fs] interest=', source_in, source_out) || score || ' cats=[' || category || '] signals={k=' || json_extract_string(game_signals, '$.k') || '} "scene ' || clip_id || '"', chr(10) ORDER BY n) AS text
FROM n GROUP BY source_id""")
def event_documents(spark, sf):
    """Event bullets of each source as parts in order, written, read back and joined to one document."""
    from ..plans.session import scratch_path

    c = views.clips(spark, sf).select(
        "source_id", "clip_id", F.col("source_in").alias("start"), F.col("source_out").alias("end"), "score",
        F.array("category").alias("cats"), F.from_json("game_signals", "map<string,string>").alias("signals"),
        F.concat(F.lit("scene "), "clip_id").alias("description"))
    line = ru.event_line(F.col("start"), F.col("end"), F.col("score"), F.col("cats"), F.col("signals"), F.col("description"))
    path = scratch_path(spark, "documents")
    ru.write_documents(ru.scene_windows(c, line), path)
    return ru.join_parts(spark.read.schema("source_id bigint, window_no int, text string").json(path))


def _windows(spark, sf):
    """Window replies in JSON, read back: three characters and one beat per window."""
    line = ru.scene_line(F.col("start"), F.col("end"), F.col("description"), F.col("dialogue"))
    w = ru.scene_windows(_scenes(spark, sf), line)
    text = F.concat(
        F.lit('Sure: {"synopsis":" part '), "window_no", F.lit(' '), F.repeat(F.lit("abcdefghi "), 90),
        F.lit('","characters":[{"name":"Ann","role":"r'), "window_no", F.lit('"},{"name":"ANN"},{"name":"W'), "window_no",
        F.lit('"}],"beats":[{"title":"b'), "window_no", F.lit('","start":'), F.col("start").cast("string"), F.lit(',"end":'),
        F.col("end").cast("string"), F.lit("}]}"))
    stop = views.sources(spark, sf)
    return ru.read_window_summaries(w.join(stop, "source_id").select("source_id", "window_no", "duration", text.alias("text")))


_WINS = _SRC + _LINES + """, win AS (SELECT source_id, w, min(source_in) AS s, arg_max(source_out, n) AS e FROM ln GROUP BY source_id, w),
wr AS (SELECT win.*, 'part ' || w || ' ' || trim(repeat('abcdefghi ', 90)) AS syn, least(e, duration) AS e2 FROM win JOIN v_sources USING (source_id))
"""


@query("source_roster", _WINS + """SELECT source_id, 'Ann' AS name, 'r0' AS role FROM win WHERE w = 0 UNION ALL SELECT source_id, 'W' || w, '' FROM win""")
def source_roster(spark, sf):
    return ru.roster(_windows(spark, sf)).select("source_id", "name", "role")


@query("joined_synopses", _WINS + "SELECT source_id, substr(string_agg(syn, ' ' ORDER BY w), 1, 2000) AS synopsis FROM wr GROUP BY source_id")
def joined_synopses(spark, sf):
    return ru.joined_synopsis(_windows(spark, sf))


@query("source_summaries", _WINS + """SELECT source_id, CASE WHEN count(*) = 1 THEN arg_min(syn, w) ELSE substr(string_agg(syn, ' ' ORDER BY w), 1, 2000) END AS synopsis,
  count(*) + 1 AS people, count(*) FILTER (WHERE e2 > s) AS beats FROM wr GROUP BY source_id""")
def source_summaries(spark, sf):
    """The texts of each source with the sizes of its cast and of its beats."""
    from ..plans.groups import shuffled
    from ..plans.session import written

    s = ru.summarize_sources(written(_windows(spark, sf), "windows"))
    people = s.cast.groupBy("source_id").agg(F.count("*").alias("people"))
    beats = s.beats.groupBy("source_id").agg(F.count("*").alias("beats"))
    zero = F.lit(0).cast("bigint")
    return s.texts.join(shuffled(people), "source_id", "left").join(shuffled(beats), "source_id", "left").select(
        "source_id", "synopsis", F.coalesce("people", zero).alias("people"), F.coalesce("beats", zero).alias("beats"))


@query("summary_cast", _WINS + """SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY w, k) - 1 AS INTEGER) AS pos, name, role FROM (
  SELECT source_id, 0 AS w, 0 AS k, 'Ann' AS name, 'r0' AS role FROM win WHERE w = 0 UNION ALL SELECT source_id, w, 2, 'W' || w, '' FROM win)""")
def summary_cast(spark, sf):
    """The cast of each source as rows with a place."""
    return ru.summarize_sources(_windows(spark, sf)).cast


@query("summary_beats", _WINS + """SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, e2, 'b' || w) - 1 AS INTEGER) AS pos, s AS "start", e2 AS "end", 'b' || w AS title
FROM wr WHERE e2 > s""")
def summary_beats(spark, sf):
    """The beats of each source as rows with a place."""
    return ru.summarize_sources(_windows(spark, sf)).beats.select("source_id", "pos", "start", "end", "title")


def _level(n: int) -> str:
    return f"""l{n} AS (SELECT source_id, {n} AS level, w // 3 AS w, count(*) AS parts, substr(string_agg(syn, ' ' ORDER BY w), 1, 2000) AS syn
  FROM l{n - 1} WHERE source_id IN (SELECT source_id FROM l{n - 1} WHERE w > 0) GROUP BY source_id, w // 3)"""


_LEVELS = 12


@query("summary_levels", _WINS + ", l0 AS (SELECT source_id, 0 AS level, w, 1 AS parts, syn FROM wr), " + ", ".join(map(_level, range(1, _LEVELS)))
       + " UNION ALL ".join(f" SELECT source_id, CAST(level AS INTEGER) AS level, CAST(w AS INTEGER) AS window_no, CAST(parts AS INTEGER) AS parts, syn AS synopsis FROM l{n}" for n in range(_LEVELS)))
def summary_levels(spark, sf):
    """Window synopses reduced three at a time until one is left."""
    return ru.summary_levels(_windows(spark, sf), 3)


@query("merged_cast", """WITH e AS (SELECT c_nationkey AS source_id, c_custkey AS pos, c_mktsegment AS name, 'img' || c_custkey % 4 AS image,
  CASE WHEN c_custkey % 3 = 0 THEN 'desc ' || c_custkey ELSE '' END AS description FROM customer),
i AS (SELECT source_id, name, image, min(pos) AS pos FROM e GROUP BY ALL)
SELECT source_id, name, (SELECT string_agg(image, ',' ORDER BY i.pos) FROM i WHERE i.source_id = e.source_id AND i.name = e.name) AS images,
  coalesce(arg_min(description, pos) FILTER (WHERE description <> ''), '') AS description FROM e GROUP BY source_id, name""")
def merged_cast(spark, sf):
    c = views.table(spark, sf, "customer")
    entries = c.select(
        F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("name"),
        F.array(F.concat(F.lit("img"), F.col("c_custkey") % 4)).alias("images"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("desc "), "c_custkey")).otherwise("").alias("description"))
    return ru.merge_cast(entries).select("source_id", "name", F.array_join("images", ",").alias("images"), "description")


_BEATS = _SRC + """, bt AS (SELECT source_id, CAST(n AS INTEGER) AS beat_no, CAST(n * 200.0 AS DOUBLE) AS bs, CAST(least(duration, n * 200.0 + 200.0) AS DOUBLE) AS be
  FROM v_sources, unnest(range(0, CAST(ceil(duration / 200.0) AS BIGINT))) t(n))
"""


def _beats(spark, sf):
    from ..operators.segments import file_segments, split_ranges

    return split_ranges(file_segments(views.sources(spark, sf)), 200.0).select(
        "source_id", F.col("tile_no").alias("beat_no"), F.col("start").alias("beat_start"), F.col("end").alias("beat_end"))


@query("beat_scenes", _BEATS + "SELECT bt.source_id, beat_no, count(*) AS scenes, max(score) AS best FROM bt JOIN v_clips c ON c.source_id = bt.source_id AND c.source_in < be AND c.source_out > bs GROUP BY ALL")
def beat_scenes(spark, sf):
    c = views.clips(spark, sf).select("source_id", "clip_id", "source_in", "source_out", "score")
    return ru.scenes_of_beats(_beats(spark, sf), c).groupBy("source_id", "beat_no").agg(F.count("*").alias("scenes"), F.max("score").alias("best"))


@query("beat_top_clips", _BEATS + """, r AS (SELECT bt.source_id, beat_no, clip_id, score, source_in, least(source_out, source_in + 40.0) AS source_out,
  row_number() OVER (PARTITION BY bt.source_id, beat_no ORDER BY score DESC, clip_id) AS n
  FROM bt JOIN v_clips c ON c.source_id = bt.source_id AND c.source_in < be AND c.source_out > bs WHERE duration >= 30)
SELECT source_id, beat_no, clip_id, score, source_in, CAST(source_out AS DOUBLE) AS source_out FROM r WHERE n = 1""")
def beat_top_clips(spark, sf):
    c = views.clips(spark, sf).select("source_id", "clip_id", "source_in", "source_out", "score")
    return ru.top_clip_per_beat(_beats(spark, sf), c, 30.0, 40.0)


@query("audio_totals", views.with_views("clips", "sources", "samples") + """, tiles AS (SELECT source_id, n, CAST(n * 195.0 AS DOUBLE) AS s, CAST(least(duration, n * 195.0 + 200.0) AS DOUBLE) AS e
  FROM v_sources, unnest(range(0, CAST(ceil(duration / 195.0) AS BIGINT))) t(n))
SELECT t.source_id, CAST(n AS INTEGER) AS seg_no, count(v.t) AS samples, count(v.t) FILTER (WHERE v.db > 40) AS peaks
FROM tiles t LEFT JOIN v_samples v ON v.source_id = t.source_id AND v.t BETWEEN s AND e GROUP BY ALL""")
def audio_totals(spark, sf):
    """Samples and loud samples (standing in for peaks) inside each tile."""
    from ..operators.segments import interval_segments

    s = views.samples(spark, sf)
    tiles = interval_segments(views.sources(spark, sf), 200.0).withColumnRenamed("tile_no", "seg_no")
    loud = s.filter("db > 40").select("source_id", "t", F.col("db").alias("intensity"))
    return ru.audio_totals(tiles, s, loud)


def _replay(spark, sf, build, name, mode="append"):
    """Run a streaming query over the event table to its end and return what it wrote."""
    from ..plans.session import scratch_path

    src = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select(
        F.col("user_id").alias("source_id"), F.timestamp_micros(views.micros() + 1704067200000000).alias("ts"), F.col("event_type"),
        (F.col("value") / 1000.0).alias("x"), F.floor("value").cast("int").alias("base_interest"), "event_id")
    out = scratch_path(spark, name)
    q = (build(rows).writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


_CLOSED = "(SELECT epoch_us(max(ts)) - 60000000 FROM events)"
_H = 3600 * 1000000


@query("stream_levels", f"""WITH w AS (SELECT user_id AS source_id, epoch_us(ts) // {6 * _H} AS n, avg((value / 1000.0) * (value / 1000.0)) AS power FROM events GROUP BY ALL)
SELECT source_id, CAST(n * 21600 AS BIGINT) AS at, round(10.0 * log10(power), 6) AS db FROM w WHERE (n + 1) * {6 * _H} <= {_CLOSED}""")
def stream_levels(spark, sf):
    from ..streaming.jobs import rms_stream

    out = _replay(spark, sf, lambda r: rms_stream(r, "6 hours", "1 minute"), "levels")
    return out.select("source_id", F.unix_seconds("ts").alias("at"), F.round("db", 6).alias("db"))


@query("stream_windows", f"""WITH e AS (SELECT user_id AS source_id, epoch_us(ts) // {24 * _H} - k AS day, value / 1000.0 AS x FROM events, (VALUES (0), (1)) t(k))
SELECT source_id, CAST(day * 86400 AS BIGINT) AS "from", count(*) AS samples, max(abs(x)) AS peak FROM e WHERE (day + 2) * {24 * _H} <= {_CLOSED} GROUP BY ALL""")
def stream_windows(spark, sf):
    from ..streaming.jobs import sliding_stream

    out = _replay(spark, sf, lambda r: sliding_stream(r, "2 days", "1 day", late="1 minute"), "windows")
    return out.select("source_id", F.unix_seconds("start").alias("from"), "samples", "peak")


@query("stream_sessions", f"""WITH o AS (SELECT user_id AS source_id, epoch_us(ts) AS us, floor(value) AS v, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before >= {4 * _H} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY us) AS run FROM o)
SELECT source_id, CAST(min(us) // 1000000 AS BIGINT) AS "from", count(*) AS merged, CAST(max(v) AS INTEGER) AS base_interest FROM r GROUP BY source_id, run HAVING max(us) + {4 * _H} <= {_CLOSED}""")
def stream_sessions(spark, sf):
    from ..streaming.jobs import session_stream

    out = _replay(spark, sf, lambda r: session_stream(r, "4 hours", "1 minute"), "sessions")
    return out.select("source_id", F.unix_seconds("start").alias("from"), "merged", "base_interest")


@query("stream_dedup", "SELECT DISTINCT user_id * 10 + length(event_type) AS key FROM events")
def stream_dedup(spark, sf):
    from ..streaming.jobs import dedup_stream

    build = lambda r: dedup_stream(r.select((F.col("source_id") * 10 + F.length("event_type")).alias("key"), "ts"), "400 days")
    return _replay(spark, sf, build, "dedup").select("key")


@query("stream_islands", f"""WITH e AS (SELECT user_id AS source_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS e, event_type AS mark, CAST(floor(value) AS INTEGER) AS interest FROM events),
o AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  lag(mark) OVER (PARTITION BY source_id ORDER BY s, e, event_id) AS before FROM e),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {_H} OR mark <> before THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e, event_id) AS run FROM o)
SELECT source_id, min(s) // 1000000 AS "from", max(e) // 1000000 AS "to", count(*) AS merged, max(interest) AS base_interest, min(mark) AS mark FROM r GROUP BY source_id, run""")
def stream_islands(spark, sf):
    """Situations of a stream whose events arrive out of order in several files, with those that are open at its end."""
    from ..plans.session import scratch_path
    from ..streaming.islands import island_stream, open_islands

    e, path = views.table(spark, sf, "events"), scratch_path(spark, "islands")
    us = views.micros() + 1704067200000000
    rows = e.select(
        F.col("user_id").alias("source_id"), "event_id", F.timestamp_micros(us).alias("start"),
        F.timestamp_micros(us + F.floor("value").cast("bigint") * 60000000).alias("end"), F.floor("value").cast("int").alias("base_interest"),
        F.col("event_type").alias("mark"), (F.floor(views.micros() / (10 * 24 * _H)) + F.col("event_id") % 2).alias("part"))
    for n in range(rows.agg(F.max("part")).first()[0] + 1):  # every second event comes ten days late
        rows.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = (island_stream(stream, 3600.0, "25 days").writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    given = spark.read.parquet(f"{path}/out").unionByName(open_islands(spark, f"{path}/state", 3600.0))
    return given.select("source_id", F.unix_seconds("start").alias("from"), F.unix_seconds("end").alias("to"), "merged", "base_interest", "mark")
