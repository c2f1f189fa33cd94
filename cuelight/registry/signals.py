"""Loudness series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import blend_score
from ..operators import events as ev
from ..operators import signal as sig
from ..plans import views
from . import query

_S = views.with_views("samples")
_B = views.with_views("clips", "samples")


def _spans(spark, sf):
    return views.clips(spark, sf).select("clip_id", "source_id", F.col("source_in").alias("start"), F.col("source_out").alias("end"))


_THRESHOLD = """, th AS (
  SELECT source_id, db AS threshold FROM (
    SELECT source_id, db, row_number() OVER (PARTITION BY source_id ORDER BY db) AS n, count(*) OVER (PARTITION BY source_id) AS total FROM v_samples)
  WHERE n = CAST(floor(CAST(0.85 AS DOUBLE) * (total - 1)) AS BIGINT) + 1)"""
_MAXIMA = _THRESHOLD + """, lv AS (SELECT source_id, min(db) AS lo, max(db) AS hi FROM v_samples GROUP BY source_id),
nb AS (SELECT *, lag(db) OVER (PARTITION BY source_id ORDER BY t) AS p, lead(db) OVER (PARTITION BY source_id ORDER BY t) AS f FROM v_samples),
mx AS (SELECT source_id, t, (db - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS intensity
  FROM nb JOIN th USING (source_id) JOIN lv USING (source_id)
  WHERE db >= threshold AND db >= coalesce(p, db) AND db >= coalesce(f, db))"""


@query("level_quantile", _S + _THRESHOLD + " SELECT * FROM th")
def level_quantile(spark, sf):
    return sig.index_quantile(views.samples(spark, sf), 0.85)


@query("local_maxima", _S + _MAXIMA + " SELECT source_id, round(t, 6) AS t, round(intensity, 6) AS intensity FROM mx")
def local_maxima(spark, sf):
    m = sig.local_maxima(views.samples(spark, sf))
    return m.select("source_id", F.round("t", 6).alias("t"), F.round("intensity", 6).alias("intensity"))


@query("loudness_peaks", "WITH RECURSIVE " + views.SQL["samples"] + _MAXIMA + """,
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY intensity DESC, t) AS n FROM mx),
walk AS (
  SELECT source_id, n, t, intensity, TRUE AS keep, [t] AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT source_id, n, t, intensity, fits, CASE WHEN fits THEN list_append(kept, t) ELSE kept END FROM (
    SELECT o.source_id, o.n, o.t, o.intensity, w.kept, len(list_filter(w.kept, lambda x: abs(x - o.t) < 60.0)) = 0 AS fits
    FROM walk w JOIN o ON o.source_id = w.source_id AND o.n = w.n + 1) s)
SELECT source_id, round(t, 6) AS t, round(intensity, 6) AS intensity FROM walk WHERE keep""")
def loudness_peaks(spark, sf):
    p = sig.detect_peaks(views.samples(spark, sf), min_gap=60.0)
    return p.select("source_id", F.round("t", 6).alias("t"), F.round("intensity", 6).alias("intensity"))


@query("audio_factor", _B + """, lv AS (SELECT source_id, min(db) AS lo, max(db) AS hi FROM v_samples GROUP BY source_id),
pk AS (SELECT clip_id, c.source_id, max(db) AS peak FROM v_clips c LEFT JOIN v_samples s
  ON s.source_id = c.source_id AND s.t BETWEEN c.source_in AND c.source_out GROUP BY ALL)
SELECT clip_id, coalesce(round_even((peak - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 100.0, 2), 0.0) AS audio_factor,
  round_even(peak, 2) AS peak_db FROM pk LEFT JOIN lv USING (source_id)""")
def audio_factor(spark, sf):
    return sig.score_audio(_spans(spark, sf), views.samples(spark, sf), "clip_id").select("clip_id", "audio_factor", "peak_db")


@query("samples_in_ranges", _B + """ SELECT clip_id, count(*) AS n, round(max(s.t), 6) AS last_t FROM v_clips c JOIN v_samples s
  ON s.source_id = c.source_id AND s.t BETWEEN c.source_in AND c.source_out GROUP BY clip_id""")
def samples_in_ranges(spark, sf):
    s = sig.samples_in_ranges(_spans(spark, sf), views.samples(spark, sf))
    return s.groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.max("t"), 6).alias("last_t"))


@query("rms_levels", views.with_views("amplitudes") + """ SELECT source_id, CAST(floor(t / 40.0) AS BIGINT) AS hop_no,
  round(20.0 * log10(sqrt(avg(x * x))), 6) AS db FROM v_amplitudes GROUP BY ALL""")
def rms_levels(spark, sf):
    return sig.rms_levels(views.amplitudes(spark, sf), 40.0).select("source_id", "hop_no", F.round("db", 6).alias("db"))


@query("window_peaks", views.with_views("clips", "amplitudes") + """, pk AS (
  SELECT clip_id, c.source_id, least(c.duration, 30.0) AS len, max(20.0 * log10(abs(x))) AS peak
  FROM v_clips c LEFT JOIN v_amplitudes a ON a.source_id = c.source_id AND x <> 0
    AND a.t BETWEEN c.source_in AND c.source_in + least(c.duration, 30.0) GROUP BY ALL)
SELECT clip_id, CAST(len AS DOUBLE) AS probe_seconds, round_even(peak, 1) AS peak_db,
  round_even(-1.0 - round_even(peak, 1), 1) AS level_db FROM pk""")
def window_peaks(spark, sf):
    out = sig.window_peaks(_spans(spark, sf), views.amplitudes(spark, sf), "clip_id", 30.0, -1.0)
    return out.select("clip_id", "probe_seconds", "peak_db", "level_db")


@query("blended_score", views.with_views("clips") + """ SELECT clip_id,
  CAST(round_even(CAST(0.7 AS DOUBLE) * least(100, greatest(0, score)) + CAST(0.3 AS DOUBLE) * least(100.0, greatest(0.0, duration * 2)), 0) AS INTEGER) AS blended FROM v_clips""")
def blended_score(spark, sf):
    return views.clips(spark, sf).select("clip_id", blend_score(F.col("score"), F.col("duration") * 2).alias("blended"))


@query("built_clips", views.with_views("clips", "sources", "samples") + """, lv AS (
  SELECT source_id, min(db) AS lo, max(db) AS hi FROM v_samples GROUP BY source_id),
n AS (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY source_in, source_out, clip_id) AS no FROM v_clips c),
i AS (SELECT clip_id, source_id, no, score, greatest(0.0, least(source_in, 900.0)) AS s, greatest(0.0, least(source_out, 900.0)) AS e FROM n),
pk AS (SELECT clip_id, i.source_id, no, score, s, e, max(db) AS peak FROM i LEFT JOIN v_samples a
  ON a.source_id = i.source_id AND a.t BETWEEN s AND e WHERE e > s GROUP BY ALL),
f AS (SELECT *, coalesce(round_even((peak - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 100.0, 2), 0.0) AS af FROM pk LEFT JOIN lv USING (source_id))
SELECT source_id, 'clip_' || CASE WHEN no < 10 THEN '0' ELSE '' END || no AS clip_local_id, clip_id AS event_id,
  CAST(s AS DOUBLE) AS source_in, CAST(e AS DOUBLE) AS source_out,
  CAST(round_even(CAST(0.7 AS DOUBLE) * score + CAST(0.3 AS DOUBLE) * af, 0) AS INTEGER) AS score, round_even(peak, 2) AS peak_loudness_db FROM f""")
def built_clips(spark, sf):
    c = views.clips(spark, sf)
    e = c.select("source_id", F.col("clip_id").alias("event_id"), F.col("source_in").alias("start"),
                 F.col("source_out").alias("end"), F.col("score").alias("base_interest"), F.lit(900.0).alias("duration"))
    return ev.build_clips(e, views.samples(spark, sf)).select(
        "source_id", "clip_local_id", "event_id", "source_in", "source_out", "score", "peak_loudness_db"
    )


@query("loudness_log", _S + " SELECT source_id, round(t, 6) AS t, db FROM v_samples WHERE NOT (CAST(floor(t) AS BIGINT) % 5 = 1)")
def loudness_log(spark, sf):
    """Level-meter logs rebuilt from the samples, with unreadable levels, read back.
    One log holds one source's day, as a meter writes one file per recording."""
    from ..sources.files import parse_loudness_log

    s = views.samples(spark, sf)
    level = F.when(F.floor("t").cast("bigint") % 5 == 1, "n/a").otherwise(F.col("db").cast("string"))
    entry = F.concat(
        F.lit("[meter @ 0x1] frame:1 pts:2 pts_time:"), F.round("t", 6).cast("decimal(20,6)").cast("string"),
        F.lit("\nlavfi.astats.Overall.RMS_level="), level,
    )
    day = F.floor(F.col("t") / 48)
    logs = s.withColumns({"entry": entry, "day": day}).groupBy("source_id", "day").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "entry"))), lambda x: x["entry"]), "\n").alias("text")
    ).select("source_id", F.concat_ws("/", "source_id", "day").alias("path"), "text")
    return parse_loudness_log(logs.drop("source_id")).select(
        F.split("path", "/")[0].cast("bigint").alias("source_id"), "t", "db"
    )
