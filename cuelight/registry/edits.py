"""Edit documents: validation rules and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_hex_colour  # noqa: F401
from ..operators import edl, layout
from ..plans import views
from . import ORACLES, query

_V = views.with_views("edl_tracks")
_VC = views.with_views("edl_tracks", "edl_clips")


def _range_sql(table: str, track: str) -> str:
    path = f"'{track}[' || pos || ']'"
    return f"""SELECT edl_id, 'error' AS severity, {path} AS path, printf('start %.3fs < 0', "start") AS message FROM {table} WHERE "start" < -1e-3
UNION ALL SELECT edl_id, 'error', {path}, printf('end %.3fs exceeds output.duration %.3fs', "end", total) FROM {table} WHERE "end" - total > 1e-3
UNION ALL SELECT edl_id, 'error', {path}, printf('end <= start (%.3f, %.3f)', "start", "end") FROM {table} WHERE "end" - "start" <= 1e-3"""


@query("edl_head_rules", _V + """ SELECT edl_id, 'error' AS severity, path, message FROM (
SELECT edl_id, 'schema_version' AS path, 'unsupported schema_version 2, expected 1' AS message FROM e_head WHERE schema_version <> 1
UNION ALL SELECT edl_id, 'output.duration', 'must be > 0' FROM e_head WHERE duration <= 0
UNION ALL SELECT edl_id, 'output', 'width/height must be > 0' FROM e_head WHERE width <= 0
UNION ALL SELECT edl_id, 'output.fps', 'must be > 0' FROM e_head WHERE fps <= 0
UNION ALL SELECT edl_id, 'output.watermark.opacity', 'must be in [0.0, 1.0]' FROM e_head WHERE k % 3 = 0 AND k % 15 > 10
UNION ALL SELECT edl_id, 'output.watermark.font_size', 'must be > 0' FROM e_head WHERE k % 3 = 0 AND k % 5 - 1 <= 0
UNION ALL SELECT edl_id, 'output.watermark.text', 'must not be empty' FROM e_head WHERE k % 3 = 0 AND k % 2 = 0) t""")
def edl_head_rules(spark, sf):
    return edl.head_issues(views.edl_tracks(spark, sf).head)


@query("edl_video_ranges", _V + " " + _range_sql("e_video", "video"))
def edl_video_ranges(spark, sf):
    return edl.range_issues(views.edl_tracks(spark, sf).video, "video")


@query("edl_audio_ranges", _V + " " + _range_sql("e_audio", "audio"))
def edl_audio_ranges(spark, sf):
    return edl.range_issues(views.edl_tracks(spark, sf).audio, "audio")


@query("edl_ost_rules", _V + " " + _range_sql("e_ost", "ost") + """
UNION ALL SELECT edl_id, 'error', 'ost[' || pos || '].animate_duration', 'must be in [0.0, 1.0]' FROM e_ost WHERE animate_duration > 1""")
def edl_ost_rules(spark, sf):
    return edl.ost_issues(views.edl_tracks(spark, sf).ost)


_REACH = """, o AS (SELECT *, greatest(0.0, coalesce(max("end") OVER (PARTITION BY edl_id ORDER BY "start", pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS reach,
  lag("end" - "start") OVER (PARTITION BY edl_id ORDER BY "start", pos) AS before,
  row_number() OVER (PARTITION BY edl_id ORDER BY "start", pos) AS nth FROM e_video)
"""


@query("edl_gaps_overlaps", _V + _REACH + """SELECT edl_id, 'error' AS severity, 'video[' || pos || ']' AS path,
  CASE WHEN "start" - reach > 1e-3 THEN printf('gap in video track: %.3fs..%.3fs uncovered', CAST(reach AS DOUBLE), "start")
  ELSE printf('overlaps previous video cue (prev ends at %.3fs, this starts at %.3fs)', CAST(reach AS DOUBLE), "start") END AS message
FROM o WHERE abs("start" - reach) > 1e-3""")
def edl_gaps_overlaps(spark, sf):
    return edl.gap_issues(edl.ordered_video(views.edl_tracks(spark, sf).video))


@query("edl_coverage", _V + """, c AS (SELECT edl_id, total, max("end") AS reach, arg_max(pos, struct_pack(s := "start", p := pos)) AS pos FROM e_video GROUP BY ALL)
SELECT edl_id, 'error' AS severity, 'video[' || pos || ']' AS path,
  printf('video track ends at %.3fs but output.duration is %.3fs', reach, total) AS message FROM c WHERE abs(reach - total) > 1e-3""")
def edl_coverage(spark, sf):
    return edl.coverage_issues(views.edl_tracks(spark, sf).video)


@query("edl_transitions", _V + _REACH + """, f AS (SELECT *, least("end" - "start", before) / 2 AS most FROM o WHERE transition_in = 'crossfade')
SELECT edl_id, 'error' AS severity, 'video[' || pos || '].transition_duration' AS path, 'must be > 0 when transition_in=''crossfade''' AS message FROM f WHERE transition_duration <= 0
UNION ALL SELECT edl_id, 'warning', 'video[' || pos || '].transition_in', 'first cue has crossfade; will fade in from black' FROM f WHERE transition_duration > 0 AND nth = 1
UNION ALL SELECT edl_id, 'error', 'video[' || pos || '].transition_duration', printf('%.3fs exceeds half the shorter neighbor cue (%.3fs)', CAST(transition_duration AS DOUBLE), CAST(most AS DOUBLE))
FROM f WHERE transition_duration > 0 AND nth > 1 AND transition_duration - most > 1e-3""")
def edl_transitions(spark, sf):
    return edl.transition_issues(edl.ordered_video(views.edl_tracks(spark, sf).video))


@query("edl_effects", _V + """ SELECT edl_id, 'error' AS severity, 'video[' || pos || '].effect_params.speed' AS path,
  'slow_mo speed must be in [0.05, 1.0]; got ' || CAST(speed AS VARCHAR) AS message FROM e_video WHERE effect = 'slow_mo' AND (speed < 0.05 OR speed > 1.0)
UNION ALL SELECT edl_id, 'error', 'video[' || pos || '].effect_params', 'zoom_from/zoom_to must be > 0' FROM e_video WHERE effect LIKE 'ken_burns%' AND zoom_from <= 0""")
def edl_effects(spark, sf):
    return edl.effect_issues(views.edl_tracks(spark, sf).video)


@query("edl_annotations", _V + " " + _range_sql("e_annotations", "annotations") + """
UNION ALL SELECT edl_id, 'error', 'annotations[' || pos || '].x', x || ' outside [0, 1080]' FROM e_annotations WHERE x > 1080
UNION ALL SELECT edl_id, 'error', 'annotations[' || pos || '].y', y || ' outside [0, 1920]' FROM e_annotations WHERE y > 1920
UNION ALL SELECT edl_id, 'error', 'annotations[' || pos || '].radius', 'circle annotation requires radius > 0' FROM e_annotations WHERE shape = 'circle' AND radius <= 0
UNION ALL SELECT edl_id, 'error', 'annotations[' || pos || ']', 'box annotation requires width > 0 and height > 0' FROM e_annotations WHERE shape = 'box' AND (width <= 0 OR height <= 0)
UNION ALL SELECT edl_id, 'error', 'annotations[' || pos || '].width', 'arrow annotation requires width > 0 (length in pixels)' FROM e_annotations WHERE shape = 'arrow' AND width <= 0""")
def edl_annotations(spark, sf):
    return edl.annotation_issues(views.edl_tracks(spark, sf).annotations)


_VOICE = """SELECT h.edl_id, CASE WHEN voiced THEN 'warning' ELSE 'error' END AS severity, 'voiceover' AS path,
  CASE WHEN voiced THEN 'voiceover defined but no audio cue uses it' ELSE 'audio track references voiceover but edl.voiceover is unset' END AS message
FROM e_head h LEFT JOIN (SELECT DISTINCT edl_id, TRUE AS used FROM e_audio WHERE kind = 'voiceover') u USING (edl_id)
WHERE voiced <> coalesce(used, FALSE)"""


@query("edl_voiceover", _V + " " + _VOICE)
def edl_voiceover(spark, sf):
    t = views.edl_tracks(spark, sf)
    return edl.voiceover_issues(t.head, t.audio)


@query("edl_captions", _V + """ SELECT edl_id, 'error' AS severity, path, message FROM (
SELECT edl_id, k, 'captions' AS path, 'captions require a voiceover to derive timing from, or explicit cues' AS message FROM e_head WHERE NOT voiced
UNION ALL SELECT edl_id, k, 'captions.max_words', 'must be > 0' FROM e_head WHERE k % 7 = 0
UNION ALL SELECT edl_id, k, 'captions.max_chars', 'must be > 0' FROM e_head WHERE k % 9 = 0
UNION ALL SELECT edl_id, k, 'captions.min_chunk_duration', 'must be >= 0' FROM e_head WHERE k % 6 = 0
UNION ALL SELECT edl_id, k, 'captions.font_size', 'must be > 0' FROM e_head WHERE k % 5 = 0
UNION ALL SELECT edl_id, k, 'captions.highlight_color', 'must be a hex color like ''#FFD600''; got ''yellow''' FROM e_head WHERE k % 3 = 0 AND k % 6 = 0
UNION ALL SELECT edl_id, k, 'captions.animate_overshoot', 'must be >= 0' FROM e_head WHERE k % 8 = 0
UNION ALL SELECT edl_id, k, 'captions.animate_duration', 'must be in [0.0, 1.0]' FROM e_head WHERE k % 10 > 8
UNION ALL SELECT edl_id, k, 'captions.fade_ms', 'must be >= 0' FROM e_head WHERE k % 14 = 0
UNION ALL SELECT edl_id, k, 'captions.active_word_bg', 'must be a hex color like ''#FFD600''; got ''#12345''' FROM e_head WHERE k % 8 = 0
UNION ALL SELECT edl_id, k, 'captions.active_word_bg_radius', 'must be >= 0' FROM e_head WHERE k % 12 = 0
UNION ALL SELECT edl_id, k, 'captions.active_word_scale', 'must be >= 1.0 (the active word scales up, not down)' FROM e_head WHERE k % 10 = 0) t WHERE k % 2 = 0""")
def edl_captions(spark, sf):
    return edl.caption_issues(views.edl_tracks(spark, sf).head)


@query("edl_caption_cues", _V + " " + _range_sql("e_caption_cues", "captions.cues") + """
UNION ALL SELECT edl_id, 'error', 'captions.cues[' || pos || '].text', 'must not be empty' FROM e_caption_cues WHERE trim(text) = ''""")
def edl_caption_cues(spark, sf):
    return edl.caption_cue_issues(views.edl_tracks(spark, sf).caption_cues)


@query("edl_music", _V + " SELECT edl_id, 'warning' AS severity, 'music.duck' AS path, 'duck=true requires a voiceover to duck under; will be ignored' AS message FROM e_head WHERE k % 6 = 0 AND k % 4 = 0")
def edl_music(spark, sf):
    return edl.music_issues(views.edl_tracks(spark, sf).head)


_FOOTAGE = """SELECT edl_id, 'error' AS severity, 'video[' || pos || '].clip_id' AS path, 'clip_id=' || clip_id || ' not found in catalog' AS message
FROM e_video v WHERE NOT EXISTS (SELECT 1 FROM v_edl_clips c WHERE c.clip_id = v.clip_id)
UNION ALL SELECT edl_id, 'error', 'video[' || pos || ']', printf('cue duration %.3fs exceeds available clip footage (%.3fs from source_in=%.3f)',
  v."end" - v."start", c.duration - (coalesce(v.source_in, c.source_in) - c.source_in), coalesce(v.source_in, c.source_in))
FROM e_video v JOIN v_edl_clips c USING (clip_id) WHERE v."end" - v."start" - (c.duration - (coalesce(v.source_in, c.source_in) - c.source_in)) > 1e-3"""


@query("edl_footage", _VC + " " + _FOOTAGE)
def edl_footage(spark, sf):
    return edl.clip_issues(views.edl_tracks(spark, sf).video, views.edl_clips(spark, sf))


_RULES = ["edl_head_rules", "edl_video_ranges", "edl_audio_ranges", "edl_ost_rules", "edl_gaps_overlaps", "edl_coverage",
          "edl_transitions", "edl_effects", "edl_annotations", "edl_voiceover", "edl_captions", "edl_caption_cues",
          "edl_music", "edl_footage"]
_ALL_RULES = "SELECT severity, message, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT severity, message FROM ({ORACLES[r]}) AS {r}" for r in _RULES) + ") t GROUP BY severity, message"


@query("edl_all_rules", _ALL_RULES)
def edl_all_rules(spark, sf):
    issues = edl.validate(views.edl_tracks(spark, sf, aside=True), views.edl_clips(spark, sf))
    return issues.groupBy("severity", "message").agg(F.count("*").alias("n"))


@query("edl_verdicts", _V + " , bad AS (" + _VOICE + """), w AS (SELECT edl_id, count(*) FILTER (WHERE severity = 'error') AS errors FROM bad GROUP BY edl_id)
SELECT edl_id, coalesce(errors, 0) = 0 AS ok FROM e_head LEFT JOIN w USING (edl_id)""")
def edl_verdicts(spark, sf):
    t = views.edl_tracks(spark, sf)
    return edl.verdicts(t.head, edl.voiceover_issues(t.head, t.audio))


@query("edl_full_verdicts", _VC + " , bad AS (" + " UNION ALL ".join(f"SELECT edl_id, severity FROM ({ORACLES[r]}) AS {r}" for r in _RULES) + """),
w AS (SELECT edl_id, count(*) FILTER (WHERE severity = 'error') AS errors FROM bad GROUP BY edl_id)
SELECT edl_id, coalesce(errors, 0) = 0 AS ok FROM e_head LEFT JOIN w USING (edl_id)""")
def edl_full_verdicts(spark, sf):
    """The verdict of each document over every rule."""
    t = views.edl_tracks(spark, sf, aside=True)
    return edl.verdicts(t.head, edl.validate(t, views.edl_clips(spark, sf)))


_CUES = views.with_views("edl_cues")


def _texts(spark, sf, offset=False):
    """``edl_id, cues, total, n``: the video cues of each order as JSON text, where they end, and how many there are."""
    cue = ["start", "end", "clip_id", "transition_in", *(["reframe_offset"] if offset else [])]
    rows = views.edl_cues(spark, sf).withColumn("reframe_offset", (F.col("end") - F.col("start")).cast("int"))
    each = F.array_sort(F.collect_list(F.struct("pos", F.struct(*cue).alias("cue"))))
    return rows.groupBy("edl_id").agg(F.to_json(F.transform(each, lambda c: c["cue"])).alias("cues"), F.max("end").alias("total"), F.count("*").alias("n"))


@query("edl_documents", _CUES + """ SELECT edl_id, CASE edl_id % 4 WHEN 0 THEN 'bad value: video.effect' WHEN 1 THEN 'unknown key: music.volume' WHEN 2 THEN 'missing field: video[].clip_id'
  ELSE '1080/' || transition_in || '/' || clip_id END AS outcome FROM v_edl_cues WHERE pos = 0""")
def edl_documents(spark, sf):
    """Edit documents of all orders as JSON text: defaults filled, bad ones in quarantine."""
    from ..sources.files import parse_edls

    k = F.col("edl_id") % 4
    cues = F.when(k == 2, F.regexp_replace("cues", r',"clip_id":\d+', "")).when(k == 0, F.regexp_replace("cues", r'^\[\{', '[{"effect":"melt",')).otherwise(F.col("cues"))
    music = F.when(k == 1, ',"music":{"file":"a.mp3","volume":3}').otherwise("")
    text = F.concat(F.lit('{"title":"t","output":{"duration":'), F.col("total").cast("string"), F.lit('},"video":'), cues, music, F.lit("}"))
    good, bad = parse_edls(_texts(spark, sf).select("edl_id", text.alias("text")), aside=True)
    first = F.col("video")[0]
    shown = F.concat_ws("/", F.col("output.width").cast("string"), first["transition_in"], first["clip_id"].cast("string"))
    return good.select("edl_id", shown.alias("outcome")).unionByName(
        bad.select("edl_id", F.array_join(F.array_distinct("problems"), ";").alias("outcome")))


@query("edl_wrong_types", """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'wrong type: output.width' WHEN 1 THEN 'wrong type: output.fps' WHEN 2 THEN 'wrong type: audio'
  WHEN 3 THEN 'wrong type: video[].effect_params' WHEN 4 THEN 'wrong type: video[].effect_params{}' WHEN 5 THEN 'wrong type: music.duck' WHEN 6 THEN 'wrong type: title'
  WHEN 7 THEN '1080/true/' || (o_orderkey % 50 + 1) WHEN 8 THEN 'wrong type: output.watermark' WHEN 9 THEN 'wrong type: video[].reframe' WHEN 10 THEN 'wrong type: ost[]'
  ELSE '720/false/' || (o_orderkey % 50 + 1) END AS outcome FROM orders""")
def edl_wrong_types(spark, sf):
    """Values of a wrong type send a document to quarantine; numbers given as texts and whole floats are read."""
    from ..sources.files import parse_edls

    o = views.table(spark, sf, "orders")
    key = F.col("o_orderkey")

    def part(plain, **cases):
        text = F.lit(plain)
        for k, value in cases.items():
            text = F.when(key % 12 == int(k[1:]), value).otherwise(text)
        return text

    text = F.concat(
        F.lit('{"title":'), part('"t"', k6="5"),
        part("", k2=',"audio":"nope"', k7=',"captions":null', k10=',"ost":[3]'),
        F.lit(',"output":{"duration":9'), part("", k0=',"width":"abc"', k1=',"fps":30.5', k7=',"width":1080.0', k8=',"watermark":"x"', k11=',"width":" 720 "'),
        F.lit('},"music":{"file":"a.mp3"'), part("", k5=',"duck":"maybe"', k11=',"duck":"No"'),
        F.lit('},"video":[{"start":0,"clip_id":3,"end":"'), (key % 50 + 1).cast("string"),
        part('"}]}', k3='","effect_params":"oops"}]}', k4='","effect_params":{"a":"x","b":1}}]}', k9='","reframe":null}]}', k11='","source_in":null}]}'),
    )
    good, bad = parse_edls(o.select("o_orderkey", text.alias("text")), aside=True)
    shown = F.concat_ws("/", "output.width", "music.duck", F.col("video")[0]["end"].cast("bigint"))
    return good.select("o_orderkey", shown.alias("outcome")).unionByName(
        bad.select("o_orderkey", F.array_join("problems", ";").alias("outcome")))


@query("edl_tracks_exploded", _CUES + ' SELECT edl_id, pos, "start", "end", clip_id, max("end") OVER (PARTITION BY edl_id) AS total FROM v_edl_cues')
def edl_tracks_exploded(spark, sf):
    """The cues of all orders as documents, parsed and taken apart again."""
    from ..sources.files import parse_edls

    text = F.concat(F.lit('{"title":"t","output":{"duration":'), F.col("total").cast("string"), F.lit('},"video":'), "cues", F.lit("}"))
    good, _ = parse_edls(_texts(spark, sf).select("edl_id", text.alias("text")))
    return edl.explode_edls(good).video.select("edl_id", "pos", "start", "end", "clip_id", "total")


@query("footage_consumed", _V + """ SELECT edl_id, pos, round(CASE effect WHEN 'freeze_first' THEN greatest(CAST(2.0 AS DOUBLE) / 30, CAST(0.05 AS DOUBLE))
  WHEN 'slow_mo' THEN greatest(("end" - "start") * greatest(CAST(0.05 AS DOUBLE), least(CAST(1.0 AS DOUBLE), speed)), CAST(1.0 AS DOUBLE) / 30) ELSE "end" - "start" END, 6) AS consumed FROM e_video""")
def footage_consumed(spark, sf):
    v = views.edl_tracks(spark, sf).video
    used = layout.footage_consumed(F.col("effect"), F.col("end") - F.col("start"), F.try_element_at("effect_params", F.lit("speed")), F.lit(30.0))
    return v.select("edl_id", "pos", F.round(used, 6).alias("consumed"))


@query("join_offsets", _V + """, s AS (SELECT edl_id, pos, "end" - "start" AS len, CASE WHEN transition_in = 'crossfade' AND transition_duration > 0 AND pos > 0 THEN CAST(transition_duration AS DOUBLE) ELSE 0.0 END AS d FROM e_video)
SELECT edl_id, pos, round(greatest(0.0, coalesce(sum(len - d) OVER (PARTITION BY edl_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) - d), 6) AS "offset" FROM s""")
def join_offsets(spark, sf):
    v = views.edl_tracks(spark, sf).video.withColumn("length", F.col("end") - F.col("start"))
    return layout.join_offsets(v).select("edl_id", "pos", F.round("offset", 6).alias("offset"))


@query("clip_audio", _V + """, m AS (SELECT a.edl_id, a.pos AS audio_pos, a."start" AS s, a."end" AS e, a.level_db, v.pos AS video_pos, v."start" AS cs, v."end" AS ce,
  row_number() OVER (PARTITION BY a.edl_id, a.pos ORDER BY v.pos) AS n
  FROM e_audio a JOIN e_video v ON a.edl_id = v.edl_id AND v."start" <= a."start" AND a."start" < v."end")
SELECT edl_id, audio_pos, video_pos, greatest(0.0, s - cs) AS segment_offset, greatest(s, cs) AS timeline_offset,
  least(e, ce) - greatest(s, cs) AS length, coalesce(level_db, -18.0) AS level_db FROM m WHERE n = 1 AND least(e, ce) - greatest(s, cs) > 0""")
def clip_audio(spark, sf):
    t = views.edl_tracks(spark, sf)
    return layout.place_clip_audio(t.audio, t.video)


@query("resolved_cues", _VC + """ SELECT edl_id, pos, file, clip_local_id, coalesce(v.source_in, c.source_in, 0.0) AS source_in FROM e_video v JOIN v_edl_clips c USING (clip_id)""")
def resolved_cues(spark, sf):
    out = layout.resolve_cues(views.edl_tracks(spark, sf).video, views.edl_clips(spark, sf))
    return out.select("edl_id", "pos", "file", "clip_local_id", "source_in")


@query("dangling_cues", _VC + " SELECT edl_id, pos, clip_id FROM e_video WHERE clip_id NOT IN (SELECT clip_id FROM v_edl_clips)")
def dangling_cues(spark, sf):
    return layout.dangling_cues(views.edl_tracks(spark, sf).video, views.edl_clips(spark, sf)).select("edl_id", "pos", "clip_id")


@query("music_files", views.with_views("edl_clips") + """ SELECT o_orderkey AS edl_id, CASE WHEN o_orderkey % 2 = 0 THEN c.file ELSE '/m/a.mp3' END AS path,
  (o_orderkey % 2 = 0 AND c.file IS NULL) AS unresolved FROM orders LEFT JOIN v_edl_clips c ON c.clip_id = o_custkey""")
def music_files(spark, sf):
    o = views.table(spark, sf, "orders")
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("catalog:"), "o_custkey")).otherwise("/m/a.mp3")
    found, missing = layout.resolve_music(o.select(F.col("o_orderkey").alias("edl_id"), ref.alias("file")), views.edl_clips(spark, sf))
    return found.select("edl_id", "path", F.lit(False).alias("unresolved")).unionByName(
        missing.select("edl_id", F.lit(None).cast("string").alias("path"), F.lit(True).alias("unresolved")))


def _chosen(spark, sf):
    v = views.edl_tracks(spark, sf).video
    return v.groupBy("edl_id").agg(F.max("pos").alias("pos"))


_CHOSEN = ', ch AS (SELECT edl_id, max(pos) AS pos FROM e_video GROUP BY edl_id), w AS (SELECT v.edl_id, v."start" AS f, v."end" AS t FROM e_video v JOIN ch USING (edl_id, pos))'


@query("single_cue_video", _V + _CHOSEN + """ SELECT edl_id, CAST(0.0 AS DOUBLE) AS "start", t - f AS "end", 'cut' AS transition_in FROM w""")
def single_cue_video(spark, sf):
    return layout.only_cue(views.edl_tracks(spark, sf).video, _chosen(spark, sf)).select("edl_id", "start", "end", "transition_in")


@query("single_cue_siblings", _V + _CHOSEN + """ SELECT a.edl_id, a.pos, greatest(0.0, a."start" - f) AS "start", least(t - f, a."end" - f) AS "end" FROM e_ost a JOIN w USING (edl_id)
WHERE a."end" > f AND a."start" < t AND least(t - f, a."end" - f) - greatest(0.0, a."start" - f) > 1e-3""")
def single_cue_siblings(spark, sf):
    t = views.edl_tracks(spark, sf)
    return layout.cues_within(t.ost, t.video, _chosen(spark, sf)).select("edl_id", "pos", "start", "end")


@query("rescaled_documents", _CUES + """, n AS (SELECT edl_id, count(*) AS n FROM v_edl_cues GROUP BY edl_id)
SELECT edl_id, pos, CAST(720 AS INTEGER) AS width, CAST(1280 AS INTEGER) AS height,
  CAST(round_even(CAST(floor("end" - "start") AS INTEGER) * CAST(720 AS DOUBLE) / 1080, 0) AS INTEGER) AS reframe_offset,
  CAST(greatest(1, round_even((n + 4) * CAST(720 AS DOUBLE) / 1080, 0)) AS INTEGER) AS stroke_width FROM v_edl_cues JOIN n USING (edl_id)""")
def rescaled_documents(spark, sf):
    """Documents of all orders, with offsets and strokes from their lines, in another size."""
    from ..sources.files import parse_edls

    text = F.concat(F.lit('{"title":"t","output":{"duration":'), F.col("total").cast("string"), F.lit('},"video":'), "cues",
                    F.lit(',"annotations":[{"start":0,"end":1,"shape":"box","x":1,"y":2,"stroke_width":'), (F.col("n") + 4).cast("string"), F.lit("}]}"))
    good, _ = parse_edls(_texts(spark, sf, True).select("edl_id", text.alias("text")))
    out = layout.rescale_to(good, "720p")
    return out.select("edl_id", "output.width", "output.height", F.col("annotations")[0]["stroke_width"].alias("stroke_width"),
                      F.posexplode(F.transform("video", lambda v: v["reframe_offset"])).alias("pos", "reframe_offset"))


@query("caption_offsets", _V + """, f AS (SELECT edl_id, arg_min("start", pos) AS s FROM e_audio WHERE kind = 'voiceover' GROUP BY edl_id)
SELECT edl_id, pos, CASE WHEN TRUE THEN p."start" + coalesce(s, 0.0) END AS "start" FROM e_ost p LEFT JOIN f USING (edl_id)""")
def caption_offsets(spark, sf):
    t = views.edl_tracks(spark, sf)
    offsets = layout.caption_offset(t.audio, t.head)
    return layout.shift_captions(t.ost, offsets).select("edl_id", "pos", "start")
