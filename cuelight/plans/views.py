"""Deterministic timeline views over the TPC-H-like driver tables.

Each view exists twice: as a DataFrame and as DuckDB text (``SQL``), so that a
query and its check read the same rows. Time is compressed (1800 s of the event
stream are one timeline second), because clips would hardly ever overlap
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.catalog import Catalog
from ..operators.edl import Tracks
from .session import written

COMPRESSION = 1800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> Column:
    """Microseconds since 2024-01-01, independent of the session time zone."""
    return F.expr(
        "datediff(ts, DATE'2024-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
        " + cast(extract(SECOND FROM ts) * 1000000 AS bigint)"
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.floor(micros() / F.lit(1e6 * COMPRESSION)).cast("double")
    length = (F.col("event_id") % 56 + 5).cast("double")
    return e.select(
        F.col("event_id").alias("clip_id"), F.col("user_id").alias("source_id"),
        start.alias("source_in"), (start + length).alias("source_out"), length.alias("duration"),
        (F.floor("value").cast("bigint") % 101).cast("int").alias("score"),
        F.col("event_type").alias("category"), F.col("props").alias("game_signals"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter("value > 0").select(
        F.col("user_id").alias("source_id"), (micros() / F.lit(1e6 * COMPRESSION)).alias("t"),
        F.round(20.0 * F.log10("value"), 6).alias("db"),
    )


def amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample values as amplitudes in 0..1."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("source_id"), (micros() / F.lit(1e6 * COMPRESSION)).alias("t"),
        (F.col("value") / 1000.0).alias("x"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per user; its length is the end of its last clip."""
    return clips(spark, sf_dir).groupBy("source_id").agg(F.max("source_out").alias("duration"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 5.0
    return c.select(
        F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("cue_no"), start.alias("start"),
        (start + 4.0).alias("end"), "text",
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance_id"), "text")


def edl_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the video cues of an edit: 25 s apart, as long as their quantity."""
    from ..plans.scan import number, ordered_scan

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("edl_id"), "l_linenumber", F.col("l_partkey").alias("clip_id"), "l_suppkey",
        "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_discount", "l_tax",
    )
    order = ["l_linenumber", "clip_id", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    placed = ordered_scan(rows, ["edl_id"], order, [number("_n")])
    start = (F.col("_n") - 1) * 25.0
    fade = F.col("l_returnflag") == "R"
    return placed.select(
        "edl_id", (F.col("_n") - 1).cast("int").alias("pos"), start.alias("start"),
        (start + F.col("l_quantity")).alias("end"), "clip_id",
        F.when(fade, "crossfade").otherwise("cut").alias("transition_in"),
        F.when(fade, F.round(F.col("l_discount") * 100, 0)).otherwise(0.0).alias("transition_duration"),
        F.when(F.col("l_returnflag") == "A", "slow_mo").when(F.col("l_returnflag") == "N", "ken_burns_in")
        .otherwise("freeze_first").alias("effect"),
        F.create_map(F.lit("speed"), F.round(F.col("l_tax") * 20, 2), F.lit("zoom_from"),
                     F.round(F.col("l_discount") - 0.02, 2)).alias("effect_params"),
        "l_suppkey",
    )


def edl_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output length of each edit, from its order's price."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("edl_id"), (F.floor("o_totalprice") % 200).cast("double").alias("total"),
                    "o_orderstatus", "o_orderpriority", "o_custkey")


def edl_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog clips; parts of size 7 are missing from the catalog."""
    p = table(spark, sf_dir, "part")
    return p.filter("p_size <> 7").select(
        F.col("p_partkey").alias("clip_id"), F.concat(F.lit("/clips/"), F.col("p_name"), F.lit(".mp4")).alias("file"),
        F.concat(F.lit("clip_"), F.col("p_partkey")).alias("clip_local_id"),
        F.col("p_size").cast("double").alias("duration"), (F.col("p_partkey") % 10).cast("double").alias("source_in"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The event stream as a catalog: one source per user, two extracts each."""
    c = clips(spark, sf_dir)
    key = (F.col("source_id") * 2 + F.col("clip_id") % 2).alias("extract_id")
    src = sources(spark, sf_dir)
    source_rows = src.select(
        "source_id", F.concat(F.lit("/media/u"), "source_id", F.lit(".mp4")).alias("file_path"),
        F.concat(F.lit("fp-"), "source_id").alias("fingerprint"), "duration", F.lit("1920x1080").alias("resolution"),
        F.lit(60.0).alias("fps"), F.lit(1).alias("has_audio"),
    )
    odd = F.col("extract_id") % 2 == 1
    extract_rows = src.select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half")).select(
        (F.col("source_id") * 2 + F.col("_half")).alias("extract_id"), "source_id"
    ).select(
        "extract_id", "source_id", F.when(odd, "interval").otherwise("auto").alias("segmenter"),
        F.lit("frames").alias("analyzer"),
        F.when(F.col("source_id") % 3 == 0, "gta").when(F.col("source_id") % 3 == 1, "movie").otherwise("vlog").alias("game_profile"),
        F.array(F.lit("view"), F.lit("click"), F.lit("purchase")).alias("taxonomy"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("source_id") % 28 + 1).cast("string"), 2, "0"),
                 F.lit("T00:00:0"), (F.col("extract_id") % 2).cast("string"), F.lit("+00:00")).alias("created_at"),
        F.concat(F.lit("/catalog/u"), "source_id", F.when(odd, "/b").otherwise("/a"), F.lit("/manifest.json")).alias("manifest_path"),
    )
    none = F.array().cast("array<string>")
    clip_rows = c.select(
        "clip_id", key, "source_id", F.concat(F.lit("clip_"), F.col("clip_id")).alias("clip_local_id"),
        F.lit("../media/source.mp4").alias("file"), "source_in", "source_out", "duration",
        F.lit("1920x1080").alias("resolution"), F.lit(60.0).alias("fps"),
        F.concat(F.col("category"), F.lit(" scene number "), F.col("clip_id")).alias("description"),
        F.lit("").alias("dialogue"), "score", F.lit("auto").alias("segment_source"), "game_signals",
        F.lit(None).cast("double").alias("peak_loudness_db"), none.alias("audio_cues"), none.alias("keyframes"),
        F.array_sort(F.when(F.col("score") > 50, F.array("category", F.lit("loud"))).otherwise(F.array("category"))).alias("categories"),
    )
    category_rows = clip_rows.select("clip_id", "extract_id", "source_id", F.explode("categories").alias("category"))
    summaries = src.select(
        "source_id", F.concat(F.lit("story of "), "source_id").alias("synopsis"), F.array(F.lit("time")).alias("themes"),
        F.lit("calm").alias("tone"), F.expr("array(named_struct('name', 'Ann', 'role', 'lead'))").alias("characters"),
        F.expr("array(named_struct('title', 'all', 'start', 0D, 'end', duration, 'summary', ''))").alias("beats"),
        F.lit("rules").alias("generated_by"),
    )
    from ..operators.textindex import FIELDS, build_postings, clip_texts, text_lengths

    texts, ids = clip_texts(clip_rows), ["clip_id", "extract_id", "source_id"]
    return Catalog(source_rows, extract_rows, clip_rows, category_rows, summaries,
                   build_postings(texts, ids, FIELDS), text_lengths(texts, ids, FIELDS))


def edl_tracks(spark: SparkSession, sf_dir: str, aside: bool = False) -> Tracks:
    """Orders as edit documents with every track filled. With ``aside``, the rows that all tracks are made of are written
    aside, so that a reader of all tracks has the cues numbered and joined once."""
    lengths = edl_lengths(spark, sf_dir)
    video = edl_cues(spark, sf_dir).join(lengths.select("edl_id", "total"), "edl_id").withColumn(
        "source_in", F.when(F.col("l_suppkey") % 2 == 0, (F.col("clip_id") % 10 + 2).cast("double"))
    )
    if aside:
        video = written(video, "cues")
    base = video.select("edl_id", "total", "pos", "start", "end", "l_suppkey", "clip_id")
    kind = F.when(F.col("l_suppkey") % 3 == 0, "voiceover").when(F.col("l_suppkey") % 3 == 1, "clip_audio").otherwise("silence")
    audio = base.select("edl_id", "total", "pos", (F.col("start") + 3.0).alias("start"), "end", kind.alias("kind"),
                        F.when(F.col("l_suppkey") % 2 == 0, -12.0).alias("level_db"))
    ost = base.select("edl_id", "total", "pos", (F.col("start") - 1.0).alias("start"), "end",
                      ((F.col("l_suppkey") % 13) / 10.0).alias("animate_duration"))
    shape = F.when(F.col("l_suppkey") % 3 == 0, "circle").when(F.col("l_suppkey") % 3 == 1, "box").otherwise("arrow")
    annotations = base.select(
        "edl_id", "total", F.lit(1080).alias("out_width"), F.lit(1920).alias("out_height"), "pos", "start", "end",
        shape.alias("shape"), (F.col("clip_id") % 1200).cast("int").alias("x"),
        (F.col("clip_id") % 2000).cast("int").alias("y"), (F.col("clip_id") % 4).cast("int").alias("radius"),
        (F.col("clip_id") % 3).cast("int").alias("width"), (F.col("clip_id") % 5).cast("int").alias("height"),
    )
    caption_cues = base.select("edl_id", "total", "pos", "start", (F.col("end") - 2.0).alias("end"),
                               F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise("line").alias("text"))
    k = F.col("edl_id")
    number = lambda n: (k % n)
    head = lengths.select(
        "edl_id", F.when(number(11) == 0, 2).otherwise(1).alias("schema_version"), F.col("total").alias("duration"),
        F.when(number(13) == 0, 0).otherwise(1080).alias("width"), F.lit(1920).alias("height"),
        F.when(number(17) == 0, 0).otherwise(60).alias("fps"),
        F.when(number(3) == 0, F.struct(
            F.when(number(2) == 0, " ").otherwise("mark").alias("text"), (number(15) / 10.0).alias("opacity"),
            (number(5) - 1).cast("int").alias("font_size"), F.lit("bottom").alias("position"))).alias("watermark"),
        F.when(number(4) != 0, F.struct(F.lit("elevenlabs").alias("backend"))).alias("voiceover"),
        F.when(number(2) == 0, F.struct(
            F.when(number(7) == 0, 0).otherwise(4).alias("max_words"), F.when(number(9) == 0, 0).otherwise(28).alias("max_chars"),
            (number(6) / 10.0 - 0.1).alias("min_chunk_duration"), F.when(number(5) == 0, 0).alias("font_size"),
            F.when(number(3) == 0, "karaoke_fill").otherwise("none").alias("highlight"),
            F.when(number(6) == 0, "yellow").otherwise("#FFD600").alias("highlight_color"),
            F.array().cast("array<string>").alias("cues"), (number(8) / 10.0 - 0.1).alias("animate_overshoot"),
            (number(10) / 8.0).alias("animate_duration"), (number(14) - 1).cast("int").alias("fade_ms"),
            F.when(number(8) == 0, "#12345").alias("active_word_bg"), (number(12) - 1).cast("int").alias("active_word_bg_radius"),
            F.when(number(10) == 0, 0.5).alias("active_word_scale"))).alias("captions"),
        F.when(number(6) == 0, F.struct((number(4) == 0).alias("duck"))).alias("music"),
    )
    return Tracks(head, video, audio, ost, annotations, caption_cues)


# The same views as DuckDB text, each a WITH list that queries append to.
_T = "CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT)"
SQL = {
    "clips": f"""v_clips AS (
  SELECT event_id AS clip_id, user_id AS source_id,
         CAST(floor({_T} / (1e6 * 1800.0)) AS DOUBLE) AS source_in,
         CAST(floor({_T} / (1e6 * 1800.0)) AS DOUBLE) + CAST(event_id % 56 + 5 AS DOUBLE) AS source_out,
         CAST(event_id % 56 + 5 AS DOUBLE) AS duration,
         CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) AS score,
         event_type AS category, props AS game_signals
  FROM events)""",
    "samples": f"""v_samples AS (
  SELECT user_id AS source_id, CAST({_T} AS DOUBLE) / CAST(1e6 * 1800.0 AS DOUBLE) AS t,
         round(CAST(20.0 AS DOUBLE) * log10(value), 6) AS db
  FROM events WHERE value > 0)""",
    "amplitudes": f"""v_amplitudes AS (
  SELECT user_id AS source_id, CAST({_T} AS DOUBLE) / CAST(1e6 * 1800.0 AS DOUBLE) AS t,
         value / CAST(1000.0 AS DOUBLE) AS x
  FROM events)""",
    "sources": "v_sources AS (SELECT source_id, max(source_out) AS duration FROM v_clips GROUP BY source_id)",
    "cues": """v_cues AS (
  SELECT conv_id AS source_id, CAST(turn AS INTEGER) AS cue_no, CAST(turn * 5.0 AS DOUBLE) AS "start",
         CAST(turn * 5.0 + 4.0 AS DOUBLE) AS "end", text
  FROM conversations)""",
    "utterances": "v_utterances AS (SELECT conv_id * 1000 + turn AS utterance_id, text FROM conversations)",
    "edl_cues": """v_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n
  FROM lineitem),
v_edl_cues AS (
  SELECT l_orderkey AS edl_id, CAST(n - 1 AS INTEGER) AS pos, CAST((n - 1) * 25.0 AS DOUBLE) AS "start",
         CAST((n - 1) * 25.0 AS DOUBLE) + l_quantity AS "end", l_partkey AS clip_id,
         CASE WHEN l_returnflag = 'R' THEN 'crossfade' ELSE 'cut' END AS transition_in,
         CASE WHEN l_returnflag = 'R' THEN round(l_discount * 100, 0) ELSE 0.0 END AS transition_duration,
         CASE l_returnflag WHEN 'A' THEN 'slow_mo' WHEN 'N' THEN 'ken_burns_in' ELSE 'freeze_first' END AS effect,
         round(l_tax * 20, 2) AS speed, round(l_discount - 0.02, 2) AS zoom_from, l_suppkey
  FROM v_numbered)""",
    "edl_lengths": """v_edl_lengths AS (
  SELECT o_orderkey AS edl_id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 200 AS DOUBLE) AS total,
         o_orderstatus, o_orderpriority, o_custkey
  FROM orders)""",
    "edl_clips": """v_edl_clips AS (
  SELECT p_partkey AS clip_id, '/clips/' || p_name || '.mp4' AS file, 'clip_' || p_partkey AS clip_local_id,
         CAST(p_size AS DOUBLE) AS duration, CAST(p_partkey % 10 AS DOUBLE) AS source_in
  FROM part WHERE p_size <> 7)""",
}
SQL["catalog"] = SQL["clips"] + ",\n" + SQL["sources"] + """,
c_sources AS (
  SELECT source_id, '/media/u' || source_id || '.mp4' AS file_path, 'fp-' || source_id AS fingerprint, duration,
         '1920x1080' AS resolution, CAST(60.0 AS DOUBLE) AS fps, 1 AS has_audio FROM v_sources),
c_extracts AS (
  SELECT source_id * 2 + h AS extract_id, source_id, CASE WHEN h = 1 THEN 'interval' ELSE 'auto' END AS segmenter,
         'frames' AS analyzer,
         CASE source_id % 3 WHEN 0 THEN 'gta' WHEN 1 THEN 'movie' ELSE 'vlog' END AS game_profile,
         '2024-01-' || lpad(CAST(source_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:0' || h || '+00:00' AS created_at,
         '/catalog/u' || source_id || CASE WHEN h = 1 THEN '/b' ELSE '/a' END || '/manifest.json' AS manifest_path
  FROM v_sources, (VALUES (0), (1)) halves(h)),
c_clips AS (
  SELECT clip_id, source_id * 2 + clip_id % 2 AS extract_id, source_id, 'clip_' || clip_id AS clip_local_id,
         source_in, source_out, duration, category || ' scene number ' || clip_id AS description, score, game_signals
  FROM v_clips),
c_categories AS (
  SELECT clip_id, category FROM v_clips UNION ALL SELECT clip_id, 'loud' FROM v_clips WHERE score > 50)"""
SQL["edl_tracks"] = SQL["edl_cues"] + ",\n" + SQL["edl_lengths"] + """,
e_video AS (
  SELECT c.*, l.total, CASE WHEN l_suppkey % 2 = 0 THEN CAST(clip_id % 10 + 2 AS DOUBLE) END AS source_in
  FROM v_edl_cues c JOIN v_edl_lengths l USING (edl_id)),
e_audio AS (
  SELECT edl_id, total, pos, "start" + 3.0 AS "start", "end",
         CASE l_suppkey % 3 WHEN 0 THEN 'voiceover' WHEN 1 THEN 'clip_audio' ELSE 'silence' END AS kind,
         CASE WHEN l_suppkey % 2 = 0 THEN CAST(-12.0 AS DOUBLE) END AS level_db FROM e_video),
e_ost AS (
  SELECT edl_id, total, pos, "start" - 1.0 AS "start", "end", CAST(l_suppkey % 13 AS DOUBLE) / 10.0 AS animate_duration
  FROM e_video),
e_annotations AS (
  SELECT edl_id, total, pos, "start", "end",
         CASE l_suppkey % 3 WHEN 0 THEN 'circle' WHEN 1 THEN 'box' ELSE 'arrow' END AS shape,
         clip_id % 1200 AS x, clip_id % 2000 AS y, clip_id % 4 AS radius, clip_id % 3 AS width, clip_id % 5 AS height
  FROM e_video),
e_caption_cues AS (
  SELECT edl_id, total, pos, "start", "end" - 2.0 AS "end", CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE 'line' END AS text
  FROM e_video),
e_head AS (
  SELECT edl_id, edl_id AS k, CASE WHEN edl_id % 11 = 0 THEN 2 ELSE 1 END AS schema_version, total AS duration,
         CASE WHEN edl_id % 13 = 0 THEN 0 ELSE 1080 END AS width, CASE WHEN edl_id % 17 = 0 THEN 0 ELSE 60 END AS fps,
         edl_id % 4 <> 0 AS voiced
  FROM v_edl_lengths)"""


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
