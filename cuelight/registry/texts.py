"""Subtitles, dialogue, full-text index and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching, termindex
from ..operators import subtitles as sub
from ..operators import textindex as ti
from ..plans import views
from . import query

_CUES = views.with_views("cues")
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _docs(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").alias("dialogue"), F.col("source").alias("tags"), F.col("lang").alias("description"))


_FIELDS = ["description", "dialogue", "tags"]


def _postings(spark, sf, stemmed=False):
    return ti.build_postings(_docs(spark, sf), ["doc_id"], _FIELDS, stemmed)


_TOKENS = """WITH fields AS (
  SELECT doc_id, 'dialogue' AS field, text AS body FROM documents UNION ALL
  SELECT doc_id, 'tags', source FROM documents UNION ALL SELECT doc_id, 'description', lang FROM documents),
words AS (
  SELECT doc_id, field, list_filter(string_split_regex(strip_accents(lower(body)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM fields),
p AS (SELECT doc_id, field, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM words)
"""


@query("token_counts", _TOKENS + "SELECT doc_id, field, count(*) AS tokens, count(DISTINCT term) AS terms FROM p GROUP BY ALL")
def token_counts(spark, sf):
    return ti.field_statistics(_docs(spark, sf), ["doc_id"], _FIELDS)


@query("term_statistics", _TOKENS + "SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs, max(pos) AS last_pos FROM p GROUP BY term")
def term_statistics(spark, sf):
    return _postings(spark, sf).groupBy("term").agg(
        F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("docs"), F.max("pos").cast("bigint").alias("last_pos")
    )


@query("match_all_terms", _TOKENS + "SELECT doc_id FROM p WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def match_all_terms(spark, sf):
    return ti.match(_postings(spark, sf), ti.TextQuery(all_of=["the", "and"]), "doc_id", stemmed=False)


@query("match_any_not", _TOKENS + """SELECT DISTINCT doc_id FROM p WHERE term IN ('une', 'license')
  AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'la')""")
def match_any_not(spark, sf):
    q = ti.TextQuery(any_of=["une", "license"], none_of=["la"])
    return ti.match(_postings(spark, sf), q, "doc_id", stemmed=False)


@query("match_phrase", _TOKENS + """SELECT DISTINCT a.doc_id FROM p a JOIN p b
  ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the'""")
def match_phrase(spark, sf):
    return ti.match(_postings(spark, sf), ti.TextQuery(phrase=["in", "the"]), "doc_id", stemmed=False)


@query("match_prefix", _TOKENS + "SELECT DISTINCT doc_id FROM p WHERE term LIKE 'lic%'")
def match_prefix(spark, sf):
    return ti.match(_postings(spark, sf), ti.TextQuery(prefix=["lic"]), "doc_id", stemmed=False)


@query("match_field", _TOKENS + "SELECT DISTINCT doc_id FROM p WHERE term = 'en' AND field = 'description'")
def match_field(spark, sf):
    q = ti.TextQuery(all_of=["en"], fields=["description"])
    return ti.match(_postings(spark, sf), q, "doc_id", stemmed=False)


_RANK = _TOKENS + """, len AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM p WHERE term IN ('the', 'license', 'und') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, greatest(CAST(1e-6 AS DOUBLE), ln((docs - df + 0.5) / (df + 0.5))) * tf * CAST(2.2 AS DOUBLE)
  / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / mean)) AS s
  FROM tf JOIN df USING (term) JOIN len USING (doc_id), st)
"""


@query("text_rank", _RANK + "SELECT doc_id, round(-sum(s), 6) AS rank FROM w GROUP BY doc_id")
def text_rank(spark, sf):
    lengths = ti.text_lengths(_docs(spark, sf), ["doc_id"], _FIELDS)
    r = ti.rank(_postings(spark, sf), lengths, ti.TextQuery(any_of=["the", "license", "und"]), "doc_id", stemmed=False)
    return r.select("doc_id", F.round("rank", 6).alias("rank"))


@query("phrase_rank", _TOKENS + """, len AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT a.doc_id, 'phrase' AS part, count(*) AS tf FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1
    WHERE a.term = 'in' AND b.term = 'the' GROUP BY a.doc_id
  UNION ALL SELECT doc_id, 'prefix', count(*) FROM p WHERE term LIKE 'lic%' GROUP BY doc_id),
df AS (SELECT part, count(*) AS df FROM tf GROUP BY part),
w AS (SELECT doc_id, greatest(CAST(1e-6 AS DOUBLE), ln((docs - df + 0.5) / (df + 0.5))) * tf * CAST(2.2 AS DOUBLE)
  / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / mean)) AS s
  FROM tf JOIN df USING (part) JOIN len USING (doc_id), st)
SELECT doc_id, round(-sum(s), 6) AS rank FROM w GROUP BY doc_id""")
def phrase_rank(spark, sf):
    p = _postings(spark, sf)
    q = ti.TextQuery(phrase=["in", "the"], prefix=["lic"])
    return ti.rank(p, ti.text_lengths(_docs(spark, sf), ["doc_id"], _FIELDS), q, "doc_id", stemmed=False).select("doc_id", F.round("rank", 6).alias("rank"))


_NESTED = _TOKENS + """, hit AS (
  SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 AND a.term = 'in' AND b.term = 'the'
  WHERE a.doc_id IN (SELECT doc_id FROM p WHERE term = 'en' AND field = 'description')
  UNION SELECT doc_id FROM p WHERE term LIKE 'lic%' AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'une'))
"""
EXPRESSION = '("in the" AND description : en) OR lic* NOT une'


@query("match_expression", _NESTED + "SELECT doc_id FROM hit")
def match_expression(spark, sf):
    """An expression with a phrase, a field, a beginning and all three operators, in one pass over the postings."""
    return matching.matching(_postings(spark, sf), EXPRESSION, "doc_id", stemmed=False)


@query("match_groups", _TOKENS + """SELECT DISTINCT doc_id FROM p WHERE term = 'und' OR doc_id IN (
  SELECT doc_id FROM p WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 2)
  AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'license')""")
def match_groups(spark, sf):
    one, two, three, four = (matching.Words((w,)) for w in ("the", "and", "license", "und"))
    tree = matching.Some((matching.Without(matching.Every((one, two)), three), four))
    return matching.matching(_postings(spark, sf), tree, "doc_id", stemmed=False)


@query("rank_expression", _NESTED + """, len AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT a.doc_id, 'phrase' AS part, count(*) AS tf FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1
    WHERE a.term = 'in' AND b.term = 'the' GROUP BY a.doc_id
  UNION ALL SELECT doc_id, 'field', count(*) FROM p WHERE term = 'en' AND field = 'description' GROUP BY doc_id
  UNION ALL SELECT doc_id, 'prefix', count(*) FROM p WHERE term LIKE 'lic%' GROUP BY doc_id),
df AS (SELECT part, count(*) AS df FROM tf GROUP BY part),
w AS (SELECT doc_id, greatest(CAST(1e-6 AS DOUBLE), ln((docs - df + 0.5) / (df + 0.5))) * tf * CAST(2.2 AS DOUBLE)
  / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / mean)) AS s
  FROM tf JOIN df USING (part) JOIN len USING (doc_id), st WHERE doc_id IN (SELECT doc_id FROM hit))
SELECT doc_id, round(-sum(s), 6) AS rank FROM w GROUP BY doc_id""")
def rank_expression(spark, sf):
    p = _postings(spark, sf)
    return matching.ranked(p, ti.text_lengths(_docs(spark, sf), ["doc_id"], _FIELDS), EXPRESSION, "doc_id", stemmed=False).select(
        "doc_id", F.round("rank", 6).alias("rank"))


def _index(spark, sf):
    return termindex.new_index(_postings(spark, sf), ti.text_lengths(_docs(spark, sf), ["doc_id"], _FIELDS), id_column="doc_id")


@query("indexed_rank", _RANK + "SELECT doc_id, round(-sum(s), 6) AS rank FROM w GROUP BY doc_id")
def indexed_rank(spark, sf):
    """Ranks from an index written by term: only the folders of the asked terms are read, and no lengths."""
    return _index(spark, sf).rank(["the", "license", "und"], stemmed=False).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query("indexed_best", _RANK.replace("IN ('the', 'license', 'und')", "IN ('license', 'und')") + ", r AS (SELECT doc_id, -sum(s) AS rank FROM w GROUP BY doc_id) SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY rank, doc_id LIMIT 40")
def indexed_best(spark, sf):
    """The best documents, by blocks whose greatest weights can still bring them in."""
    return _index(spark, sf).best(["license", "und"], 40, stemmed=False).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query("index_removal", _TOKENS + "SELECT field, count(*) AS n FROM p WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de') GROUP BY field")
def index_removal(spark, sf):
    gone = views.table(spark, sf, "documents").filter("lang = 'de'")
    return ti.remove_documents(_postings(spark, sf), gone, "doc_id").groupBy("field").agg(F.count("*").alias("n"))


# The word forms in the tables that share the stem of "licenses".
@query("stemmed_matches", _TOKENS + "SELECT DISTINCT doc_id FROM p WHERE term IN ('license', 'licenses', 'licensed', 'licensing')")
def stemmed_matches(spark, sf):
    return ti.match(_postings(spark, sf, True), ti.TextQuery(all_of=["licenses"]), "doc_id")


_TAGS = views.with_views("clips") + """ SELECT clip_id, json_extract_string(game_signals, '$.k') || ' a b deep' AS tags FROM v_clips"""


@query("signal_tags", _TAGS)
def signal_tags(spark, sf):
    """Nested signal values flattened to tag words; nulls and keys are left out."""
    nested = F.concat(F.lit('{"a_k":'), F.get_json_object("game_signals", "$.k"),
                      F.lit(',"b":["a",null,"b"],"c":{"x":null,"y":"deep"}}'))
    return views.clips(spark, sf).select("clip_id", F.array_join(ti.signal_values(nested), " ").alias("tags"))


def _srt(spark, sf):
    """Subtitle text per conversation, rebuilt from its turns: one block per turn."""
    c = views.cues(spark, sf)
    stamp = lambda t: F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(t / 3600), F.floor(t % 3600 / 60), F.floor(t % 60), F.floor(t * 1000 % 1000))
    flat = F.regexp_replace("text", r"\s*\n\s*", "\n")
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\r\n"), stamp(F.col("start")), F.lit(" --> "),
                     stamp(F.col("end")), F.lit("\r\n<i>{x}"), flat, F.lit("</i>"))
    return c.withColumn("block", block).groupBy("source_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "block"))), lambda b: b["block"]), "\n\n").alias("content")
    )


@query("subtitle_cues", _CUES + f"""SELECT source_id, "start", "end", {_SQUEEZE.format("regexp_replace(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g'), '<[^>]+>|\\{[^}]*\\}', ' ', 'g')")} AS text FROM v_cues WHERE {_SQUEEZE.format("text")} <> ''""")
def subtitle_cues(spark, sf):
    """Subtitle files rebuilt from the turns and parsed back."""
    return sub.parse_subtitles(_srt(spark, sf), "source_id").select("source_id", "start", "end", "text")


_TILES = _CUES + """, d AS (SELECT source_id, max("end") AS stop FROM v_cues GROUP BY source_id),
tiles AS (SELECT source_id, source_id * 1000 + n AS tile_id, CAST(n * 7.0 AS DOUBLE) AS s, CAST(least(stop, n * 7.0 + 10.0) AS DOUBLE) AS e
  FROM d, unnest(range(0, CAST(ceil(stop / 7.0) AS BIGINT))) t(n))
"""


def _tiles(spark, sf):
    from ..operators.segments import interval_segments

    c = views.cues(spark, sf)
    sources = c.groupBy("source_id").agg(F.max("end").alias("duration"))
    return interval_segments(sources, 10.0, 3.0).withColumn("tile_id", F.col("source_id") * 1000 + F.col("tile_no"))


@query("range_dialogue", _TILES + f"""SELECT tile_id, coalesce({_SQUEEZE.format("string_agg(text, ' ' ORDER BY \"start\", cue_no)")}, '') AS dialogue
FROM tiles t LEFT JOIN v_cues c ON c.source_id = t.source_id AND c."start" < t.e AND c."end" > t.s GROUP BY tile_id""")
def range_dialogue(spark, sf):
    return sub.dialogue_for_ranges(_tiles(spark, sf), views.cues(spark, sf), "tile_id").select("tile_id", "dialogue")


@query("clip_cues", _TILES + """SELECT tile_id AS clip_id, cue_no, round(greatest(0.0, c."start" - t.s), 3) AS "start",
  round(least(least(e - s, 6.0), c."end" - t.s), 3) AS "end"
FROM tiles t JOIN v_cues c ON c.source_id = t.source_id AND c."start" < t.s + least(e - s, 6.0) AND c."end" > t.s""")
def clip_cues(spark, sf):
    clips = _tiles(spark, sf).select(F.col("tile_id").alias("clip_id"), "source_id", F.col("start").alias("source_in"),
                                     (F.col("end") - F.col("start")).alias("duration"))
    return sub.cues_for_clips(clips, views.cues(spark, sf), max_seconds=6.0).select("clip_id", "cue_no", "start", "end")


@query("sidecar_choice", _CUES + """, v AS (SELECT DISTINCT source_id FROM v_cues)
SELECT '/m/film' || source_id || '.part.mp4' AS video,
  CASE source_id % 4 WHEN 0 THEN '/m/film' || source_id || '.part.srt' WHEN 1 THEN '/m/film' || source_id || '.part.vtt'
    WHEN 2 THEN '/m/film' || source_id || '.part.de.srt' END AS subtitle FROM v""")
def sidecar_choice(spark, sf):
    from ..sources.files import resolve_sidecars

    ids = views.cues(spark, sf).select("source_id").distinct()
    stem = F.concat(F.lit("/m/film"), F.col("source_id"), F.lit(".part"))
    endings = (
        F.when(F.col("source_id") % 4 == 0, F.array(F.lit(".en.srt"), F.lit(".srt"), F.lit(".vtt")))
        .when(F.col("source_id") % 4 == 1, F.array(F.lit(".en.srt"), F.lit(".vtt"), F.lit(".txt")))
        .when(F.col("source_id") % 4 == 2, F.array(F.lit(".en.vtt"), F.lit(".en.srt"), F.lit(".de.srt")))
        .otherwise(F.array(F.lit("x.srt"), F.lit(".nfo")))
    )
    videos = ids.select(F.concat(stem, F.lit(".mp4")).alias("video"))
    files = ids.select(stem.alias("stem"), F.explode(endings).alias("ending")).select(F.concat("stem", "ending").alias("path"))
    return resolve_sidecars(videos, files)


@query("embedded_fallback", _CUES + """ SELECT '/m/' || source_id || '.mp4' AS video, CASE WHEN source_id % 2 = 0 THEN 'side' ELSE 'embedded' END AS origin, count(*) AS cues FROM v_cues GROUP BY source_id""")
def embedded_fallback(spark, sf):
    """Videos whose chosen file has no cues use their embedded text."""
    c = views.cues(spark, sf).withColumn("video", F.concat(F.lit("/m/"), "source_id", F.lit(".mp4")))
    chosen = c.select("video", F.concat(F.col("video"), F.lit(".srt")).alias("subtitle")).distinct()
    timed = c.select("video", "source_id", "cue_no", "start", "end")
    side = timed.filter("source_id % 2 = 0").select(
        F.concat(F.col("video"), F.lit(".srt")).alias("path"), "cue_no", "start", "end", F.lit("side").alias("origin"))
    embedded = timed.select("video", "cue_no", "start", "end", F.lit("embedded").alias("origin"))
    return sub.cues_for_videos(chosen, side, embedded).groupBy("video", "origin").agg(F.count("*").alias("cues"))


@query("timestamps", views.with_views("clips") + """ SELECT clip_id, CAST(t AS DOUBLE) AS parsed,
  CASE WHEN t >= 3600 THEN printf('%d:%02d:%06.3f', CAST(floor(t / 3600) AS BIGINT), CAST(floor((t % 3600) / 60) AS BIGINT), CAST(t % 60 AS DOUBLE))
       ELSE printf('%d:%06.3f', CAST(floor(t / 60) AS BIGINT), CAST(t % 60 AS DOUBLE)) END AS shown
FROM (SELECT clip_id, CAST(clip_id AS DOUBLE) + 0.25 AS t FROM v_clips)""")
def timestamps(spark, sf):
    t = F.col("clip_id").cast("double") + 0.25
    shown = tx.format_timestamp(t)
    return views.clips(spark, sf).select("clip_id", tx.parse_timestamp(shown).alias("parsed"), shown.alias("shown"))


@query("compact_text", f"""SELECT doc_id, CASE WHEN length(s) > 80 THEN substr(s, 1, 79) || '…' ELSE s END AS short
FROM (SELECT doc_id, {_SQUEEZE.format("text")} AS s FROM documents)""")
def compact_text(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", tx.compact(F.col("text"), 80).alias("short"))


@query("clean_markup", f"""SELECT page_id, {_SQUEEZE.format("regexp_replace(html, '<[^>]+>|\\{[^}]*\\}', ' ', 'g')")} AS body FROM pages""")
def clean_markup(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", tx.clean_cue(F.col("html")).alias("body"))


@query("frame_rates", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 1000 / 1001.0, 6)
  WHEN 1 THEN 0.0 WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS fps FROM part""")
def frame_rates(spark, sf):
    k = F.col("p_partkey") % 4
    rate = F.when(k == 0, F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001"))).when(
        k == 1, F.concat(F.col("p_size").cast("string"), F.lit("/0"))
    ).when(k == 2, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return views.table(spark, sf, "part").select("p_partkey", F.round(tx.frame_rate(rate), 6).alias("fps"))


@query("colour_checks", "SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer")
def colour_checks(spark, sf):
    k = F.col("c_custkey")
    colour = F.when(k % 3 == 1, F.format_string("#%06x", k)).when(k % 3 == 2, F.format_string("#%08X", k)).otherwise(
        F.format_string("#%05x", k % 1000))
    return views.table(spark, sf, "customer").select("c_custkey", tx.is_hex_colour(colour).alias("valid"))


@query("pause_markup", "SELECT conv_id, turn, turn % 2 = 0 AS paused FROM conversations")
def pause_markup(spark, sf):
    c = views.table(spark, sf, "conversations")
    marked = F.concat("text", F.when(F.col("turn") % 2 == 0, '<break time="1.5s" />').otherwise('<break time="x"/>'))
    return c.select("conv_id", "turn", tx.has_pause_markup(marked).alias("paused"))


@query("voice_settings", """SELECT s_suppkey, CAST(CASE WHEN s_acctbal > 1 THEN least(1.0, greatest(0.0, s_acctbal / 100.0)) ELSE greatest(0.0, s_acctbal) END AS DOUBLE) AS similarity_boost,
  CAST(s_suppkey % 2 AS DOUBLE) AS use_speaker_boost FROM supplier""")
def voice_settings(spark, sf):
    settings = F.create_map(F.lit("similarity"), F.col("s_acctbal"), F.lit("use_speaker_boost"),
                            (F.col("s_suppkey") % 2).cast("double"))
    out = tx.voice_settings(settings)
    return views.table(spark, sf, "supplier").select(
        "s_suppkey", out["similarity_boost"].alias("similarity_boost"), out["use_speaker_boost"].alias("use_speaker_boost"))


@query("file_fingerprints", "SELECT o_orderkey, sha1('/media/' || o_orderkey || '.mp4' || CAST(floor(o_totalprice) AS BIGINT) || o_custkey) AS fingerprint FROM orders")
def file_fingerprints(spark, sf):
    """Fingerprints of a file listing: path, size and change time."""
    from ..sources.files import fingerprint

    o = views.table(spark, sf, "orders")
    path = F.concat(F.lit("/media/"), "o_orderkey", F.lit(".mp4"))
    return o.select("o_orderkey", fingerprint(path, F.floor("o_totalprice"), F.col("o_custkey")).alias("fingerprint"))


@query("relative_files", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a/' || o_orderkey || '.mp4' ELSE '/other/' || o_orderkey || '.mp4' END AS file FROM orders")
def relative_files(spark, sf):
    from ..operators.search import relative_path

    base = F.when(F.col("o_orderkey") % 2 == 0, "/out/a/").otherwise("/other/")
    path = F.concat(base, F.col("o_orderkey"), F.lit(".mp4"))
    return views.table(spark, sf, "orders").select("o_orderkey", relative_path(path, F.lit("/out")).alias("file"))
