"""Catalog search, statistics and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import search as find
from ..operators.textindex import TextQuery
from ..plans import views
from ..plans.session import many_files, written
from . import query

_C = views.with_views("catalog")
_FLAT = ["clip_id", "score", "duration", "source_in", "extract_segmenter", "extract_game_profile", "source_file", "categories"]
_JOINED = """, joined AS (
  SELECT c.clip_id, c.score, c.duration, c.source_in, e.segmenter AS extract_segmenter,
         e.game_profile AS extract_game_profile, s.file_path AS source_file, s.fingerprint, e.created_at,
         (SELECT string_agg(category, ',' ORDER BY category) FROM c_categories k WHERE k.clip_id = c.clip_id) AS categories,
         c.game_signals, c.description, e.manifest_path, c.source_id, c.extract_id
  FROM c_clips c JOIN c_extracts e USING (extract_id) JOIN c_sources s ON s.source_id = e.source_id)
"""
_OUT = "SELECT clip_id, score, duration, source_in, extract_segmenter, extract_game_profile, source_file, categories FROM joined "


def flat(rows):
    return rows.select(*_FLAT).withColumn("categories", F.array_join("categories", ","))


@query("search_minimum_score", _C + _JOINED + _OUT + "WHERE score >= 70 AND clip_id IN (SELECT clip_id FROM c_categories WHERE category IN ('view', 'click')) ORDER BY score DESC, clip_id LIMIT 50")
def search_minimum_score(spark, sf):
    return flat(find.search(views.catalog(spark, sf), categories=["view", "click"], min_score=70))


@query("search_all_categories", _C + _JOINED + _OUT + """WHERE clip_id IN (
  SELECT clip_id FROM c_categories WHERE category IN ('purchase', 'loud') GROUP BY clip_id HAVING count(DISTINCT category) = 2)""")
def search_all_categories(spark, sf):
    return flat(find.search(views.catalog(spark, sf), categories=["purchase", "loud"], all_categories=True, limit=-1))


@query("search_repeated_category", _C + _JOINED + _OUT + """WHERE clip_id IN (
  SELECT clip_id FROM c_categories WHERE category IN ('view', 'view') GROUP BY clip_id HAVING count(DISTINCT category) = 2)""")
def search_repeated_category(spark, sf):
    return flat(find.search(views.catalog(spark, sf), categories=["view", "view"], all_categories=True, limit=-1))


@query("search_ranges", _C + _JOINED + _OUT + "WHERE score BETWEEN 0 AND 60 AND duration BETWEEN 10 AND 30")
def search_ranges(spark, sf):
    return flat(find.search(views.catalog(spark, sf), min_score=0, max_score=60, min_duration=10, max_duration=30, limit=-1))


@query("search_extract_fields", _C + _JOINED + _OUT + "WHERE extract_segmenter = 'interval' AND extract_game_profile = 'movie'")
def search_extract_fields(spark, sf):
    return flat(find.search(views.catalog(spark, sf), segmenter="interval", game_profile="movie", limit=-1))


@query("search_source_path", _C + _JOINED + _OUT + "WHERE source_file = '/media/u7.mp4' OR fingerprint = '/media/u7.mp4'")
def search_source_path(spark, sf):
    return flat(find.search(views.catalog(spark, sf), source="/media/u7.mp4", limit=-1))


@query("search_source_fingerprint", _C + _JOINED + _OUT + "WHERE source_file = 'fp-3' OR fingerprint = 'fp-3'")
def search_source_fingerprint(spark, sf):
    return flat(find.search(views.catalog(spark, sf), source="fp-3", limit=-1))


@query("search_signal_equals", _C + _JOINED + _OUT + "WHERE json_extract_string(game_signals, '$.k') = '42'")
def search_signal_equals(spark, sf):
    return flat(find.search(views.catalog(spark, sf), signals=[("k", "=", "42")], limit=-1))


@query("search_signal_like", _C + _JOINED + _OUT + "WHERE json_extract_string(game_signals, '$.k') ILIKE '%7%'")
def search_signal_like(spark, sf):
    return flat(find.search(views.catalog(spark, sf), signals=[("k", "~=", "7")], limit=-1))


@query("search_by_duration", _C + _JOINED + _OUT + "ORDER BY duration DESC, clip_id LIMIT 40")
def search_by_duration(spark, sf):
    return flat(find.search(views.catalog(spark, sf), order_by="duration", limit=40))


@query("search_by_created_at", _C + _JOINED + _OUT + "ORDER BY created_at DESC, clip_id LIMIT 40")
def search_by_created_at(spark, sf):
    return flat(find.search(views.catalog(spark, sf), order_by="created_at", limit=40))


@query("search_by_timeline", _C + _JOINED + _OUT + "ORDER BY source_in, clip_id LIMIT 40")
def search_by_timeline(spark, sf):
    return flat(find.search(views.catalog(spark, sf), order_by="timeline", limit=40))


@query("search_unknown_order", _C + _JOINED + _OUT + "ORDER BY score DESC, clip_id LIMIT 40")
def search_unknown_order(spark, sf):
    return flat(find.search(views.catalog(spark, sf), order_by="best", limit=40))


@query("search_text", _C + _JOINED + _OUT + "WHERE description LIKE 'purchase %' AND score >= 40")
def search_text(spark, sf):
    return flat(find.search(views.catalog(spark, sf), query=TextQuery(all_of=["purchases", "scene"]), min_score=40, limit=-1))


@query("search_expression", _C + _JOINED + _OUT + "WHERE (description LIKE 'purchase %' OR clip_id IN (SELECT clip_id FROM c_categories WHERE category = 'loud')) AND NOT description LIKE 'view %'")
def search_expression(spark, sf):
    """A search by a match expression over all fields and one."""
    return flat(find.search(views.catalog(spark, sf), query='(description : purchases OR tags : loud) NOT "view scene"', limit=-1))


_RANKED = """, len AS (SELECT clip_id, CAST(4 + 1 + CASE WHEN score > 50 THEN 2 ELSE 1 END AS DOUBLE) AS n FROM v_clips),
st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT clip_id, 'purchase' AS term, 2 AS tf FROM v_clips WHERE category = 'purchase' UNION ALL SELECT clip_id, 'loud', 1 FROM v_clips WHERE score > 50),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT clip_id, -sum(greatest(CAST(1e-6 AS DOUBLE), ln((docs - df + 0.5) / (df + 0.5))) * tf * CAST(2.2 AS DOUBLE)
  / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / mean))) AS rank
  FROM tf JOIN df USING (term) JOIN len USING (clip_id), st GROUP BY clip_id)
SELECT clip_id, round(rank, 9) AS fts_rank, score FROM r JOIN v_clips USING (clip_id) ORDER BY fts_rank, score DESC, clip_id LIMIT 100"""


@query("search_text_ranked", _C + _RANKED)
def search_text_ranked(spark, sf):
    rows = find.search(views.catalog(spark, sf), query=TextQuery(any_of=["purchase", "loud"]), limit=100)
    return rows.select("clip_id", F.round("fts_rank", 9).alias("fts_rank"), "score")


@query("search_result_paths", _C + _JOINED + """SELECT clip_id, '/catalog/u' || source_id || '/media/source.mp4' AS file,
  extract_id, source_id, manifest_path, created_at AS extract_created_at, fingerprint AS source_fingerprint FROM joined""")
def search_result_paths(spark, sf):
    return find.search(views.catalog(spark, sf), limit=-1).select(
        "clip_id", "file", "extract_id", "source_id", "manifest_path", "extract_created_at", "source_fingerprint"
    )


@query("clip_lookup", _C + _JOINED + _OUT + "WHERE clip_id = 11")
def clip_lookup(spark, sf):
    return flat(find.get_clip(views.catalog(spark, sf), 11))


@query("clip_preview", _C + _JOINED + "SELECT clip_id, description, score, source_in, source_file, categories FROM joined WHERE clip_id = 23")
def clip_preview(spark, sf):
    return find.preview(find.get_clip(views.catalog(spark, sf), 23)).select(
        "clip_id", "description", "score", "source_in", "source_file", F.array_join("categories", ",").alias("categories")
    )


@query("source_lookup", _C + " SELECT source_id, file_path, fingerprint, duration FROM c_sources WHERE source_id = 5")
def source_lookup(spark, sf):
    return find.get_source(views.catalog(spark, sf), 5).select("source_id", "file_path", "fingerprint", "duration")


@query("summary_lookup", _C + " SELECT source_id, 'story of ' || source_id AS synopsis, 'time' AS themes, 'Ann' AS cast_names, duration AS beat_end FROM c_sources WHERE source_id = 5")
def summary_lookup(spark, sf):
    s = find.get_summary(views.catalog(spark, sf), 5)
    return s.select("source_id", "synopsis", F.array_join("themes", ",").alias("themes"),
                    F.array_join("characters.name", ",").alias("cast_names"), F.col("beats")[0]["end"].alias("beat_end"))


@query("clip_categories", _C + " SELECT clip_id, string_agg(category, ',' ORDER BY category) AS categories, CAST(count(DISTINCT category) AS BIGINT) AS n FROM c_categories GROUP BY clip_id")
def clip_categories(spark, sf):
    c = views.catalog(spark, sf)
    return find.with_categories(c.clips.select("clip_id"), c.clip_categories).select(
        "clip_id", F.array_join("categories", ",").alias("categories"), F.size("categories").cast("bigint").alias("n")
    )


@query("category_any_join", _C + " SELECT clip_id FROM c_clips WHERE clip_id IN (SELECT clip_id FROM c_categories WHERE category IN ('view', 'loud'))")
def category_any_join(spark, sf):
    c = views.catalog(spark, sf)
    return find.in_any_category(c.clips, c.clip_categories, ["view", "loud"]).select("clip_id")


@query("category_all_join", _C + """ SELECT clip_id FROM c_clips WHERE clip_id IN (
  SELECT clip_id FROM c_categories WHERE category IN ('view', 'loud') GROUP BY clip_id HAVING count(DISTINCT category) = 2)""")
def category_all_join(spark, sf):
    c = views.catalog(spark, sf)
    return find.in_all_categories(c.clips, c.clip_categories, ["view", "loud"]).select("clip_id")


@query("catalog_stats", _C + """ SELECT 'sources' AS table_name, count(*) AS row_count FROM c_sources UNION ALL
SELECT 'extracts', count(*) FROM c_extracts UNION ALL SELECT 'clips', count(*) FROM c_clips UNION ALL
SELECT 'clip_categories', count(*) FROM c_categories""")
def catalog_stats(spark, sf):
    return cat.stats(views.catalog(spark, sf))


@query("source_list", _C + """ SELECT s.source_id, s.file_path, (SELECT count(*) FROM c_extracts e WHERE e.source_id = s.source_id) AS extract_count,
  (SELECT count(*) FROM c_clips c WHERE c.source_id = s.source_id AND c.score > 90) AS clip_count FROM c_sources s""")
def source_list(spark, sf):
    from dataclasses import replace

    c = views.catalog(spark, sf)
    return cat.list_sources(replace(c, clips=c.clips.filter("score > 90"))).select(
        "source_id", "file_path", "extract_count", "clip_count"
    )


@query("extract_list", _C + """ SELECT e.extract_id, e.segmenter, e.created_at, s.file_path,
  (SELECT count(*) FROM c_clips c WHERE c.extract_id = e.extract_id) AS clip_count
  FROM c_extracts e JOIN c_sources s USING (source_id) ORDER BY e.extract_id LIMIT 50""")
def extract_list(spark, sf):
    return cat.list_extracts(views.catalog(spark, sf)).select("extract_id", "segmenter", "created_at", "file_path", "clip_count")


_MANIFESTS = """, docs AS (
  SELECT e.manifest_path, e.created_at, e.segmenter, s.file_path, c.clip_local_id, c.description, c.score, c.source_in, c.category, c.extract_id
  FROM c_extracts e JOIN c_sources s USING (source_id)
  JOIN (SELECT x.*, v.category FROM c_clips x JOIN v_clips v USING (clip_id)) c USING (extract_id))
"""


def manifests(spark, sf, summaries=None):
    """The event catalog as manifest documents, one per extract, in JSON text."""
    from ..sources.files import manifest_json

    return manifest_json(_built(spark, sf, summaries))


def _built(spark, sf, summaries=None):
    from ..sources.files import build_manifests

    c = views.catalog(spark, sf)
    cats = views.clips(spark, sf).select("clip_id", F.array("category").alias("categories"))
    clips = c.clips.drop("categories").join(cats, "clip_id").select(
        "extract_id", F.col("clip_local_id").alias("id"), "file", "source_in", "source_out", "duration", "resolution", "fps",
        "description", "dialogue", "categories", "score", "game_signals",
        F.struct("peak_loudness_db", F.col("audio_cues").alias("cues")).alias("audio"), "keyframes", "segment_source",
    )
    return build_manifests(c.sources, c.extracts, clips, summaries)


@query("manifest_round_trip", _C + _MANIFESTS + "SELECT manifest_path, file_path AS source_file, clip_local_id, description, score, source_in, category AS categories FROM docs")
def manifest_round_trip(spark, sf):
    """Manifests written below the shared folder, found and read back strictly."""
    from ..plans.session import scratch_path
    from ..sources.files import parse_manifests

    path = scratch_path(spark, "manifests")
    manifests(spark, sf).write.json(path)
    texts = spark.read.schema("manifest_path string, text string").json(path)
    good, _ = parse_manifests(texts)
    return good.select("manifest_path", F.col("source.file").alias("source_file"), F.explode("clips").alias("c")).select(
        "manifest_path", "source_file", F.col("c.id").alias("clip_local_id"), "c.description", "c.score", "c.source_in",
        F.array_join("c.categories", ",").alias("categories"),
    )


@query("manifest_rejects", _C + " SELECT manifest_path, CASE WHEN extract_id % 4 = 0 THEN 'unknown key: bogus' ELSE 'missing field: source.file' END AS problems FROM c_extracts WHERE extract_id % 4 < 2")
def manifest_rejects(spark, sf):
    """Documents with an unknown key or without a required field go to quarantine."""
    from ..sources.files import parse_manifests

    ids = views.catalog(spark, sf).extracts.select("manifest_path", (F.col("extract_id") % 4).alias("_kind"))
    texts = manifests(spark, sf).join(ids, "manifest_path").select(
        "manifest_path",
        F.when(F.col("_kind") == 0, F.regexp_replace("text", r"^\{", '{"bogus":1,'))
        .when(F.col("_kind") == 1, F.regexp_replace("text", r'"file":"/media/[^"]*",', ""))
        .otherwise(F.col("text")).alias("text"),
    )
    _, bad = parse_manifests(texts)
    return bad.select("manifest_path", F.array_join("problems", ";").alias("problems"))


@query("manifest_wrong_types", _C + """ SELECT manifest_path, CASE extract_id % 8 WHEN 0 THEN 'wrong type: clips[].score' WHEN 1 THEN 'wrong type: clips[].categories'
  WHEN 2 THEN 'wrong type: schema_version' WHEN 3 THEN 'wrong type: clips[].audio' ELSE 'wrong type: clips[].dialogue' END AS problems FROM c_extracts WHERE extract_id % 8 < 5""")
def manifest_wrong_types(spark, sf):
    """Optional and required fields of a wrong type, or null where null is no value, send a manifest to quarantine."""
    from ..sources.files import parse_manifests

    ids = views.catalog(spark, sf).extracts.select("manifest_path", (F.col("extract_id") % 8).alias("_kind"))
    breaks = [(r'"score":\d+', '"score":"high"'), (r'"categories":\[[^\]]*\]', '"categories":"x"'), (r'"schema_version":\d+', '"schema_version":"three"'),
              (r'"audio":\{[^}]*\}', '"audio":null'), (r'"dialogue":"[^"]*"', '"dialogue":7')]
    text = F.col("text")
    for k, (old, new) in enumerate(breaks):
        text = F.when(F.col("_kind") == k, F.regexp_replace("text", old, new)).otherwise(text)
    _, bad = parse_manifests(manifests(spark, sf).join(ids, "manifest_path").select("manifest_path", text.alias("text")))
    return bad.select("manifest_path", F.array_join(F.array_distinct("problems"), ";").alias("problems"))


@query("score_rejects", _C + """ SELECT manifest_path, n = 0 AS kept, n AS refused_scores FROM (
  SELECT e.manifest_path, count(*) FILTER (WHERE e.extract_id % 3 = 0 AND c.score >= 50) AS n
  FROM c_extracts e LEFT JOIN c_clips c USING (extract_id) GROUP BY e.manifest_path) t""")
def score_rejects(spark, sf):
    """Manifests with a score outside 0 to 100 are refused as a whole and counted."""
    ids = views.catalog(spark, sf).extracts.select("manifest_path", (F.col("extract_id") % 3 == 0).alias("_bad"))
    docs = _documents(spark, sf).join(ids, "manifest_path")
    raised = F.transform("clips", lambda c: F.when(F.col("_bad") & (c["score"] >= 50), c.withField("score", c["score"] + 100)).otherwise(c))
    _, report = cat.ingest(cat.empty_catalog(spark), docs.withColumn("clips", raised).drop("_bad"))
    return report.select("manifest_path", (F.col("refused_scores") == 0).alias("kept"), F.col("refused_scores").cast("bigint").alias("refused_scores"))


def _documents(spark, sf):
    from ..sources.files import parse_manifests

    return parse_manifests(manifests(spark, sf))[0]


@query("ingest_new", _C + _MANIFESTS + """SELECT manifest_path, file_path AS source_file, created_at, clip_local_id, score, category AS categories, TRUE AS created FROM docs""")
def ingest_new(spark, sf):
    updated, report = cat.ingest(cat.empty_catalog(spark), _documents(spark, sf))
    rows = find.search(updated, limit=-1)
    return rows.join(report.select("extract_id", "created"), "extract_id").select(
        "manifest_path", "source_file", F.col("extract_created_at").alias("created_at"), "clip_local_id", "score",
        F.array_join("categories", ",").alias("categories"), "created",
    )


@query("ingest_twice", _C + """ SELECT 'sources' AS table_name, count(*) AS row_count FROM c_sources UNION ALL
SELECT 'extracts', count(DISTINCT extract_id) FROM c_clips UNION ALL SELECT 'clips', count(*) FROM c_clips UNION ALL
SELECT 'clip_categories', count(*) FROM c_clips""")
def ingest_twice(spark, sf):
    """Folding the same manifests in again changes nothing."""
    docs = written(_documents(spark, sf).filter(F.size("clips") > 0), "documents")
    once, _ = cat.ingest(cat.empty_catalog(spark), docs)
    twice, _ = cat.ingest(once, docs)
    return cat.stats(twice)


@query("ingest_moved", _C + """ SELECT '/new' || manifest_path AS manifest_path, CAST(count(*) AS BIGINT) AS clip_count, FALSE AS created
FROM c_extracts JOIN c_clips USING (extract_id) GROUP BY manifest_path""")
def ingest_moved(spark, sf):
    """A moved manifest updates its extract's path and creates nothing."""
    docs = written(_documents(spark, sf).filter(F.size("clips") > 0), "documents")
    first, _ = cat.ingest(cat.empty_catalog(spark), docs)
    moved = docs.withColumn("manifest_path", F.concat(F.lit("/new"), F.col("manifest_path")))
    second, report = cat.ingest(first, moved)
    return second.extracts.join(report.select("extract_id", "created"), "extract_id").join(
        second.clips.groupBy("extract_id").agg(F.count("*").alias("clip_count")), "extract_id"
    ).select("manifest_path", "clip_count", "created")


@query("remove_manifest", _C + """ SELECT 'sources' AS table_name, count(*) AS row_count FROM c_sources UNION ALL
SELECT 'extracts', count(*) FROM c_extracts WHERE manifest_path <> '/catalog/u3/a/manifest.json' UNION ALL
SELECT 'clips', count(*) FROM c_clips WHERE extract_id <> 6 UNION ALL
SELECT 'clip_categories', count(*) FROM c_categories JOIN c_clips USING (clip_id) WHERE extract_id <> 6""")
def remove_manifest(spark, sf):
    left, _ = cat.remove_manifest(views.catalog(spark, sf), "/catalog/u3/a/manifest.json")
    return cat.stats(left)


@query("stored_removal", _C + """ SELECT 'sources' AS table_name, count(*) AS row_count FROM c_sources UNION ALL
SELECT 'extracts', count(*) FROM c_extracts WHERE manifest_path <> '/catalog/u3/a/manifest.json' UNION ALL
SELECT 'clips', count(*) FROM c_clips WHERE extract_id <> 6 UNION ALL
SELECT 'clip_categories', count(*) FROM c_categories JOIN c_clips USING (clip_id) WHERE extract_id <> 6 UNION ALL
SELECT 'removed', count(*) FROM c_extracts WHERE manifest_path = '/catalog/u3/a/manifest.json'""")
def stored_removal(spark, sf):
    """A manifest removed from a stored catalog; only the buckets of its sources are rewritten."""
    from ..plans.session import scratch_path

    path = scratch_path(spark, "catalog")
    cat.write_catalog(views.catalog(spark, sf), path, buckets=16)
    gone = cat.remove_stored(spark, path, "/catalog/u3/a/manifest.json")
    cat.remove_stored(spark, path, "/catalog/none/manifest.json")
    counted = gone.agg(F.count("*").alias("row_count")).select(F.lit("removed").alias("table_name"), "row_count")
    return cat.stats(cat.read_catalog(spark, path)).unionByName(counted)


@query("repeated_clip_ids", _C + " SELECT manifest_path, count(*) AS clips, count(*) AS ids FROM c_extracts JOIN c_clips USING (extract_id) GROUP BY manifest_path")
def repeated_clip_ids(spark, sf):
    """Clips of one manifest that share a local id stay as many clips, each with an id of its own."""
    docs = _documents(spark, sf).withColumn("clips", F.transform("clips", lambda c: c.withField("id", F.lit("same"))))
    updated, _ = cat.ingest(cat.empty_catalog(spark), docs)
    return updated.clips.join(updated.extracts.select("extract_id", "manifest_path"), "extract_id").groupBy("manifest_path").agg(
        F.count("*").alias("clips"), F.count_distinct("clip_id").alias("ids"))


@query("ingest_summaries", _C + """ SELECT DISTINCT file_path, 'story of ' || source_id AS synopsis, 'Ann' AS cast_names
FROM c_sources JOIN c_extracts USING (source_id) WHERE source_id % 3 <> 0""")
def ingest_summaries(spark, sf):
    """Summaries that come with manifests are kept when later manifests of their sources have none."""
    from ..sources.files import manifest_json, parse_manifests

    told = views.catalog(spark, sf).source_summaries.filter("source_id % 3 <> 0")
    built = written(_built(spark, sf, told), "built")  # the later manifests differ from the first by their summary only
    first, _ = cat.ingest(cat.empty_catalog(spark), parse_manifests(manifest_json(built))[0])
    later = built.withColumn("summary", F.lit(None).cast(built.schema["summary"].dataType))
    second, _ = cat.ingest(first, parse_manifests(manifest_json(later))[0])
    return second.source_summaries.join(second.sources.select("source_id", "file_path"), "source_id").select(
        "file_path", "synopsis", F.array_join("characters.name", ",").alias("cast_names"))


@query("ingest_fingerprints", _C + """, s AS (SELECT DISTINCT source_id, file_path FROM c_sources JOIN c_extracts USING (source_id))
SELECT CASE WHEN source_id % 2 = 0 THEN 'known-' || source_id // 4 ELSE 'missing:' || file_path END AS fingerprint,
  count(*) AS paths FROM s GROUP BY ALL""")
def ingest_fingerprints(spark, sf):
    """Files of one fingerprint are one source; files that are not there have a key of their own."""
    s = views.catalog(spark, sf).sources.filter("source_id % 2 = 0")
    prints = s.select(F.col("file_path").alias("path"), F.concat(F.lit("known-"), F.floor(F.col("source_id") / 4)).alias("fingerprint"))
    docs = written(_documents(spark, sf), "documents")
    updated, report = cat.ingest(cat.empty_catalog(spark), docs, prints)
    paths = report.join(docs.select("manifest_path", F.col("source.file").alias("file_path")), "manifest_path").select("source_id", "file_path").distinct()
    return updated.sources.select("source_id", "fingerprint").join(paths, "source_id").groupBy("fingerprint").agg(F.count("*").alias("paths"))


@query("manifest_tree", _C + " SELECT e.extract_id % 4 AS folder, s.file_path AS source_file, e.created_at, count(c.clip_id) AS clips FROM c_extracts e JOIN c_sources s USING (source_id) LEFT JOIN c_clips c USING (extract_id) GROUP BY ALL")
def manifest_tree(spark, sf):
    """Manifests written into a folder for each value of a column, found in that tree by name and read strictly."""
    from ..plans.session import scratch_path
    from ..sources.files import scan_manifests

    path = scratch_path(spark, "tree")
    ids = views.catalog(spark, sf).extracts.select("manifest_path", (F.col("extract_id") % 4).alias("folder"), "extract_id")
    texts = manifests(spark, sf).join(ids, "manifest_path")
    many_files(texts.select("folder", "extract_id", "text").repartitionByRange("extract_id")).partitionBy("folder", "extract_id").text(path)
    good, _ = scan_manifests(spark, path, "*.txt")
    return good.select(F.regexp_extract("manifest_path", "folder=([0-9]+)", 1).cast("bigint").alias("folder"), F.col("source.file").alias("source_file"),
                       F.col("extract.created_at").alias("created_at"), F.size("clips").cast("bigint").alias("clips"))


@query("upgrade_old_catalog", _C + " SELECT clip_id, '' AS dialogue FROM v_clips WHERE category = 'click'")
def upgrade_old_catalog(spark, sf):
    """Tables without dialogue gain it, and the rebuilt index finds tags."""
    from ..operators.textindex import match

    c = views.catalog(spark, sf)
    old = cat.upgrade_catalog(
        c.sources, c.extracts, c.clips.drop("dialogue", "source_id"), c.clip_categories.select("clip_id", "category"),
        c.source_summaries,
    )
    hits = match(old.postings, TextQuery(all_of=["click"], fields=["tags"]))
    return old.clips.join(hits, "clip_id", "left_semi").select("clip_id", "dialogue")


@query("catalog_written", _C + " SELECT clip_id, score, source_in, extract_id FROM c_clips")
def catalog_written(spark, sf):
    """The catalog written in source buckets and read back."""
    from ..plans.session import scratch_path

    path = scratch_path(spark, "catalog")
    cat.write_catalog(views.catalog(spark, sf), path, buckets=16)
    return cat.read_catalog(spark, path).clips.select("clip_id", "score", "source_in", "extract_id")


@query("interrupted_update", _C + """ SELECT e.manifest_path, c.clip_id, c.score, k.categories
FROM c_clips c JOIN c_extracts e USING (extract_id)
JOIN (SELECT clip_id, string_agg(category, ',' ORDER BY category) AS categories FROM c_categories GROUP BY clip_id) k USING (clip_id)""")
def interrupted_update(spark, sf):
    """A stored catalog after an update of half its manifests that wrote all its tables and ended before it was published."""
    from ..plans.session import scratch_path

    path = scratch_path(spark, "catalog")
    cat.write_catalog(views.catalog(spark, sf), path, buckets=4)
    docs = _documents(spark, sf).filter(F.pmod(F.xxhash64("manifest_path"), F.lit(2)) == 0)
    cat.staged_update(spark, path, docs.withColumn("clips", F.transform("clips", lambda c: c.withField("score", F.lit(7)))))
    c = cat.read_catalog(spark, path)
    return c.clips.join(c.extracts.select("extract_id", "manifest_path"), "extract_id").select(
        "manifest_path", "clip_id", "score", F.array_join("categories", ",").alias("categories"))


@query("search_report",_C + _JOINED + """SELECT clip_id, CAST(json_extract_string(line, '$.score') AS INTEGER) AS score FROM (
  SELECT clip_id, json_object('clip_id', clip_id, 'score', score) AS line FROM joined) t""")
def search_report(spark, sf):
    """Results as JSON lines."""
    from ..sources.files import report_lines

    rows = find.search(views.catalog(spark, sf), limit=-1).select("clip_id", "score")
    lines = report_lines(rows)
    return lines.select(F.get_json_object("line", "$.clip_id").cast("bigint").alias("clip_id"),
                        F.get_json_object("line", "$.score").cast("int").alias("score"))


@query("stream_ingest", _C + """ SELECT s.file_path, e.created_at, CAST(count(*) AS BIGINT) AS clip_count, CAST(sum(score) AS BIGINT) AS total
FROM c_extracts e JOIN c_clips c USING (extract_id) JOIN c_sources s ON s.source_id = e.source_id GROUP BY ALL""")
def stream_ingest(spark, sf):
    """Manifest files folded into a stored catalog as a stream finds them."""
    from ..plans.session import scratch_path
    from ..streaming.jobs import continuous_ingest

    path = scratch_path(spark, "stream")
    texts = manifests(spark, sf).repartition("manifest_path").select("text")
    many_files(texts).option("maxRecordsPerFile", 1).text(f"{path}/in")
    continuous_ingest(spark, f"{path}/in", f"{path}/catalog", f"{path}/state", name="part-*", buckets=4).awaitTermination()
    c = cat.read_catalog(spark, f"{path}/catalog")
    return find.search(c, limit=-1).groupBy(F.col("source_file").alias("file_path"), F.col("extract_created_at").alias("created_at")).agg(
        F.count("*").alias("clip_count"), F.sum("score").alias("total"))
