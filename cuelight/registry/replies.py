"""Model replies rebuilt from the tables as dirty JSON, coerced and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semi
from ..operators import events as ev
from ..operators import plugins
from ..operators import work
from ..plans import views
from ..sources import profiles as prof
from . import query

_E = "WITH e AS (SELECT event_id, event_id % 8 AS k, event_type, user_id, CAST(floor(value) AS BIGINT) AS v FROM events)"


def replies(spark, sf):
    """One reply per event under two profiles, in eight kinds: list, fenced, prose around JSON, flat
    object, out of range, broken, scalar, too short."""
    e = views.table(spark, sf, "events")
    v = F.floor("value").cast("string")
    tag = F.when(F.col("event_id") % 3 == 0, "crash").otherwise(F.col("event_type"))
    item = lambda start, end: F.concat(
        F.lit('{"start":'), start, F.lit(',"end":'), end, F.lit(',"description":" scene '), F.col("event_id").cast("string"),
        F.lit(' ","categories":["stunt","'), tag, F.lit('",7],"base_interest":'), v,
        F.lit(',"game_signals":{"wanted_level":2,"colour":"red"},"audio_cues":["horn",null,""]}'))
    lit = F.lit
    k = F.col("event_id") % 8
    text = (
        F.when(k == 0, F.concat(lit("["), item(lit('"3.5"'), lit("9")), lit(","), item(lit("0"), lit("3.25")), lit("]")))
        .when(k == 1, F.concat(lit('```json\n{"events":['), item(lit("1"), lit("8")), lit("]}\n```")))
        .when(k == 2, F.concat(lit('Here it is: {"events":['), item(lit("2"), lit("7.5")), lit("]} done")))
        .when(k == 3, item(lit("4"), lit("6")))
        .when(k == 4, F.concat(lit('{"events":['), item(lit("-2"), lit("100")), lit(',"junk"]}')))
        .when(k == 5, F.concat(lit('{"events":['), item(lit("1"), lit("8"))))
        .when(k == 6, v)
        .otherwise(F.concat(lit('{"events":['), item(lit("5"), lit("5.5")), lit("]}")))
    )
    return e.select(F.col("event_id").alias("chunk_id"), F.when(F.col("event_id") % 5 == 4, "movie").otherwise("gta").alias("profile"), F.lit(12.0).alias("duration"), text.alias("text"))


@query("coerced_replies", _E + """, x AS (
  SELECT event_id AS chunk_id, CAST(n AS INTEGER) AS event_no,
    CASE k WHEN 0 THEN CASE n WHEN 0 THEN 0.0 ELSE 3.5 END WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 4.0 ELSE 0.0 END AS s,
    CASE k WHEN 0 THEN CASE n WHEN 0 THEN 3.25 ELSE 9.0 END WHEN 1 THEN 8.0 WHEN 2 THEN 7.5 WHEN 3 THEN 6.0 ELSE 12.0 END AS e,
    CASE k WHEN 5 THEN '(analyzer failed to return valid JSON)' WHEN 6 THEN '(analyzer returned unexpected JSON shape)'
      ELSE 'scene ' || event_id END AS description,
    CASE WHEN k IN (5, 6) OR event_id % 5 = 4 THEN '' WHEN event_id % 3 = 0 THEN 'stunt,crash' ELSE 'stunt' END AS categories,
    CASE WHEN k IN (5, 6) THEN 0 ELSE CAST(least(v, 100) AS INTEGER) END AS base_interest,
    CASE WHEN k IN (5, 6) OR event_id % 5 = 4 THEN '{}' ELSE '{"wanted_level":2}' END AS game_signals,
    CASE WHEN k IN (5, 6) THEN '' ELSE 'horn' END AS audio_cues
  FROM e, unnest(range(0, CASE WHEN k = 0 THEN 2 ELSE 1 END)) t(n))
SELECT chunk_id, event_no, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end", description, categories, base_interest, game_signals, audio_cues FROM x""")
def coerced_replies(spark, sf):
    out = ev.coerce_replies(replies(spark, sf), prof.whitelists(prof.builtin_profiles(spark)))
    return out.withColumns({"categories": F.array_join("categories", ","), "audio_cues": F.array_join("audio_cues", ",")})


@query("tolerant_json", _E + " SELECT event_id AS chunk_id, CASE k WHEN 5 THEN 'none' WHEN 6 THEN 'scalar' WHEN 0 THEN 'list' ELSE 'object' END AS kind FROM e")
def tolerant_json(spark, sf):
    doc = semi.tolerant_json(F.col("text"))
    return replies(spark, sf).select("chunk_id", F.when(doc.isNull(), "none").when(semi.is_list(doc), "list").when(
        semi.is_object(doc), "object").otherwise("scalar").alias("kind"))


@query("replies_with_blanks", """SELECT event_id AS chunk_id, CAST(n AS INTEGER) AS event_no, CAST(n * 6 AS DOUBLE) AS "start", CAST(n * 6 + 4 AS DOUBLE) AS "end",
  CASE n WHEN 0 THEN 'scene ' || event_id ELSE '(no description)' END AS description, CASE n WHEN 0 THEN '0|false|horn' ELSE '' END AS audio_cues
  FROM events, unnest(range(0, 2)) t(n)""")
def replies_with_blanks(spark, sf):
    """White space of any kind around and inside replies, fences, prose, repeated keys, and cues that look empty."""
    e = views.table(spark, sf, "events")
    k = F.col("event_id") % 4
    body = F.concat(
        F.lit('[\n\t{"start": 9, "start": 0,\r\n "end": "4\\n", "description": "\\u00a0\\n scene '), F.col("event_id").cast("string"),
        F.lit('\\t\\n", "audio_cues": ["0", "false", 0, false, null, "", "horn"]},\n{"start":\t6, "end": 10, "description": "\\n\\u3000"}\n]'))
    text = (
        F.when(k == 0, F.concat(F.lit("\n```json\n"), body, F.lit("\n```\n")))
        .when(k == 1, F.concat(F.lit("\t\r\n"), body, F.lit("\n\n")))
        .when(k == 2, F.concat(F.lit('Sure:\n{"events":\n'), body, F.lit("\n}\nthat is all")))
        .otherwise(F.concat(F.lit("```\n{\"events\": [], \"events\":"), body, F.lit("}\n\t```")))
    )
    rows = e.select(F.col("event_id").alias("chunk_id"), F.lit("movie").alias("profile"), F.lit(12.0).alias("duration"), text.alias("text"))
    out = ev.coerce_replies(rows, prof.whitelists(prof.builtin_profiles(spark)))
    return out.select("chunk_id", "event_no", "start", "end", "description", F.array_join("audio_cues", "|").alias("audio_cues"))


@query("coerced_beats", """SELECT o_orderkey, CAST(n AS INTEGER) AS beat_no, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end", title FROM (
  SELECT o_orderkey, 0 AS n, 0.0 AS s, 30.0 AS e, 'Untitled beat' AS title FROM orders UNION ALL
  SELECT o_orderkey, 1, 20.0 + o_orderkey % 50, 90.0, 'late ' || o_orderkey FROM orders) t""")
def coerced_beats(spark, sf):
    o = views.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    doc = F.concat(
        F.lit('[{"title":"late '), key, F.lit('","start":"'), (key % 50 + 20).cast("string"),
        F.lit('","end":500},{"title":" ","start":-4,"end":30,"summary":"s"},{"title":"inverted","start":50,"end":40},3,{"start":"x"}]'))
    beats = semi.coerced_beats(F.try_parse_json(doc), F.lit(90.0))
    return o.select("o_orderkey", F.posexplode(beats).alias("beat_no", "b")).select(
        "o_orderkey", "beat_no", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.title").alias("title"))


@query("coerced_cast", "SELECT c_custkey, c_name || ':lead|Bo:' AS people, 'time,loss' AS themes FROM customer")
def coerced_cast(spark, sf):
    c = views.table(spark, sf, "customer")
    doc = F.try_parse_json(F.concat(F.lit('{"cast":[{"name":" '), "c_name", F.lit('","role":"lead "},{"name":" "},{"role":"x"},4,{"name":"Bo"}],"themes":[" time ","","loss"]}')))
    people = semi.coerced_characters(semi.get(doc, "$.cast", "variant"))
    return c.select(
        "c_custkey", F.array_join(F.transform(people, lambda p: F.concat(p["name"], F.lit(":"), p["role"])), "|").alias("people"),
        F.array_join(semi.text_list(semi.get(doc, "$.themes", "variant")), ",").alias("themes"))


class Echo:
    """A stand-in analyzer that answers from the task and fails on every seventh."""

    def __call__(self, task: dict) -> str:
        if task["event_id"] % 7 == 0:
            raise plugins.PermanentError("no answer")
        return '{"events":[{"start":0,"end":5,"base_interest":%d}]}' % (task["event_id"] % 100)


@query("analyzer_calls", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 100 AS INTEGER) END AS base_interest,
  CASE WHEN event_id % 7 = 0 THEN 'PermanentError: no answer' END AS error FROM events""")
def analyzer_calls(spark, sf):
    tasks = views.table(spark, sf, "events").select("event_id")
    out = plugins.call_model(tasks, Echo(), attempts=2, base_delay=0.0)
    return out.select("event_id", F.get_json_object("payload", "$.events[0].base_interest").cast("int").alias("base_interest"), "error")


class Rework:
    """A stand-in text model: one event for all of a source, no JSON for some, an error for others."""

    def __call__(self, task: dict) -> str:
        if task["source_id"] % 5 == 0:
            raise plugins.PermanentError("no answer")
        return "no events here" if task["source_id"] % 5 == 1 else '{"events":[{"start":1,"end":7,"description":"all","base_interest":50}]}'


@query("refined_events", """SELECT user_id AS source_id, CASE WHEN user_id % 5 < 2 OR count(*) < 2 THEN count(*) ELSE 1 END AS n,
  CAST(CASE WHEN user_id % 5 < 2 OR count(*) < 2 THEN min(event_id % 100) ELSE 1 END AS DOUBLE) AS first_start,
  CASE WHEN user_id % 5 < 2 OR count(*) < 2 THEN min(event_type) ELSE 'all' END AS description FROM events GROUP BY user_id""")
def refined_events(spark, sf):
    """Events reworked by a text model; a source whose call fails or whose reply is no JSON keeps its own."""
    e = views.table(spark, sf, "events")
    start = (F.col("event_id") % 100).cast("double")
    given = e.select(
        F.col("user_id").alias("source_id"), start.alias("start"), (start + 2).alias("end"), F.col("event_type").alias("description"),
        F.array().cast("array<string>").alias("categories"), F.lit(5).alias("base_interest"), F.lit("{}").alias("game_signals"),
        F.array().cast("array<string>").alias("audio_cues"))
    tasks = given.groupBy("source_id").agg(F.lit("movie").alias("profile"), F.lit(120.0).alias("duration"), F.count("*").alias("events"))
    results = plugins.call_model(tasks, Rework(), attempts=1, base_delay=0.0)
    out = ev.refine_events(given, results, prof.whitelists(prof.builtin_profiles(spark)))
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.min("description").alias("description"))


@query("recorded_work", "SELECT CASE WHEN event_id % 7 = 0 THEN 'open' ELSE 'done' END AS state, count(*) AS n FROM events GROUP BY ALL")
def recorded_work(spark, sf):
    """Failures are not recorded as done, so the next run takes them up again."""
    from ..plans.session import checkpointed

    tasks = views.table(spark, sf, "events").select("event_id", work.content_key(F.col("event_id"), F.lit("v1")).alias("key"))
    results = checkpointed(plugins.call_model(tasks, Echo(), attempts=1, base_delay=0.0))
    done = work.record(spark.createDataFrame([], work.DONE_SCHEMA), results, "analysis")
    counted = lambda df, state: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "n")
    return counted(done, "done").unionByName(counted(work.pending(tasks, done, "analysis"), "open"))


class Count:
    """A stand-in analyzer that is lost while it works on one batch of tasks, or never."""

    def __init__(self, lost_at: int | None):
        self.lost_at = lost_at

    def __call__(self, task: dict) -> str:
        if task["event_id"] == self.lost_at:
            raise SystemExit("the worker is gone")
        return '{"run":%d}' % (1 if self.lost_at is not None else 2)


@query("resumed_calls", "SELECT CAST(NULL AS VARCHAR) AS error, count(*) AS n, TRUE AS some_kept FROM events")
def resumed_calls(spark, sf):
    """Calls of a run that was lost half-way, and of the run after it: what the first one recorded is not called again."""
    from ..plans.session import scratch_path

    path = scratch_path(spark, "work")
    tasks = views.table(spark, sf, "events").select("event_id", work.content_key(F.col("event_id"), F.lit("v2")).alias("key"))
    size = -(-tasks.count() // 4)
    last = tasks.orderBy(F.desc(F.pmod(F.xxhash64("key"), F.lit(4))), "event_id").first()["event_id"]  # in the last batch
    try:
        plugins.resumable_calls(tasks, Count(last), path, "analysis", size, attempts=1).count()
    except Exception as lost:  # noqa: BLE001
        if "the worker is gone" not in str(lost):
            raise
    out = plugins.resumable_calls(tasks, Count(None), path, "analysis", size, attempts=1)
    runs = F.get_json_object("payload", "$.run")
    return out.groupBy("error").agg(F.count("*").alias("n"), ((F.count_if(runs == "1") > 0) & (F.count_if(runs == "2") > 0)).alias("some_kept"))


@query("edited_cut_lists", """SELECT o_custkey AS source_id, count(*) AS open_chunks FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey""")
def edited_cut_lists(spark, sf):
    """Analysis that is open again after some cut lists were edited: all chunks of their sources, and no other."""
    o = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") * 10).cast("double").alias("start"), (F.col("o_orderkey") * 10 + 5).cast("double").alias("end"))
    sources = o.select("source_id").distinct().select("source_id", F.concat(F.lit("fp"), "source_id").alias("fingerprint"), F.lit("manual").alias("segmenter"))
    chunks = o.withColumn("profile", F.lit("gta"))
    keys = lambda cuts: work.analysis_keys(sources, cuts, chunks, ["profile"])
    done = keys(o).select(F.lit("analysis").alias("namespace"), "key", F.lit("{}").alias("payload"))
    edited = o.unionByName(sources.filter("source_id % 7 = 0").select("source_id", F.lit(0.5).alias("start"), F.lit(1.5).alias("end")))
    return work.pending(keys(edited), done, "analysis").groupBy("source_id").agg(F.count("*").alias("open_chunks"))


@query("rendered_prompts", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Watch 12.0 s of film scene in 12 frames (4x3). Tags: establishing, dialogue, action, chase, fight, romance, montage, flashback, comedy_beat, emotional_beat, credits'
  ELSE 'Watch 12.0 s of podcast or interview in 12 frames (4x3). Tags: intro, monologue, interview, debate, joke, story, ad_read, outro' END AS prompt FROM events""")
def rendered_prompts(spark, sf):
    from ..operators.rollup import render_prompts

    chunks = views.table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "movie").otherwise("podcast").alias("profile"), F.lit(0.0).alias("start"), F.lit(12.0).alias("end"))
    template = "Watch {duration} s of {subject} in {frames} frames ({columns}x{rows}). Tags: {taxonomy}"
    return render_prompts(chunks, prof.builtin_profiles(spark).drop("template"), template).select("event_id", "prompt")


@query("request_sizes", views.with_views("clips") + """, f AS (SELECT clip_id, source_id, CAST(least(16, greatest(6, floor(duration))) AS INTEGER) AS frames FROM v_clips),
g AS (SELECT *, CAST(ceil(sqrt(frames)) AS INTEGER) AS c FROM f)
SELECT source_id, count(*) AS chunks, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(10 + 256 * frames) AS BIGINT) AS tokens,
  CAST(sum(c * ceil(frames / c)) AS BIGINT) AS cells FROM g GROUP BY source_id""")
def request_sizes(spark, sf):
    from ..operators.rollup import run_totals, size_requests

    chunks = views.clips(spark, sf).select("clip_id", "source_id", F.col("source_in").alias("start"), F.col("source_out").alias("end"))
    sized = size_requests(chunks, F.lit("0123456789" * 4 + "abc"))
    cells = sized.groupBy("source_id").agg(F.sum(F.col("grid_columns") * F.col("grid_rows")).alias("cells"))
    return run_totals(sized).join(cells, "source_id")


@query("profile_whitelist", """SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY event_type""")
def profile_whitelist(spark, sf):
    """Categories kept by a custom profile read from JSON text."""
    texts = spark.createDataFrame([('{"name":"shop","taxonomy":["view","error"],"signals":[]}',)], "text string")
    custom, _ = prof.parse_profiles(texts)
    allowed = prof.taxonomy_rows(prof.load_profiles(spark, ["shop"], custom))
    e = views.table(spark, sf, "events")
    return e.join(allowed.select(F.col("category").alias("event_type")), "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("context_keys", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no-context'
  ELSE substr(sha256('' || chr(0) || c_name || chr(0) || '' || chr(1) || 'a.png'), 1, 16) END AS key FROM customer""")
def context_keys(spark, sf):
    c = views.table(spark, sf, "customer")
    none = F.array().cast("array<struct<name:string,description:string,images:array<string>>>")
    people = F.when(F.col("c_custkey") % 5 == 0, none).otherwise(F.array(F.struct(
        F.col("c_name").alias("name"), F.lit("").alias("description"), F.array(F.lit("a.png")).alias("images"))))
    return c.select("c_custkey", work.context_key(F.lit(" "), people).alias("key"))


class Watch:
    """A stand-in analyzer of chunks of 20 seconds: no answer, an event with a tail over it, a short event, the whole chunk."""

    def __call__(self, task: dict) -> str:
        kind, tag = task["chunk_id"] % 4, ("stunt", "crash")[task["chunk_id"] % 2]
        if kind == 0:
            raise plugins.PermanentError("no answer")
        spans = {1: [(1, 12.5), (12, 14)], 2: [(5, 11)], 3: [(0, 25)]}[kind]
        events = ",".join(f'{{"start":{a},"end":{b},"description":"part {task["chunk_id"]}","categories":["{tag}","none"],'
                          f'"base_interest":{task["chunk_id"] % 90},"game_signals":{{"wanted_level":{kind},"x":1}}}}' for a, b in spans)
        return f"Found:\n{{\"events\":[{events}]}}"


_EXTRACT = views.with_views("clips", "sources", "samples", "cues") + """, src AS (SELECT source_id, CAST(ceil(duration) AS DOUBLE) AS duration FROM v_sources),
ch AS (SELECT source_id, source_id * 4096 + n AS chunk_id, n * 20.0 AS s0 FROM src, unnest(range(0, CAST(floor(duration / 20.0) AS BIGINT))) t(n)),
ev AS (SELECT source_id, chunk_id, chunk_id % 4 AS k, CAST(s0 + CASE chunk_id % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 3.0 ELSE 0.0 END AS DOUBLE) AS s,
  CAST(s0 + CASE chunk_id % 4 WHEN 1 THEN 12.5 WHEN 2 THEN 13.0 ELSE 20.0 END AS DOUBLE) AS e FROM ch WHERE chunk_id % 4 <> 0),
lv AS (SELECT source_id, min(db) AS lo, max(db) AS hi FROM v_samples GROUP BY source_id),
pk AS (SELECT ev.source_id, chunk_id, k, s, e, max(db) AS peak FROM ev LEFT JOIN v_samples a ON a.source_id = ev.source_id AND a.t BETWEEN s AND e GROUP BY ALL),
said AS (SELECT chunk_id, string_agg(text, ' ' ORDER BY c."start", cue_no) AS text FROM ev JOIN v_cues c ON c.source_id = ev.source_id AND c."start" < e AND c."end" > s GROUP BY chunk_id)
SELECT '/out/' || p.source_id || '/manifest.json' AS manifest_path, '/media/u' || p.source_id || '.mp4' AS source_file,
  printf('clip_%02d', row_number() OVER (PARTITION BY p.source_id ORDER BY s)) AS clip_local_id, s AS source_in, e AS source_out,
  'part ' || chunk_id AS description, CASE chunk_id % 2 WHEN 0 THEN 'stunt' ELSE 'crash' END AS categories,
  CAST(round_even(CAST(0.7 AS DOUBLE) * (chunk_id % 90) + CAST(0.3 AS DOUBLE) * coalesce(round_even((peak - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 100.0, 2), 0.0), 0) AS INTEGER) AS score,
  '{"wanted_level":' || k || '}' AS game_signals, round_even(peak, 2) AS peak_loudness_db,
  coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS dialogue
FROM pk p LEFT JOIN lv USING (source_id) LEFT JOIN said USING (chunk_id)"""


@query("extract_pipeline", _EXTRACT)
def extract_pipeline(spark, sf):
    """From chunks of recordings to manifests that are written, found and read back: replies, pruning, stretching, levels,
    dialogue, numbers and scores."""
    from ..operators.extract import extract_manifests
    from ..operators.segments import interval_segments
    from ..plans.session import scratch_path
    from ..sources.files import manifest_json, parse_manifests

    sources = views.sources(spark, sf).select(
        "source_id", F.concat(F.lit("/media/u"), "source_id", F.lit(".mp4")).alias("file_path"), F.ceil("duration").cast("double").alias("duration"),
        F.lit("1920x1080").alias("resolution"), F.lit(30.0).alias("fps"))
    tiles = interval_segments(sources, 20.0, 0.0).filter(F.col("end") - F.col("start") >= 20.0)
    chunks = tiles.select((F.col("source_id") * 4096 + F.col("tile_no")).alias("chunk_id"), "source_id", "start", "end", F.lit("gta").alias("profile"))
    results = plugins.call_model(chunks.select("chunk_id"), Watch(), attempts=1, base_delay=0.0)
    extracts = sources.select(
        F.col("source_id").alias("extract_id"), "source_id", F.concat(F.lit("/out/"), "source_id", F.lit("/manifest.json")).alias("manifest_path"),
        F.lit("interval").alias("segmenter"), F.lit("stand-in").alias("analyzer"), F.lit("gta").alias("game_profile"),
        F.lit("2024-05-01T10:00:00+00:00").alias("created_at"), F.array(F.lit("stunt")).alias("taxonomy"))
    docs = extract_manifests(sources, extracts, chunks, results, prof.whitelists(prof.builtin_profiles(spark)), views.samples(spark, sf), views.cues(spark, sf))
    path = scratch_path(spark, "extracted")
    manifest_json(docs).write.json(path)
    good, _ = parse_manifests(spark.read.schema("manifest_path string, text string").json(path))
    return good.select("manifest_path", F.col("source.file").alias("source_file"), F.explode("clips").alias("c")).select(
        "manifest_path", "source_file", F.col("c.id").alias("clip_local_id"), "c.source_in", "c.source_out", "c.description",
        F.array_join("c.categories", ",").alias("categories"), "c.score", "c.game_signals",
        F.col("c.audio.peak_loudness_db").alias("peak_loudness_db"), "c.dialogue")
