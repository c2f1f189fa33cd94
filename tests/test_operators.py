"""Small-input behaviour of ranges, signals, events, subtitles and scalar functions."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelight.functions import numeric, semi, text
from cuelight.functions.stem import stem
from cuelight.operators import captions, events, plugins, rollup, segments, signal, subtitles, work
from cuelight.sources import files, profiles


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_iou(spark):
    cases = [((0, 10), (5, 15), 1 / 3), ((0, 10), (10, 20), 0.0), ((0, 10), (0, 10), 1.0), ((5, 5), (0, 10), 0.0)]
    for a, b, want in cases:
        got = one(spark, numeric.iou(*[F.lit(float(x)) for x in (*a, *b)]))
        assert got == pytest.approx(want)


def test_merge_thresholds(spark):
    ddl = "source_id long, pos long, start double, end double"
    r = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 1.0, 11.0), (1, 2, 50.0, 60.0)], ddl)
    assert rows(segments.merge_overlapping(r, 0.5), "start", "end") == [(0.0, 11.0), (50.0, 60.0)]
    r = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 5.0, 15.0)], ddl)
    assert rows(segments.merge_overlapping(r, 0.99), "start", "end") == [(0.0, 10.0), (5.0, 15.0)]
    with pytest.raises(ValueError):
        segments.merge_overlapping(r, 0.0)


def test_clamp_and_tiles(spark):
    r = spark.createDataFrame([(1, 0.0, 5.0, 400.0), (1, 10.0, 200.0, 400.0), (1, 300.0, 320.0, 400.0)],
                              "source_id long, start double, end double, duration double")
    assert rows(segments.clamp_ranges(r, 15, 60), "start", "end") == [(10.0, 70.0), (300.0, 320.0)]
    s = spark.createDataFrame([(1, 150.0)], "source_id long, duration double")
    assert rows(segments.interval_segments(s, 60.0), "start", "end") == [(0.0, 60.0), (55.0, 115.0), (110.0, 150.0)]
    assert segments.interval_segments(s, 0.0).count() == 0
    r = spark.createDataFrame([(1, 0.0, 1000.0)], "source_id long, start double, end double")
    assert rows(segments.split_ranges(r, 480.0), "start", "end") == [(0.0, 480.0), (480.0, 960.0), (960.0, 1000.0)]
    assert segments.split_ranges(r, 0.0).count() == 0


def test_sample_times(spark):
    r = spark.createDataFrame([(1, 10.0, 20.0)], "source_id long, start double, end double")
    assert rows(segments.sample_times(r, 2), "t") == [(12.5,), (17.5,)]
    assert segments.sample_times(r, 0).count() == 0


def test_timestamps(spark):
    for given, want in [("30", 30.0), ("1:30", 90.0), ("01:00:05", 3605.0), ("0:00:01.500", 1.5), ("", None), ("1:2:3:4", None), ("x", None)]:
        assert one(spark, text.parse_timestamp(F.lit(given))) == want
    for given, want in [(65.25, "1:05.250"), (3605.0, "1:00:05.000"), (-4.0, "0:00.000")]:
        assert one(spark, text.format_timestamp(F.lit(given))) == want


def test_cut_list_file(spark, tmp_path):
    (tmp_path / "cuts.csv").write_text("0,5\n1:00,1:10\n# a comment\n\n9,3\nlonely\n")
    good, bad = files.scan_cut_list(spark, str(tmp_path))
    assert rows(good, "start", "end") == [(0.0, 5.0), (60.0, 70.0)]
    assert rows(bad, "line") == [("9,3",), ("lonely",)]


def test_peaks_and_levels(spark):
    levels = [-40, -30, -20, -25, -35, -30, -10, -5, -10, -20, -40]
    data = [("a", i * 0.5, float(v)) for i, v in enumerate(levels)] + [("a", 90.0, float("nan")), ("a", 91.0, float("-inf"))]
    s = spark.createDataFrame(data, "source_id string, t double, db double")
    assert [t for t, in rows(signal.detect_peaks(s, 0.6, 0.5), "t")] == [1.0, 3.5]
    s = spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate([-60, -50, -40, -10, -50, -60])],
                              "source_id string, t double, db double")
    r = spark.createDataFrame([(1, "a", 2.0, 4.0), (2, "a", 80.0, 90.0)], "id long, source_id string, start double, end double")
    got = {x.id: (x.audio_factor, x.peak_db) for x in signal.score_audio(r, s, "id").collect()}
    assert got == {1: (100.0, -10.0), 2: (0.0, None)}


def test_index_quantile_is_not_a_percentile(spark):
    s = spark.createDataFrame([(1, float(i), float(i)) for i in range(1, 11)], "source_id long, t double, db double")
    assert rows(signal.index_quantile(s, 0.85)) == [(1, 8.0)]


def test_blend_score(spark):
    for interest, audio, want in [(100, 0.0, 70), (0, 100.0, 30), (-5, 200.0, 30), (50, 50.0, 50)]:
        assert one(spark, numeric.blend_score(F.lit(interest), F.lit(audio))) == want


def test_chunks_cut_at_a_trough(spark):
    quiet = {28, 29, 30, 31, 32, 60, 61, 62}
    s = spark.createDataFrame([(1, float(t), -60.0 if t in quiet else -10.0) for t in range(120)], "source_id long, t double, db double")
    seg = spark.createDataFrame([(1, 0, 0.0, 120.0)], "source_id long, seg_no int, start double, end double")
    chunks = rows(segments.chunk_segments(seg, s), "start", "end")
    assert chunks[0][0] == 0.0 and 28 <= chunks[0][1] - 5 <= 32 and chunks[-1][1] == 120.0
    assert all(a[1] > b[0] for a, b in zip(chunks, chunks[1:]))


def test_chunks_without_samples(spark):
    none = spark.createDataFrame([], "source_id long, t double, db double")
    seg = spark.createDataFrame([(1, 0, 10.0, 160.0), (1, 1, 0.0, 40.0)], "source_id long, seg_no int, start double, end double")
    chunks = rows(segments.chunk_segments(seg, none), "seg_no", "start", "end")
    assert (1, 0.0, 40.0) in chunks
    long = [c for c in chunks if c[0] == 0]
    assert long[0][1] == 10.0 and long[-1][2] == 160.0 and all(c[2] - c[1] <= 55 for c in long)


SHOP = ["crash", "stunt"]


def coerced(spark, reply, duration=12.0):
    p = spark.createDataFrame([("p", SHOP, ["wanted_level"])], "profile string, taxonomy array<string>, signal_keys array<string>")
    r = spark.createDataFrame([("c", "p", duration, reply if isinstance(reply, str) else json.dumps(reply))],
                              "chunk_id string, profile string, duration double, text string")
    return events.coerce_replies(r, p).orderBy("event_no").collect()


def event(start, end, **more):
    return {"start": start, "end": end, "description": "d", **more}


def test_coercion_cases(spark):
    got = coerced(spark, {"events": [event(6, 12), event(0, 5)]})
    assert [(e.start, e.end) for e in got] == [(0.0, 5.0), (6.0, 12.0)]
    assert [(e.start, e.end) for e in coerced(spark, {"events": [event(-2, 100)]})] == [(0.0, 12.0)]
    got = coerced(spark, {"events": [event(0, 8, categories=["crash", "nope", 3], game_signals={"wanted_level": 2, "x": 1},
                                           base_interest="140", audio_cues=["a", None, ""])]})[0]
    assert got.categories == ["crash"] and json.loads(got.game_signals) == {"wanted_level": 2}
    assert got.base_interest == 100 and got.audio_cues == ["a"]
    assert [(e.start, e.end, e.description) for e in coerced(spark, {"events": [event(0, 0.5)]})] == [(0.0, 12.0, "d")]
    assert coerced(spark, {"events": []})[0].description == semi.NO_DESCRIPTION
    assert [(e.start, e.end) for e in coerced(spark, {"description": "flat"})] == [(0.0, 12.0)]
    assert [e.base_interest for e in coerced(spark, {"events": [event(0, 10, base_interest=20), event(1, 9, base_interest=80)]})] == [80]
    assert [(e.start, e.end) for e in coerced(spark, {"events": [event(0, 6), event(5, 12)]})] == [(0.0, 6.0), (6.0, 12.0)]
    assert coerced(spark, "nothing here")[0].description == semi.BAD_JSON
    assert coerced(spark, "7")[0].description == semi.BAD_SHAPE
    assert coerced(spark, "[3]")[0].description == semi.NO_USABLE_EVENTS
    assert coerced(spark, {"events": [event("x", 5)]})[0].end == 12.0
    assert coerced(spark, {"events": [event(0, 8, base_interest=4.7)]})[0].base_interest == 4
    assert coerced(spark, {"events": [event(0, 8, base_interest="4.7")]})[0].base_interest == 0


def test_minimum_duration_drops_what_cannot_stretch(spark):
    e = spark.createDataFrame([(1, 1, 0.0, 12.0, 14.0), (1, 2, 12.0, 13.0, 14.0)],
                              "source_id long, event_id long, start double, end double, duration double")
    assert rows(events.enforce_min_duration(e), "event_id", "start", "end") == [(1, 0.0, 12.0)]


SRT = """1
00:00:01,000 --> 00:00:04,000
Hello there.

2
00:00:05,500 --> 00:00:08,000
<i>General Kenobi.</i>
You are a bold one.

3
\x01 00:01:00,5 --> 00:01:02,000
Late

no timing here

4
00:00:10,000 --> 00:00:50,000
too long
"""


def test_subtitles(spark):
    f = spark.createDataFrame([("a", SRT)], "source_id string, content string")
    cues = subtitles.parse_subtitles(f, "source_id")
    assert rows(cues, "start", "end", "text") == [
        (1.0, 4.0, "Hello there."), (5.5, 8.0, "General Kenobi. You are a bold one."), (60.5, 62.0, "Late")]
    r = spark.createDataFrame([(1, "a", 5.0, 9.0), (2, "a", 0.0, 10.0), (3, "a", 4.2, 5.2)],
                              "id long, source_id string, start double, end double")
    said = dict(rows(subtitles.dialogue_for_ranges(r, cues, "id"), "id", "dialogue"))
    assert said == {1: "General Kenobi. You are a bold one.", 2: "Hello there. General Kenobi. You are a bold one.", 3: ""}
    clip = spark.createDataFrame([(7, "a", 3.0, 4.0)], "clip_id long, source_id string, source_in double, duration double")
    assert rows(subtitles.cues_for_clips(clip, cues), "start", "end") == [(0.0, 1.0), (2.5, 4.0)]


def test_subtitle_files_and_sidecars(spark, tmp_path):
    (tmp_path / "movie.srt").write_bytes("﻿1\n00:00:01,000 --> 00:00:02,000\nHi \n".encode() + b"\xff")
    (tmp_path / "movie.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\n{an8}Hey\n")
    found = files.scan_subtitle_files(spark, str(tmp_path))
    videos = spark.createDataFrame([(f"{tmp_path}/movie.mp4",), (f"{tmp_path}/other.mp4",)], "video string")
    chosen = files.resolve_sidecars(videos, found.select("path"))
    assert dict(rows(chosen)) == {f"{tmp_path}/movie.mp4": f"{tmp_path}/movie.srt", f"{tmp_path}/other.mp4": None}
    assert all(not r.content.startswith("﻿") for r in found.collect())
    assert rows(subtitles.parse_subtitles(found), "text")[0] == ("Hey",)


def test_loudness_log(spark):
    log = "[x @ 1] frame:0 pts:0 pts_time:0\nlavfi.astats.Overall.RMS_level=-20.5\nframe:1 pts_time:0.5\n" \
          "lavfi.astats.Overall.RMS_level=-inf\nlavfi.astats.Overall.RMS_level=oops\nframe:2 pts_time:bad\nlavfi.astats.Overall.RMS_level=-3\n"
    logs = spark.createDataFrame([("a", log)], "path string, text string")
    assert rows(files.parse_loudness_log(logs), "t", "db") == [(0.0, -20.5), (0.5, float("-inf"))]


def test_fingerprints_follow_size(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"12")
    first = rows(files.fingerprint_files(spark, str(tmp_path)))
    assert first == rows(files.fingerprint_files(spark, str(tmp_path)))
    (tmp_path / "a.mp4").write_bytes(b"123")
    assert first != rows(files.fingerprint_files(spark, str(tmp_path)))


def aligned(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "utterance_id long, text string")
    return captions.spread_text(df, 0.05)


def test_caption_phrases(spark):
    p = captions.phrase_alignments(aligned(spark, "Hello world. How are you?"), 10, 100)
    assert [r[0] for r in rows(p, "text")] == ["Hello world.", "How are you?"]
    p = captions.phrase_alignments(aligned(spark, "one two three four five six"), 3, 100)
    assert [r[0] for r in rows(p, "text")] == ["four five six", "one two three"]
    (start, end), = rows(captions.phrase_alignments(aligned(spark, "Hi."), min_seconds=1.0), "start", "end")
    assert end - start >= 1.0
    got = rows(captions.phrase_alignments(aligned(spark, "Hi. Yo."), min_seconds=5.0), "start", "end")
    assert got[0][1] <= got[1][0]
    assert captions.phrase_alignments(aligned(spark, "... !!")).count() == 0


def test_word_timing_and_characters(spark):
    t = spark.createDataFrame([(1, " one 12 three ")], "utterance_id long, text string")
    words = captions.word_positions(captions.split_words(t))
    assert rows(words, "word", "char_start", "char_end") == [("12", 5, 7), ("one", 1, 4), ("three", 8, 13)]
    known = {0: (0.5, 1.0), 2: (2.0, 2.5)}
    start = F.when(F.col("word_no") == 0, 0.5).when(F.col("word_no") == 2, 2.0)
    end = F.when(F.col("word_no") == 0, 1.0).when(F.col("word_no") == 2, 2.5)
    timed = captions.assign_word_timings(words.withColumns({"start": start, "end": end}))
    assert dict((w, (s, e)) for w, s, e in rows(timed, "word_no", "start", "end")) == {**known, 1: (1.5, 1.5)}
    chars = rows(captions.character_times(timed), "pos", "start", "end")
    assert [c[0] for c in chars] == list(range(14))
    assert all(a[1] <= b[1] + 1e-9 and a[1] <= a[2] for a, b in zip(chars, chars[1:]))
    assert one(spark, text.normal_word(F.lit("12"))) == "" and one(spark, text.normal_word(F.lit("Don't!"))) == "don't"


def test_stemmer_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
             "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "triplicate": "triplic",
             "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt",
             "effective": "effect", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener"}
    assert {w: stem(w) for w in pairs} == pairs


def test_beats_and_characters(spark):
    doc = F.parse_json(F.lit('[{"start":80,"end":400},{"start":30,"end":20},{"start":0,"end":30,"title":"a"}]'))
    got = one(spark, semi.coerced_beats(doc, F.lit(90.0)))
    assert [(b.start, b.end, b.title) for b in got] == [(0.0, 30.0, "a"), (80.0, 90.0, "Untitled beat")]


def test_sixty_scenes_make_two_windows(spark):
    scenes = spark.createDataFrame([(1, i, i * 10.0, i * 10.0 + 9, f"s{i}", "") for i in range(60)],
                                   "source_id long, clip_id long, start double, end double, description string, dialogue string")
    line = rollup.scene_line(F.col("start"), F.col("end"), F.col("description"), F.col("dialogue"))
    windows = rollup.scene_windows(scenes, line)
    assert rows(windows, "window_no", "scenes") == [(0, 30), (1, 30)]
    reply = F.concat(F.lit('{"synopsis":"part","characters":[{"name":"Ann"},{"name":"ANN"}],"beats":[{"title":"b","start":'),
                     F.col("start").cast("string"), F.lit(',"end":'), F.col("end").cast("string"), F.lit("}]}"))
    read = rollup.read_window_summaries(windows.select("source_id", "window_no", F.lit(700.0).alias("duration"), reply.alias("text")))
    s = rollup.summarize_sources(read)
    assert rows(s.texts, "synopsis") == [("part part",)]
    assert rows(s.cast, "pos", "name") == [(0, "Ann")] and rows(s.beats, "pos", "start") == [(0, 0.0), (1, 300.0)]
    empty = read.withColumns({"synopsis": F.lit(""), "beats": F.slice("beats", 1, 0)})
    assert rollup.summarize_sources(empty).texts.count() == 0


def test_synopses_are_reduced_level_by_level(spark):
    words = [f"w{i} " + "x" * (i % 7) for i in range(95)]
    windows = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)] + [(2, 0, "alone"), (3, 0, ""), (3, 1, "second")],
                                    "source_id long, window_no int, synopsis string")
    levels = rollup.summary_levels(windows, 4, 100)
    assert max(r.parts for r in levels.collect()) == 4
    last = {r.source_id: r for r in levels.orderBy("level").collect()}
    assert last[1].synopsis == " ".join(words)[:100] and last[1].level == 4 and last[1].window_no == 0
    assert (last[2].level, last[2].synopsis, last[3].level, last[3].synopsis) == (0, "alone", 1, "second")

    def shorter(rows):
        assert rows.columns == ["source_id", "level", "window_no", "parts", "texts"]
        return rows.withColumn("synopsis", F.concat(F.lit("of "), F.size("texts").cast("string")))

    told = rollup.summary_levels(windows, 30, combine=shorter).orderBy(F.desc("level"), "source_id").first()
    assert (told.level, told.synopsis) == (2, "of 4")
    assert rollup.summary_levels(windows.limit(0)).count() == 0


def test_prompts_have_context_and_rules(spark):
    people = "array<struct<name:string,description:string,images:array<string>>>"
    df = spark.createDataFrame([(" A race. ", [("Ann", " driver ", ["a.png", "b.png"]), ("Bo", "", [])]), ("", []), (None, None)], f"intro string, cast {people}")
    got = [r[0] for r in df.select(rollup.context_preamble(F.col("intro"), F.col("cast"))).collect()]
    assert got == ["About this recording: A race.\nPeople in it:\n- Ann: driver (pictures: 2)\n- Bo\n\n", "", ""]
    chunks = spark.createDataFrame([("p", 0.0, 5.0, "Ctx. "), ("q", 0.0, 5.0, "")], "profile string, start double, end double, context string")
    known = spark.createDataFrame([("p", "game", ["a"], "", " ", "", []), ("q", "game", ["a"], "", "Cut at doors.", "", [])],
                                  "profile string, subject string, taxonomy array<string>, hints string, rules string, example string, signals array<struct<key:string,type:string,description:string>>")
    one, two = (r.prompt for r in rollup.render_prompts(chunks, known).orderBy("profile").collect())
    assert one.startswith("Ctx. A 5.0-second piece of game") and rollup.RULES in one
    assert "Cut at doors." in two and rollup.RULES not in two


def test_failed_work_is_tried_again(spark):
    def flaky(task):
        if task["key"] == "bad":
            raise RuntimeError("503")
        return '{"a":1}'

    tasks = spark.createDataFrame([("good",), ("bad",)], "key string")
    out = plugins.call_model(tasks, flaky, attempts=2, base_delay=0.0)
    done = work.record(spark.createDataFrame([], work.DONE_SCHEMA), out, "analysis")
    assert rows(done, "key") == [("good",)]
    assert rows(work.pending(tasks, done, "analysis"), "key") == [("bad",)]
    assert rows(work.recorded(tasks, done, "analysis"), "key", "payload") == [("good", '{"a":1}')]


def test_a_killed_run_is_resumed(spark, tmp_path):
    import os
    import signal as signals

    log = tmp_path / "calls"
    log.mkdir()

    def calling(kill):
        def call(task):
            if kill and len(os.listdir(log)) >= 25:
                os.kill(os.getpid(), signals.SIGKILL)
            (log / f"{task['key']}-{kill}").write_text("")
            return "no answer" if task["key"] == "k07" else '{"of":"%s"}' % task["key"]
        return call

    tasks = spark.createDataFrame([(f"k{i:02}", i) for i in range(60)], "key string, n int")
    with pytest.raises(Exception):
        plugins.resumable_calls(tasks, calling(True), str(tmp_path / "done"), "analysis", 10, attempts=1)
    recorded = {r.key for r in spark.read.parquet(str(tmp_path / "done" / "analysis")).collect()}
    assert 0 < len(recorded) < 60
    out = plugins.resumable_calls(tasks, calling(False), str(tmp_path / "done"), "analysis", 10, attempts=1, concurrency=4)
    assert {r.key: r.payload for r in out.collect()} == {f"k{i:02}": "no answer" if i == 7 else '{"of":"k%02d"}' % i for i in range(60)}
    second = {p.name.removesuffix("-False") for p in log.iterdir() if p.name.endswith("-False")}
    assert not second & recorded and second | recorded == {f"k{i:02}" for i in range(60)}
    again = plugins.resumable_calls(tasks, calling(True), str(tmp_path / "done"), "analysis", 10, attempts=1)
    assert again.filter("payload IS NOT NULL").count() == 60  # nothing is called


def test_calls_keep_their_order_and_their_pace(spark):
    import time

    def slow(task):
        time.sleep(0.02 * (5 - task["n"] % 5))
        if task["n"] == 3:
            raise plugins.PermanentError("never")
        return '{"n":%d}' % task["n"]

    tasks = spark.createDataFrame([(i,) for i in range(20)], "n int").coalesce(1)
    got = plugins.call_model(tasks, slow, concurrency=5).collect()
    assert [(r.n, r.payload) for r in got] == [(i, None if i == 3 else '{"n":%d}' % i) for i in range(20)]
    pace, begun = plugins.Pace(50.0), time.monotonic()
    for _ in range(11):
        pace.wait()
    assert time.monotonic() - begun >= 0.19


def test_chained_keys(spark):
    sources = spark.createDataFrame([(1, "f1", "manual"), (2, "f2", "manual"), (3, "f3", "auto")], "source_id long, fingerprint string, segmenter string")
    cuts = spark.createDataFrame([(1, 0.0, 5.0), (1, 6.0, 9.0), (2, 0.0, 5.0)], "source_id long, start double, end double")
    chunks = spark.createDataFrame([(s, float(i), i + 1.0, "p") for s in (1, 2, 3) for i in range(2)], "source_id long, start double, end double, profile string")
    keys = lambda c, s=sources: {(r.source_id, r.start): r.key for r in work.analysis_keys(s, c, chunks, ["profile"]).collect()}
    before = keys(cuts)
    assert before == keys(cuts.orderBy(F.desc("start"))) and len(set(before.values())) == 6
    edited = keys(cuts.withColumn("end", F.when(F.col("source_id") == 2, 5.5).otherwise(F.col("end"))))
    assert {k for k in before if before[k] != edited[k]} == {(2, 0.0), (2, 1.0)}
    other = keys(cuts, sources.withColumn("segmenter", F.when(F.col("source_id") == 3, "scene").otherwise(F.col("segmenter"))))
    assert {k[0] for k in before if before[k] != other[k]} == {3}


def test_profiles(spark):
    assert profiles.builtin_profiles(spark).count() == 8
    good, bad = profiles.parse_profiles(spark.createDataFrame(
        [('{"name":"x","taxonomy":["a"],"signals":[{"key":"k","type":"int","description":"d"}]}',), ('{"name":"y","nope":1}',)], "text string"))
    assert rows(good, "profile", "subject") == [("x", "video")]
    assert bad.first()["problems"] == ["unknown key: nope"]
    with pytest.raises(ValueError):
        profiles.load_profiles(spark, ["nope"])


def test_context_files_and_cast(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"intro": "hi", "characters": [{"name": "Ann", "images": ["a.png"]}]}))
    (tmp_path / "d.json").write_text(json.dumps({"intro": "hi", "cast": []}))
    good, bad = files.scan_context(spark, str(tmp_path))
    assert good.count() == 1 and good.first().characters[0].description == ""
    assert bad.first()["problems"] == ["unknown key: cast"]
    entries = spark.createDataFrame([(1, 0, "Ann", ["a", "b"], ""), (1, 1, "Ann", ["b", "c"], "tall"), (1, 2, "Bo", [], "x")],
                                    "source_id long, pos int, name string, images array<string>, description string")
    assert {r.name: (r.images, r.description) for r in rollup.merge_cast(entries).collect()} == {
        "Ann": (["a", "b", "c"], "tall"), "Bo": ([], "x")}


def test_alignment_files(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"characters": ["H", "i"], "start_times": [0, 0.1], "end_times": [0.1, 0.2]}))
    (tmp_path / "short.json").write_text(json.dumps({"characters": ["H", "i"], "start_times": [0], "end_times": [0.1, 0.2]}))
    (tmp_path / "more.json").write_text(json.dumps({"characters": [], "start_times": [], "end_times": [], "speed": 1}))
    (tmp_path / "less.json").write_text(json.dumps({"characters": [], "start_times": []}))
    good, bad = files.scan_alignments(spark, str(tmp_path))
    assert {r.utterance_id.rsplit("/", 1)[1]: r.problems for r in bad.collect()} == {
        "short.json": ["unequal lengths: 2, 1, 2"], "more.json": ["unknown key: speed"], "less.json": ["missing field: end_times"]}
    chars = files.alignment_characters(good)
    assert rows(chars, "pos", "ch", "start", "end") == [(0, "H", 0.0, 0.1), (1, "i", 0.1, 0.2)]


def test_merge_events_plans_agree(spark):
    data = [(1 if i % 4 else 2, i, float(i * 3 % 97), float(i * 3 % 97 + 5), f"d{i}", ["crash"] if i % 5 else ["stunt", "x"], i % 100,
             i % 3, ["car"], "here" if i % 7 else "a longer place", ["crash", "stunt"]) for i in range(120)]
    ddl = ("source_id long, event_id long, start double, end double, description string, categories array<string>, "
           "base_interest int, wanted_level int, vehicles array<string>, location string, taxonomy array<string>")
    e = spark.createDataFrame(data, ddl)
    pick = ["source_id", "run_no", "start", "end", "merged", "base_interest", "wanted_level", "location", "description", "categories"]
    assert rows(events.merge_events(e, 2.0), *pick) == rows(events.merge_events(e, 2.0, max_group_rows=10), *pick)


def test_scalar_odds_and_ends(spark):
    assert one(spark, text.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    for bad in ("1/0", "x", "a/b"):
        assert one(spark, text.frame_rate(F.lit(bad))) == 0.0
    assert one(spark, text.compact(F.lit("  a  b\nc "), 10)) == "a b c" and one(spark, text.compact(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.is_hex_colour(F.lit("#FFD600"))) and not one(spark, text.is_hex_colour(F.lit("#FFD60")))
    s = one(spark, text.voice_settings(F.create_map(F.lit("similarity"), F.lit(40.0), F.lit("style"), F.lit(-1.0))))
    assert s == {"similarity_boost": 0.4, "style": 0.0}
    for seconds, want in [(0.0, 0), (3.0, 6), (12.0, 12), (90.0, 16)]:
        assert one(spark, numeric.frame_count(F.lit(seconds))) == want
    assert one(spark, numeric.grid_columns(F.lit(10))) == 4 and one(spark, numeric.grid_rows(F.lit(10))) == 3
    assert one(spark, numeric.scale_factor(F.lit(1080), F.lit(1920), F.lit("720p"))) == pytest.approx(2 / 3)
    assert one(spark, numeric.scaled_even(F.lit(1081), F.lit(1.0))) == 1082
    assert one(spark, text.fold(F.lit("Ünïted Łódź"))) == "united łodz"
