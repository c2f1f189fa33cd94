"""Untidy input: blanks of every kind, repeated ids, accents, inflections."""

import json

import pytest
from pyspark.sql import functions as F

from cuelight import schemas
from cuelight.functions import semi
from cuelight.functions.text import clean_cue, folded_tokens, fold, strip, tokens
from cuelight.operators.catalog import manifest_clips
from cuelight.operators.events import _Stretch
from cuelight.operators.layout import resolve_music
from cuelight.operators.search import signal_filter, signal_like
from cuelight.operators.textindex import TextQuery, build_postings, match
from cuelight.sources import files, profiles


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_blanks(spark):
    assert one(spark, strip(F.col("a")), a=" \n\t　a b \r\n") == "a b"
    assert one(spark, clean_cue(F.col("a")), a=" one　 two\n<i>three</i> ") == "one two three"


def test_replies_with_line_ends(spark):
    got = one(spark, semi.tolerant_json(F.col("a")).cast("string"), a="\n```json\n[{\"start\": 1}, {\"start\": 2}]\n```\n")
    assert got == '[{"start":1},{"start":2}]'
    text = one(spark, semi.text(F.parse_json(F.col("a"))), a='"a\\n"')
    assert text == "a"


def test_audio_cues(spark):
    got = one(spark, semi.string_items(F.parse_json(F.col("a"))), a='["0", "false", 0, 0.0, false, null, "", [], {}, true, 7, "x"]')
    assert got == ["0", "false", "true", "7", "x"]


def test_music_reference_is_read_whole(spark):
    music = spark.createDataFrame([(1, "catalog:12"), (1, "catalog:12" + " " * 40 + "junk")], "edl_id long, file string")
    clips = spark.createDataFrame([(12, "a.mp4")], "clip_id long, file string")
    good, bad = resolve_music(music, clips)
    assert [r.path for r in good.collect()] == ["a.mp4"] and bad.count() == 1


def test_flags_match_as_numbers(spark):
    df = spark.createDataFrame([('{"flag": true}',), ('{"flag": false}',), ('{"flag": "x1"}',), ("{}",)], "s string")
    assert [r.s for r in df.filter(signal_like(F.col("s"), "flag", "1")).collect()] == ['{"flag": true}', '{"flag": "x1"}']


@pytest.mark.parametrize("text, want", [
    ("résumé", ["resume"]), ("résumé", ["resume"]), ("well-known", ["well", "known"]), ("ἄνθρωπος", ["ανθρωπος"]),
    ("한국어 テキスト", None),
])
def test_folding_is_alike_in_index_and_query(spark, text, want):
    got = one(spark, tokens(F.col("a")), a=text)
    assert got == folded_tokens(text) and (want is None or got == want)
    assert one(spark, fold(F.col("a")), a=text) is not None


def test_queries_agree_with_the_index(spark):
    texts = spark.createDataFrame([
        (1, "a café by the river"), (2, "a well-known place"), (3, "they run here"), (4, "known well"), (5, "nothing"),
    ], "clip_id long, body string")
    postings = build_postings(texts, ["clip_id"], ["body"])

    def ids(**query):
        return sorted(r.clip_id for r in match(postings, TextQuery(**query)).collect())

    assert ids(all_of=["café"]) == [1] and ids(all_of=["cafe"]) == [1]
    assert ids(all_of=["well-known"]) == [2] and ids(any_of=["well-known", "CAFÉ"]) == [1, 2]
    assert ids(prefix=["running"]) == [3] and ids(all_of=["runs"]) == [3]
    assert ids(phrase=["well-known", "place"]) == [2] and ids(none_of=["well-known"]) == [1, 3, 4, 5]


def test_repeated_local_ids_are_two_clips(spark):
    audio = "struct<peak_loudness_db:double,cues:array<string>>"
    clip = (f"struct<id:string,file:string,source_in:double,source_out:double,duration:double,resolution:string,fps:double,"
            f"description:string,dialogue:string,score:int,segment_source:string,game_signals:string,audio:{audio},"
            "keyframes:array<string>,categories:array<string>>")
    made = lambda i: (i, None, 0.0, 1.0, 1.0, None, 1.0, "d", None, 1, None, None, None, None, None)
    rows = spark.createDataFrame([(1, 1, [made("a"), made("b"), made("a")])], f"extract_id long, source_id long, clips array<{clip}>")
    got = manifest_clips(rows).collect()
    assert len({r.clip_id for r in got}) == 3 and [r.clip_local_id for r in got] == ["a", "b", "a"]


def test_stretching_shares():
    fold_ = _Stretch(6.0)
    assert fold_.step(0.0, (10.0, 12.0, 100.0, "x")) == (14.0, [(8.0, 14.0, 100.0, "x")])
    assert fold_.step(9.0, (10.0, 12.0, 100.0, "x")) == (15.0, [(9.0, 15.0, 100.0, "x")])
    assert fold_.step(0.0, (10.0, 12.0, 13.0, "x")) == (13.0, [(7.0, 13.0, 13.0, "x")])
    assert fold_.step(9.0, (10.0, 12.0, 13.0, "x")) == (9.0, [])
    assert fold_.step(0.0, (10.0, 17.0, 18.0, "x")) == (17.0, [(10.0, 17.0, 18.0, "x")])


def test_signal_arguments():
    assert signal_filter("map.name=de_dust=2") == ("map.name", "=", "de_dust=2")
    assert signal_filter("map ~= dust") == ("map", "~=", "dust")
    for bad in ("map", "=x", "~=x", ""):
        with pytest.raises(ValueError):
            signal_filter(bad)


def test_values_of_a_wrong_type(spark):
    base = {"title": "t", "output": {"duration": 9}}
    cases = {
        "ok": ({**base, "output": {"duration": "9.5", "width": 720.0, "height": "1280"}, "captions": None, "music": {"file": "a", "duck": "off"}}, []),
        "int": ({**base, "output": {"duration": 9, "fps": 30.5}}, ["wrong type: output.fps"]),
        "text": ({**base, "output": {"duration": 9, "width": "abc"}}, ["wrong type: output.width"]),
        "large": ({**base, "output": {"duration": 9, "width": 3e9}}, ["wrong type: output.width"]),
        "suffix": ({**base, "output": {"duration": "9d"}}, ["wrong type: output.duration"]),
        "list": ({**base, "audio": "nope"}, ["wrong type: audio"]),
        "null list": ({**base, "ost": None}, ["wrong type: ost"]),
        "null title": ({**base, "title": None}, ["missing field: title"]),
        "map": ({**base, "voiceover": {"voice_id": "v", "script": "s", "settings": {"a": "1.5", "b": []}}}, ["wrong type: voiceover.settings{}"]),
        "element": ({**base, "annotations": [None, 3]}, ["wrong type: annotations[]"]),
        "number as title": ({**base, "title": 5}, ["wrong type: title"]),
        "object": ({**base, "output": []}, ["wrong type: output"]),
    }
    texts = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in cases.items()] + [
        ("twice", '{"title": "a", "title": "b", "output": {"duration": 1, "duration": 2}}'), ("list doc", "[]"), ("none", None),
    ], "edl_id string, text string")
    good, bad = files.parse_edls(texts)
    assert {r.edl_id: r.problems for r in bad.collect()} == {
        **{k: p for k, (_, p) in cases.items() if p}, "list doc": ["not a JSON object"], "none": ["not a JSON object"]}
    read = {r.edl_id: (r.title, r.output.duration, r.output.width, r.output.height) for r in good.collect()}
    assert read == {"ok": ("t", 9.5, 720, 1280), "twice": ("b", 2.0, 1080, 1920)}


def test_signal_types_of_a_profile(spark):
    texts = spark.createDataFrame([(json.dumps({"name": n, "signals": [{"key": "k", "type": n, "description": ""}]}),) for n in ("int", "list[str]", "date")], "text string")
    good, bad = profiles.parse_profiles(texts)
    assert sorted(r.profile for r in good.collect()) == ["int", "list[str]"]
    assert bad.first().problems == ["bad value: signals.type"]


def test_repeated_keys_in_replies(spark):
    got = one(spark, semi.tolerant_json(F.col("a")).cast("string"), a='{"a": 1, "a": 2}')
    assert got == '{"a":2}'


def test_summaries_are_written(spark):
    sources = spark.createDataFrame([(1, "/a.mp4", 9.0, "1x1", 1.0), (2, "/b.mp4", 9.0, "1x1", 1.0)], "source_id long, file_path string, duration double, resolution string, fps double")
    extracts = spark.createDataFrame([(i, i, f"/{i}.json", "s", "a", "g", "now", None) for i in (1, 2)], (
        "extract_id long, source_id long, manifest_path string, segmenter string, analyzer string, game_profile string, created_at string, taxonomy array<string>"))
    clips = spark.createDataFrame([], f"extract_id long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schemas.CLIP)}")
    summaries = spark.createDataFrame([(1, "a film", ["time"])], "source_id long, synopsis string, themes array<string>")
    good, bad = files.parse_manifests(files.manifest_json(files.build_manifests(sources, extracts, clips, summaries)))
    assert bad.count() == 0
    told = {r.manifest_path: r.summary and (r.summary.synopsis, r.summary.themes, r.summary.beats) for r in good.collect()}
    assert told == {"/1.json": ("a film", ["time"], []), "/2.json": None}
