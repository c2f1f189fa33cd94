"""Manifests, catalog maintenance, search and edit documents on small inputs."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelight.operators import catalog as cat
from cuelight.operators import edl, layout, store
from cuelight.operators.search import absolute_path, get_clip, get_source, get_summary, preview, search
from cuelight.operators.textindex import TextQuery, match, signal_values
from cuelight.sources import files


def clip(i, start, end, cats, score, signals, peak, cues, **more):
    return {
        "id": f"clip_{i:02d}", "file": "src.mp4", "source_in": start, "source_out": end, "duration": end - start,
        "resolution": "1920x1080", "fps": 60.0, "description": more.pop("description", f"a {cats[0].replace('_', ' ')} scene"),
        "categories": cats, "score": score, "game_signals": signals,
        "audio": {"peak_loudness_db": peak, "cues": cues}, "keyframes": ["k/01.jpg"], "segment_source": "auto", **more,
    }


def manifest(created="2024-05-01T10:00:00+00:00", file="/v/source.mp4", clips=None, **more):
    return {
        "schema_version": 3,
        "source": {"file": file, "duration": 300.0, "resolution": "1920x1080", "fps": 60.0},
        "extract": {"segmenter": "auto", "analyzer": "frames", "game_profile": "gta", "created_at": created},
        "taxonomy": ["police_chase", "crash", "cruising"],
        "clips": clips if clips is not None else [
            clip(1, 0.0, 20.0, ["police_chase", "crash"], 82, {"wanted_level": 4, "vehicles": ["police cruiser", "sports car"]}, -8.2, ["sirens", "collision"]),
            clip(2, 25.0, 55.0, ["cruising"], 40, {"wanted_level": 0, "vehicles": ["sports car"], "fast": True}, -25.0, ["engine"]),
        ],
        **more,
    }


def parsed(spark, *docs):
    data = [(path, d if isinstance(d, str) else json.dumps(d)) for path, d in docs]
    return files.parse_manifests(spark.createDataFrame(data, "manifest_path string, text string"))


def ingested(spark, *docs, into=None):
    good, _ = parsed(spark, *docs)
    return cat.ingest(into or cat.empty_catalog(spark), good)


def counts(catalog):
    return dict(rows(cat.stats(catalog)))


@pytest.fixture(scope="module")
def base(spark):
    updated, _ = ingested(spark, ("/m/a/manifest.json", manifest()))
    return cat.Catalog(**{n: t.cache() for n, t in updated.tables().items()})


def scores(df):
    return [r.score for r in df.collect()]


def test_strict_reading(spark):
    unknown, nested = manifest(bogus=1), manifest()
    nested["clips"][0]["audio"]["volume"] = 3
    missing = manifest()
    del missing["source"]["fps"]
    good, bad = parsed(spark, ("ok", manifest()), ("u", unknown), ("n", nested), ("m", missing), ("j", "{broken"))
    assert rows(good, "manifest_path") == [("ok",)]
    assert {r.manifest_path: r.problems for r in bad.collect()} == {
        "u": ["unknown key: bogus"], "n": ["unknown key: clips[].audio.volume"],
        "m": ["missing field: source.fps"], "j": ["not a JSON object"]}
    short = manifest(clips=[{k: v for k, v in clip(1, 0, 9, ["crash"], 5, {}, None, []).items()
                             if k not in ("categories", "audio", "keyframes", "game_signals")}])
    c = parsed(spark, ("ok", short))[0].first().clips[0]
    assert c.dialogue == "" and c.categories == [] and c.game_signals == "{}"


def test_manifest_files_are_found_and_written(spark, tmp_path):
    for name in ("a", "b/c"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "manifest.json").write_text(json.dumps(manifest(), indent=2))
    (tmp_path / "a" / "other.json").write_text("{}")
    good, bad = files.scan_manifests(spark, str(tmp_path))
    assert rows(good, "manifest_path") == [(f"{tmp_path}/a/manifest.json",), (f"{tmp_path}/b/c/manifest.json",)]
    assert bad.count() == 0
    files.write_manifests(good.withColumn("stem", F.sha1("manifest_path")), str(tmp_path / "out"), "stem")
    again, bad = files.scan_manifests(spark, str(tmp_path / "out"), "part-*")
    shape = lambda df: [(r.file, [{**c.asDict(True), "game_signals": json.loads(c.game_signals)} for c in r.clips]) for r in df.select("source.file", "clips").collect()]
    assert bad.count() == 0 and shape(again) == shape(good)


def test_search_filters(base):
    assert scores(search(base, query=TextQuery(all_of=["chase"]))) == [82]
    assert scores(search(base, query=TextQuery(all_of=["chases"]))) == [82]
    assert scores(search(base, categories=["crash", "cruising"])) == [82, 40]
    assert scores(search(base, categories=["police_chase", "crash"], all_categories=True)) == [82]
    assert scores(search(base, categories=["crash", "crash"], all_categories=True)) == []
    assert scores(search(base, min_score=70)) == [82]
    assert scores(search(base, max_score=50)) == [40]
    assert scores(search(base, min_score=0)) == [82, 40]
    assert scores(search(base, min_duration=25)) == [40]
    assert scores(search(base, signals=[("wanted_level", "=", "4")])) == [82]
    assert scores(search(base, signals=[("vehicles", "~=", "POLICE")])) == [82]
    assert scores(search(base, signals=[("fast", "=", "1")])) == [40]
    assert scores(search(base, source="/v/source.mp4")) == [82, 40]
    assert scores(search(base, source="missing:/v/source.mp4")) == [82, 40]
    assert scores(search(base, source="/nope")) == []
    assert scores(search(base, segmenter="", game_profile="gta")) == [82, 40]
    assert scores(search(base, limit=1)) == [82]
    assert scores(search(base, order_by="timeline", query=TextQuery(any_of=["scene"]))) == [82, 40]
    assert scores(search(base, order_by="duration")) == [40, 82]


def test_search_row(base):
    r = search(base, min_score=70).first()
    assert r.file == "/m/a/src.mp4" and r.keyframes == ["/m/a/k/01.jpg"]
    assert r.categories == ["crash", "police_chase"] == r.matched_categories and r.fts_rank is None
    assert r.audio.peak_loudness_db == -8.2 and len(r) == 27
    p = preview(get_clip(base, r.clip_id)).first()
    assert p.score == 82 and len(p) == 16
    assert get_clip(base, 0).count() == 0
    assert get_source(base, r.source_id).first().duration == 300.0


def test_text_search_reaches_every_field(spark):
    c = clip(1, 0, 20, ["romance"], 5, {"mood": {"deep": ["wistful"]}}, None, ["thunder"],
             dialogue="The serum is the only antidote left.")
    got, _ = ingested(spark, ("/m/a/manifest.json", manifest(clips=[c])))
    for word in ("antidote", "thunder", "romance", "wistful", "ANTIDOTES"):
        assert search(got, query=TextQuery(all_of=[word])).count() == 1, word
    assert search(got, query=TextQuery(phrase=["only", "antidote"])).count() == 1
    assert search(got, query=TextQuery(phrase=["antidote", "only"])).count() == 0
    assert search(got, query=TextQuery(all_of=["serum"], none_of=["left"])).count() == 0
    assert search(got, query=TextQuery(prefix=["anti"])).count() == 1
    assert match(got.postings, TextQuery(all_of=["romance"], fields=["dialogue"])).count() == 0


def test_better_match_ranks_first(spark):
    texts = ["chase chase chase", "a chase through the long and quiet town", "nothing", "rain", "sun", "wind"]
    clips = [clip(i, 0, 20, ["crash"], 10, {}, None, [], description=t) for i, t in enumerate(texts)]
    got, _ = ingested(spark, ("/m/a/manifest.json", manifest(clips=clips)))
    found = search(got, query=TextQuery(all_of=["chase"])).collect()
    assert [r.description for r in found] == texts[:2] and found[0].fts_rank < found[1].fts_rank < 0


def test_signal_values_skip_nulls_and_keys(spark):
    df = spark.createDataFrame([('{"a":null,"b":[1,{"c":"x"}],"d":"y"}',)], "s string")
    assert df.select(signal_values(F.col("s"))).first()[0] == ["1", "x", "y"]
    deep = {"a": {"b": {"c": {"d": [[{"e": 'q"u,o: te'}], -1.5e3, True, None]}}}, "k:": "\\", "z": ""}
    df = spark.createDataFrame([(json.dumps(deep),)], "s string")
    assert df.select(signal_values(F.col("s"))).first()[0] == ['q"u,o: te', "-1500.0", "true", "\\"]


def test_paths_are_resolved(spark):
    df = spark.createDataFrame([("../../../../../x/./a.mp4", "/1/2/3/4/5/6/m.json"), ("/abs.mp4", "/m/m.json"),
                                ("k/1.jpg", "s3://bucket/d/m.json"), ("a.mp4", "/m.json")], "p string, m string")
    got = [r[0] for r in df.select(absolute_path(F.col("p"), F.col("m"))).collect()]
    assert got == ["/1/x/a.mp4", "/abs.mp4", "s3://bucket/d/k/1.jpg", "/a.mp4"]


def test_ingest_is_idempotent(spark, base):
    again, report = ingested(spark, ("/m/a/manifest.json", manifest()), into=base)
    assert counts(again) == counts(base) == {"sources": 1, "extracts": 1, "clips": 2, "clip_categories": 3}
    assert rows(report, "clip_count", "created") == [(2, False)]
    assert rows(again.postings) == rows(base.postings)


def test_moved_manifest_updates_the_path(spark, base):
    moved, _ = ingested(spark, ("/m/b/manifest.json", manifest()), into=base)
    assert rows(moved.extracts, "manifest_path") == [("/m/b/manifest.json",)]
    assert counts(moved) == counts(base)


def test_two_extracts_of_one_source(spark, base):
    more, report = ingested(spark, ("/m/c/manifest.json", manifest(created="2024-06-01T10:00:00+00:00")), into=base)
    assert counts(more)["sources"] == 1 and counts(more)["extracts"] == 2
    assert rows(report, "created") == [(True,)]
    assert rows(cat.list_sources(more), "extract_count", "clip_count") == [(2, 4)]
    assert cat.list_extracts(more, 1).count() == 1 and cat.list_extracts(more, -1).count() == 2


def test_last_manifest_of_a_batch_wins(spark):
    second = manifest(clips=[])
    got, report = ingested(spark, ("/m/a/manifest.json", manifest()), ("/m/z/manifest.json", second))
    assert rows(got.extracts, "manifest_path") == [("/m/z/manifest.json",)] and got.clips.count() == 0
    assert report.count() == 1


def test_known_files_share_a_source_by_fingerprint(spark):
    good, _ = parsed(spark, ("/m/a/manifest.json", manifest(file="/v/old.mp4")))
    prints = spark.createDataFrame([("/v/old.mp4", "f1"), ("/v/new.mp4", "f1")], "path string, fingerprint string")
    first, _ = cat.ingest(cat.empty_catalog(spark), good, prints)
    silent = cat.replace(first, sources=first.sources.withColumn("has_audio", F.lit(0)))
    good, _ = parsed(spark, ("/m/a/manifest.json", manifest(file="/v/new.mp4")))
    second, _ = cat.ingest(silent, good, prints)
    assert rows(second.sources, "file_path", "fingerprint", "has_audio") == [("/v/new.mp4", "f1", 0)]


def test_summary_survives_a_manifest_without_one(spark):
    summary = {"synopsis": "s", "themes": ["t"], "characters": [{"name": "Ann", "role": "lead"}],
               "beats": [{"title": "b", "start": 0.0, "end": 9.0}]}
    first, _ = ingested(spark, ("/m/a/manifest.json", manifest(summary=summary)))
    second, _ = ingested(spark, ("/m/a/manifest.json", manifest()), into=first)
    s = get_summary(second, second.sources.first().source_id).first()
    assert s.synopsis == "s" and s.characters[0].role == "lead" and s.beats[0].summary == "" and s.themes == ["t"]


def test_remove_cascades(base):
    left, gone = cat.remove_manifest(base, "/m/a/manifest.json")
    assert gone.count() == 1
    assert counts(left) == {"sources": 1, "extracts": 0, "clips": 0, "clip_categories": 0}
    assert left.postings.count() == 0
    assert cat.remove_manifest(base, "/nope")[1].count() == 0


def test_only_touched_buckets_are_rewritten(spark, base, tmp_path):
    root = str(tmp_path / "catalog")
    other, _ = ingested(spark, ("/m/o/manifest.json", manifest(file="/v/other.mp4")), into=base)
    cat.write_catalog(other, root, buckets=8)
    before = store.latest(spark, root)
    good, _ = parsed(spark, ("/m/n/manifest.json", manifest()))
    report = cat.update_catalog(spark, root, good, buckets=8)
    assert rows(report, "manifest_path", "created") == [("/m/n/manifest.json", False)]
    after = cat.read_catalog(spark, root)
    assert counts(after) == counts(other)
    assert ("/m/n/manifest.json",) in rows(after.extracts, "manifest_path")
    now = store.latest(spark, root)
    touched = set(cat.touched_buckets(base.sources, 8))
    assert {k for k, f in before.folders.items() if now.folders.get(k) == f} == {k for k in before.folders if k[1] not in touched} != set()
    size = cat.stored_bytes(spark, root).first()[0]
    good, _ = parsed(spark, ("/m/n/manifest.json", manifest(clips=[])))
    cat.update_catalog(spark, root, good, buckets=8)
    assert counts(cat.read_catalog(spark, root)) == {"sources": 2, "extracts": 2, "clips": 2, "clip_categories": 3}
    assert 0 < cat.stored_bytes(spark, root).first()[0] < size
    # a bucket without rows has no folder and no files
    assert not [k for k in store.latest(spark, root).folders if k[0] == "clips" and k[1] in touched]
    folders = list((tmp_path / "catalog" / "data").glob("*/*/*"))
    assert store.sweep(spark, root) > 0
    left = [f for f in folders if f.exists() and f.is_dir()]
    assert {str(f.relative_to(tmp_path / "catalog")) for f in left} == set(store.latest(spark, root).folders.values())
    assert counts(cat.read_catalog(spark, root)) == {"sources": 2, "extracts": 2, "clips": 2, "clip_categories": 3}
    assert store.sweep(spark, root) == 0 == store.sweep(spark, str(tmp_path / "none"))


def test_new_manifests_are_written_beside_what_is_there(spark, base, tmp_path):
    root = str(tmp_path / "catalog")
    cat.write_catalog(base, root, buckets=1)
    before = store.latest(spark, root)
    good, _ = parsed(spark, ("/m/n/manifest.json", manifest(file="/v/new.mp4")))
    assert rows(cat.update_catalog(spark, root, good), "created") == [(True,)]
    now = store.latest(spark, root)
    assert before.folders.items() < now.folders.items()
    want, _ = ingested(spark, ("/m/n/manifest.json", manifest(file="/v/new.mp4")), into=base)
    got = cat.read_catalog(spark, root)
    for name, table in got.tables().items():
        assert sorted(map(repr, table.collect())) == sorted(map(repr, getattr(want, name).collect()))
    # rows that are replaced: the bucket is written whole, one folder for each table
    assert rows(cat.update_catalog(spark, root, good), "created") == [(False,)]
    assert counts(cat.read_catalog(spark, root)) == counts(want)
    last = store.latest(spark, root).folders
    assert len({k[:2] for k in last}) == len(last)


def test_layers_become_one_of_the_next_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LAYERS", 2)
    root = str(tmp_path / "catalog")
    cat.create_catalog(spark, root, buckets=1)
    levels = []
    for n in range(4):
        good, _ = parsed(spark, (f"/m/{n}/manifest.json", manifest(file=f"/v/{n}.mp4")))
        cat.update_catalog(spark, root, good)
        levels.append(sorted(k[3] for k in store.latest(spark, root).folders if k[0] == "clips"))
    assert levels == [[0], [1], [0, 1], [2]]
    assert counts(cat.read_catalog(spark, root)) == {"sources": 4, "extracts": 4, "clips": 8, "clip_categories": 12}


@pytest.mark.parametrize("table", [0, 3, 6])
def test_an_update_that_ends_half_way_changes_nothing(spark, base, tmp_path, monkeypatch, table):
    root = str(tmp_path / "catalog")
    cat.write_catalog(base, root, buckets=2)
    early = cat.read_catalog(spark, root)
    seen, wanted = [], rows(base.postings)

    def broken(place, tables):
        done = dict(list(tables.items())[:table])  # it ends between two of the tables
        seen.append(whole(place, done))
        raise RuntimeError("the run ended")

    whole = store.write_buckets
    good, _ = parsed(spark, ("/m/n/manifest.json", manifest(clips=[])))
    with monkeypatch.context() as m:
        m.setattr(store, "write_buckets", broken)
        with pytest.raises(RuntimeError, match="ended"):
            cat.update_catalog(spark, root, good)
    assert len(seen) == 1
    assert counts(cat.read_catalog(spark, root)) == counts(base) and rows(cat.read_catalog(spark, root).postings) == wanted
    cat.update_catalog(spark, root, good)
    assert counts(cat.read_catalog(spark, root))["clips"] == 0
    assert counts(early) == counts(base)  # a reader that began before still has its files


def test_two_updates_of_one_state(spark, base, tmp_path):
    root = str(tmp_path / "catalog")
    cat.write_catalog(base, root, buckets=2)
    good, _ = parsed(spark, ("/m/n/manifest.json", manifest(clips=[])))
    first, _ = cat.staged_update(spark, root, good)
    second, _ = cat.staged_update(spark, root, good)
    store.publish(spark, root, first)
    with pytest.raises(RuntimeError, match="run this one again"):
        store.publish(spark, root, second)
    assert store.latest(spark, root).folders == first.folders


def test_stored_removal(spark, base, tmp_path):
    root = str(tmp_path / "catalog")
    other, _ = ingested(spark, ("/m/o/manifest.json", manifest(file="/v/other.mp4")), into=base)
    cat.write_catalog(other, root, buckets=8)
    assert cat.remove_stored(spark, root, "/nope").count() == 0
    assert cat.remove_stored(spark, root, "/m/a/manifest.json").count() == 1
    left = cat.read_catalog(spark, root)
    want, _ = cat.remove_manifest(other, "/m/a/manifest.json")
    assert counts(left) == counts(want) and left.postings.count() == want.postings.count() > 0
    assert rows(left.extracts, "manifest_path") == [("/m/o/manifest.json",)]


def test_buckets_and_version_are_stored(spark, base, tmp_path):
    root = str(tmp_path / "catalog")
    cat.write_catalog(base, root, buckets=4)
    good, _ = parsed(spark, ("/m/n/manifest.json", manifest()))
    with pytest.raises(ValueError, match="4 buckets"):
        cat.update_catalog(spark, root, good, buckets=8)
    cat.update_catalog(spark, root, good)
    assert counts(cat.read_catalog(spark, root)) == counts(base) and cat.stored_buckets(spark, root) == 4
    store.publish(spark, root, store.Published(9, 1, 4, {}))
    with pytest.raises(ValueError, match="version 1"):
        cat.read_catalog(spark, root)


def test_scores_out_of_range_are_refused(spark, base):
    bad = manifest(file="/v/bad.mp4")
    bad["clips"][0]["score"] = 101
    got, report = ingested(spark, ("/m/bad/manifest.json", bad), ("/m/a/manifest.json", manifest()), into=base)
    assert counts(got) == counts(base)
    assert rows(report, "manifest_path", "clip_count", "created", "refused_scores") == [
        ("/m/a/manifest.json", 2, False, 0), ("/m/bad/manifest.json", 0, False, 1)]


def test_upgrade_adds_dialogue_and_rebuilds_the_index(spark, base):
    old = base.clips.drop("dialogue", "categories").withColumn("description", F.lit("a quiet sunset over the bay"))
    got = cat.upgrade_catalog(base.sources, base.extracts, old, base.clip_categories, base.source_summaries)
    assert search(got, query=TextQuery(all_of=["sunset"])).count() == 2
    assert search(got, query=TextQuery(all_of=["cruising"])).count() == 1
    assert rows(got.clips, "dialogue") == [("",), ("",)]


def edl_doc(**more):
    doc = {
        "title": "t", "output": {"duration": 10.0},
        "voiceover": {"voice_id": "v", "script": "hi"},
        "video": [{"start": 0.0, "end": 6.0, "clip_id": 1}, {"start": 6.0, "end": 10.0, "clip_id": 2}],
        "audio": [{"start": 0.0, "end": 10.0, "kind": "voiceover"}],
    }
    doc.update(more)
    return doc


def issues(spark, clips=None, **more):
    texts = spark.createDataFrame([("e", json.dumps(edl_doc(**more)))], "edl_id string, text string")
    good, bad = files.parse_edls(texts)
    assert bad.count() == 0
    return {(r.severity, r.path, r.message) for r in edl.validate(edl.explode_edls(good), clips).collect()}


def cue(start, end, **more):
    return {"start": start, "end": end, "clip_id": 1, **more}


def test_clean_document_has_no_issues(spark):
    assert issues(spark) == set()


def test_edl_rules(spark):
    paths = lambda found: {p for _, p, _ in found}
    assert ("error", "video[1]", "gap in video track: 4.000s..6.000s uncovered") in issues(spark, video=[cue(0, 4), cue(6, 10)])
    assert ("error", "video[1]", "overlaps previous video cue (prev ends at 7.000s, this starts at 6.000s)") in issues(
        spark, video=[cue(0, 7), cue(6, 10)])
    assert ("error", "video[0]", "video track ends at 9.000s but output.duration is 10.000s") in issues(spark, video=[cue(0, 9)])
    assert paths(issues(spark, captions={}, voiceover=None, audio=[])) == {"captions"}
    assert issues(spark, captions={"cues": [{"start": 0, "end": 2, "text": "x"}]}, voiceover=None, audio=[]) == set()
    assert paths(issues(spark, captions={"cues": [{"start": 0, "end": 12, "text": " "}]})) == {"captions.cues[0]", "captions.cues[0].text"}
    assert ("error", "voiceover", edl.MESSAGES["no_voiceover"]) in issues(spark, voiceover=None)
    assert ("warning", "voiceover", edl.MESSAGES["unused_voiceover"]) in issues(spark, audio=[])
    assert ("error", "schema_version", "unsupported schema_version 2, expected 1") in issues(spark, schema_version=2)
    fade = dict(transition_in="crossfade")
    assert paths(issues(spark, video=[cue(0, 6, **fade, transition_duration=1), cue(6, 10, **fade, transition_duration=3)])) == {
        "video[0].transition_in", "video[1].transition_duration"}
    assert paths(issues(spark, video=[cue(0, 10, effect="slow_mo", effect_params={"speed": 2})])) == {"video[0].effect_params.speed"}
    assert paths(issues(spark, video=[cue(0, 10, effect="ken_burns_in", effect_params={"zoom_to": 0})])) == {"video[0].effect_params"}
    ann = [{"start": 0, "end": 1, "shape": "circle", "x": 2000, "y": 5}]
    assert paths(issues(spark, annotations=ann)) == {"annotations[0].x", "annotations[0].radius"}
    assert paths(issues(spark, music={"file": "a.mp3"}, voiceover=None, audio=[])) == {"music.duck"}
    assert paths(issues(spark, output={"duration": 10, "watermark": {"text": " ", "opacity": 2, "font_size": 0}})) == {
        "output.watermark.text", "output.watermark.opacity", "output.watermark.font_size"}
    bad = {"max_words": 0, "max_chars": 0, "min_chunk_duration": -1, "font_size": 0, "highlight": "karaoke_fill",
           "highlight_color": "red", "animate_overshoot": -1, "animate_duration": 2, "fade_ms": -1,
           "active_word_bg": "blue", "active_word_bg_radius": -1, "active_word_scale": 0.5}
    assert paths(issues(spark, captions=bad)) == {f"captions.{k}" for k in bad if k != "highlight"}
    clips = spark.createDataFrame([(1, 5.0, 2.0)], "clip_id long, duration double, source_in double")
    found = issues(spark, clips)
    assert ("error", "video[1].clip_id", "clip_id=2 not found in catalog") in found
    assert ("error", "video[0]", "cue duration 6.000s exceeds available clip footage (5.000s from source_in=2.000)") in found


def test_edl_documents_are_strict(spark):
    texts = spark.createDataFrame([
        ("a", json.dumps(edl_doc(extra=1))), ("b", json.dumps(edl_doc(video=[cue(0, 1, effect="melt")]))),
    ], "edl_id string, text string")
    _, bad = files.parse_edls(texts)
    assert {r.edl_id: r.problems for r in bad.collect()} == {"a": ["unknown key: extra"], "b": ["bad value: video.effect"]}


def test_verdicts(spark):
    texts = spark.createDataFrame([("ok", json.dumps(edl_doc())), ("warned", json.dumps(edl_doc(audio=[]))),
                                   ("bad", json.dumps(edl_doc(video=[cue(0, 3)])))], "edl_id string, text string")
    tracks = edl.explode_edls(files.parse_edls(texts)[0])
    assert dict(rows(edl.verdicts(tracks.head, edl.validate(tracks)))) == {"ok": True, "warned": True, "bad": False}


def test_join_offsets(spark):
    v = spark.createDataFrame([("e", 0, 5.0, "crossfade", 1.0), ("e", 1, 4.0, "crossfade", 1.0), ("e", 2, 3.0, "cut", 9.0)],
                              "edl_id string, pos int, length double, transition_in string, transition_duration double")
    assert rows(layout.join_offsets(v), "pos", "offset") == [(0, 0.0), (1, 4.0), (2, 8.0)]


def test_edl_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text(json.dumps(edl_doc()))
    good, bad = files.scan_edls(spark, str(tmp_path / "in"))
    assert bad.count() == 0 and good.first().output.height == 1920
    files.write_edls(good.drop("edl_id"), str(tmp_path / "out"))
    back, bad = files.scan_edls(spark, str(tmp_path / "out"), "part-*")
    assert bad.count() == 0 and rows(back, "title") == [("t",)]


def test_stored_search_pushes_filters_and_prunes_columns(spark, base, tmp_path, capsys):
    cat.write_catalog(base, str(tmp_path / "c"), buckets=2)
    stored = cat.read_catalog(spark, str(tmp_path / "c"))
    search(stored, min_score=70, max_duration=30).select("clip_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(score,70)" in plan and "LessThanOrEqual(duration,30" in plan
    assert "keyframes" not in plan and "CartesianProduct" not in plan
    assert scores(search(stored, min_score=70)) == [82]
    only = cat.touched_buckets(stored.sources, 2)
    cat.read_catalog(spark, str(tmp_path / "c"), only).clips.explain("formatted")
    assert f"clips/bucket={only[0]}]" in capsys.readouterr().out
