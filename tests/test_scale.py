"""What must not grow with the data: plans, rows sent to the driver, passes over files."""

import pytest
from pyspark.sql import functions as F

from cuelight.operators import signal as sig


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_covering_tiles_every_cell_once_and_grows_by_level(spark):
    r = spark.range(300).select((F.col("id") * 37 % 911 - 300).alias("lo"), ((F.col("id") * 37 % 911 - 300) + F.col("id") * F.col("id") % 70001 - 3).alias("hi"))
    for x in r.select("lo", "hi", sig._covering(F.col("lo"), F.col("hi"), 5).alias("c")).collect():
        assert sorted(v for b in x.c for v in range(b.block * 16**b.level, (b.block + 1) * 16**b.level)) == list(range(x.lo, x.hi + 1))
    sizes = [len(sig._covering(F.col("lo"), F.col("hi"), n)._jc.toString()) for n in (3, 4, 5)]
    assert sizes[2] - sizes[1] < 1.5 * (sizes[1] - sizes[0])


def test_window_peaks_broadcasts_no_blocks(spark):
    ranges = spark.createDataFrame([(1, 7, 0.0, 900.0), (2, 7, 5.0, 5.5)], "clip_id bigint, source_id bigint, start double, end double")
    amplitudes = spark.createDataFrame([(7, 2.0, 0.5), (7, 5.25, 0.1), (7, 899.0, 1.0)], "source_id bigint, t double, x double")
    out = sig.window_peaks(ranges, amplitudes, "clip_id", 900.0)
    assert "Broadcast" not in plan(out)
    assert sorted((x.clip_id, x.peak_db) for x in out.collect()) == [(1, 0.0), (2, -20.0)]


def test_event_documents_and_summaries_do_the_whole_job():
    """One document per source from its parts, and the sizes of casts and beats beside the texts."""
    import __spark_entry__ as driver

    sql = driver.oracle_sql()
    assert "GROUP BY source_id" in sql["event_documents"] and "window_no" not in sql["event_documents"]
    assert "AS people" in sql["source_summaries"] and "AS beats" in sql["source_summaries"]


def test_join_parts_in_order(spark):
    from cuelight.operators.rollup import join_parts

    parts = spark.createDataFrame([(1, n, f"p{n}") for n in (10, 2, 0)] + [(2, 0, "x")], "source_id bigint, window_no int, text string")
    assert sorted(tuple(x) for x in join_parts(parts).collect()) == [(1, "p0\np2\np10"), (2, "x")]


def test_generated_rows_are_not_broadcast(spark):
    from cuelight.plans.intervals import interval_join

    a = spark.createDataFrame([(1, 0.0, 90.0)], "k bigint, s double, e double")
    b = spark.createDataFrame([(1, 5.0, 6.0)], "k bigint, f double, t double")
    pairs = interval_join(a, b, ["k"], left_span=("s", "e"), right_span=("f", "t"), width=10.0)
    assert "Broadcast" not in plan(pairs) and pairs.count() == 1


def test_fields_of_a_document_are_taken_out_once():
    """Every check of a field asked the whole document for it, several times."""
    from cuelight import schemas
    from cuelight.sources import documents

    text = documents.wrong_types("_v", schemas.EDL)
    assert "'$.title'" not in text and text.count("struct<`schema_version`") == 1


def test_both_halves_read_every_text_once(spark):
    from cuelight.sources.files import parse_edls

    texts = spark.createDataFrame([(1, '{"title":"t","output":{"duration":9}}'), (2, '{"title":5}')], "id bigint, text string")
    good, bad = parse_edls(texts, aside=True)
    assert "from_json" not in plan(good) + plan(bad) and "try_parse_json" not in plan(good) + plan(bad)
    assert [x.id for x in good.collect()] == [1]
    assert [(x.id, list(x.problems)) for x in bad.collect()] == [(2, ["missing field: output", "wrong type: title"])]


def test_places_are_small_numbers():
    from cuelight.operators.captions import _places_of

    found = _places_of([[(1, 3), (5, 9)], []])
    assert [x.tolist() for x in found["b"]] == [[1, 5], []] and [x.tolist() for x in found["e"]] == [[3, 9], []]
    assert {x.dtype.name for x in found["b"]} == {"int32"}


def test_term_blocks_shuffle_postings_twice(spark):
    """Once by document and once by range of terms; a frequent term still has several blocks."""
    from cuelight.operators import termindex

    postings = spark.range(3000).select(F.lit("a").alias("term"), F.col("id").alias("clip_id"), F.lit("f").alias("field"), F.lit(0).alias("pos"))
    lengths = postings.select("clip_id", F.lit(1).cast("bigint").alias("length"))
    blocks = termindex.term_blocks(postings, lengths, parts=4)
    assert plan(blocks).count("Exchange rangepartitioning") == 1 and plan(blocks).count("Exchange hashpartitioning") <= 1
    got = blocks.select("blocks", "n").collect()
    assert len(got) == 4 and {x.blocks for x in got} == {4} and sum(x.n for x in got) == 3000


def test_many_files_are_put_in_place_by_tasks(spark, tmp_path, monkeypatch):
    """The driver moved every file on its own at the end of a write."""
    from cuelight.plans.session import many_files
    from cuelight.sources import files

    seen = []
    monkeypatch.setattr(files, "many_files", lambda df: seen.append(1) or many_files(df))
    one = spark.createDataFrame([("/m", "{}")], "manifest_path string, text string")
    monkeypatch.setattr(files, "manifest_json", lambda manifests, keep: one.withColumnRenamed("manifest_path", "stem"))
    files.write_manifests(one, str(tmp_path / "out"), "stem")
    assert seen and len(list((tmp_path / "out").rglob("part-*"))) == 1


def test_many_files_are_written_as_spark_names_them(spark, tmp_path, monkeypatch):
    """Spark's writer set the rights of each file and folder by a process of its own; names, values, lines and empty tables stay."""
    from cuelight.plans.session import many_files

    rows = [("a/b =%é", 1, "x"), (None, 2, None), ("", 3, "two\nlines"), ("c", None, "é"), ("c", None, "again"), ("d", 4, ""), ("c", None, "last")]
    df = spark.createDataFrame(rows, "k string, n int, text string").coalesce(1)
    df.write.partitionBy("k", "n").text(str(tmp_path / "spark"))
    with monkeypatch.context() as m:
        m.setattr(type(df), "write", property(lambda self: 1 / 0))
        many_files(df).partitionBy("k", "n").text(str(tmp_path / "own"))
        many_files(df.select("text")).option("maxRecordsPerFile", 1).text(f"file://{tmp_path}/each")
        many_files(df.limit(0)).mode("overwrite").partitionBy("k", "n").text(str(tmp_path / "none"))
    read = lambda name: sorted((str(f.parent.relative_to(tmp_path / name)), f.read_text()) for f in (tmp_path / name).rglob("part-*.txt"))
    assert read("own") == read("spark") and not list((tmp_path / "own").rglob(".0*"))
    assert sorted(t for _, t in read("each")) == sorted((r[2] or "") + "\n" for r in rows) and (tmp_path / "none").is_dir()
    assert spark.read.schema("text string, k string, n int").text(str(tmp_path / "own")).count() == spark.read.text(str(tmp_path / "spark")).count()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        many_files(df).partitionBy("k", "n").text(str(tmp_path / "own"))


def test_a_batch_of_new_manifests_computes_its_tables_once(spark, tmp_path, monkeypatch):
    """Every table of a batch was written to a copy first, and joined with tables without rows; the files of a batch had a task each."""
    from test_catalog import manifest

    from cuelight.operators import catalog as cat
    from cuelight.operators import store
    from cuelight.plans import session
    from cuelight.streaming.jobs import continuous_ingest

    import json

    for i in range(3):
        doc = manifest()
        doc["source"]["file"] = f"/media/{i}.mp4"
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "manifest.json").write_text(json.dumps(doc))
    copies = []
    monkeypatch.setattr(store, "written", lambda df, label: copies.append(label) or session.written(df, label))
    places = [str(tmp_path / n) for n in ("catalog", "state")]
    continuous_ingest(spark, f"{tmp_path}/in*", *places, buckets=2).awaitTermination()
    assert not copies and cat.read_catalog(spark, places[0]).sources.count() == 3
    assert "Join" not in plan(cat.empty_catalog(spark).clips.join(spark.range(9).withColumnRenamed("id", "clip_id"), "clip_id", "left_anti"))
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 4 * spark.sparkContext.defaultParallelism


def test_right_documents_are_told_by_their_shape(spark, monkeypatch):
    """Every field of every document was looked at on its own; odd ones still are, with the same problems found."""
    import json

    from test_catalog import edl_doc, manifest

    from cuelight import schemas
    from cuelight.sources import documents

    def clip(**fields):
        doc = manifest()
        doc["clips"][0].update(fields)
        return doc

    drop = manifest()
    del drop["clips"][0]["file"]
    manifests = [manifest(), drop, {**manifest(), "bogus": 1}, {**manifest(), "clips": [None]}, {**manifest(), "clips": None}, {**manifest(), "summary": None},
                 {**manifest(), "summary": {"themes": [None]}}, {**manifest(), "source": "x"}, {**manifest(), "taxonomy": ["a", 1]}, [], "x", None,
                 *(clip(**f) for f in ({"score": 2**40}, {"score": 2**70}, {"score": "5"}, {"score": True}, {"score": 5.0}, {"score": None}, {"id": None}, {"id": 5}, {"audio": None},
                                       {"audio": {"cues": None}}, {"game_signals": None}, {"game_signals": "x"}, {"game_signals": {"a b": {"c": [1]}}}, {"fps": "x"}, {"fps": 1e300},
                                       {"dialogue": None}, {"categories": [None]}, {"bo>gus, id: STRING": 1}, {"file": {"a": 1}}))]
    edls = [edl_doc(), *({**edl_doc(), "voiceover": {"voice_id": "v", "script": "s", "settings": s}} for s in
                         ({}, {"a": 1}, {"a": None}, {"a": "5"}, {"a": "true"}, {"a": True}, {"a": "5d"}, {"a": [1]}, {"a": {}}, None, {f"k{n}": n for n in range(20000)}))]
    for docs, schema in ((manifests, schemas.MANIFEST), (edls, schemas.EDL)):
        texts = spark.createDataFrame(list(enumerate(map(json.dumps, docs))), "id int, text string")
        got = [sorted(map(repr, half.collect())) for half in documents.parse_documents(texts, "text", schema)]
        with monkeypatch.context() as m:
            m.setattr(documents, "plainly_right", lambda *_: "false")
            assert got == [sorted(map(repr, half.collect())) for half in documents.parse_documents(texts, "text", schema)]
        assert len(got[0]) + len(got[1]) == len(docs) and len(got[1]) > 3
        if schema is schemas.MANIFEST:
            filled = documents.parse_documents(texts, "text", schema)[0].filter("id = 0").drop("id")  # with its optional fields
            full = filled.select(F.to_json(F.struct(*[n for n in filled.columns if n != "summary"])).alias("text"))
            full = full.select(F.regexp_replace("text", r'"game_signals":"[^}]*}"', '"game_signals":{"k":1}').alias("text"))
            v = full.select(F.try_parse_json("text").alias("_v"), F.from_json("text", documents._texts(schema)).alias("_doc"))
            assert v.filter(F.expr(documents.plainly_right("_v", "_doc", schema))).count() == 1


def test_ingest_summaries_builds_its_manifests_once(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from cuelight.registry import catalog
    from cuelight.sources import files

    rows = [(n, datetime(2024, 1, 1, n), n % 3, "view", 5.0 * n, '{"k": 1}') for n in range(6)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    calls, build = [], files.build_manifests
    monkeypatch.setattr(files, "build_manifests", lambda *a: calls.append(1) or build(*a))
    out = catalog.ingest_summaries(spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in out) == [("/media/u1.mp4", "story of 1", "Ann"), ("/media/u2.mp4", "story of 2", "Ann")]
    assert len(calls) == 1
