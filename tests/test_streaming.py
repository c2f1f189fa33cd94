"""Streaming forms: late data, repeats, sessions, continuous ingest."""

import json
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F
from test_catalog import counts, manifest

from cuelight.operators.catalog import read_catalog
from cuelight.streaming import jobs

T0 = datetime(2024, 1, 1)


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat()


def replay(spark, tmp_path, schema, batches, build, name):
    """Feed batches one by one and return everything that was emitted."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
        query.processAllAvailable()
    query.stop()
    return spark.table(name)


SAMPLES = "source_id long, ts timestamp, x double"


def test_rms_drops_late_samples(spark, tmp_path):
    row = lambda t, x: {"source_id": 1, "ts": at(t), "x": x}
    batches = [[row(0.1, 0.5), row(0.2, 0.5)], [row(60, 1.0)], [row(0.3, 1.0), row(120, 1.0)], [row(180, 1.0)]]
    out = replay(spark, tmp_path, SAMPLES, batches, jobs.rms_stream, "levels")
    first = {r.ts: r.db for r in out.collect()}[T0]
    assert round(first, 3) == -6.021  # the late loud sample is not in it


def test_sliding_windows_overlap(spark, tmp_path):
    row = lambda t: {"source_id": 1, "ts": at(t), "x": 0.1}
    build = lambda s: jobs.sliding_stream(s, "60 seconds", "55 seconds", "0 seconds", "0 seconds")
    out = replay(spark, tmp_path, SAMPLES, [[row(t) for t in range(0, 400, 5)], [row(2000)], [row(4000)]], build, "tiles")
    spans = [(a.timestamp(), b.timestamp()) for a, b in rows(out, "start", "end")]
    assert all(b - a == 60 for a, b in spans)
    assert all(later[0] - earlier[0] == 55 for earlier, later in zip(spans, spans[1:]) if later[0] - earlier[0] < 100)


def test_sessions_merge_across_batches(spark, tmp_path):
    row = lambda t, i: {"source_id": 1, "ts": at(t), "base_interest": i}
    schema = "source_id long, ts timestamp, base_interest int"
    build = lambda s: jobs.session_stream(s, "30 seconds", "1 second")
    out = replay(spark, tmp_path, schema, [[row(0, 3)], [row(20, 9)], [row(500, 1)], [row(900, 1)], [row(1500, 1)]], build, "sessions")
    assert rows(out, "merged", "base_interest")[-1] == (2, 9)


def test_repeated_work_is_dropped(spark, tmp_path):
    row = lambda t, k: {"key": k, "ts": at(t)}
    out = replay(spark, tmp_path, "key string, ts timestamp", [[row(0, "a"), row(1, "a")], [row(2, "a"), row(3, "b")]],
                 jobs.dedup_stream, "work")
    assert rows(out, "key") == [("a",), ("b",)]


def test_continuous_ingest(spark, tmp_path):
    def land(name, doc):
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name / "manifest.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))

    def run():
        jobs.continuous_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/cat", f"{tmp_path}/state",
                               rejects_path=f"{tmp_path}/bad", buckets=4).awaitTermination()
        return read_catalog(spark, f"{tmp_path}/cat")

    land("a", manifest())
    land("broken", "{")
    assert counts(run()) == {"sources": 1, "extracts": 1, "clips": 2, "clip_categories": 3}
    land("b", manifest(file="/v/b.mp4"))
    land("again", manifest())
    got = run()
    assert counts(got) == {"sources": 2, "extracts": 2, "clips": 4, "clip_categories": 6}
    assert {r[0].split("/")[-2] for r in rows(got.extracts, "manifest_path")} == {"again", "b"}
    assert spark.read.json(f"{tmp_path}/bad").filter(F.col("text") == "{").count() == 1


def test_islands_in_any_order_of_arrival(spark, tmp_path):
    import random

    from cuelight.streaming import islands

    rng = random.Random(3)
    schema = "source_id long, event_id long, start timestamp, end timestamp, base_interest int, mark string"
    events, t = [], 0
    for i in range(120):
        t += rng.choice([1, 3, 5, 30])
        events.append({"source_id": i % 2, "event_id": i, "start": at(t), "end": at(t + rng.randint(1, 8)), "base_interest": rng.randint(0, 99), "mark": rng.choice("aab")})
    late = [e for e in events if e["event_id"] == 5]
    order = [e for e in events if e["event_id"] != 5]
    batches = [order[i:i + 30] for i in range(0, len(order), 30)]
    for batch in batches:
        rng.shuffle(batch)
    batches[1], batches[2] = batches[1][::2] + batches[2][::2], batches[1][1::2] + batches[2][1::2]  # across batches too
    batches.append(late)  # much too late
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = islands.island_stream(stream, 4.0, "700 seconds").writeStream.format("memory").queryName("islands").outputMode("append").option(
        "checkpointLocation", state).start()
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
        query.processAllAvailable()
    query.stop()
    given = spark.table("islands")
    assert given.count() > 3
    everything = given.unionByName(islands.open_islands(spark, state, 4.0))
    us = lambda text: int((datetime.fromisoformat(text) - T0).total_seconds() * 1e6)
    want = []
    for s in (0, 1):
        own = sorted((us(e["start"]), us(e["end"]), e["event_id"], e["base_interest"], e["mark"]) for e in order if e["source_id"] == s)
        run, ended = islands.walk(None, own, 4_000_000)
        want += [(s, *r[:5]) for r in [*ended, run]]
    got = [(r.source_id, int((r.start - T0).total_seconds() * 1e6), int((r.end - T0).total_seconds() * 1e6), r.merged, r.base_interest, r.mark) for r in everything.collect()]
    assert sorted(got) == sorted(want)
