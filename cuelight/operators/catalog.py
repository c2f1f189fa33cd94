"""Idempotent catalog maintenance: ingest, remove, upgrade, statistics.

A catalog is a set of DataFrames. Every change returns a new catalog; writing it
replaces only the source buckets that changed, and all of them at once (``store``).
A bucket none of whose rows an update replaces gets the new rows as a further layer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.semi import get
from ..plans.groups import broadcast_if_small
from ..plans.session import at_once, written
from . import store
from .textindex import FIELDS, build_postings, clip_texts, text_lengths

BUCKETS = 256
# An update of so many clips at most is dealt out by bucket; ranges of a larger one are drawn from a copy of its tables first.
SMALL = 100_000

_TABLES = {
    "sources": schemas.SOURCES_TABLE, "extracts": schemas.EXTRACTS_TABLE, "clips": schemas.CLIPS_TABLE,
    "clip_categories": schemas.CATEGORIES_TABLE, "source_summaries": schemas.SUMMARIES_TABLE,
    "postings": schemas.POSTINGS_TABLE, "lengths": schemas.LENGTHS_TABLE,
}
_KEYS = ["clip_id", "extract_id", "source_id"]


@dataclass(frozen=True)
class Catalog:
    sources: DataFrame
    extracts: DataFrame
    clips: DataFrame
    clip_categories: DataFrame
    source_summaries: DataFrame
    postings: DataFrame
    lengths: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in _TABLES}


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(**{name: spark.createDataFrame([], schema).limit(0) for name, schema in _TABLES.items()})


def published_state(spark: SparkSession, root: str, asked: int | None = None) -> store.Published:
    """What is published of the catalog stored at ``root``. A catalog of another version is an error, and so is another
    number of source buckets than ``asked``: its rows would be looked for, and written, in the wrong buckets."""
    state = store.latest(spark, root)
    if state is None or state.version != schemas.CATALOG_VERSION:
        raise ValueError(f"the catalog is of version {state and state.version}, not {schemas.CATALOG_VERSION}; see upgrade_catalog")
    if asked is not None and asked != state.buckets:
        raise ValueError(f"the catalog has {state.buckets} buckets, not {asked}")
    return state


def stored_buckets(spark: SparkSession, root: str) -> int:
    """The number of source buckets of the catalog stored at ``root``."""
    return published_state(spark, root).buckets


def read_catalog(spark: SparkSession, root: str, only: Sequence[int] | None = None, state: store.Published | None = None) -> Catalog:
    """The stored catalog, as it was published last (or in ``state``); ``only`` reads the given source buckets and no other
    file. Later updates do not change what it reads."""
    state = state or published_state(spark, root)
    return Catalog(**{name: store.read_table(spark, root, state, name, schema, only) for name, schema in _TABLES.items()})


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")


def touched_buckets(source_ids: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets of the given ``source_id`` rows: at most ``buckets`` numbers."""
    return sorted(r[0] for r in source_ids.select(_bucket(buckets)).distinct().collect())


# Sort keys that make file statistics useful for each table's usual filter.
# They end in a key, so a common category or a long source still splits into files.
_SORT = {
    "extracts": ["source_id", "extract_id"], "clips": ["source_id", "source_in", "clip_id"],
    "clip_categories": ["category", "clip_id"], "postings": ["term", "clip_id", "field", "pos"],
    "lengths": ["clip_id"],
}


def stage(catalog: Catalog, root: str, state: store.Published, only: Sequence[int] | None = None,
          known: dict[str, set[int]] | None = None, small: Sequence[str] = ()) -> store.Published:
    """Write the tables, or the buckets ``only`` of them, into new folders and return the state that would show them in place
    of those of ``state``, or beside the layers that stay (``_layers``). Readers see nothing of it before it is published. A
    bucket of a ``small`` table is sorted by one task; others are divided by ranges, which are drawn from a copy."""
    rows = {name: table.withColumn("bucket", _bucket(state.buckets)) for name, table in catalog.tables().items()}
    taken, levels = set(state.folders), {}
    if only is not None:
        rows = {name: table.filter(F.col("bucket").isin(list(only))) for name, table in rows.items()}
        taken, levels = _layers(state, only, known)
    kept = {k: f for k, f in state.folders.items() if k not in taken}
    how = {name: [] if only is None else ["small"] if name in small else ["copied"] for name in rows}
    new = store.write_buckets(root, {name: (table, _SORT.get(name, ["source_id"]), *how[name]) for name, table in rows.items()})
    layers = {(*k, state.generation + 1, levels.get(k, 0)): f for k, f in new.items()}
    return replace(state, generation=state.generation + 1, folders={**kept, **layers})


def _layers(state: store.Published, only: Sequence[int], known: dict[str, set[int]] | None) -> tuple[set[store.Layer], dict[tuple[str, int], int]]:
    """The layers that an update of the buckets ``only`` writes again, and the levels of its own. ``known`` names the buckets
    of each table with rows that it replaces; without it, that is all of them."""
    taken, levels = set(), {}
    for name in _TABLES:
        for b in only:
            found, levels[name, b] = store.absorbed(state, name, b, known is None or b in known[name])
            taken |= found
    return taken, levels


def _known_buckets(catalog: Catalog, prepared: DataFrame, buckets: int) -> dict[str, set[int]]:
    """The buckets of each table with rows that the prepared manifests replace. A catalog has clips, categories and postings
    only of extracts that it has."""
    found = None
    for name, key in (("sources", "source_id"), ("source_summaries", "source_id"), ("extracts", "extract_id")):
        old = getattr(catalog, name).select("source_id", key).join(prepared.select(key), key, "left_semi")
        one = old.select(F.lit(key).alias("key"), _bucket(buckets).alias("bucket"))
        found = one if found is None else found.unionByName(one)
    seen = [(r["key"], r["bucket"]) for r in found.distinct().collect()]
    return {name: {b for k, b in seen if k == ("source_id" if name in ("sources", "source_summaries") else "extract_id")} for name in _TABLES}


def write_catalog(catalog: Catalog, root: str, only: Sequence[int] | None = None, buckets: int | None = None) -> None:
    """Write all tables below ``root`` in source buckets, and publish them at once.

    With ``only``, those buckets are replaced and all other files stay as they
    are. A catalog keeps its number of buckets (``buckets``, or ``BUCKETS``, when
    it is first written): it is published with the version.
    """
    spark = catalog.sources.sparkSession
    if only is None:
        before = store.latest(spark, root)
        state = store.Published(before.generation if before else 0, schemas.CATALOG_VERSION, buckets or BUCKETS, {})
    else:
        state = published_state(spark, root, buckets)
    store.publish(spark, root, stage(catalog, root, state, only))


def staged_update(spark: SparkSession, root: str, manifests: DataFrame, fingerprints: DataFrame | None = None,
                  buckets: int | None = None) -> tuple[store.Published | None, DataFrame]:
    """The state that ``update_catalog`` publishes, written but not published (None if there is nothing to change), and its
    report."""
    state = published_state(spark, root, buckets)
    rows = written(prepare_manifests(manifests, fingerprints), "manifests")
    sizes = dict(_fitting(rows).groupBy(_bucket(state.buckets)).agg(F.sum(F.coalesce(F.size("clips"), F.lit(0)))).collect())
    only = sorted(sizes)
    if not only:
        return None, _refused(rows)
    known, marked = at_once(spark, [partial(_known_buckets, read_catalog(spark, root, only, state), _fitting(rows), state.buckets),
                                    partial(_with_winners, _fitting(rows))])
    taken, _ = _layers(state, only, known)
    before = replace(state, folders={k: f for k, f in state.folders.items() if k in taken})
    updated, report = _fold(read_catalog(spark, root, state=before), marked)
    small = [name for name in _TABLES if not any(k[0] == name for k in taken)] if sum(sizes.values()) <= SMALL else []
    return tuple(at_once(spark, [partial(stage, updated, root, state, only, known, small),
                                 partial(written, report.unionByName(_refused(rows)), "report")]))


def update_catalog(spark: SparkSession, root: str, manifests: DataFrame, fingerprints: DataFrame | None = None,
                   buckets: int | None = None) -> DataFrame:
    """Fold manifests into the catalog stored at ``root``, reading and writing the
    buckets of their sources only, and of those only what they replace and a few layers of
    about the size of the update. Readers see all of it or nothing; an update that
    ends half-way is run again. Returns the report of ``ingest``."""
    state, report = staged_update(spark, root, manifests, fingerprints, buckets)
    if state is not None:
        store.publish(spark, root, state)
    return report


def create_catalog(spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
    """An empty stored catalog."""
    before = store.latest(spark, root)
    store.publish(spark, root, store.Published(before.generation + 1 if before else 1, schemas.CATALOG_VERSION, buckets, {}))


def source_key(fingerprint: Column) -> Column:
    return F.xxhash64(fingerprint)


def extract_key() -> Column:
    return F.xxhash64("source_id", "created_at", "segmenter", "analyzer", "game_profile")


def _with_winners(rows: DataFrame) -> DataFrame:
    """Mark the rows whose manifest is the last, in path order, for its extract,
    for its source, and for its source's summary.

    Winners are found on the narrow key columns; the wide rows are joined once,
    by path, and written, as every table is derived from them.
    """
    keys = rows.select("manifest_path", "extract_id", "source_id", F.col("summary").isNotNull().alias("told"))
    told = F.when(F.col("told"), F.col("manifest_path"))
    by_extract = keys.groupBy("extract_id").agg(F.max("manifest_path").alias("_e"))
    by_source = keys.groupBy("source_id").agg(F.max("manifest_path").alias("_s"), F.max(told).alias("_t"))
    flags = written(keys.join(by_extract, "extract_id").join(by_source, "source_id").select(
        "manifest_path", (F.col("manifest_path") == F.col("_e")).alias("_extract_wins"),
        (F.col("manifest_path") == F.col("_s")).alias("_source_wins"),
        F.coalesce(F.col("manifest_path") == F.col("_t"), F.lit(False)).alias("_summary_wins"),
    ), "winners")
    return written(rows.join(broadcast_if_small(flags), "manifest_path"), "marked")


def prepare_manifests(manifests: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """Flat manifest rows with keys. ``fingerprints`` (``path, fingerprint``) are
    those of the files that exist; others get a ``missing:`` key."""
    rows = manifests.withColumn("file_path", F.col("source.file"))
    if fingerprints is not None:
        known = fingerprints.select(F.col("path").alias("file_path"), "fingerprint")
        rows = rows.join(known, "file_path", "left")
    else:
        rows = rows.withColumn("fingerprint", F.lit(None).cast("string"))
    rows = rows.withColumn("fingerprint", F.coalesce("fingerprint", F.concat(F.lit("missing:"), F.col("file_path"))))
    rows = rows.select("manifest_path", "file_path", "fingerprint", "source", "extract.*", "taxonomy", "clips", "summary",
                       F.coalesce(F.size(F.filter("clips", lambda c: ~_score_fits(c["score"]))), F.lit(0)).alias("refused_scores"))
    rows = rows.withColumn("source_id", source_key(F.col("fingerprint")))
    return rows.withColumn("extract_id", extract_key())


def manifest_clips(rows: DataFrame) -> DataFrame:
    """Clips of manifests. A clip is known by its local id; a manifest's further clips of the same local id are told apart
    by their place in it."""
    each = rows.select("extract_id", "source_id", F.transform("clips", lambda c: c["id"]).alias("_ids"),
                       F.posexplode("clips").alias("_place", "c"))
    first = F.array_position("_ids", F.col("c.id")) - 1
    known = F.when(F.coalesce(first, F.col("_place")) == F.col("_place"), F.xxhash64("extract_id", "c.id")).otherwise(
        F.xxhash64("extract_id", "c.id", "_place"))
    return each.select(
        known.alias("clip_id"), "extract_id", "source_id",
        F.col("c.id").alias("clip_local_id"), "c.file", "c.source_in", "c.source_out", "c.duration",
        "c.resolution", "c.fps", "c.description", F.coalesce("c.dialogue", F.lit("")).alias("dialogue"),
        "c.score", "c.segment_source", F.coalesce("c.game_signals", F.lit("{}")).alias("game_signals"),
        F.col("c.audio.peak_loudness_db").alias("peak_loudness_db"),
        F.coalesce("c.audio.cues", F.array().cast("array<string>")).alias("audio_cues"),
        F.coalesce("c.keyframes", F.array().cast("array<string>")).alias("keyframes"),
        F.array_sort(F.array_distinct(F.coalesce("c.categories", F.array().cast("array<string>")))).alias("categories"),
    )


def replaced(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` without the incoming keys, plus ``incoming``."""
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def category_lists(categories: DataFrame) -> DataFrame:
    """``clip_id, categories``: the sorted, distinct categories of each clip."""
    return categories.groupBy("clip_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def _score_fits(score: Column) -> Column:
    return F.coalesce(score.between(0, 100), F.lit(False))


def _fitting(prepared: DataFrame) -> DataFrame:
    return prepared.filter("refused_scores <= 0")


def _refused(prepared: DataFrame) -> DataFrame:
    """Report rows of manifests with a score outside 0 to 100."""
    return prepared.filter("refused_scores > 0").select(
        "manifest_path", "source_id", "extract_id", F.lit(0).alias("clip_count"), F.lit(False).alias("created"), "refused_scores")


def ingest(catalog: Catalog, manifests: DataFrame, fingerprints: DataFrame | None = None) -> tuple[Catalog, DataFrame]:
    """Fold manifests into the catalog; repeating it changes nothing.

    Sources update by fingerprint, extracts by their five-part key; a known
    extract gets the new path and taxonomy and all its clips replaced. Within one
    batch the last manifest in path order wins. A manifest with a score outside 0
    to 100 is refused as a whole. Returns the new catalog and one result row per
    extract, and per refused manifest: ``manifest_path, source_id, extract_id,
    clip_count, created, refused_scores`` (how many scores made it refused, or 0).
    """
    # Every table is derived from the batch, so it is parsed and written aside once.
    rows = written(prepare_manifests(manifests, fingerprints), "manifests")
    updated, report = _fold(catalog, _with_winners(_fitting(rows)))
    return updated, report.unionByName(_refused(rows))


def _fold(catalog: Catalog, rows: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog with ``rows``, prepared manifests with their winners marked, and their report."""
    latest = rows.filter("_extract_wins")
    seen = catalog.sources.select("source_id", F.col("has_audio").alias("_had"))
    sources = (
        rows.filter("_source_wins")
        .select("source_id", "file_path", "fingerprint", "source.duration", "source.resolution", "source.fps")
        .join(seen, "source_id", "left")
        .withColumn("has_audio", F.coalesce("_had", F.lit(1)))
    )
    summaries = rows.filter("_summary_wins").select("source_id", "summary.*")
    clips = manifest_clips(latest)
    categories = clips.select(*_KEYS, F.explode("categories").alias("category"))
    texts = clip_texts(clips)
    postings = build_postings(texts, _KEYS, FIELDS)

    gone = latest.select("extract_id")
    swap = lambda old, new: (
        old.join(gone, "extract_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    )
    updated = Catalog(
        sources=replaced(catalog.sources, sources, "source_id"),
        extracts=replaced(catalog.extracts, latest, "extract_id"),
        clips=swap(catalog.clips, clips),
        clip_categories=swap(catalog.clip_categories, categories),
        source_summaries=replaced(catalog.source_summaries, summaries, "source_id"),
        postings=swap(catalog.postings, postings),
        lengths=swap(catalog.lengths, text_lengths(texts, _KEYS, FIELDS)),
    )
    return updated, _report(catalog, rows)


def _report(catalog: Catalog, rows: DataFrame) -> DataFrame:
    known = catalog.extracts.select("extract_id", F.lit(False).alias("_new"))
    return rows.filter("_extract_wins").join(known, "extract_id", "left").select(
        "manifest_path", "source_id", "extract_id", F.size("clips").alias("clip_count"),
        F.coalesce("_new", F.lit(True)).alias("created"), F.lit(0).alias("refused_scores"),
    )


def remove_manifest(catalog: Catalog, manifest_path: str) -> tuple[Catalog, DataFrame]:
    """Drop the extracts of one manifest with everything below them; sources stay.
    Returns the new catalog and the removed extracts."""
    gone = catalog.extracts.filter(F.col("manifest_path") == manifest_path)
    return _without(catalog, gone), gone


def _without(catalog: Catalog, gone: DataFrame) -> Catalog:
    keys = gone.select("extract_id")
    left = lambda t: t.join(keys, "extract_id", "left_anti").select(*t.columns)
    return replace(
        catalog, extracts=left(catalog.extracts), clips=left(catalog.clips),
        clip_categories=left(catalog.clip_categories), postings=left(catalog.postings),
        lengths=left(catalog.lengths),
    )


def remove_stored(spark: SparkSession, root: str, manifest_path: str) -> DataFrame:
    """``remove_manifest`` for the catalog stored at ``root``: the manifest is found in the extracts, and only the buckets
    of its sources are read whole and replaced. Returns the removed extracts; a manifest that is not there removes nothing."""
    state = published_state(spark, root)
    gone = written(read_catalog(spark, root, state=state).extracts.filter(F.col("manifest_path") == manifest_path), "gone")
    only = touched_buckets(gone, state.buckets)
    if only:
        store.publish(spark, root, stage(_without(read_catalog(spark, root, only, state), gone), root, state, only))
    return gone


def upgrade_catalog(sources: DataFrame, extracts: DataFrame, clips: DataFrame, categories: DataFrame,
                    summaries: DataFrame) -> Catalog:
    """Bring older tables to the current shape: clips without ``dialogue`` get an
    empty one and the text index is rebuilt."""
    if "dialogue" not in clips.columns:
        clips = clips.withColumn("dialogue", F.lit(""))
    clips = clips.withColumn("dialogue", F.coalesce("dialogue", F.lit("")))
    if "source_id" not in clips.columns:
        clips = clips.join(extracts.select("extract_id", "source_id"), "extract_id")
    if "extract_id" not in categories.columns:
        categories = categories.join(clips.select("clip_id", "extract_id", "source_id"), "clip_id")
    if "audio_cues" not in clips.columns:
        audio = F.try_parse_json("audio_json")
        clips = clips.withColumns({
            "peak_loudness_db": get(audio, "$.peak_loudness_db", "double"),
            "audio_cues": F.coalesce(get(audio, "$.cues", "array<string>"), F.array().cast("array<string>")),
        })
    clips = clips.drop("categories").join(category_lists(categories), "clip_id", "left").withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>"))
    )
    texts = clip_texts(clips)
    shaped = {
        "sources": sources, "extracts": extracts, "clips": clips, "clip_categories": categories,
        "source_summaries": summaries, "postings": build_postings(texts, _KEYS, FIELDS),
        "lengths": text_lengths(texts, _KEYS, FIELDS),
    }
    return Catalog(**{
        n: t.select(*[c.split()[0] for c in _columns(_TABLES[n])]) for n, t in shaped.items()
    })


def _columns(ddl: str) -> list[str]:
    """Top-level column definitions of a table's DDL text."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def stats(catalog: Catalog) -> DataFrame:
    """Row counts of the four main tables: ``table_name, row_count``."""
    out = None
    for name in ("sources", "extracts", "clips", "clip_categories"):
        one = getattr(catalog, name).groupBy().count().select(F.lit(name).alias("table_name"), F.col("count").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


def stored_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of the files of the published catalog, from file metadata."""
    paths = [f"{root}/{f}" for f in published_state(spark, root).folders.values()]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    sizes = files.load(paths).select("length") if paths else spark.createDataFrame([], "length bigint")
    return sizes.groupBy().agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))


def list_sources(catalog: Catalog) -> DataFrame:
    """Every source with its extract and clip counts, by id."""
    extracts = catalog.extracts.groupBy("source_id").agg(F.count("*").alias("extract_count"))
    clips = catalog.clips.groupBy("source_id").agg(F.count("*").alias("clip_count"))
    zero = F.lit(0).cast("bigint")
    return (
        catalog.sources.join(extracts, "source_id", "left").join(clips, "source_id", "left")
        .withColumns({"extract_count": F.coalesce("extract_count", zero), "clip_count": F.coalesce("clip_count", zero)})
        .orderBy("source_id")
    )


def list_extracts(catalog: Catalog, limit: int = 50) -> DataFrame:
    """The first extracts by id with source path and clip count."""
    top = catalog.extracts.orderBy("extract_id")
    top = top.limit(limit) if limit >= 0 else top
    counts = catalog.clips.groupBy("extract_id").agg(F.count("*").alias("clip_count"))
    return (
        top.join(catalog.sources.select("source_id", "file_path"), "source_id")
        .join(counts, "extract_id", "left")
        .select(
            "extract_id", "segmenter", "analyzer", "game_profile", "created_at", "manifest_path", "file_path",
            F.coalesce("clip_count", F.lit(0).cast("bigint")).alias("clip_count"),
        )
        .orderBy("extract_id")
    )
