"""Faceted and full-text search over a catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .catalog import Catalog, category_lists
from .matching import Match, ranked
from .textindex import TextQuery, match, rank

# Sort orders by name.
ORDERS = {
    "score": ("score", False), "duration": ("duration", False),
    "created_at": ("extract_created_at", False), "timeline": ("source_in", True),
}
DEFAULT_LIMIT = 50
PREVIEW = [
    "clip_id", "clip_local_id", "description", "dialogue", "categories", "duration", "score", "source_in",
    "source_out", "source_file", "file", "keyframes", "game_signals", "audio", "resolution", "fps",
]


def signal_equals(signals: Column, key: str, value: str) -> Column:
    found = F.get_json_object(signals, f"$.{key}")
    truth = {"true": "1", "false": "0", "1": "true", "0": "false"}.get(value)
    same = found == value
    return same | (found == truth) if truth in ("true", "false") or value in ("true", "false") else same


def signal_like(signals: Column, key: str, value: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in ``value`` are wildcards. A flag matches as the word or as the
    number, as in ``signal_equals``."""
    pattern = "%" + value.replace("\\", "\\\\") + "%"
    found = F.get_json_object(signals, f"$.{key}")
    flag = F.when(found == "true", "1").when(found == "false", "0")
    return found.ilike(pattern) | F.coalesce(flag.like(pattern), F.lit(False))


def signal_filter(argument: str) -> tuple[str, str, str]:
    """``key=value`` or ``key~=value`` as the parts that ``search`` takes; the value may hold further equals signs."""
    key, equals, value = argument.partition("=")
    op = "~=" if key.endswith("~") else "="
    key = key.removesuffix("~").strip()
    if not equals or not key:
        raise ValueError(f"a signal filter is key=value or key~=value: {argument!r}")
    return key, op, value.strip()


def with_categories(clips: DataFrame, categories: DataFrame) -> DataFrame:
    """Add the sorted category list of each clip."""
    return clips.join(category_lists(categories), "clip_id", "left").withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>"))
    )


def in_any_category(clips: DataFrame, categories: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return clips.join(categories.filter(F.col("category").isin(list(wanted))), "clip_id", "left_semi")


def in_all_categories(clips: DataFrame, categories: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Clips that have every wanted category; a repeated name can match nothing,
    because the list is counted as given."""
    hits = (
        categories.filter(F.col("category").isin(list(wanted)))
        .groupBy("clip_id").agg(F.collect_set("category").alias("found"))
        .filter(F.size("found") == len(wanted))
    )
    return clips.join(hits, "clip_id", "left_semi")


def has_any(wanted: Sequence[str]) -> Column:
    return F.arrays_overlap("categories", F.array(*[F.lit(c) for c in wanted]))


def has_all(wanted: Sequence[str]) -> Column:
    """All wanted categories; the list is counted as given, so a repeated name
    matches nothing."""
    found = F.array_intersect("categories", F.array(*[F.lit(c) for c in wanted]))
    return F.size(found) == len(wanted)


def absolute_path(path: Column, manifest_path: Column) -> Column:
    """A path relative to the manifest's folder made absolute, without ``.`` and
    ``..`` steps."""
    scheme = r"^([A-Za-z][A-Za-z0-9+.-]*://|/)"
    folder = F.regexp_replace(manifest_path, r"[^/]*$", "")
    root = F.regexp_extract(folder, scheme, 1)
    steps = F.split(F.concat(F.regexp_replace(folder, scheme, ""), path), "/")
    walked = F.aggregate(
        F.filter(steps, lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(
            F.concat(kept, F.array(s))),
    )
    return F.when(path.rlike(scheme), path).otherwise(F.concat(root, F.array_join(walked, "/")))


def relative_path(path: Column, base: Column) -> Column:
    """A path below ``base`` made relative to it; others stay as they are."""
    inside = F.startswith(path, F.concat(base, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def _joined(catalog: Catalog, clips: DataFrame, extracts: DataFrame, sources: DataFrame) -> DataFrame:
    e = extracts.select(
        "extract_id", F.col("segmenter").alias("extract_segmenter"), F.col("analyzer").alias("extract_analyzer"),
        F.col("game_profile").alias("extract_game_profile"), F.col("created_at").alias("extract_created_at"),
        "manifest_path",
    )
    s = sources.select(
        "source_id", F.col("file_path").alias("source_file"), F.col("fingerprint").alias("source_fingerprint")
    )
    return clips.join(e, "extract_id").join(s, "source_id")


def _projected(rows: DataFrame) -> DataFrame:
    """The 27-column result row."""
    return rows.select(
        "clip_id", "clip_local_id", "description", "dialogue", "score", "duration", "source_in", "source_out",
        absolute_path(F.col("file"), F.col("manifest_path")).alias("file"),
        F.transform("keyframes", lambda k: absolute_path(k, F.col("manifest_path"))).alias("keyframes"),
        "categories", "game_signals",
        F.struct("peak_loudness_db", F.col("audio_cues").alias("cues")).alias("audio"),
        "segment_source", "resolution", "fps", "extract_id", "extract_segmenter", "extract_analyzer",
        "extract_game_profile", "extract_created_at", "manifest_path", "source_id", "source_file",
        "source_fingerprint", "fts_rank", F.col("categories").alias("matched_categories"),
    )


def search(
    catalog: Catalog,
    *,
    query: TextQuery | Match | str | None = None,
    categories: Sequence[str] | None = None,
    all_categories: bool = False,
    min_score: int | None = None,
    max_score: int | None = None,
    min_duration: float | None = None,
    max_duration: float | None = None,
    segmenter: str | None = None,
    game_profile: str | None = None,
    source: str | None = None,
    signals: Sequence[tuple[str, str, str] | str] | None = None,
    order_by: str = "score",
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Clips that pass every given filter, best first.

    Filters on clip columns reach the file scan, category tests read the list
    kept with each clip, extracts and sources are filtered before they are
    joined. Ties are broken by clip id. A negative limit means no limit.
    ``signals`` are ``(key, "=" or "~=", value)``, or texts such as ``map~=dust``.
    ``query`` is a structured one, or a match expression (``matching``) as a tree or
    a text.
    """
    clips = catalog.clips
    for column, low, high in (("score", min_score, max_score), ("duration", min_duration, max_duration)):
        if low is not None:
            clips = clips.filter(F.col(column) >= low)
        if high is not None:
            clips = clips.filter(F.col(column) <= high)
    for given in signals or []:
        key, op, value = signal_filter(given) if isinstance(given, str) else given
        test = signal_equals if op == "=" else signal_like
        clips = clips.filter(test(F.col("game_signals"), key, value))
    if categories:
        clips = clips.filter(has_all(categories) if all_categories else has_any(categories))

    extracts, sources = catalog.extracts, catalog.sources
    if segmenter:
        extracts = extracts.filter(F.col("segmenter") == segmenter)
    if game_profile:
        extracts = extracts.filter(F.col("game_profile") == game_profile)
    if source:
        sources = sources.filter((F.col("file_path") == source) | (F.col("fingerprint") == source))

    lengths = catalog.lengths.select("clip_id", "length")
    if isinstance(query, TextQuery):
        hits = match(catalog.postings, query)
        scores = rank(catalog.postings, lengths, query)
        clips = clips.join(hits, "clip_id", "left_semi").join(
            scores.withColumnRenamed("rank", "fts_rank"), "clip_id", "left"
        )
    elif query is not None:
        clips = clips.join(ranked(catalog.postings, lengths, query).withColumnRenamed("rank", "fts_rank"), "clip_id")
    else:
        clips = clips.withColumn("fts_rank", F.lit(None).cast("double"))

    column, ascending = ORDERS.get(order_by, ORDERS["score"])
    order = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("clip_id")]
    if query is not None and order_by != "timeline":
        order = [F.col("fts_rank").asc_nulls_last(), *order]

    # Every clip has an extract and a source, so without a filter on those the
    # best clips are known before the joins.
    early = limit >= 0 and column in clips.columns and not (segmenter or game_profile or source)
    if early:
        clips = clips.orderBy(*order).limit(limit)
    rows = _joined(catalog, clips, extracts, sources).orderBy(*order)
    return _projected(rows.limit(limit) if limit >= 0 and not early else rows)


def get_clip(catalog: Catalog, clip_id: int) -> DataFrame:
    """The result row of one clip; no row when it is absent."""
    clips = catalog.clips.filter(F.col("clip_id") == clip_id)
    rows = _joined(catalog, clips, catalog.extracts, catalog.sources).withColumn("fts_rank", F.lit(None).cast("double"))
    return _projected(rows)


def get_source(catalog: Catalog, source_id: int) -> DataFrame:
    return catalog.sources.filter(F.col("source_id") == source_id)


def get_summary(catalog: Catalog, source_id: int) -> DataFrame:
    return catalog.source_summaries.filter(F.col("source_id") == source_id)


def preview(clips: DataFrame) -> DataFrame:
    """The columns needed to decide whether a clip fits an edit."""
    return clips.select(*PREVIEW)
