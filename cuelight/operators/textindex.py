"""Inverted index over clip texts and structured full-text matching.

``texts``: an id column and text columns. ``postings``: ``term, <id>, field,
pos``. Matching takes terms as data (all, any, none, phrase, prefix), never a
query string.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stem import stem, stem_all
from ..functions.text import folded_tokens, strip, tokens

# Ranking constants (Okapi BM25 as published for full-text tables).
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6

FIELDS = ("description", "dialogue", "audio_cues", "tags")


@dataclass(frozen=True)
class TextQuery:
    """``all_of``: every term; ``any_of``: at least one; ``none_of``: not one;
    ``phrase``: terms next to each other in one field; ``prefix``: terms beginning
    with each of these; ``fields``: where to look (everywhere when empty)."""

    all_of: Sequence[str] = ()
    any_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    phrase: Sequence[str] = ()
    prefix: Sequence[str] = ()
    fields: Sequence[str] = field(default=())


# A key with its colon (not captured), or a scalar value (captured).
_STRING = r'"(?:[^"\\]|\\.)*+"'
_LEAF = _STRING + r"\s*:|(" + _STRING + r"|-?[0-9][0-9.eE+-]*+|true|false)"


def signal_values(signals: Column) -> Column:
    """Leaf values of a JSON object as text, at any depth and in input order;
    keys and nulls are left out."""
    leaves = F.filter(F.regexp_extract_all(signals, F.lit(_LEAF), F.lit(1)), lambda v: v != "")
    texts = F.from_json(F.concat(F.lit("["), F.array_join(leaves, ","), F.lit("]")), "array<string>")
    valid = F.try_parse_json(signals).isNotNull()
    return F.filter(F.when(valid, texts), lambda w: strip(w) != "")


def clip_texts(clips: DataFrame) -> DataFrame:
    """The four searchable texts of each clip."""
    none = F.array().cast("array<string>")
    return clips.select(
        "clip_id", "extract_id", "source_id", "description", F.coalesce("dialogue", F.lit("")).alias("dialogue"),
        F.concat_ws(" ", F.coalesce("audio_cues", none)).alias("audio_cues"),
        F.concat_ws(" ", F.concat(F.coalesce("categories", none), F.coalesce(signal_values(F.col("game_signals")), none))).alias("tags"),
    )


def build_postings(texts: DataFrame, ids: Sequence[str], fields: Sequence[str], stemmed: bool = True) -> DataFrame:
    """One row per token occurrence. Needs no shuffle."""
    named = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in fields
    ]))
    words = texts.select(*ids, named.alias("f")).select(*ids, "f.field", "f.words")
    if stemmed:
        words = words.withColumn("words", stem_all("words"))
    return words.select(*ids, "field", F.posexplode("words").alias("pos", "term")).select(
        "term", *ids, "field", "pos"
    )


def field_statistics(texts: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Tokens and distinct tokens of each field that has any: ``<ids>, field, tokens, terms``. Needs no shuffle."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in fields]))
    words = texts.select(*ids, named.alias("f")).select(*ids, "f.field", "f.words")
    return words.filter(F.size("words") > 0).select(
        *ids, "field", F.size("words").cast("bigint").alias("tokens"), F.size(F.array_distinct("words")).cast("bigint").alias("terms"))


def text_lengths(texts: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Tokens per document, straight from its texts. Needs no shuffle."""
    total = sum((F.size(tokens(F.col(f))) for f in fields), F.lit(0)).cast("bigint")
    return texts.select(*ids, total.alias("length"))


def document_lengths(postings: DataFrame, id_column: str = "clip_id") -> DataFrame:
    return postings.groupBy(id_column).agg(F.count("*").alias("length"))


def query_terms(word: str, stemmed: bool) -> list[str]:
    """The index terms of a query word: one, or several where the index parts it (``well-known``), or none."""
    return [stem(w) if stemmed else w for w in folded_tokens(word)]


def _parted(words: Sequence[str], stemmed: bool) -> tuple[list[str], list[list[str]]]:
    """Single terms of query words, and those that are phrases."""
    terms = [query_terms(w, stemmed) for w in words]
    return sorted({t[0] for t in terms if len(t) == 1}), [t for t in terms if len(t) > 1]


def _searched(postings: DataFrame, query: TextQuery) -> DataFrame:
    return postings.filter(F.col("field").isin(list(query.fields))) if query.fields else postings


def match(postings: DataFrame, query: TextQuery, id_column: str = "clip_id", stemmed: bool = True) -> DataFrame:
    """Ids of the documents that satisfy ``query``. Sets gathered per document
    hold at most the query's terms."""
    base = _searched(postings, query)
    found = None

    def narrow(ids: DataFrame) -> DataFrame:
        return ids if found is None else found.join(ids, id_column, "left_semi")

    def phrase(terms: list[str]) -> DataFrame:
        return _phrases(base, terms, id_column).select(id_column).distinct()

    def having_any(words: Sequence[str]) -> DataFrame:
        single, phrases = _parted(words, stemmed)
        ids = base.filter(F.col("term").isin(single)).select(id_column)
        for p in phrases:
            ids = ids.unionByName(phrase(p))
        return ids.distinct()

    wanted, parted = _parted(query.all_of, stemmed)
    if wanted:
        hits = base.filter(F.col("term").isin(wanted)).groupBy(id_column)
        found = narrow(hits.agg(F.collect_set("term").alias("t")).filter(F.size("t") == len(wanted)).select(id_column))
    for p in parted:
        found = narrow(phrase(p))
    if query.any_of:
        found = narrow(having_any(query.any_of))
    for beginning in query.prefix:
        found = narrow(base.filter(_begins(beginning, stemmed)).select(id_column).distinct())
    if query.phrase:
        found = narrow(phrase([t for w in query.phrase for t in query_terms(w, stemmed)]))
    if found is None:
        found = base.select(id_column).distinct()
    if query.none_of:
        found = found.join(having_any(query.none_of), id_column, "left_anti")
    return found


def _begins(beginning: str, stemmed: bool) -> Column:
    """Terms that begin as asked; what is asked is folded and stemmed like the index, so ``running`` begins ``run``."""
    terms = query_terms(beginning, stemmed)
    return F.col("term").startswith(terms[-1]) if terms else F.lit(False)


def _phrases(postings: DataFrame, words: list[str], id_column: str) -> DataFrame:
    """Places where the words stand at consecutive positions of one field: every
    occurrence votes for the position where its phrase would begin."""
    slots = F.explode(F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)
    ]))
    votes = (
        postings.filter(F.col("term").isin(words))
        .select(id_column, "field", "pos", "term", slots.alias("s"))
        .filter("term = s.w")
        .groupBy(id_column, "field", (F.col("pos") - F.col("s.i")).alias("begin"))
        .agg(F.collect_set("s.i").alias("slots"))
    )
    return votes.filter(F.size("slots") == len(words)).select(id_column, "field", "begin")


def occurrences(postings: DataFrame, query: TextQuery, id_column: str = "clip_id", stemmed: bool = True) -> DataFrame:
    """How often each positive part of the query (a term, a prefix, the phrase)
    occurs in each document: ``id, part, tf``."""
    base = _searched(postings, query)
    counted = lambda rows, part: rows.groupBy(id_column, part.alias("part")).agg(F.count("*").alias("tf"))
    parts = []
    terms, phrases = _parted([*query.all_of, *query.any_of], stemmed)
    if terms:
        parts.append(counted(base.filter(F.col("term").isin(terms)), F.concat(F.lit("="), F.col("term"))))
    for beginning in query.prefix:
        parts.append(counted(base.filter(_begins(beginning, stemmed)), F.lit(beginning + "*")))
    if query.phrase:
        phrases.append([t for w in query.phrase for t in query_terms(w, stemmed)])
    for p in phrases:
        parts.append(counted(_phrases(base, p, id_column), F.lit(" ".join(p))))
    if not parts:
        return base.select(id_column, F.lit("").alias("part"), F.lit(0).cast("bigint").alias("tf")).limit(0)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def rank(postings: DataFrame, lengths: DataFrame, query: TextQuery, id_column: str = "clip_id",
         stemmed: bool = True) -> DataFrame:
    """Negated BM25 of every document with a positive part of the query:
    ascending is best.

    Document count and mean length are two numbers; document frequencies are one
    row per part of the query.
    """
    n_docs, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    n_docs, mean = int(n_docs or 0), float(mean or 1.0)
    tf = occurrences(postings, query, id_column, stemmed)
    df = tf.groupBy("part").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(MIN_IDF), F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = (
        F.col("idf") * F.col("tf") * (K1 + 1)
        / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    )
    return (
        tf.join(F.broadcast(df.select("part", idf.alias("idf"))), "part")
        .join(lengths, id_column)
        .groupBy(id_column)
        .agg((-F.sum(weight)).alias("rank"))
    )


def remove_documents(postings: DataFrame, gone: DataFrame, id_column: str = "clip_id") -> DataFrame:
    return postings.join(gone.select(id_column), id_column, "left_anti").select(*postings.columns)
