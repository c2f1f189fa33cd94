"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification, groups."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shingles import hashed_runs, linked_sketches, sketches
from .tables import components, stored

BITS = 64
#: Words of a shingle, where texts are linked by their shingles, and sets of a crowded shingle.
SHINGLE, CROWDED = 5, 32


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned number.

    Words are runs of other than space and U+0009 to U+000D after A-Z are lower-cased. Each run of ``words`` words,
    repeats included, is hashed with XXH64; a bit is set if it is set in over half the hashes. A shorter text has one
    run, all its words; a text without words has fingerprint 0. A long text is read piece by piece.
    """
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in hashed_runs(text, words, seed):
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            block = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``(doc_id, print)``, the fingerprint as a signed long, for every row of ``docs``; null text: empty."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(hashed, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, print long")


def block_keys(value: Column, distance: int, blocks: int) -> list[Column]:
    """A fingerprint's blocks in every choice of ``blocks - distance`` of them: two fingerprints that differ in at most
    ``distance`` bits differ in at most so many blocks, so they share a key."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def mask(choice: tuple[int, ...]) -> int:
        bits = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        return bits - (1 << BITS) if bits >= 1 << (BITS - 1) else bits

    return [F.struct(F.lit(n).alias("choice"), value.bitwiseAND(F.lit(mask(c))).alias("bits"))
            for n, c in enumerate(combinations(range(blocks), blocks - distance))]


def close_links(prints: DataFrame, distance: int = 2, blocks: int = 4, crowded: int = 64) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints of ``prints(print)`` exactly as their pairs at
    ``distance`` or fewer bits do.

    Fingerprints are joined on pigeonhole block keys and pairs are verified. A block that holds more than ``crowded``
    fingerprints would make pairs with the square of its size; its fingerprints are instead hung on the values around
    them: all that differ from the same value in at most half the distance are linked to one of them. Two
    fingerprints share such a value exactly if they are close (for an even distance), so no link is lost and none is
    added, at a cost in proportion to the fingerprints.
    """
    if distance % 2:
        raise ValueError("an even distance is needed")
    if not distance < blocks:
        raise ValueError("more blocks than differing bits are needed")
    keyed = stored(prints.select("print", F.explode(F.array(*block_keys(F.col("print"), distance, blocks))).alias("key"))
                   .select("print", "key.choice", "key.bits"), "blocks")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = keyed.join(sizes, ["choice", "bits"])
    small = sized.filter(F.col("size") <= crowded).select("choice", "bits", "print")
    pairs = (
        small.select("choice", "bits", F.col("print").alias("a"))
        .join(small.select("choice", "bits", F.col("print").alias("b")), ["choice", "bits"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    flips = [0] + [sum(1 << i for i in c) for n in range(1, distance // 2 + 1) for c in combinations(range(BITS), n)]
    signed = [f - (1 << BITS) if f >= 1 << (BITS - 1) else f for f in flips]
    around = (
        sized.filter(F.col("size") > crowded).select("print").distinct()
        .select("print", F.explode(F.array(*map(F.lit, signed))).alias("flip"))
        .select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("value"))
    )
    least = around.groupBy("value").agg(F.min("print").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hung = around.join(least, "value").filter("print <> least").select(F.col("least").alias("a"), F.col("print").alias("b"))
    return pairs.unionByName(hung)


def _marked(rows: DataFrame, words: int, seed: int, similar: float | None) -> DataFrame:
    """The fingerprints of ``rows(doc_id, text)``, stored; with ``similar``, their sketches too."""
    if similar is None:
        return stored(fingerprints(rows, words, seed), "fingerprints")
    return stored(sketches(rows, lambda text: fingerprint(text, words, seed), Fraction(str(similar)), SHINGLE, seed), "sketches")


def _rooted(found: DataFrame, texts: DataFrame, distance: int, blocks: int, seed: int, similar: float | None) -> DataFrame:
    """Rows ``(print, first, root)``: each fingerprint of ``found``, its least id, and the least fingerprint that links
    reach."""
    nodes = stored(found.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    links = close_links(nodes.select("print"), distance, blocks)
    if similar is not None:
        links = links.unionByName(linked_sketches(texts, found, Fraction(str(similar)), SHINGLE, seed, CROWDED))
    reach = components(links)
    rooted = nodes.join(reach.withColumnRenamed("node", "print"), "print", "left")
    return rooted.withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4,
                    id_column: str = "doc_id", text_column: str = "text", similar: float | None = None) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one per row of ``docs``: the fingerprint as 16 hexadecimal digits
    and the smallest document id that links reach.

    Texts of one fingerprint are one node, so copies, however many, never meet in pairs. A text without words has
    fingerprint 0, which links like any other; so does a null text. Rows that repeat an id keep their own fingerprint
    and component. A row with a null id has its component's id, or null if the component has no other. Other columns
    are not read. An empty table gives an empty one. With ``similar``, texts whose sets of five-word shingles have that
    Jaccard similarity or more are linked too, however far their fingerprints are.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = _marked(rows, words, seed, similar)
    rooted = _rooted(found, rows, distance, blocks, seed, similar)
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("print", "component_id")
    return found.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is their component's. A row that repeats a kept id is dropped; rows with a null id
    name no document and stay. For tables of distinct ids: where rows of one id are in two groups, one of these can be
    left without a row; ``keep_one`` holds for any table."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(id_column)}"
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(at)).distinct()
    named = plain.join(kept, at, "left_semi").dropDuplicates([at])
    return named.select(*plain.columns).unionByName(plain.filter(F.col(at).isNull())).toDF(*docs.columns)


def keep_one(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4,
             id_column: str = "doc_id", text_column: str = "text", similar: float | None = None) -> DataFrame:
    """Exactly one row of ``docs`` for each group of ``near_duplicates``: that of the least id, null ids last, and of the
    least hash of the text among rows that repeat the id. Groups are told by their fingerprints, so it makes no
    difference whether ids repeat or are null. Rows of one id and text are exchangeable. Null and empty texts are one group. An empty table gives
    an empty one; columns stay, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, text = (f"c{docs.columns.index(c)}" for c in (id_column, text_column))
    key = {"none": F.col(at).isNull(), "id": F.coalesce(F.col(at), F.lit(0).cast(plain.schema[at].dataType)), "hash": F.xxhash64(text)}
    rows = plain.select(F.struct(*[c.alias(n) for n, c in key.items()]).alias("doc_id"), F.col(text).alias("text"))
    found = _marked(rows, words, seed, similar)
    rooted = _rooted(found, rows, distance, blocks, seed, similar)
    kept = found.join(rooted.select("print", "root"), "print").groupBy("root").agg(F.min("doc_id").alias("row")).select("row.*")
    same = plain.withColumns(key).join(kept, [*key], "left_semi").dropDuplicates([*key])
    return same.select(*plain.columns).toDF(*docs.columns)
