"""Texts that share most of their word shingles: an exact similarity join by prefixes of rare shingles."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import pieces
from .tables import Scratch, components, stored

#: Counters of shingles, size of a part of a crowded key (a set counts one and one more for every 256 shingles), most bits of the filter
#: on shingles and bits of that on sets, shingles of a batch.
COUNTED, BLOCK, REPEATED, WANTED, BATCH = 1 << 22, 256, 29, 1 << 24, 1 << 18
#: Counters of a segment; bits of a place in a segment of the places of shingles; the bit of a shingle at which its place begins.
SEGMENT, RANGE, SHIFT = 1 << 15, 24, 22


def hashed_runs(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 hashes of the runs of ``words`` words of a text, repeats included, a piece of the text after the other.

    Words are runs of other than space and U+0009 to U+000D after A-Z are lower-cased. A shorter text has one run, all its words; one
    without words has none.
    """
    import xxhash

    digest, carry, short = xxhash.xxh64_intdigest, [], True
    for piece in pieces(text.encode()):
        parts = [*carry, *piece.lower().split()]
        if len(parts) < words:
            carry = parts
            continue
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[:len(parts) - words].tolist()]
        stops = (ends[words - 1:] - 1).tolist()
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)
        carry, short = parts[len(parts) - words + 1:], False
    if short and carry:
        yield np.array([digest(b" ".join(carry), seed)], dtype=np.uint64)


def shingles(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the runs of words of a text."""
    runs = [np.unique(r) for r in hashed_runs(text, words, seed)]
    return (runs[0] if len(runs) == 1 else np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *runs]))).view(np.int64)


def signature(hashes: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    import xxhash

    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7))


def signed(number: int) -> int:
    """An unsigned number of 64 bits as a signed long."""
    return number - (1 << 64) if number >= 1 << 63 else number


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def occurrences(texts: DataFrame, words: int, seed: int) -> np.ndarray:
    """How often shingles occur in ``texts(text)``, all of them, in ``COUNTED`` counters that shingles share by their last bits. They only
    set the order of shingles: the join is exact with any order, and fast if rare ones come first, of whatever size the table is. Tasks count
    their own texts, and counters are added up segment by segment, each by one task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(COUNTED, dtype="<u4"), [], 0

        def add() -> None:
            place, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]) & COUNTED - 1, return_counts=True)
            counts[place] += n.astype(np.uint32)

        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py() or "", words, seed))
                size += len(held[-1])
                if size > BATCH:
                    add()
                    held, size = [], 0
        add()
        for at in range(0, COUNTED, SEGMENT):
            part = counts[at:at + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // SEGMENT]), pa.array([zlib.compress(part.tobytes(), 1)])], names=["segment", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(*batch.columns):
                more = np.frombuffer(zlib.decompress(counts.as_py()), dtype="<u4").astype(np.int64)
                sums[segment.as_py()] = sums.get(segment.as_py(), 0) + more
        for segment, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([np.minimum(counts, 65535).astype("<u2").tobytes()])], names=["segment", "counts"])

    out = np.zeros(COUNTED, dtype="<u2")
    parts = texts.select("text").mapInArrow(count, "segment long, counts binary").repartition("segment")
    for r in parts.mapInArrow(total, "segment long, counts binary").toLocalIterator():
        out[r["segment"] * SEGMENT:(r["segment"] + 1) * SEGMENT] = np.frombuffer(r["counts"], dtype="<u2")
    return out


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def sketches(rows: DataFrame, label: Callable[[str], int], least: Fraction, words: int, seed: int) -> DataFrame:
    """Rows ``(doc_id, print, sig, place, n, own, last, keys)``, one per row of ``rows(doc_id, text)``: the label of a text, the signature and
    size of its shingle set (null and 0 without words), the hash of the text, its rarest shingles as far as a set no larger must share one of them
    to be similar, and how many of these are needed against sets that are no smaller; ``last`` is the rank of the last
    one. Of equal sets in one task all but the first have null keys."""
    shipped = rows.sparkSession.sparkContext.broadcast(occurrences(rows, words, seed))
    whole = 2 * least / (1 + least)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = shipped.value

        def batch_of(ids: pa.Array, places: pa.Array, held: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*held)) if held else [()] * 6
            prints, sigs, sizes, owns, lasts, keys = columns
            none = np.array([k is None for k in keys], dtype=bool)
            lists = _lists([k if k is not None else np.zeros(0, dtype=np.int64) for k in keys])
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(none)) if len(keys) else lists
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(prints, pa.int64()), pa.array(sigs, pa.int64()), places, pa.array(sizes, pa.int32()),
                 pa.array(owns, pa.int32()), pa.array(lasts, pa.int64()), lists],
                names=["doc_id", "print", "sig", "place", "n", "own", "last", "keys"])

        for batch in batches:
            held, begin, size = [], 0, 0
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                hashes = shingles(text, words, seed)
                n = len(hashes)
                sig = signature(hashes) if n else None
                order = last = None
                if n and sig not in seen:
                    seen.add(sig)
                    rank = counts[hashes & COUNTED - 1]
                    order = np.lexsort((hashes, rank))[:n + 1 - _ceil(least * n)]
                    last, order = int(rank[order[-1]]), hashes[order]
                    size += len(order)
                held.append((signed(label(text)), sig, n, n + 1 - _ceil(whole * n), last, order))
                if size > BATCH:
                    yield batch_of(batch.column(0).slice(begin, len(held)), batch.column(2).slice(begin, len(held)), held)
                    held, begin, size = [], i + 1, 0
            if held:
                yield batch_of(batch.column(0).slice(begin), batch.column(2).slice(begin), held)

    source = rows.select("doc_id", "text", F.xxhash64("text").alias("place"))
    return source.mapInArrow(
        sketch, f"doc_id {kind}, print long, sig long, place long, n int, own int, last long, keys array<long>")


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of shingles among ``1 << bits``, by bits that neither their order nor their counters depend on."""
    return keys >> SHIFT & (1 << bits) - 1


def _packed(places: np.ndarray) -> bytes:
    """Sorted numbers of four bytes as their differences, all first bytes, then all second ones and so on: the last are zeros."""
    return np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64).astype(np.uint32)


def _repeated(found: DataFrame) -> tuple[np.ndarray, int]:
    """Packed bits, and the bits of a place: 1 where a shingle that two rows of ``found(keys)`` have falls, and some others. Shingles have
    places, at least 64 for each of them; tasks send the places of their shingles, segment by segment, and a segment's task marks those that came twice.
    The marks fill fewer bits than there are shingles, as only repeated ones are marked."""
    size = found.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(36, max(20, (64 * size).bit_length()))
    kept = min(bits, REPEATED, max(20, (size >> 1).bit_length()))
    span = min(RANGE, bits)  # bits of a place in a segment
    part = 1 << span - (bits - kept) >> 3  # bytes of the marks of a segment

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments(held: list[np.ndarray]) -> pa.RecordBatch:
            place = np.sort(np.concatenate(held))
            segment, begin = np.unique(place >> span, return_index=True)
            parts = [_packed(p & (1 << span) - 1) for p in np.split(place, begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), pa.array(parts, pa.binary())], names=["segment", "places"])

        held, size = [], 0
        for batch in batches:
            held.append(_places(batch.column(0).flatten().to_numpy(), bits))
            size += len(held[-1])
            if size > 16 * BATCH:
                yield segments(held)
                held, size = [], 0
        if size:
            yield segments(held)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, places in zip(*batch.columns):
                held.setdefault(segment.as_py(), []).append(_unpacked(places.as_py()))
        while held:
            segment, parts = held.popitem()
            place = np.sort(np.concatenate(parts))
            twice = np.unique(place[1:][place[1:] == place[:-1]] >> bits - kept)
            if len(twice):
                marks = np.zeros(part, dtype=np.uint8)
                np.bitwise_or.at(marks, twice >> 3, (1 << (twice & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([marks.tobytes()])], names=["segment", "twice"])

    sent = found.filter("keys is not null").select("keys").mapInArrow(mark, "segment long, places binary")
    out = np.zeros(1 << kept - 3, dtype=np.uint8)
    for r in sent.repartition("segment").mapInArrow(unite, "segment long, twice binary").toLocalIterator():
        out[r["segment"] * part:(r["segment"] + 1) * part] = np.frombuffer(r["twice"], dtype=np.uint8)
    return out, bits


def _keyed(found: DataFrame, repeated: np.ndarray, bits: int) -> DataFrame:
    """Rows ``(key, sig, n, own, at)`` for the shingles of ``found`` that another row may have, by ``_repeated``."""
    shipped, less = found.sparkSession.sparkContext.broadcast(repeated), bits - (8 * len(repeated)).bit_length() + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shipped.value
        for batch in batches:
            lists = batch.column(3)
            edges = lists.offsets.to_numpy().astype(np.int64)
            keys = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(edges))
            at = np.arange(len(keys)) - (edges[:-1] - edges[0])[row]
            place = _places(keys, bits) >> less
            kept = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            row = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[kept]), *(batch.column(i).take(row) for i in range(3)), pa.array(at[kept].astype(np.int32))],
                names=["key", "sig", "n", "own", "at"])

    rows = found.filter("keys is not null").select("sig", "n", "own", "keys")
    return rows.mapInArrow(emit, "key long, sig long, n int, own int, at int")


def _sets(texts: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """Rows ``(sig, hashes)``, the sets of the texts of ``wanted(place)``, their hashes, and a few others: most texts are left out by a
    filter of bits, whose size is bounded, before they are read."""
    marks = wanted.groupBy(F.shiftright(F.pmod("place", F.lit(WANTED)), 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(place, 64) as int)))").alias("bits")).toArrow()
    filled = np.zeros(WANTED >> 6, dtype="<i8")
    filled[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    shipped = texts.sparkSession.sparkContext.broadcast(filled.view(np.uint8))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = shipped.value
        for batch in batches:
            place = batch.column(1).to_numpy() & WANTED - 1
            held, size = [], 0
            for i in np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).tolist():
                hashes = shingles(batch.column(0)[i].as_py() or "", words, seed)
                sig = signature(hashes)
                if sig not in seen:
                    seen.add(sig)
                    held.append((sig, hashes))
                    size += len(hashes)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), _lists([h for _, h in held])], names=["sig", "hashes"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), _lists([h for _, h in held])], names=["sig", "hashes"])

    found = texts.select("text", F.xxhash64("text").alias("place")).mapInArrow(read, "sig long, hashes array<long>")
    return found.dropDuplicates(["sig"])  # once more than a task can


def _linked(ids: np.ndarray, sets: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """Links that connect the similar ones of some sets, as few as that takes."""
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    starts = ends - size
    root, links = np.arange(len(ids)), []
    mark = np.zeros(codes.max() + 1, dtype=bool)
    for i in range(len(ids)):
        if (root == root[i]).all():
            break
        own = codes[starts[i]:ends[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[own] = False
        close = shared * least.denominator >= (size[i] + size - shared) * least.numerator
        others, first = np.unique(root[close], return_index=True)
        near = np.flatnonzero(close)[first][others != root[i]]
        links += [(int(ids[i]), int(ids[j])) for j in near]
        root[np.isin(root, others)] = root[i]
    return links


def _compared(tiles: DataFrame, texts: DataFrame, unique: DataFrame, least: Fraction, words: int, seed: int) -> DataFrame:
    """Links between the sets of each group of ``tiles(tile, sig)``, a stored table. The sets are read from their texts once more; each is
    sent to its tiles and held nowhere else."""
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("sig").sort_values("sig")
        links = _linked(frame["sig"].to_numpy(), [np.asarray(v, dtype=np.int64) for v in frame["hashes"]], least)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    wanted = unique.select("sig", "place").join(tiles.select("sig").distinct(), "sig", "left_semi")
    sets = _sets(texts, wanted, words, seed)
    return tiles.join(sets, "sig").groupBy("tile").applyInPandas(compare, "a long, b long").distinct()


def _pair_tiles(pairs: DataFrame, unique: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(tile, sig)`` that bring the sets of each of ``pairs(a, b)`` together. Sets that pairs connect are one tile, to which each is
    sent once; if they are too many for one, they are dealt into blocks, and a tile has those of two blocks that pairs connect."""
    roots = scratch.stored(components(pairs, scratch=Scratch(pairs.sparkSession, "pairs")).withColumnRenamed("node", "sig"), "candidates")
    sized = roots.join(unique.select("sig", "n"), "sig").groupBy("root").agg(F.ceil(_weight() / (4 * BLOCK)).alias("parts"))
    both = pairs.join(roots.withColumnRenamed("sig", "a"), "a").join(sized, "root")
    block = lambda c: F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64(c), 2 * F.col("parts")))
    tile = F.concat_ws(":", F.lit("pairs"), "root", F.least(block("a"), block("b")), F.greatest(block("a"), block("b")))
    return both.select(tile.alias("tile"), F.explode(F.array("a", "b")).alias("sig")).distinct()


def _close_pairs(small: DataFrame, unique: DataFrame, least: Fraction, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of signatures that share a key of ``small`` and can be similar by all that their sketches tell."""
    p, q = least.numerator, least.denominator
    x, y = (small.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("sig", "n", "own", "at")]) for s in "xy")
    pairs = scratch.stored(
        x.join(y.filter("y_at < y_own"), "key")
        .filter(f"x_sig <> y_sig and y_n <= x_n and y_n * {q}L >= x_n * {p}L"
                f" and least(x_n - x_at, y_n - y_at) * {p + q}L >= (x_n + y_n) * {p}L")
        .select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct(), "met")
    # common ones beyond both prefixes are at most as many as follow the prefix that ends first
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    drafts = scratch.stored(unique.select("sig", "n", "keys", "last").join(ends, "sig", "left_semi"), "drafts")
    a, b = (drafts.select(*[F.col(c).alias(c_) for c, c_ in zip(drafts.columns, (s, f"{s}_n", f"{s}_keys", f"{s}_last"))]) for s in "ab")
    rest = [F.col(f"{s}_n") - F.size(f"{s}_keys") for s in "ab"]
    first = F.expr("a_last < b_last or (a_last = b_last and element_at(a_keys, -1) < element_at(b_keys, -1))")
    most = F.size(F.array_intersect("a_keys", "b_keys")) + F.when(first, rest[0]).otherwise(rest[1])
    close = pairs.join(a, "a").join(b, "b").filter(most * (p + q) >= (F.col("a_n") + F.col("b_n")) * p).select("a", "b")
    out = scratch.stored(close, "pairs")
    scratch.discard("met", "drafts")
    return out


def _weight() -> "F.Column":
    return F.sum(F.lit(1) + F.floor(F.col("n") / 256))


def _crowds(large: DataFrame, least: Fraction) -> DataFrame:
    """Rows ``(key, sig, n)``: the groups in which the sets of each key of ``large(key, sig, n)`` are compared.

    Similar sets are of similar size: their classes, by powers of a ratio that is wider than they can differ by, are equal or next to each
    other. A group is a class and the one below it. Of groups of the same sets, as the shingles of one passage make them, one
    is kept.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1.04 / float(least))).cast("int")
    home = large.withColumn("class", size_class)
    both = home.select("key", "sig", "n", F.col("class").alias("class"), F.lit(True).alias("own")).unionByName(
        home.select("key", "sig", "n", (F.col("class") + 1).alias("class"), F.lit(False).alias("own")))
    groups = both.groupBy("key", "class").agg(
        F.count(F.lit(1)).alias("size"), F.max("own").alias("own"), F.bit_xor(F.xxhash64("sig")).alias("one"),
        F.sum(F.xxhash64("sig", F.lit(1)).cast("decimal(38,0)")).alias("two")).filter("own and size > 1")
    kept = groups.groupBy("size", "one", "two").agg(F.min(F.struct("key", "class")).alias("g")).select("g.key", "g.class")
    return both.join(kept, ["key", "class"]).select(F.concat_ws(":", "key", "class").alias("key"), "sig", "n")


def _open_tiles(large: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(tile, sig)``: for every key of ``large(key, sig, n)`` the pairs of blocks whose members are not all linked
    by now. Members of one group of links stand in blocks of their own, if they fill one; the largest group of a key is compared
    with the others, never with itself."""
    named = large.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    groups = named.groupBy("key", "root").agg(_weight().alias("weight"))
    keys = groups.groupBy("key").agg(
        F.count(F.lit(1)).alias("groups"), F.max_by("root", F.struct("weight", "root")).alias("major"),
        F.sum(F.when(F.col("weight") < BLOCK, F.col("weight"))).alias("pool")).filter("groups > 1")
    parts = groups.join(keys, "key").select(
        "key", "root", F.when((F.col("weight") >= BLOCK) | (F.col("root") == F.col("major")), F.col("root")).alias("home"), "major",
        F.ceil(F.when((F.col("weight") >= BLOCK) | (F.col("root") == F.col("major")), F.col("weight")).otherwise(F.col("pool")) / BLOCK).alias("parts"))
    number = F.pmod(F.xxhash64(F.when(F.col("home").isNull(), F.col("root")).otherwise(F.col("sig"))), F.col("parts"))
    block = F.concat_ws(":", F.coalesce(F.col("home").cast("string"), F.lit("")), number.cast("string")).alias("block")
    placed = scratch.stored(named.join(parts, ["key", "root"]).select("key", "sig", "home", "major", block), "placed")
    blocks = placed.groupBy("key", "block").agg(F.max("home").alias("home"), F.max("major").alias("major"))
    left = blocks.filter("home is null or home <> major").select("key", F.col("block").alias("left"), F.col("home").alias("left_home"))
    right = blocks.select("key", F.col("block").alias("right"), "home", "major")
    tiles = left.join(right, "key").filter(
        "(left_home is null or home is null or left_home <> home) and (home = major or left <= right)").select("key", "left", "right")
    ends = tiles.withColumn("block", F.explode(F.array("left", "right"))).distinct()
    tile = F.concat_ws("|", F.lit("open"), "key", "left", "right")
    return placed.select("key", "block", "sig").join(ends, ["key", "block"]).select(tile.alias("tile"), "sig")


def linked_sketches(texts: DataFrame, found: DataFrame, least: Fraction, words: int, seed: int, crowded: int) -> DataFrame:
    """Links ``(a, b)`` between the prints of ``found``, stored ``sketches`` of ``texts(text)``; see ``similar_links``."""
    scratch = Scratch(texts.sparkSession, "similar")
    unique = scratch.stored(found.filter("keys is not null").select("sig", "place", "n", "own", "last", "keys").dropDuplicates(["sig"]), "unique")
    keyed = scratch.stored(_keyed(unique, *_repeated(unique)), "keyed")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.expr("at < own")).alias("held")).filter("size > 1 and held")
    sized = scratch.stored(keyed.join(met.select("key", "size"), "key"), "sized")
    scratch.discard("keyed")
    pairs = _close_pairs(sized.filter(F.col("size") <= crowded), unique, least, scratch)
    large = scratch.stored(_crowds(sized.filter(F.col("size") > crowded).select("key", "sig", "n"), least), "large")
    scratch.discard("sized")
    # members of a crowded key are compared in blocks, each with one that all blocks hold: near copies of one text are one group then
    first = large.groupBy("key").agg(F.min("sig").alias("first"), F.ceil(_weight() / BLOCK).cast("int").alias("parts"))
    blocks = large.join(first, "key").select("key", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("block"), "sig")
    common = first.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.col("first").alias("sig"))
    crowds = blocks.unionByName(common).select(F.concat_ws("|", F.lit("key"), "key", "block").alias("tile"), "sig")
    tiles = scratch.stored(_pair_tiles(pairs, unique, scratch).unionByName(crowds), "tiles")
    links = scratch.stored(_compared(tiles, texts, unique, least, words, seed), "near")
    roots = scratch.stored(components(links, scratch=Scratch(texts.sparkSession, "near")).withColumnRenamed("node", "sig"), "roots")
    # a group of one block has been compared whole by now
    several = large.join(first.filter("parts > 1").select("key"), "key", "left_semi")
    left = scratch.stored(_open_tiles(several, roots, scratch), "left")
    if not left.isEmpty():
        links = links.unionByName(scratch.stored(_compared(left, texts, unique, least, words, seed), "more"))
    named = scratch.stored(found.filter("sig is not null").groupBy("sig").agg(F.min("print").alias("print")), "named")
    equal = found.filter("sig is not null").select("sig", F.col("print").alias("b")).distinct().join(named, "sig").select(F.col("print").alias("a"), "b")
    ends = links.join(named.select(F.col("sig").alias("a"), F.col("print").alias("from")), "a").join(
        named.select(F.col("sig").alias("b"), F.col("print").alias("to")), "b").select(F.col("from").alias("a"), F.col("to").alias("b"))
    out = stored(ends.unionByName(equal).filter("a <> b").distinct(), "similar")
    scratch.discard()
    return out


def similar_links(texts: DataFrame, label: Callable[[str], int], least: float = 0.8, words: int = 5, seed: int = 42,
                  crowded: int = 32) -> DataFrame:
    """Links ``(a, b)`` between the labels (numbers) of ``texts(text)``: they connect what the pairs of texts connect whose
    shingle sets have a Jaccard similarity of ``least`` or more, all of them and no others.

    Equal sets are one from the start. Shingles have an order, rare ones first. Of two similar sets, the larger has one of
    its first ``n + 1 - least n`` shingles among the first ``n + 1 - 2 least n / (1 + least)`` of the smaller, so sets are
    joined on these, but for shingles that no other set has (a filter of bits tells most of them). Sizes, the places of the shingle and the
    shingles before rule out most pairs, the others are verified. The sets of a shingle that more than ``crowded`` share
    are compared with those of about their size, block by block, then only those of different groups of links with each other: no
    rows for pairs are made, and no set is left out.

    Null and empty texts, and texts without words, have no links. Repeated texts are one. An empty table gives an empty one. Only the column ``text``
    is read.
    """
    exact = Fraction(str(least))
    rows = texts.select(F.lit(0).alias("doc_id"), F.col("text"))
    return linked_sketches(rows, stored(sketches(rows, label, exact, words, seed), "sketches"), exact, words, seed, crowded)
