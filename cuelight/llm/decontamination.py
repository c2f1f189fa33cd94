"""Benchmark decontamination: an FM-index per shard of training texts, searched for the phrases of test items.

The index is a table of its own, made once and searched for as many benchmarks as come. A shard holds about
``SHARD`` bytes of texts; a longer text is cut into pieces that overlap by less than a phrase, so memory does not grow
with a text. Phrases are searched in blocks of a bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import fm_index
from .tables import stored

#: Bytes of texts in a shard, phrases of a block.
SHARD, BLOCK = 6 << 20, 200_000
#: A-Z lower-cased, and a space for what is no part of a word: ASCII but for digits and letters.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_NEXT = re.compile(rb" *[^ ]+")
#: Few rows of an index fit into a row group.
FEW_ROWS = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def folded(text: bytes) -> bytes:
    """A text with its words lower-cased, and spaces for all else."""
    return text.translate(FOLD)


def pieces(text: bytes, limit: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of a folded text, each with the ``overlap`` words that follow it, and how many these are."""
    start = 0
    while True:
        stop = text.find(b" ", start + limit) if len(text) > start + limit else -1
        if stop < 0:
            yield text[start:], 0
            return
        after, words = stop, 0
        while words < overlap and (word := _NEXT.match(text, after)):
            after, words = word.end(), words + 1
        yield text[start:after], words
        start = stop


def _row(keys: list, firsts: list, extras: list, texts: list[bytes]) -> dict:
    """A row of the index: pieces of texts, and the index of their words."""
    split = pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")
    flat = split.flatten()
    full = np.array(pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = np.diff(before[offsets])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    starts = np.cumsum(words + 1) - words - 1
    text = np.full(int((words + 1).sum()) + 1, fm_index.SEPARATOR, dtype=np.int64)
    place = np.arange(int(words.sum())) + np.repeat(np.arange(len(words)), words)
    text[place] = coded.indices.to_numpy().astype(np.int64) + fm_index.WORDS
    text[-1] = fm_index.END
    index = fm_index.build(text)
    return {"keys": keys, "firsts": firsts, "words": (words - extras).tolist(), "starts": starts.tolist(),
            "vocabulary": b" ".join(coded.dictionary.to_pylist()), **vars(index)}


def build_index(docs: DataFrame, overlap: int = 9, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The FM-indexes of ``docs``, a row per shard: its pieces of texts, each with the key, the id and the hash of its text, and the
    index. A null text has no words. Phrases of up to ``overlap + 1`` words can be searched."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = pa.schema([
        ("keys", pa.list_(pa.int64())), ("ids", pa.list_(kind)), ("hashes", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())),
        ("words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("vocabulary", pa.binary()), *[(n, pa.binary()) for n in fm_index.STORED]])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # key, id, hash, first word, extra words, text
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            keys, ids, hashes, firsts, extras, texts = map(list, zip(*held))
            held.clear()
            size = 0
            row = _row(keys, firsts, np.array(extras), texts) | {"ids": ids, "hashes": hashes}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            texts = batch.column(3).cast(pa.binary() if pa.types.is_string(batch.column(3).type) else pa.large_binary())
            for key, doc, named, text in zip(batch.column(0), batch.column(1), batch.column(2), texts):
                first = 0
                for piece, extra in pieces(folded(text.as_py() or b""), SHARD, overlap):
                    if held and size + len(piece) > SHARD:
                        yield flush()
                    held.append((key.as_py(), doc.as_py(), named.as_py(), first, extra, piece))
                    size += len(piece) + 64
                    if extra:
                        first += len(piece.split()) - extra
        if held:
            yield flush()

    source = rows.select("key", "doc_id", F.xxhash64("text").alias("hash"), "text")
    doc = rows.schema["doc_id"].dataType.simpleString()
    binary = ", ".join(f"{n} binary" for n in ("vocabulary", *fm_index.STORED))
    lists = f"keys array<long>, ids array<{doc}>, hashes array<long>, firsts array<long>, words array<long>, starts array<long>"
    return stored(source.mapInArrow(index, f"{lists}, {binary}"), "fm-index", **FEW_ROWS)


def phrases(items: DataFrame, words: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Rows ``(item, phrase)``: every run of ``words`` words of each item, joined by spaces; an item of fewer words, but not
    none, is one phrase."""
    source = items.select(F.col(id_column).alias("item"), F.col(text_column).cast("string").cast("binary").alias("text"))
    kind, doc = to_arrow_type(source.schema["item"].dataType), source.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                own = folded(text.as_py() or b"").split()
                for start in range(0, max(1, len(own) - words + 1) if own else 0, 4096):
                    stop = min(start + 4096, max(1, len(own) - words + 1))
                    runs = [b" ".join(own[i:i + words]) for i in range(start, stop)]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(runs), kind), pa.array(runs, pa.binary())], names=["item", "phrase"])

    return source.mapInArrow(cut, f"item {doc}, phrase binary").distinct()


class Asked:
    """A block of phrases as numbers of a vocabulary of their own, aligned to the right."""

    def __init__(self, rows: pa.Table):
        coded = rows.column("phrase").combine_chunks().dictionary_encode()
        split = [p.split(b" ") for p in coded.dictionary.to_pylist()]
        self.vocabulary: dict[bytes, int] = {}
        self.lengths = np.array([len(p) for p in split], dtype=np.int64)
        self.words = np.zeros((len(split), int(self.lengths.max())), dtype=np.int64)
        for i, p in enumerate(split):
            self.words[i, -len(p):] = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in p]
        named = rows.column("item").combine_chunks()
        given = np.flatnonzero(named.is_valid().to_numpy(zero_copy_only=False))
        items = named.take(pa.array(given)).dictionary_encode()
        self.items = items.dictionary
        phrase = coded.indices.to_numpy()[given]
        by = np.argsort(phrase, kind="stable")
        self.held = items.indices.to_numpy()[by].astype(np.int64)
        self.edges = np.searchsorted(phrase[by], np.arange(len(split) + 1))

    def matches(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, stops, pairs)`` in the shard of an index row: the merged runs of words that phrases cover, and each
        piece and item that met, as ``(piece, item)``."""
        number = np.full(len(self.vocabulary), -1, dtype=np.int64)
        for i, word in enumerate(row["vocabulary"].split(b" "), fm_index.WORDS):
            if word in self.vocabulary:
                number[self.vocabulary[word]] = i
        wanted = number[self.words]
        beside = np.arange(wanted.shape[1])[None, :] < wanted.shape[1] - self.lengths[:, None]
        there = np.flatnonzero(((wanted >= 0) | beside).all(axis=1))
        starts = np.asarray(row["starts"], dtype=np.int64)
        cover = np.zeros(0, dtype=np.int64)
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        if len(there):
            index = fm_index.Index(fm_index.Stored(*[row[n] for n in fm_index.STORED]))
            low, high = index.search(wanted[there], self.lengths[there])
            found = np.maximum(high - low, 0)
            ends = np.cumsum(found)
            cover = np.zeros(index.size + 1, dtype=np.int64)
            for at in range(0, int(ends[-1]), fm_index.LOCATED):
                n = np.arange(at, min(at + fm_index.LOCATED, int(ends[-1])))
                phrase = np.searchsorted(ends, n, side="right")
                place = index.locate(low[phrase] + n - (ends[phrase] - found[phrase]))
                np.add.at(cover, place, 1)
                np.add.at(cover, place + self.lengths[there[phrase]], -1)
                piece = np.searchsorted(starts, place, side="right") - 1
                met = np.unique(piece * len(there) + phrase)
                piece, phrase = met // len(there), there[met % len(there)]
                many = self.edges[phrase + 1] - self.edges[phrase]
                each = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.edges[phrase], many)
                pairs.append(np.unique(np.stack([np.repeat(piece, many), self.held[each]], axis=1), axis=0))
        inside = np.concatenate([[False], np.cumsum(cover) > 0, [False]])
        step = np.diff(inside.astype(np.int8))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1), np.unique(np.concatenate(pairs), axis=0)


def search_index(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_hash, n_words, spans, items)``: for every text of an index its words, the runs of words that
    ``asked(item, phrase)`` covers, merged, as word numbers (start, stop), and the items with an occurring phrase. An item of a
    null id is no item, though its phrases cover words."""
    asked = stored(asked, "phrases")
    blocks = -(-asked.count() // BLOCK)
    kind, held = to_arrow_type(asked.schema["item"].dataType), asked.schema["item"].dataType.simpleString()
    named, doc = to_arrow_type(index.schema["ids"].dataType.elementType), index.schema["ids"].dataType.elementType.simpleString()
    names = ["key", "doc_id", "text_hash", "words", "starts", "stops", "items"]
    schema = f"key long, doc_id {doc}, text_hash long, words long, starts array<long>, stops array<long>, items array<{held}>"
    none = np.zeros(0, dtype=np.int64)

    def look(block: Asked | None, counted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                    start, stop, pairs = block.matches(row) if block else (none, none, none.reshape(0, 2))
                    begins, firsts = (np.asarray(row[n], dtype=np.int64) for n in ("starts", "firsts"))
                    piece = np.searchsorted(begins, start, side="right") - 1
                    move = firsts[piece] - begins[piece]
                    spans = np.searchsorted(piece, np.arange(len(begins) + 1))
                    met = np.searchsorted(pairs[:, 0], np.arange(len(begins) + 1))
                    edges = pa.array(spans, pa.int32())
                    items = block.items.take(pa.array(pairs[:, 1].copy())) if block else pa.array([], kind)
                    out = pa.RecordBatch.from_arrays([
                        pa.array(row["keys"], pa.int64()), pa.array(row["ids"], named), pa.array(row["hashes"], pa.int64()),
                        pa.array(row["words"] if counted else [0] * len(begins), pa.int64()),
                        pa.ListArray.from_arrays(edges, pa.array(start + move)), pa.ListArray.from_arrays(edges, pa.array(stop + move)),
                        pa.ListArray.from_arrays(pa.array(met, pa.int32()), items.cast(kind))], names=names)
                    yield out if counted else out.filter(pa.array((np.diff(spans) > 0) | (np.diff(met) > 0)))
        return run

    found = None
    for n in range(max(1, blocks)):  # one block at a time is sent to the tasks
        block = asked.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == n).toArrow() if blocks else None
        one = index.mapInArrow(look(Asked(block) if block is not None and block.num_rows else None, n == 0), schema)
        found = one if found is None else found.unionByName(one)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for starts, stops in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                merged: list[dict] = []
                for start, stop in sorted(zip((x for s in starts for x in s), (x for s in stops for x in s))):
                    if merged and start <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(stop, merged[-1]["stop"])
                    else:
                        merged.append({"start": start, "stop": stop})
                out.append(merged)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, span), batch.column(5)],
                                             names=["doc_id", "text_hash", "n_words", "spans", "items"])

    one = found.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.sum("words").alias("n_words"), F.collect_list(F.when(F.size("starts") > 0, F.col("starts"))).alias("starts"),
        F.collect_list(F.when(F.size("stops") > 0, F.col("stops"))).alias("stops"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return one.drop("key").mapInArrow(
        finish, f"doc_id {doc}, text_hash long, n_words long, spans array<struct<start: long, stop: long>>, items array<{held}>")


def find_passages(docs: DataFrame, benchmark: DataFrame, words: int = 10, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items, text_hash)``, one per row of ``docs``.

    A word is a run of letters, digits and characters beyond ASCII, with A-Z lower-cased. A phrase is ``words`` consecutive words of an item, or
    all words of a shorter one. ``spans`` are the runs of words that occurring phrases cover, merged, as word numbers; a word in
    any of them is hit. A null text has no words, and neither has an empty one. Rows that repeat an id, or have none, keep
    their own result. An item whose id repeats is one item; one without id counts for hits, not as an item. Empty tables of documents
    give an empty result, empty benchmarks no hits. Other columns are not read.
    """
    index = build_index(docs, words - 1, id_column, text_column)
    found = search_index(index, phrases(benchmark, words, item_column, item_text_column))
    texts = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", texts), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items", "text_hash")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the given runs and what stands between them."""
    raw = text.encode()
    inside = np.frombuffer(FOLD, dtype=np.uint8)[np.frombuffer(raw, dtype=np.uint8)] != 32
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    kept, at = [], 0
    for start, stop in spans:
        kept.append(raw[at:starts[start]])
        at = stops[stop - 1]
    return b"".join([*kept, raw[at:]]).decode()


def remove_passages(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the passages that ``find_passages`` found in them; all rows and columns stay. A text that is only
    a passage becomes empty, a null text stays null."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    at, text_at = docs.columns.index(id_column), docs.columns.index(text_column)
    plain = docs.toDF(*places)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans").dropDuplicates(["id", "hash"])
    joined = plain.join(hit, plain[f"c{at}"].eqNullSafe(hit["id"]) & (F.xxhash64(plain[f"c{text_at}"].cast("string")) == hit["hash"]), "left")
    cut = stored(joined.select(*places, F.transform("spans", lambda s: F.array(s["start"], s["stop"])).alias("spans")), "passages")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if s is None else without_spans(t, s) for t, s in zip(batch.column(text_at).to_pylist(), batch.column(len(places)).to_pylist())]
            columns = [*batch.columns[:text_at], pa.array(texts, batch.schema.field(text_at).type), *batch.columns[text_at + 1:len(places)]]
            yield pa.RecordBatch.from_arrays(columns, names=places)

    return cut.mapInArrow(remove, cut.drop("spans").schema).toDF(*docs.columns)
