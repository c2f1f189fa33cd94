"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .chunks import gather, map_rows, pieces, plain, slices

#: Buckets of n-grams, texts are read in slices of so many bytes.
FEATURES, SLICE = 1 << 18, 1 << 20


class NGrams:
    """Distinct one- and two-token features of texts, hashed into ``FEATURES`` buckets.

    Tokens are runs of letters and digits, lower-cased, and runs of other visible characters. Each distinct
    blank-delimited chunk of a batch is read once.
    """

    def __init__(self):
        import re

        self._tokens = re.compile(r"\w+|[^\w\s]+").findall

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(row, bucket)`` of every distinct feature, by row and then bucket. A long text, which is alone, is read piece by piece,
        each with the last words of the piece before it."""
        if len(texts) != 1 or not texts[0].is_valid or len(raw := texts[0].as_buffer()) <= 2 * SLICE:
            return self._read(texts)
        found, before = np.zeros(FEATURES, dtype=bool), b""
        for piece in pieces(raw.to_pybytes(), SLICE):
            found[self._read(pa.array([before + piece], pa.large_binary()).cast(pa.large_string()))[1]] = True
            # two words at least, so that the pair across the cut is seen; what is read twice says nothing new
            before = b" ".join((before + piece).rsplit(None, 2)[-2:])
        bucket = np.flatnonzero(found)
        return np.zeros(len(bucket), dtype=np.int64), bucket

    def _read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import zlib

        parts = pc.utf8_split_whitespace(texts)
        edges = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        split = [self._tokens(c) for c in coded.dictionary.to_pylist()]
        number: dict[str, int] = {}
        flat = np.fromiter((number.setdefault(t, len(number)) for s in split for t in s), dtype=np.int64)
        length = np.array([len(s) for s in split], dtype=np.int64)
        hashes = np.fromiter((zlib.crc32(t.lower().encode()) for t in number), dtype=np.uint64, count=len(number))
        index = coded.indices.to_numpy()
        begin = np.cumsum(length) - length
        token = hashes[gather(flat, begin[index], length[index])] if len(index) else np.zeros(0, np.uint64)
        ends = np.concatenate([[0], np.cumsum(length[index])])[edges]
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        one = token % FEATURES
        same = row[1:] == row[:-1]
        mixed = (token[:-1] * np.uint64(0x9E3779B97F4A7C15) + token[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        two = mixed[same] % FEATURES
        pairs = np.unique(np.concatenate([
            row.astype(np.int64) * FEATURES + one.astype(np.int64),
            row[1:][same].astype(np.int64) * FEATURES + two.astype(np.int64)]))
        return pairs // FEATURES, pairs % FEATURES


@dataclass(frozen=True)
class Model:
    """Weights of the buckets (log-count ratios folded in), bias, and the two numbers that turn a margin into a
    probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        features, out = NGrams(), []
        for a, b in slices(texts, SLICE):
            row, bucket = features(texts.slice(a, b - a))
            out.append(np.bincount(row, weights=self.weights[bucket], minlength=b - a) + self.bias)
            pa.default_memory_pool().release_unused()
        margin = np.concatenate([np.zeros(0), *out])
        return 1.0 / (1.0 + np.exp(np.clip(self.slope * margin + self.offset, -500, 500)))


def fold(id_column: str) -> "F.Column":
    """crc32 of the id as text, modulo 5; a null id is in fold 0 and never learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5, F.lit(0))


def known_labels(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """``(doc_id, label)`` to learn from. Ids of fold 0, ids whose labels contradict each other, null ids and labels
    other than 0 and 1 say nothing; a repeated label row counts once."""
    return (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .filter("label in (0, 1) and doc_id is not null").filter(fold("doc_id") != 0)
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    )


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of class 0 and of class 1 each bucket occurs, over all rows. Tasks send at most one row per
    bucket; the result has ``FEATURES`` rows at most."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = NGrams(), np.zeros((2, FEATURES), dtype=np.int64)
        for batch in batches:
            texts = plain(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE):
                row, bucket = features(texts.slice(a, b - a))
                for k in (0, 1):
                    total[k] += np.bincount(bucket[label[a + row] == k], minlength=FEATURES)
                pa.default_memory_pool().release_unused()
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "zero", "one"])

    found = (rows.select("text", "label").mapInArrow(counted, "bucket long, zero long, one long")
             .groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow())
    out = np.zeros((2, FEATURES))
    for k, name in enumerate(("zero", "one")):
        out[k, found["bucket"].to_numpy()] = found[name].to_numpy()
    return out[0], out[1]


def hinge(rows: list[np.ndarray], values: np.ndarray, sign: np.ndarray, cost: np.ndarray,
          epochs: int = 12, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear support vector machine with hinge loss, by dual coordinate descent (Hsieh et al.
    2008): each step solves one row's dual variable exactly, within 0 and its cost. ``rows`` hold the buckets of each
    text, ``values`` what a bucket's indicator is worth."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    norm = np.array([(values[r] ** 2).sum() + 1.0 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            gradient = sign[i] * (values[r] @ w[r] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[r] += step * sign[i] * values[r]
                bias += step * sign[i]
                worst = max(worst, abs(step) / cost[i])
        if worst < tolerance:
            break
    return w, bias


def calibrate(margin: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid ``1 / (1 + exp(slope * margin + offset))`` by damped Newton steps; the
    targets are pulled in from 0 and 1, so separable classes give finite numbers."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.array([-1.0, np.log((zeros + 1) / (ones + 1))])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - (1 - target) * z).sum() + 1e-6 * (t ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(x @ at))
        slope = x.T @ (target - p) + 2e-6 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2) + 1e-12 * np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, smoothing: float = 1.0, cost: float = 0.1,
        id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Learn from the labelled documents that are not held out.

    The log-count ratios are over all of them; a row that repeats an id counts each time. The machine is fitted on at
    most ``sample`` ids of each class, those of least hash (with the least text of each), of which every fifth is kept
    back to turn margins into probabilities. With no document of either class, the model is the share of ones (one half
    without any) for every text.

    Documents are shuffled once, to meet their labels, at every size of the tables; the sample, whose size is bounded, is broadcast to them.
    """
    known = known_labels(labels, id_column, label_column)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    zero, one = class_counts(source.filter(fold("doc_id") != 0).join(known.hint("merge"), "doc_id"))
    p, q = one + smoothing, zero + smoothing
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    order = F.xxhash64("doc_id").alias("order")
    few = known.filter("label = 0").select("*", order).orderBy("order", "doc_id").limit(sample).unionByName(
        known.filter("label = 1").select("*", order).orderBy("order", "doc_id").limit(sample))
    few = source.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = NGrams()
        for batch in batches:
            texts = plain(batch.column(0))
            for a, b in slices(texts, SLICE):
                row, bucket = ngrams(texts.slice(a, b - a))
                edge = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(edge, pa.array(bucket.astype(np.int32))),
                    batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["buckets", "label", "order"])

    held = (few.select("text", "label", "order").mapInArrow(features, "buckets array<int>, label int, order long").toArrow())
    label, place = (held[c].to_numpy() for c in ("label", "order"))
    by = np.lexsort((label, place))
    label = label[by].astype(float)
    if len(label) < 10 or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log((1 - share) / share)))
    lists = held["buckets"].combine_chunks()
    edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy()  # views, not copies
    buckets = [flat[edge[i]:edge[i + 1]] for i in by]
    learn = np.arange(len(label)) % 5 != 0
    if label[learn].min() == label[learn].max():
        learn[:] = True
    sign = np.where(label == 1, 1.0, -1.0)
    share = np.where(label == 1, label[learn].mean(), 1 - label[learn].mean())
    at = np.flatnonzero(learn)
    weights, bias = hinge([buckets[i] for i in at], ratio, sign[at], (cost * 0.5 / share)[at])
    weights = weights * ratio
    margin = np.array([weights[b].sum() + bias for b in buckets])
    check = ~learn if (~learn).any() and len(set(label[~learn])) == 2 else learn
    return Model(weights.astype(np.float32), bias, *calibrate(margin[check], label[check]))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one per row of ``docs``. Only the text is an input of the score; a
    null text scores as an empty one does. The model has a fixed size and is sent to the tasks."""
    shipped = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shipped.value)
        for batch in batches:
            got = held.scores(plain(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_column).alias("doc_id"), (fold(id_column) == 0).alias("held_out"),
                         F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id",
             text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Learn from the labelled rows that are not held out and score every row; see ``fit`` and ``score_documents``.
    Empty tables, of documents or of labels, are no error."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column)
    return score_documents(docs, model, threshold, id_column, text_column)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id",
              text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, whole, with all their columns, whatever the names of these. Null texts score as empty
    ones, repeated rows alike; null ids stay if their text is good. An empty table gives an empty one; without labels every
    row scores one half."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column)
    shipped = docs.sparkSession.sparkContext.broadcast(astuple(model))
    column = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(held.scores(plain(batch.column(column))) >= threshold))

    return map_rows(docs, keep)
