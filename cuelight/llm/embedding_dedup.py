"""Embedding near-dedup on a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import components, stored
from .vectors import by_length, products, valid_vectors

#: Vectors a cluster aims at, vectors of a block of a crowded cluster, and vectors the centres are fitted on at most.
CLUSTER, BLOCK, SAMPLE = 512, 1024, 20000
#: Nearest vectors looked at, edges kept, slack of the pruning rule, entries of a search, width of its beam.
LOOK, DEGREE, ALPHA, ENTRIES, BEAM = 48, 20, 1.2, 8, 24


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow and no vanishing squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(x: np.ndarray, count: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres by spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total ** 2).sum(axis=1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each of the unit vectors ``x``: its nearest ones after robust pruning (Subramanya et al. 2019: going
    outwards, a vector is left out if one already kept is closer to it, by the factor ``ALPHA``, than the node is), and
    the reverse edges."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    like = (x @ x.T).astype(np.float32)
    np.fill_diagonal(like, -np.inf)
    look = min(LOOK, n - 1)
    near = np.argpartition(-like, look - 1, axis=1)[:, :look]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, axis=1), axis=1), axis=1)
    far = np.maximum(2 - 2 * np.take_along_axis(like, near, axis=1), 0)  # squared distances
    alive = np.ones_like(near, dtype=bool)
    edges = []
    for _ in range(DEGREE):
        left = np.flatnonzero(alive.any(axis=1))
        if not len(left):
            break
        pick = alive[left].argmax(axis=1)
        kept = near[left, pick]
        edges.append(np.stack([left, kept], axis=1))
        between = np.maximum(2 - 2 * like[kept[:, None], near[left]], 0)
        between[near[left] == kept[:, None]] = 0
        alive[left] &= ALPHA ** 2 * between > far[left]
        alive[left, pick] = False
    pairs = np.concatenate(edges)
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))


def entries(x: np.ndarray) -> np.ndarray:
    """Medoids: the vectors nearest to a few centres of ``x``."""
    return np.unique((centres(x, min(ENTRIES, len(x)), 4) @ x.T).argmax(axis=1))


class Searcher:
    """Range-expanding greedy search of many queries at once over one graph."""

    def __init__(self, x: np.ndarray, graph: list[np.ndarray]):
        self.x = x.astype(np.float32)
        self.starts = np.cumsum([0, *map(len, graph)])
        self.flat = np.concatenate([*graph, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.medoids = entries(x)

    def _fresh(self, query: np.ndarray, node: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen neighbours of ``node`` for each ``query`` row, with their similarities; they count as seen then."""
        size = self.starts[node + 1] - self.starts[node]
        before = np.cumsum(size) - size
        at = np.repeat(self.starts[node] - before, size) + np.arange(int(size.sum()))
        pair = np.repeat(query, size) * len(self.x) + self.flat[at]
        pair = pair[~seen.ravel()[pair]]
        seen.ravel()[pair] = True
        pair = np.unique(pair)
        q, v = pair // len(self.x), pair % len(self.x)
        like = np.concatenate([np.einsum("ij,ij->i", self.x[self.who[q[i:i + 65536]]], self.x[v[i:i + 65536]])
                               for i in range(0, len(q), 65536)] or [np.zeros(0, np.float32)])
        return q, v, like

    def search(self, who: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(who, node)`` found with a similarity of ``reach`` or more.

        A query keeps its ``beam`` most similar nodes and opens the best one not yet opened, from the medoids on. Once
        that ends, every node in range is opened too, and whatever they bring into range, until nothing is left.
        """
        self.who = who
        m, n = len(who), len(self.x)
        seen = np.zeros((m, n), dtype=bool)
        opened = np.zeros((m, n), dtype=bool)
        inside: list[tuple[np.ndarray, np.ndarray]] = []
        first = np.tile(self.medoids, m)
        rows = np.repeat(np.arange(m), len(self.medoids))
        seen[rows, first] = True
        q, v = rows, first
        like = np.einsum("ij,ij->i", self.x[who[q]], self.x[v])
        held_v, held_s = np.full((m, beam), -1), np.full((m, beam), -np.inf, dtype=np.float32)
        while len(q):
            close = like >= reach
            inside.append((q[close], v[close]))
            # into the beams: the new ones of each row side by side, best first
            order = np.lexsort((-like, q))
            q, v, like = q[order], v[order], like[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, v, like, place = (a[place < beam] for a in (q, v, like, place))
            touched = np.unique(q)
            at = np.searchsorted(touched, q)
            new_v, new_s = np.full((len(touched), beam), -1), np.full((len(touched), beam), -np.inf, dtype=np.float32)
            new_v[at, place], new_s[at, place] = v, like
            both_v = np.concatenate([held_v[touched], new_v], axis=1)
            both_s = np.concatenate([held_s[touched], new_s], axis=1)
            best = np.argsort(-both_s, axis=1, kind="stable")[:, :beam]
            held_v[touched], held_s[touched] = np.take_along_axis(both_v, best, 1), np.take_along_axis(both_s, best, 1)
            waiting = (held_v >= 0) & ~opened[np.arange(m)[:, None], held_v]
            rows = np.flatnonzero(waiting.any(axis=1))
            node = held_v[rows, waiting[rows].argmax(axis=1)]
            opened[rows, node] = True
            q, v, like = self._fresh(rows, node, seen)
            while len(rows) and not len(q):  # nothing new behind these: open the next ones
                waiting = (held_v >= 0) & ~opened[np.arange(m)[:, None], held_v]
                rows = np.flatnonzero(waiting.any(axis=1))
                node = held_v[rows, waiting[rows].argmax(axis=1)]
                opened[rows, node] = True
                q, v, like = self._fresh(rows, node, seen)
        q, v = (np.concatenate([p[k] for p in inside]) for k in (0, 1))
        found = [(q, v)]
        while len(q):
            closed = ~opened[q, v]
            q, v = q[closed], v[closed]
            opened[q, v] = True
            news = [self._fresh(q[i:i + 16384], v[i:i + 16384], seen) for i in range(0, len(q), 16384)]
            q, v, like = (np.concatenate([p[k] for p in news]) if news else np.zeros(0, np.int64) for k in range(3))
            close = like >= reach
            q, v = q[close], v[close]
            found.append((q, v))
        q, v = (np.concatenate([p[k] for p in found]) for k in (0, 1))
        return who[q], v


def range_pairs(x: np.ndarray, graph: list[np.ndarray], least: float, audit: int = 64, target: float = 0.99) -> np.ndarray:
    """Pairs of different rows of ``x`` with a cosine of ``least`` or more, verified in double precision.

    The search is audited on up to ``audit`` rows against brute force. While it misses more than ``1 - target`` of their
    pairs, the beam is doubled; at the end of that, the shard is compared in full.
    """
    n, reach = len(x), least - 1e-4  # float32 in the search, double after it
    searcher = Searcher(x, graph)
    probe = np.unique(np.linspace(0, n - 1, min(audit, n)).astype(np.int64))
    truth = (x[probe] @ x.T) >= least
    beam = BEAM
    while beam < n:
        who, node = searcher.search(probe, reach, beam)
        got = np.zeros_like(truth)
        got[np.searchsorted(probe, who), node] = True
        if (got & truth).sum() >= target * truth.sum():
            parts = [searcher.search(np.arange(i, min(i + 1024, n)), reach, beam) for i in range(0, n, 1024)]
            pairs = np.stack([np.concatenate([p[k] for p in parts]) for k in (0, 1)], axis=1)
            break
        beam *= 2
    else:
        pairs = np.concatenate([np.argwhere(x[i:i + 1024] @ x.T >= reach) + [i, 0] for i in range(0, n, 1024)])
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    exact = [products(x[pairs[i:i + 65536, 0]], x[pairs[i:i + 65536, 1]]) for i in range(0, len(pairs), 65536)]
    return pairs[np.concatenate([*exact, np.zeros(0)]) >= least]


def local_roots(n: int, pairs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the row of least ``order`` that ``pairs`` connect it to."""
    root = np.arange(n)
    rank = np.argsort(np.argsort(order))
    while True:
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        lower, upper = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
        apart = lower != upper
        if not apart.any():
            return root
        best = np.full(n, n)
        np.minimum.at(best, upper[apart], rank[lower[apart]])
        row_of = np.argsort(rank)
        changed = best < n
        root[changed] = row_of[best[changed]]
        while (root[root] != root).any():
            root = root[root]


def _assign(middle: np.ndarray, overlap: int):
    """Rows ``(node, copies, vector, clusters)``: the ``overlap`` nearest clusters of each vector."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, matrix in by_length(batch.column(0), batch.column(2)):
                x = unit(matrix)
                m = min(overlap, len(middle))
                like = x @ middle.T if x.shape[1] == middle.shape[1] else np.zeros((len(x), len(middle)))
                top = np.sort(np.argpartition(-like, m - 1, axis=1)[:, :m], axis=1).astype(np.int32)
                edge = pa.array(np.arange(len(x) + 1) * m, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), batch.column(1).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.ListArray.from_arrays(edge, pa.array(top.ravel()))], names=["node", "copies", "vector", "clusters"])

    return assign


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.float64) for v in frame["vector"]])


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node", ignore_index=True)
    ids = frame["node"].to_numpy()
    return pd.DataFrame({"node": ids, "near": [ids[g] for g in build_graph(_matrix(frame))]})


def _search(least: float):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        ids, copies, x = frame["node"].to_numpy(), frame["copies"].to_numpy(), _matrix(frame)
        graph = []
        for near in frame["near"]:  # of the united lists, what is in this shard
            near = np.asarray(near, dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            graph.append(at[ids[at] == near])
        pairs = range_pairs(x, graph, least)
        pairs = np.sort(pairs, axis=1)
        a, b = pairs[:, 0], pairs[:, 1]
        none = np.zeros(len(ids), dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([ids, ids[a]]), "b": np.concatenate([ids[local_roots(len(ids), pairs, ids)], ids[b]]),
                             "a_copies": np.concatenate([none, copies[a]]), "b_copies": np.concatenate([none, copies[b]])})

    return search


def find_links(nodes: DataFrame, middle: np.ndarray, overlap: int, least: float) -> DataFrame:
    """Rows ``(a, b, a_copies, b_copies)``: each pair of nodes that a shard found, and with no copies each node of a shard with a
    node that it is connected to there."""
    placed = stored(nodes.select("node", "copies", "embedding").mapInArrow(
        _assign(middle, overlap), "node long, copies long, vector binary, clusters array<int>"), "placed")
    spread = placed.withColumn("dim", F.octet_length("vector")).withColumn("cluster", F.explode("clusters"))
    sizes = spread.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("parts"))
    # a cluster of at most 2 BLOCK vectors is one shard; a larger one is cut into blocks and a shard holds two of them
    tiled = spread.join(sizes, ["dim", "cluster"]).withColumn("parts", F.when(F.col("parts") == 1, 1).otherwise(2 * F.col("parts")))
    tiled = tiled.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    shards = stored(tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "node", "copies", "vector", "dim", "cluster",
        F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")), "shards")
    key = ["dim", "cluster", "left", "right"]
    lists = shards.select(*key, "node", "vector").groupBy(*key).applyInPandas(
        lambda f: _build(f), "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    search = _search(least)
    ready = shards.join(united, "node")
    return stored(ready.groupBy(*key).applyInPandas(lambda f: search(f), "a long, b long, a_copies long, b_copies long"), "found")


def counted(found: DataFrame) -> DataFrame:
    """Rows ``(node, links)``: to how many vectors of other nodes each node of ``find_links`` is linked. A pair that several shards
    found counts once."""
    pairs = found.filter("b_copies > 0").dropDuplicates(["a", "b"])
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b_copies").alias("n")), F.struct(F.col("b").alias("node"), F.col("a_copies").alias("n"))))
    return pairs.select(ends.alias("end")).groupBy(F.col("end.node").alias("node")).agg(F.sum("end.n").alias("links"))


def audited(nodes: DataFrame, links: DataFrame, least: float, skip: int, sample: int) -> tuple[int, int]:
    """The true links of ``sample`` nodes, by brute force over all nodes in one pass, and how many of them ``links(node, links)``
    has. Nodes come in the order of their hashes, after the first ``skip``."""
    probe = nodes.orderBy(F.xxhash64("node"), "node").limit(skip + sample).offset(skip).select("node", "embedding").toPandas()
    if not len(probe):
        return 0, 0
    ids, matrix = probe["node"].to_numpy(), [unit(np.asarray(v)[None, :])[0] for v in probe["embedding"]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(1).to_numpy()
            total = np.zeros(len(ids), dtype=np.int64)
            for at, own, x in by_length(batch.column(0), batch.column(2)):
                same = [i for i, m in enumerate(matrix) if len(m) == x.shape[1]]
                if same:
                    close = (np.stack([matrix[i] for i in same]) @ unit(x).T >= least) & (ids[same][:, None] != own)
                    total[same] += close @ copies[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "links"])

    truth = nodes.select("node", "copies", "embedding").mapInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    row = truth.join(links, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
    return row[0] or 0, row[1] or 0


def recall(nodes: DataFrame, links: DataFrame, least: float, enough: int, sample: int, most: int) -> float | None:
    """The share of true links that were found, over nodes until ``enough`` true links were seen, ``most`` at most; None if there were fewer."""
    true = got = done = 0
    while true < enough and done < most:
        more, found = audited(nodes, links, least, done, min(sample, most - done))
        true, got, done = true + more, got + found, done + sample
        sample *= 4
        if done >= nodes.count():
            break
    return got / true if true >= enough or true and done >= nodes.count() else 1.0 if done >= nodes.count() else None


def near_duplicates(rows: DataFrame, least: float = 0.9, overlap: int = 3, sample: int = 256, target: float = 0.98,
                    enough: int = 200, most: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one per id of ``rows``: how many other vectors have a cosine of
    ``least`` or more with it, the smallest id that links reach, and whether that is its own.

    Vectors that are null, empty or zero, or hold null or non-finite components, have no links and are kept, each its
    own component; so do ids without a vector. An id that occurs more than once counts once, with its least vector; null
    ids are left out. Vectors of different lengths aren't linked. Other columns are not read. An empty table gives an
    empty one.

    Equal vectors are one node from the start. Nodes go to the shards of their ``overlap`` nearest clusters (centres
    fitted on at most ``SAMPLE`` vectors; every vector is assigned); in every shard a graph is built, a node's lists are
    united, and each node is searched in its shards. A crowded cluster is cut into blocks, and a shard holds two, so that
    no task meets more than ``4 BLOCK`` vectors, about, and no pair of the cluster is left out. A link that several
    shards find counts once. Recall is audited against brute force over all vectors, for ``sample`` nodes and more, up to ``most``, until ``enough`` true links were
    seen; below ``target`` the search is done again with twice the overlap, as long as there are clusters. Where links are too rare to
    measure it, or it stays below, a warning says so.
    """
    vectors = stored(valid_vectors(rows, id_column, vector_column), "vectors")
    nodes = stored(vectors.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    count = nodes.count()
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    usual = pd.Series([len(v) for v in drawn]).mode()
    drawn = [v for v in drawn if len(v) == usual[0]] if len(drawn) else [np.ones(1)]
    clusters = max(1, min(-(-count // CLUSTER) if count > 2 * BLOCK else 1, len(drawn) // 4))
    middle = centres(unit(np.stack(drawn)), clusters)
    while True:
        found = find_links(nodes, middle, overlap, least)
        links = stored(counted(found), "counted")
        share = recall(nodes, links, least, enough, sample, most)
        if share is None or share >= target or overlap >= clusters:
            break
        overlap *= 2
    if share is None or share < target:
        warnings.warn("too few links to measure recall" if share is None else f"recall is {share:.3f}", stacklevel=2)
    reach = components(found.filter("b_copies = 0").select("a", "b"))
    known = (nodes.join(links, "node", "left").join(reach, "node", "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    named = vectors.join(known, "embedding").select("vec_id", "n_links", "component_id")
    everyone = rows.select(F.col(id_column).alias("vec_id")).filter("vec_id is not null").distinct()
    full = everyone.join(named, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return full.withColumn("kept", F.col("vec_id") == F.col("component_id"))
