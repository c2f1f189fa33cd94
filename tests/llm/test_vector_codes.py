"""Vector codes against plain integer arithmetic."""

import hashlib
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from cuelight.llm import vector_codes


def brute(rows, parts=16, size=64, rounds=2):
    """Codes by the definition, with Python integers: rows of (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and abs(x) < inf for x in r[1])]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    ints = [[floor(Fraction(x) * 256) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    cut = [[x[p * width:(p + 1) * width] for p in range(parts)] for x in ints]
    books = [[cut[i][p] for i in order[:size]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    return [(k[0], "".join(f"{e:02x}" for _, e in f), n, sum(m for q, m in zip(kept, errors) if q[2] == k[2]), digest)
            for k, f, n in zip(kept, found, errors)]


def columns(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 0) for r in rows], "vec_id long, embedding array<double>, label int, code string, _key int")


def sample(n=150, width=48, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    x[40:60] = x[3]
    x[60:70, :16] = 0
    rows = [(i * 3 % 101 + i // 101 * 200, [float(v) for v in r], [0, 0, 1, None][i % 4]) for i, r in enumerate(x)]
    return [*rows, rows[5], rows[5], (9000, None, 1), (9001, [nan] * width, 1), (9002, [None] + [1.0] * (width - 1), 1), (9003, [-inf] * width, 1),
            (None, [0.5] * width, None), (9004, [0.0] * width, 7), (9005, [], 7), (9006, [1.0, -0.001], 7)]


@pytest.mark.parametrize("width", [48, 16, 70])
def test_codes_are_those_of_plain_arithmetic(spark, width):
    rows = sample(width=width)
    assert columns(vector_codes.compress(frame(spark, rows))) == sorted(brute(rows), key=str)


def test_huge_numbers_stay_exact(spark):
    rows = [(i, [float(v) * 10.0 ** e for v, e in zip(np.random.default_rng(i).normal(size=32), [0, 4, 9, 17] * 8)], i % 2) for i in range(80)]
    want = brute(rows)
    long = [n if n < 1 << 63 else None for _, _, n, _, _ in want]
    assert None in long and any(long)
    assert columns(vector_codes.compress(frame(spark, rows))) == sorted([(i, c, n, None, d) for (i, c, _, _, d), n in zip(want, long)], key=str)
    rows = [(i, [1e300 if i == 3 else float(i), -1e-300, 0.0, 5e-324], 0) for i in range(5)]
    want = brute(rows, parts=2, size=2)
    got = vector_codes.compress(frame(spark, rows), parts=2, size=2)
    assert [(r.vec_id, r.code, r.codebooks_sha256) for r in got.orderBy("vec_id").collect()] == [(i, c, d) for i, c, _, _, d in want]


def test_few_and_no_vectors(spark):
    rows = sample()
    for part in (rows[:1], rows[:10], [(5, [], 1)]):
        assert columns(vector_codes.compress(frame(spark, part))) == sorted(brute(part), key=str)
    for part in ([], [(1, None, 1)]):
        none = vector_codes.compress(frame(spark, part))
        assert none.columns == vector_codes.compress(frame(spark, rows[:1])).columns and none.count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, rows), size=257)


def test_elimination_keeps_the_nearest_and_the_lower_of_ties():
    rng = np.random.default_rng(7)
    for width in (1, 3, 4, 7):
        matrix = vector_codes.sequency(1 << (width - 1).bit_length())
        assert [int((np.diff(r) != 0).sum()) for r in matrix] == list(range(len(matrix)))
        x, entries = rng.integers(-9, 9, (400, width)), rng.integers(-9, 9, (40, width))
        entries[20:] = entries[:20]
        index, distance = vector_codes.nearest_entries(x, entries, matrix)
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_decoding_gives_the_entries(spark):
    rows = sample()
    vectors = frame(spark, rows[:60]).select("vec_id", "embedding", "label")
    books = vector_codes.fit_codebooks(vectors)
    got = vector_codes.decode(vector_codes.encode(vectors, books), books).collect()
    for r in got:
        entries = [books.entries[p, int(r.code[2 * p:2 * p + 2], 16)] for p in range(16)]
        assert r.approximate == [v / 256 for e in entries for v in e.tolist()]
