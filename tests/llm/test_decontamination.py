"""Benchmark decontamination against a plain search, and the index against plain suffixes."""

import hashlib
import random
import re

import numpy as np
import pytest

from cuelight.llm import decontamination as dec, fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    """Rows by the definition; docs and items are (id, text)."""
    wanted = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - n + 1) if own else 0):
            wanted.setdefault(tuple(own[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, met = words(text), set(), set()
        for size in {len(p) for p in wanted}:
            for i in range(len(own) - size + 1):
                if (p := tuple(own[i:i + size])) in wanted:
                    hit |= set(range(i, i + size))
                    met |= wanted[p]
        named = ",".join(sorted(str(m) for m in met if m is not None))
        out.append((doc, len(own), len(hit), len(met - {None}), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def sample(seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "cat", "Dog", "été", "日本", "x1", "7", "ÀB", "zz"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "_", "  ", "\x00"]) for _ in range(n))
    items = [(i, text(rng.randint(4, 25))) for i in range(30)] + [(30, None), (31, ""), (32, " ... "), (3, "the a cat"), (None, text(12)), (33, "only here " * 7)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for i in range(60):
        own = rng.choice([t for _, t in items if t])
        docs.append((100 + i, text(rng.randint(0, 9)) + " " + own + " " + text(rng.randint(0, 9)) + own[:rng.randint(0, len(own))]))
    return [*docs, (200, None), (201, ""), (202, " \n"), (203, "the " * 900), docs[70], docs[70], (None, docs[75][1]), (5, "another text of id five")], items


def frame(spark, rows, name):
    return spark.createDataFrame([(*r, "z", [1]) for r in rows], f"{name} long, text string, key string, words array<int>")


def found(spark, docs, items, **kwargs):
    got = dec.find_passages(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), **kwargs)
    return got, sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("shard,block", [(6 << 20, 200_000), (300, 150), (25, 60)])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(dec, "SHARD", shard)
    monkeypatch.setattr(dec, "BLOCK", block)
    docs, items = sample()
    want = brute(docs, items)
    assert sum(r[-1] for r in want) > 40 and sum(not r[-1] for r in want) > 10
    assert found(spark, docs, items)[1] == want


def test_other_phrase_lengths_and_empty_tables(spark):
    docs, items = sample(seed=2)
    assert found(spark, docs, items, words=3)[1] == brute(docs, items, 3)
    got, rows = found(spark, [], items)
    assert rows == [] and got.columns[:3] == ["doc_id", "n_words", "n_hit"]
    for none in ([], [(1, None), (2, " ")]):
        assert found(spark, docs, none)[1] == brute(docs, [])


def test_passages_are_removed(spark):
    docs, items = sample(seed=3)
    table = frame(spark, docs, "doc_id").withColumnRenamed("key", "a.b")
    clean = dec.remove_passages(table, dec.find_passages(table, frame(spark, items, "item_id")))
    assert clean.columns == table.columns and clean.count() == len(docs)
    kept = {r.doc_id: r.text for r in clean.collect()}
    hits = {r[0]: r[2] for r in brute(docs, items)}
    for doc, text in docs:
        if doc is not None and doc != 5:
            assert kept[doc] == text if not hits[doc] else len(words(kept[doc])) == len(words(text)) - hits[doc]
    assert dec.without_spans("One, two! three FOUR five", [(1, 3)]) == "One,  FOUR five"


def test_very_long_texts_are_indexed_in_pieces(spark):
    item = " ".join(f"w{i}" for i in range(14))
    text = "filler words, " * 1_500_000 + item + " more" * 900_000 + " " + item  # 25 MB
    docs, items = [(1, text), (2, "x" * 9_000_000 + " " + item)], [(7, item)]
    assert found(spark, docs, items)[1] == [
        (1, 3_900_028, 28, 1, hashlib.sha256(b"7").hexdigest(), True), (2, 15, 14, 1, hashlib.sha256(b"7").hexdigest(), True)]


def test_index_finds_all_places():
    rng = np.random.default_rng(4)
    for size, kinds in ((1, 1), (40, 2), (3000, 3), (5000, 900)):
        text = np.append(rng.integers(1, kinds + 1, size), 0)
        if size == 3000:
            text[1000:2000] = text[:1000]
        order = fm_index.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = fm_index.Index(fm_index.build(text))
        lengths = rng.integers(1, 5, 200)
        asked = np.zeros((200, 4), dtype=np.int64)
        for row, n in zip(asked, lengths):
            row[-n:] = rng.integers(1, kinds + 1, n)
        low, high = index.search(asked, lengths)
        for row, n, a, b in zip(asked, lengths, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == row[-n:]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_pieces_hold_every_run_of_words():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb", " ", "   ", "ccc "]) for _ in range(rng.randint(0, 60))).encode()
        own, at = text.split(), 0
        for piece, extra in dec.pieces(text, rng.randint(1, 9), 2):
            part = piece.split()
            assert part == own[at:at + len(part)] and extra == min(2, len(own) - at - len(part) + extra)
            at += len(part) - extra
        assert at == len(own)
