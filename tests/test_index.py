"""Match expressions and the index by term against plain loops over small texts."""

import math
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelight.operators import matching, termindex, textindex
from cuelight.operators.matching import Every, Some, Without, Words

FIELDS = ["title", "body"]


def texts(spark, n=80, seed=4):
    rng = random.Random(seed)
    words = ["red", "car", "night", "rain", "raining", "chase", "the", "boat", "a"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, title string, body string")


def holds(tree, doc):
    fields = dict(zip(FIELDS, (t.split() for t in doc[1:])))
    if isinstance(tree, Words):
        n = len(tree.words)
        for name, own in fields.items():
            if not tree.fields or name in tree.fields:
                for i in range(len(own) - n + 1):
                    part = own[i:i + n]
                    if part[:-1] == list(tree.words[:-1]) and (part[-1].startswith(tree.words[-1]) if tree.begins else part[-1] == tree.words[-1]):
                        return True
        return False
    if isinstance(tree, Without):
        return holds(tree.keep, doc) and not holds(tree.drop, doc)
    return (all if isinstance(tree, Every) else any)(holds(p, doc) for p in tree.parts)


def test_expressions_are_read():
    w = lambda *words, **more: Words(words, **more)
    read = matching.read_match
    assert read("a b OR c") == Some((Every((w("a"), w("b"))), w("c")))
    assert read("a AND b OR c") == Some((Every((w("a"), w("b"))), w("c")))
    assert read("a AND (b OR c)") == Every((w("a"), Some((w("b"), w("c")))))
    assert read("a NOT b c") == Without(w("a"), Every((w("b"), w("c"))))
    assert read("a AND b NOT c") == Every((w("a"), Without(w("b"), w("c"))))
    assert read('"red car"*') == Words(("red car",), True) and read("red + car *") == Words(("red", "car"), True)
    assert read('"say ""hi"""') == w('say "hi"')
    assert read("title : (a OR body : b)") == Some((Words(("a",), False, ("title",)), Words(("b",), False, ())))
    assert read("{title body} : a") == Words(("a",), False, ("title", "body"))
    assert read("and or") == Every((w("and"), w("or")))
    for bad in ("", "a AND", "(a", "a)", "OR a", "title :", "a ** b", "- a", '"a'):
        with pytest.raises(ValueError):
            read(bad)


@pytest.mark.parametrize("text", [
    "(red AND car) OR boat", 'title : "red car" OR body : "the chase"', "rain* NOT raining", '("red car" OR "car red") AND night NOT (boat OR title : a)',
    "chase + the + boat OR red + c*", "nothing", "{title} : night AND {body} : night",
])
def test_expressions_match_like_a_plain_loop(spark, text):
    data, df = texts(spark)
    postings = textindex.build_postings(df, ["doc_id"], FIELDS, stemmed=False)
    tree = matching.read_match(text)
    plain = lambda t: t if not isinstance(t, Words) else Words(tuple(x for p in t.words for x in p.split()), t.begins, t.fields)

    def split(t):
        if isinstance(t, Words):
            return plain(t)
        return Without(split(t.keep), split(t.drop)) if isinstance(t, Without) else type(t)(tuple(map(split, t.parts)))

    want = [(d[0],) for d in data if holds(split(tree), d)]
    assert rows(matching.matching(postings, text, "doc_id", stemmed=False)) == want
    lengths = textindex.text_lengths(df, ["doc_id"], FIELDS)
    assert sorted((r.doc_id,) for r in matching.ranked(postings, lengths, text, "doc_id", stemmed=False).collect()) == want


def test_many_words_and_signs_only(spark):
    data, df = texts(spark, 30)
    postings = textindex.build_postings(df, ["doc_id"], FIELDS, stemmed=False)
    many = Some(tuple(Words((f"w{i}",)) for i in range(130)) + (Words(("boat",)),))
    assert rows(matching.matching(postings, many, "doc_id", stemmed=False)) == [(d[0],) for d in data if holds(Words(("boat",)), d)]
    assert rows(matching.matching(postings, Every((Words(("boat",)), Words(("!?",)))), "doc_id", stemmed=False)) == [
        (d[0],) for d in data if holds(Words(("boat",)), d)]
    assert matching.matching(postings, Words(("!",)), "doc_id").count() == 0
    assert matching.matching(postings.limit(0), "a OR b", "doc_id").count() == 0


def bm25(data, words):
    docs = [(d[0], (d[1] + " " + d[2]).split()) for d in data]
    mean = sum(len(t) for _, t in docs) / len(docs)
    out = {}
    for w in sorted(words):
        df = sum(w in t for _, t in docs)
        idf = max(1e-6, math.log((len(docs) - df + 0.5) / (df + 0.5)))
        for i, t in docs:
            if tf := t.count(w):
                out[i] = out.get(i, 0.0) - idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / mean)))
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_index_by_term(spark, monkeypatch, capsys, block):
    monkeypatch.setattr(termindex, "BLOCK", block)
    data, df = texts(spark, 200, 9)
    data += [(1000 + i, "rare" if i % 3 else "rare word", "x " * i) for i in range(7)]
    df = spark.createDataFrame(data, "doc_id long, title string, body string")
    postings, lengths = textindex.build_postings(df, ["doc_id"], FIELDS, stemmed=False), textindex.text_lengths(df, ["doc_id"], FIELDS)
    index = termindex.new_index(postings, lengths, 6, "doc_id")
    for words in (["night", "car"], ["none"], ["rare", "word", "a", "boat"]):
        want = bm25(data, words)
        assert {r.id: round(r.rank, 9) for r in index.rank(words, stemmed=False).collect()} == {i: round(s, 9) for i, s in want.items()}
        for k in (5, 40):
            best = [i for _, i in sorted((round(s, 13), i) for i, s in want.items())[:k]]
            got = index.best(words, k, stemmed=False).collect()
            assert [r.id for r in sorted(got, key=lambda r: (round(r.rank, 13), r.id))] == best
    assert sorted({r.term for r in index.blocks([], ["rai"]).collect()}) == ["rain", "raining"]
    index.blocks(["night"]).explain("formatted")
    folders = set(re.findall(r"blocks/part=(\d+)", capsys.readouterr().out))
    assert len(folders) < len(index.ends) and len(index.ends) > 1
    stored = index.blocks(["night"]).select("docs.places").first()
    assert {p["field"] for d in stored.places for p in d} <= set(FIELDS)


def test_index_skips_blocks_that_cannot_matter(spark, monkeypatch):
    monkeypatch.setattr(termindex, "BLOCK", 8)
    data = [(i, "common", "filler " * (i % 5)) for i in range(400)] + [(1000 + i, "rare common", "") for i in range(6)]
    df = spark.createDataFrame(data, "doc_id long, title string, body string")
    index = termindex.new_index(textindex.build_postings(df, ["doc_id"], FIELDS, stemmed=False), textindex.text_lengths(df, ["doc_id"], FIELDS), 4, "doc_id")
    read = []
    scored = termindex.TermIndex._scored
    monkeypatch.setattr(termindex.TermIndex, "_scored", lambda self, blocks, idf: read.append(blocks.select("term", "block").collect()) or scored(self, blocks, idf))
    assert [r.id for r in index.best(["rare", "common"], 3, stemmed=False).collect()] == [1000, 1001, 1002]
    everything = index.blocks(["rare", "common"]).count()
    assert sum(len(r) for r in read) < everything


def test_search_by_expression(spark):
    from test_catalog import clip, ingested, manifest, scores

    from cuelight.operators.search import search

    clips = [clip(1, 0, 20, ["crash"], 10, {}, None, [], description="red car in the rain"), clip(2, 20, 40, ["stunt"], 20, {}, None, [], description="a red boat")]
    got, _ = ingested(spark, ("/m/a/manifest.json", manifest(clips=clips)))
    assert scores(search(got, query='description : (cars OR boats) NOT tags : crash')) == [20]
    assert scores(search(got, query=Some((Words(("rain",)), Words(("boat",)))), order_by="timeline")) == [10, 20]
    assert search(got, query="red").filter(F.col("fts_rank").isNull()).count() == 0
