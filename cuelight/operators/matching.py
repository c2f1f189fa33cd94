"""Match expressions over an inverted index: words, phrases and beginnings joined by and, or and not, in one pass.

An expression is a tree of ``Words``, ``Every``, ``Some`` and ``Without``. Each of its words and phrases is one bit: the
postings that any of them asks for are read once and gathered per document, where the tree is evaluated on the bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .textindex import K1, B, MIN_IDF, query_terms

#: Bits of one number.
BITS = 60


@dataclass(frozen=True)
class Words:
    """Words next to each other in one field, one word or more; with ``begins`` the last is a beginning. ``fields``: where to look,
    everywhere when empty."""

    words: tuple[str, ...]
    begins: bool = False
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Some:
    parts: tuple


@dataclass(frozen=True)
class Without:
    """What ``keep`` matches and ``drop`` does not."""

    keep: object
    drop: object


Match = Words | Every | Some | Without

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:*+-])|([^\s"(){}:*+-]+))')


def read_match(text: str) -> Match:
    """The tree of an expression such as ``(chase AND night) OR description : "red car" NOT rain*``.

    Words side by side are all needed, before any operator; then ``NOT`` binds closest, then ``AND``, then ``OR``. Parentheses group. A quoted text is a
    phrase, ``+`` joins phrases to a longer one, ``*`` after one makes its last word a beginning, ``field :`` or ``{a b} :`` before
    a phrase or a parenthesis says where to look. The three operators are in capitals.
    """
    found, at = [], 0
    while text[at:].strip():
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"cannot be read as a match expression: {text!r}")
        quoted, sign, word = token.groups()
        found.append(("phrase", quoted.replace('""', '"')) if quoted is not None else (sign, sign) if sign else
                     (word, word) if word in ("AND", "OR", "NOT") else ("word", word))
        at = token.end()
    tokens = [*found, ("end", ""), ("end", "")]
    place = 0

    def ahead(kind: str, skip: int = 0) -> bool:
        return tokens[place + skip][0] == kind

    def take(*kinds: str) -> str:
        nonlocal place
        kind, value = tokens[place]
        if kind not in kinds:
            raise ValueError(f"{value or 'its end'!r} is not expected in the match expression {text!r}")
        place += 1
        return value

    def some(fields: tuple) -> Match:
        parts = [every(fields)]
        while ahead("OR"):
            take("OR")
            parts.append(every(fields))
        return parts[0] if len(parts) == 1 else Some(tuple(parts))

    def every(fields: tuple) -> Match:
        parts = [without(fields)]
        while ahead("AND"):
            take("AND")
            parts.append(without(fields))
        return parts[0] if len(parts) == 1 else Every(tuple(parts))

    def without(fields: tuple) -> Match:
        left = beside(fields)
        while ahead("NOT"):
            take("NOT")
            left = Without(left, beside(fields))
        return left

    def beside(fields: tuple) -> Match:
        parts = [unit(fields)]
        while any(ahead(k) for k in ("word", "phrase", "(", "{")):
            parts.append(unit(fields))
        return parts[0] if len(parts) == 1 else Every(tuple(parts))

    def unit(fields: tuple) -> Match:
        if ahead("{") or ahead("word") and ahead(":", 1):
            named = []
            if ahead("{"):
                take("{")
                while not ahead("}"):
                    named.append(take("word", "phrase"))
                take("}")
            else:
                named.append(take("word"))
            take(":")
            return unit(tuple(n for n in named if not fields or n in fields))
        if ahead("("):
            take("(")
            inner = some(fields)
            take(")")
            return inner
        words = [take("word", "phrase")]
        while ahead("+"):
            take("+")
            words.append(take("word", "phrase"))
        begins = ahead("*")
        if begins:
            take("*")
        return Words(tuple(words), begins, fields)

    tree = some(())
    take("end")
    return tree


def leaves(tree: Match) -> Iterator[Words]:
    """The words of a tree, those that must not be there last in their part."""
    if isinstance(tree, Words):
        yield tree
    else:
        for part in (tree.keep, tree.drop) if isinstance(tree, Without) else tree.parts:
            yield from leaves(part)


def _wanted(tree: Match) -> Iterator[Words]:
    if isinstance(tree, Without):
        yield from _wanted(tree.keep)
    elif isinstance(tree, Words):
        yield tree
    else:
        for part in tree.parts:
            yield from _wanted(part)


def terms_of(leaf: Words, stemmed: bool) -> list[str]:
    """Index terms of a leaf: a word may be several, or none."""
    return [t for w in leaf.words for t in query_terms(w, stemmed)]


def _occurrences(postings: DataFrame, asked: Sequence[Words], id_column: str, stemmed: bool) -> DataFrame:
    """Rows ``(id, leaf, tf)``: how often each leaf, by its number, occurs in each document that has it."""
    exact: dict[str, list[tuple[int, int]]] = {}
    rest: list[tuple[Column, int, int]] = []
    sizes = []
    for leaf, words in enumerate(asked):
        terms = terms_of(words, stemmed)
        sizes.append(len(terms))
        for slot, term in enumerate(terms):
            if words.begins and slot == len(terms) - 1:
                rest.append((F.col("term").startswith(term), leaf, slot))
            else:
                exact.setdefault(term, []).append((leaf, slot))

    def vote(leaf: int, slot: int) -> Column:
        return F.struct(F.lit(leaf).alias("leaf"), F.lit(slot).alias("slot"))

    def where(leaf: int, test: Column) -> Column:
        return test & F.col("field").isin(list(asked[leaf].fields)) if asked[leaf].fields else test

    votes = [F.when(where(leaf, F.col("term") == term), vote(leaf, slot)) for term, places in exact.items() for leaf, slot in places]
    votes += [F.when(where(leaf, test), vote(leaf, slot)) for test, leaf, slot in rest]
    if not votes:
        return postings.select(id_column, F.lit(0).alias("leaf"), F.lit(0).cast("bigint").alias("tf")).limit(0)
    read = F.lit(False)
    for test in [F.col("term").isin(list(exact))] * bool(exact) + [test for test, _, _ in rest]:
        read = read | test
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("v.leaf") + 1)
    alone = size == 1
    voted = postings.filter(read).select(id_column, "field", "pos", F.explode(F.array_compact(F.array(*votes))).alias("v")).select(
        id_column, "v.leaf", F.when(~alone, F.col("field")).alias("field"), F.when(~alone, F.col("pos") - F.col("v.slot")).alias("begin"),
        F.when(~alone, F.col("v.slot")).alias("slot"), size.alias("size"))
    # one exchange, by document, serves this grouping and all that follow
    held = voted.repartition(id_column).groupBy(id_column, "leaf", "field", "begin").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set("slot")).alias("slots"), F.max("size").alias("size"))
    return held.filter("size = 1 or slots = size").groupBy(id_column, "leaf").agg(
        F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(1)).alias("tf"))


def _numbered(tree: Match) -> list[Words]:
    return list(dict.fromkeys(leaves(tree)))


def _holds(tree: Match, asked: Sequence[Words], stemmed: bool) -> Column:
    if isinstance(tree, Words):
        if not terms_of(tree, stemmed):  # words of signs only say nothing
            return F.lit(True)
        n = asked.index(tree)
        return F.col(f"bits{n // BITS}").bitwiseAND(F.lit(1 << n % BITS)) != 0
    if isinstance(tree, Without):
        return _holds(tree.keep, asked, stemmed) & ~_holds(tree.drop, asked, stemmed)
    parts = [_holds(p, asked, stemmed) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(tree, Every) else out | p
    return out


def _gathered(found: DataFrame, tree: Match, asked: Sequence[Words], id_column: str, stemmed: bool) -> DataFrame:
    bits = [F.bit_or(F.when(F.floor(F.col("leaf") / BITS) == g, F.expr(f"shiftleft(1L, leaf % {BITS})")).otherwise(F.lit(0).cast("bigint"))).alias(f"bits{g}")
            for g in range(-(-len(asked) // BITS))]
    one = found.groupBy(id_column).agg(*bits, F.collect_list(F.struct("leaf", "tf")).alias("parts"))
    return one.filter(_holds(tree, asked, stemmed)).select(id_column, "parts")


def matching(postings: DataFrame, match: Match | str, id_column: str = "clip_id", stemmed: bool = True) -> DataFrame:
    """Ids of the documents that an expression matches, each once. Postings are filtered by the asked terms, dealt out by
    document once, and what a document gathers has at most one entry per leaf. A document must have one of the asked words."""
    tree = read_match(match) if isinstance(match, str) else match
    asked = _numbered(tree)
    return _gathered(_occurrences(postings, asked, id_column, stemmed), tree, asked, id_column, stemmed).select(id_column)


def ranked(postings: DataFrame, lengths: DataFrame, match: Match | str, id_column: str = "clip_id", stemmed: bool = True) -> DataFrame:
    """``id, rank`` of the matched documents: negated BM25 over the words and phrases that may be there, as in ``rank``. Documents
    count as having a part whether they match the whole or not."""
    tree = read_match(match) if isinstance(match, str) else match
    asked = _numbered(tree)
    found = _occurrences(postings, asked, id_column, stemmed)
    scored = sorted({asked.index(w) for w in _wanted(tree)})
    counts = found.filter(F.col("leaf").isin(scored)).groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    totals = lengths.agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg("length").alias("mean"))
    idf = F.greatest(F.lit(MIN_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    known = counts.join(F.broadcast(totals)).select("leaf", idf.alias("idf"), "mean")
    each = _gathered(found, tree, asked, id_column, stemmed).select(id_column, F.inline("parts"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return each.join(F.broadcast(known), "leaf").join(lengths.select(id_column, "length"), id_column).groupBy(id_column).agg(
        (-F.sum(weight)).alias("rank"))
