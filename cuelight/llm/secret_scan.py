"""Secret scans with a trigram index.

Every rule is a regular expression. From it a Boolean query over trigrams is derived that every match must meet. Each
batch of texts gets postings for the trigrams that some rule asks for; a rule's query is answered by intersecting and
uniting postings, and only the candidates are searched with the expression. A rule without a mandatory trigram searches
every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import map_rows, plain, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost first and without overlaps, whose ``group`` has at least
    ``least`` characters. Letters of ``pattern`` stand for either case if ``any_case`` (A-Z only)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Published shapes of credentials that clean text does not hold.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9]{8,}-[A-Za-z0-9-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: Bytes that are indexed at a time, and of the texts that are scanned together.
INDEXED, SCANNED = 1 << 19, 4 << 20

# A query is None (anything may match), a trigram, or ("and" | "or", frozenset of queries).
Query = object
_MOST = 64  # strings of a set that is still spelt out


def _all(queries) -> Query:
    known = frozenset(q for q in queries if q is not None)
    return None if not known else next(iter(known)) if len(known) == 1 else ("and", known)


def _any(queries) -> Query:
    known = frozenset(queries)
    return None if None in known or not known else next(iter(known)) if len(known) == 1 else ("or", known)


def _of_strings(strings: frozenset[str]) -> Query:
    """What a text must hold if it holds one of ``strings``."""
    return _any(_all(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


_CLASSES = {"d": "0123456789", "w": "".join(c for c in map(chr, range(128)) if c.isalnum() or c == "_"), "s": " \t\n\r\f\v"}
_REPEAT = re.compile(r"\{(\d+)(,?)(\d*)\}")


def parsed(pattern: str) -> list[tuple]:
    """The items of a regular expression, of the part of its syntax that rules are written in; anything else is an error.

    Items: ``("in", characters)`` (None: any or very many), ``("group", items)``, ``("or", branches)``,
    ``("repeat", least, most, items)`` (most None: no limit) and ``("at",)``, which matches no character.
    """
    at = 0

    def refuse() -> ValueError:
        return ValueError(f"no trigrams can be derived from {pattern!r} at {at}")

    def next_is(text: str) -> bool:
        return pattern.startswith(text, at)

    def branches() -> list[tuple]:
        nonlocal at
        found = [sequence()]
        while next_is("|"):
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else [("or", found)]

    def sequence() -> list[tuple]:
        items = []
        while at < len(pattern) and not next_is("|") and not next_is(")"):
            items.append(repeated(atom()))
        return items

    def repeated(item: tuple) -> tuple:
        nonlocal at
        counts = {"?": (0, 1), "*": (0, None), "+": (1, None)}
        while at < len(pattern):
            if pattern[at] in counts:
                least, most = counts[pattern[at]]
                at += 1
            elif given := _REPEAT.match(pattern, at):
                least = int(given[1])
                most = int(given[3]) if given[3] else None if given[2] else least
                at = given.end()
            else:
                break
            if next_is("+"):  # possessive
                raise refuse()
            at += next_is("?")
            item = ("repeat", least, most, [item])
        return item

    def atom() -> tuple:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            if next_is("?:"):
                at += 2
            elif next_is("?"):
                raise refuse()
            inner = branches()
            if not next_is(")"):
                raise refuse()
            at += 1
            return ("group", inner)
        if c == "[":
            return ("in", members())
        if c == ".":
            return ("in", None)
        if c in "^$":
            return ("at",)
        if c in "*+?{":
            raise refuse()
        if c == "\\":
            if pattern[at:at + 1] in ("b", "B", "A", "Z"):
                at += 1
                return ("at",)
            return ("in", escaped())
        return ("in", frozenset(c))

    def escaped() -> frozenset | None:
        nonlocal at
        c = pattern[at:at + 1]
        at += 1
        if c == "x":
            at += 2
            return frozenset(chr(int(pattern[at - 2:at], 16)))
        if c in _CLASSES:
            return frozenset(_CLASSES[c])
        if c.lower() in _CLASSES:
            return None
        if c in "nrtfv":
            return frozenset({"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}[c])
        if c.isalnum() or not c:
            raise refuse()
        return frozenset(c)

    def members() -> frozenset | None:
        nonlocal at
        outside = next_is("^")
        at += outside
        found, first = set(), True
        while first or not next_is("]"):
            if at >= len(pattern):
                raise refuse()
            first = False
            c = pattern[at]
            at += 1
            one = escaped() if c == "\\" else frozenset(c)
            if next_is("-") and not next_is("-]") and one is not None and len(one) == 1:
                at += 1
                end = pattern[at]
                at += 1
                last = escaped() if end == "\\" else frozenset(end)
                one = frozenset(map(chr, range(ord(min(one)), ord(min(last)) + 1)))
            outside = outside or one is None
            found |= one or set()
        at += 1
        return None if outside else frozenset(found)

    items = branches()
    if at < len(pattern):
        raise refuse()
    return items


def _strings(item: tuple) -> frozenset[str] | None:
    """All strings that one item matches, if they are few."""
    kind = item[0]
    if kind == "in":
        return item[1] if item[1] is not None and len(item[1]) <= _MOST else None
    if kind == "group":
        return _sequence_strings(item[1])
    if kind == "or":
        options = [_sequence_strings(x) for x in item[1]]
        return frozenset().union(*options) if all(o is not None for o in options) else None
    if kind == "at":
        return frozenset([""])
    _, least, most, items = item
    one = _sequence_strings(items) if most is not None and most <= 3 else None
    if one is None:
        return None
    found, step = set(), {""}
    for n in range(most + 1):
        found |= step if n >= least else set()
        step = {a + b for a in step for b in one}
        if len(step) > _MOST:
            return None
    return frozenset(found)


def _sequence_strings(items: list[tuple]) -> frozenset[str] | None:
    whole = frozenset([""])
    for item in items:
        found = _strings(item)
        whole = None if found is None else frozenset(a + b for a in whole for b in found)
        if whole is None or len(whole) > _MOST:
            return None
    return whole


def _inner(item: tuple) -> Query:
    """What a match of an item that can't be spelt out must hold."""
    if item[0] == "group":
        return _sequence(item[1])
    if item[0] == "or":
        return _any(_sequence(x) for x in item[1])
    if item[0] == "repeat" and item[1] > 0:
        return _sequence(item[3])
    return None


def _sequence(items: list[tuple]) -> Query:
    queries, run = [], frozenset([""])
    for item in items:
        found = _strings(item)
        longer = None if found is None else frozenset(a + b for a in run for b in found)
        if longer is not None and len(longer) <= _MOST:
            run = longer
            continue
        queries.append(_of_strings(run))
        run = frozenset([""])
        if found is not None and len(found) <= _MOST:
            run = found
        else:
            queries.append(_inner(item))
            once = _sequence_strings(item[3]) if item[0] == "repeat" and item[1] > 0 else None
            if once and len(once) <= _MOST:
                run = once
    queries.append(_of_strings(run))
    return _all(queries)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query, in lower case, that the lower-cased text of every match meets."""
    def low(q: Query) -> Query:
        if isinstance(q, tuple):
            return (q[0], frozenset(map(low, q[1])))
        return q.lower() if isinstance(q, str) and q.isascii() else None

    def tidy(q: Query) -> Query:  # a part outside ASCII has no postings here and so demands nothing
        if isinstance(q, tuple):
            return (_all if q[0] == "and" else _any)(tidy(x) for x in q[1])
        return q

    return tidy(low(_sequence(parsed(pattern))))


def trigrams(q: Query) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1])) if isinstance(q, tuple) else set()


class Postings:
    """For each indexed trigram the sorted rows of a batch whose text holds it, letters in lower case."""

    def __init__(self, indexed: Sequence[str]):
        self.number = {t: i for i, t in enumerate(indexed)}
        self.code = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.code[a << 16 | b << 8 | c] = i + 1
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.rows: list[np.ndarray] = []

    def index(self, texts: pa.Array) -> None:
        """``texts``: a large string array that begins at its buffer's start or not. Its bytes are read block by block, so a long text
        takes no more memory than short ones."""
        edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        pairs = []
        for start in range(int(edges[0]), int(edges[-1]) - 2, INDEXED):
            low = self.low[raw[start:min(start + INDEXED + 2, int(edges[-1]))]].astype(np.int32)
            found = self.code[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(found)
            which = found[at].astype(np.int64) - 1
            at = at + start
            row = np.searchsorted(edges, at, side="right") - 1
            inside = at + 3 <= edges[row + 1]  # not across two texts
            pairs.append(np.unique(which[inside] * len(texts) + row[inside]))
        held = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pairs]))
        split = np.searchsorted(held, np.arange(1, len(self.number)) * len(texts))
        self.rows = [p % max(1, len(texts)) for p in np.split(held, split)] if len(self.number) else []

    def answer(self, q: Query) -> np.ndarray:
        if isinstance(q, str):
            return self.rows[self.number[q]]
        parts = sorted(map(self.answer, q[1]), key=len)
        found = parts[0]
        for p in parts[1:]:
            found = (np.intersect1d if q[0] == "and" else np.union1d)(found, p)
        return found


class Scanner:
    """Spans ``(start, rule number, end)`` of each text of a batch, in code points."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.postings = Postings(sorted(set().union(*(trigrams(q) for _, _, q in self.rules))))

    def scan(self, texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        self.postings.index(texts)
        found: dict[int, list[tuple[int, int, int]]] = {}
        held: dict[int, str] = {}
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in range(len(texts)) if query is None else self.postings.answer(query).tolist():
                text = held.get(i)
                if text is None:
                    text = texts[i].as_py()
                    if len(texts) > 1:  # a long text is alone
                        held[i] = text
                for m in expression.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(i, []).append((m.start(), k, m.end()))
        for spans in found.values():
            spans.sort()
        return found


def _scanned(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], column: int):
    scanner = Scanner(rules)
    for batch in batches:
        texts = plain(batch.column(column))
        for a, b in slices(texts, SCANNED):
            part = texts.slice(a, b - a)
            yield batch.slice(a, b - a), part, scanner.scan(part)
        del texts
        pa.default_memory_pool().release_unused()


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Secrets of every whole text: ``doc_id``, ``n_<kind>`` of each base rule, ``base_sha256`` of the base spans
    (``kind:start:end``, by start, then as listed, joined by commas) and ``spans``, all spans written so.

    Spans cover the whole match, in code points, end exclusive. One pass without a shuffle; each input row gives one
    row. A null or empty text has no spans: counts 0 and the digest of the empty string. Null and repeated ids stay;
    other columns are not read. Spans of different kinds may overlap.
    """
    rules, kinds = tuple(rules), [r.kind for r in base]
    if [r.kind for r in rules[:len(base)]] != kinds:
        raise ValueError("rules begin with the base rules")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found in _scanned(batches, rules, 1):
            counts = [[0] * len(texts) for _ in kinds]
            plain_base, everything = [""] * len(texts), [""] * len(texts)
            for i, spans in found.items():
                written = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in spans]
                for k, _ in written:
                    if k < len(kinds):
                        counts[k][i] += 1
                plain_base[i] = ",".join(w for k, w in written if k < len(kinds))
                everything[i] = ",".join(w for _, w in written)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain_base]), pa.array(everything),
            ], names=["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {kind}, {''.join(f'n_{k} long, ' for k in kinds)}base_sha256 string, spans string")


def redact(text: str, spans: Sequence[tuple[int, int, int]], kinds: Sequence[str]) -> str:
    """``text`` with each run of overlapping spans replaced by its first kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kinds[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text_column: str = "text",
                   length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in its texts replaced; columns and rows stay, whatever the names of columns, and repeated rows too. A null text stays
    null, an empty one empty, and ``length_column``, if there is one, is counted anew where the text changed. An empty table gives an empty one."""
    rules = tuple(rules)
    kinds, names = [r.kind for r in rules], docs.columns
    column = names.index(text_column)
    counted = names.index(length_column) if length_column in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found in _scanned(batches, rules, column):
            if not found:
                yield batch
                continue
            columns = batch.columns
            values = columns[column].to_pylist()
            lengths = columns[counted].to_pylist() if counted is not None else None
            for i, spans in found.items():
                values[i] = redact(values[i], spans, kinds)
                if lengths is not None:
                    lengths[i] = len(values[i])
            columns[column] = pa.array(values, columns[column].type)
            if lengths is not None:
                columns[counted] = pa.array(lengths, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, clean)
