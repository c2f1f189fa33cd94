"""Encoding many texts while each distinct space-delimited chunk is encoded once per batch.

For the byte-level vocabularies here no token spans a single space between two non-blank characters: the space
opens the next token. A text's ids are therefore the ids of its chunks in a row. Chunks that are empty or touch other
blanks break that rule; texts that hold one are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text whose chunks share one dictionary, bytes assembled at a time, and characters encoded in one string.
BATCH_BYTES, STEP_BYTES, JOINED = 8 << 20, 2 << 20, 1 << 16
#: Bytes of a piece of a long text.
PIECE = 1 << 20
#: ASCII punctuation but for the apostrophe, which opens contractions.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


_BLANK = re.compile(rb"[\x09-\x0D ]")


def pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes, cut before a space or U+0009 to U+000D; where there is none, a piece is longer."""
    start = 0
    while len(text) - start > limit and (blank := _BLANK.search(text, start + limit)):
        yield text[start:blank.start()]
        start = blank.start()
    yield text[start:]


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each; a longer text is a range of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield start, stop
        start = stop


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``pool[begin:begin + length]`` of every row, one after the other."""
    length = length.astype(np.int64)
    total = int(length.sum())
    before = np.cumsum(length) - length
    return pool[np.repeat(begin - before, length) + np.arange(total)]


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, where it is a visible
    Latin-1 character, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


Encode = Callable[[list[str]], list[np.ndarray]]


def tokenizers_encoder(tokenizer) -> tuple[Encode, list[bytes]]:
    """The tokenizers library: many texts to ids, and the bytes of each id."""
    # a task has one core; more threads would only hold more memory
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    special = tokenizer.get_added_tokens_decoder()
    table = [b""] * (tokenizer.get_vocab_size())
    for token, i in tokenizer.get_vocab().items():
        table[i] = token.encode() if i in special else bytes(byte_of[c] for c in token)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32)
                for i in range(0, len(texts), 2048)
                for e in tokenizer.encode_batch_fast(texts[i:i + 2048], add_special_tokens=False)]

    return encode, table


def rank_encoder(definition: str, pattern: str) -> tuple[Encode, list[bytes]]:
    """The same ids as ``tokenizers_encoder`` for a byte-level tokenizers file, a few times as fast: its vocabulary
    serves tiktoken as ranks, and its added tokens as special strings."""
    import json

    import tiktoken

    held = json.loads(definition)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        table[i] = token
    engine = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [engine.encode_to_numpy(t, allowed_special="all").astype(np.int32) for t in texts]

    return encode, table


class ChunkEncoder:
    """Token ids of texts by a byte-level vocabulary whose pre-tokens may open with one space and never hold another.

    ``encode`` gives the ids of many texts, ``table`` the bytes of each id.
    """

    def __init__(self, encode: Encode, table: list[bytes]):
        self._encode = encode
        self.opens = np.array([t.startswith(b" ") for t in table], dtype=bool)

    def _encode_joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of `` chunk`` for clean chunks, many in one string."""
        groups, size = [[]], 0
        for c in chunks:
            if size > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(c)
            size += len(c) + 1
        ids, lengths = [], []
        for i in range(0, len(groups), 4):
            part = [g for g in groups[i:i + 4] if g]
            for group, got in zip(part, self._encode([" " + " ".join(g) for g in part]), strict=True):
                at = np.flatnonzero(self.opens[got])
                if len(at) == len(group) and at[0] == 0:
                    ids.append(got)
                    lengths.append(np.diff(np.append(at, len(got))))
                else:  # a chunk that does not open with a space token: one by one
                    single = self._encode([" " + c for c in group])
                    ids += single
                    lengths.append(np.array([len(x) for x in single], dtype=np.int64))
        empty = np.zeros(0, dtype=np.int32)
        return np.concatenate([*ids, empty]), np.concatenate([*lengths, empty.astype(np.int64)])

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode_joined``, but a word and the punctuation behind it, which are pre-tokens of their own, are
        encoded apart, so that a word is encoded once whatever follows it."""
        cores: dict[str, int] = {}
        tails: dict[str, int] = {"": 0}
        pair = np.zeros((len(chunks), 2), dtype=np.int64)
        for i, c in enumerate(chunks):
            core = c.rstrip(PUNCTUATION)
            if not core.isalpha():
                core = c
            pair[i] = cores.setdefault(core, len(cores)), tails.setdefault(c[len(core):], len(tails))
        pool, length = self._encode_joined(list(cores))
        ends = self._encode(list(tails))
        length = np.append(length, [len(x) for x in ends]).astype(np.int64)
        begin = np.cumsum(length) - length
        pair[:, 1] += len(cores)
        flat = pair.ravel()
        return gather(np.concatenate([pool, *ends]), begin[flat], length[flat]), length[pair].sum(axis=1)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, offsets)`` for consecutive runs of rows."""
        for start, stop in slices(texts, BATCH_BYTES):
            for first, ids, offsets in self._batch(plain(texts.slice(start, stop - start))):
                yield start + first, ids, offsets
            pa.default_memory_pool().release_unused()

    def _batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        parts = pc.split_pattern(texts, " ")
        edges = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        chunks = coded.dictionary.to_pylist()
        clean = np.array([bool(c) and not c[0].isspace() and not c[-1].isspace() for c in chunks], dtype=bool)
        whole = np.logical_or.reduceat(~clean[index], edges[:-1]) if len(index) else np.ones(len(texts), dtype=bool)

        pool, lengths = self._encode_chunks([c for c, ok in zip(chunks, clean, strict=True) if ok])
        length = np.zeros(len(chunks), dtype=np.int64)
        length[clean] = lengths
        begin = np.cumsum(length) - length

        heads = index[edges[:-1]].copy()  # a text's first chunk has no space before it
        heads[whole] = -1
        kinds, back = np.unique(heads, return_inverse=True)
        own = self._encode([chunks[k] if k >= 0 else "" for k in kinds])
        slow = self._encode(texts.filter(pa.array(whole)).to_pylist())
        pools = [pool, *own, *slow]
        sizes = np.array([len(x) for x in pools], dtype=np.int64)
        at = np.cumsum(sizes) - sizes
        pool = np.concatenate(pools)
        head_begin, head_length = at[1:1 + len(own)][back], sizes[1:1 + len(own)][back]
        head_begin[whole], head_length[whole] = at[1 + len(own):], sizes[1 + len(own):]

        for start, stop in slices(texts, STEP_BYTES):
            lo, hi = edges[start], edges[stop]
            where = index[lo:hi]
            b, n = begin[where].copy(), length[where].copy()
            rows = edges[start:stop] - lo
            n[np.repeat(whole[start:stop], np.diff(edges[start:stop + 1]))] = 0
            b[rows], n[rows] = head_begin[start:stop], head_length[start:stop]
            ids = gather(pool, b, n)
            ends = np.concatenate([[0], np.cumsum(n)])
            yield start, ids, ends[edges[start:stop + 1] - lo]


def map_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df.mapInArrow`` for a function that returns rows of the same columns, which it knows by their places: whatever their
    names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(function, plain.schema).toDF(*df.columns)
