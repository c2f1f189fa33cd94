"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .chunks import BATCH_BYTES, PUNCTUATION, byte_alphabet, plain, slices


class Merges:
    """A merge table of a byte-level vocabulary as sorted arrays."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.first = np.array([vocab[c] for c in byte_alphabet()])
        self.last = np.array([vocab[c + suffix] for c in byte_alphabet()])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or the number of merges, where there is none) and result of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], len(self.keys)), self.made[at]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word.

        All words are held as one ragged array. A round finds the lowest rank in each word that still has a mergeable
        pair and merges all pairs of that rank in it, left to right; a word without such a pair is finished.
        """
        out = np.array([len(w) for w in words], dtype=np.int64)
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.zeros(len(symbols), dtype=bool)
        last[np.cumsum(out[out > 0]) - 1] = True
        symbols = np.where(last, self.last[symbols], self.first[symbols])
        live = np.arange(len(words))
        word = np.repeat(live, out[live])
        none = len(self.keys)
        while len(symbols):
            rank, made = self.look_up(symbols[:-1], symbols[1:])
            rank = np.append(np.where(word[:-1] == word[1:], rank, none), none)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            merge = (rank == least) & (rank < none)
            # in a run of overlapping pairs every second one merges
            at = np.flatnonzero(merge)
            if len(at) > 1 and (np.diff(at) == 1).any():
                run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
                begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                at = at[(np.arange(len(at)) - begin[run]) % 2 == 0]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            keep &= least < none  # finished words leave
            out -= np.bincount(word[at], minlength=len(out))
            symbols, word = symbols[keep], word[keep]
        return out


class ChunkCounter:
    """Tokens of texts by a tokenizers file whose pre-tokens never hold a blank: a text's count is the sum over its
    chunks between blanks, so each distinct chunk of a batch is counted once."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(json.loads(definition)["model"])
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _pre_tokens(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))

    def _split(self, chunk: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a chunk and the number of special strings in it."""
        parts, found = [chunk], 0
        for s in sorted(self.special, key=len, reverse=True):
            cut = [p.split(s) for p in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return [bytes(map(self.byte_of.__getitem__, w)) for p in parts if p for w, _ in self._pre_tokens(p)], found

    def chunk_counts(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk. Most are letters with punctuation behind them; their pre-tokens are told without the
        library's pattern: the letters, lower-cased, and the punctuation."""
        words: dict[bytes, int] = {}
        owner, which = [], []
        total = np.zeros(len(chunks), dtype=np.int64)
        for i, c in enumerate(chunks):
            core = c.rstrip(PUNCTUATION)
            low = core.lower()
            # not so a final sigma, which lower() looks around for, and letters that lower() parts into marks
            if low.isalpha() and (core.isascii() or "Σ" not in core and unicodedata.is_normalized("NFC", core)):
                found = [low.encode()]
                if len(core) < len(c):
                    found.append(c[len(core):].encode())
            else:
                found, total[i] = self._split(c)
            for w in found:
                owner.append(i)
                which.append(words.setdefault(w, len(words)))
        if words:
            counts = self.merges.counts(list(words))
            total += np.bincount(owner, weights=counts[which], minlength=len(chunks)).astype(np.int64)
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        parts = pc.ascii_split_whitespace(texts)
        edges = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        each = self.chunk_counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ends[edges[1:]] - ends[edges[:-1]]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    One pass without a shuffle. A null text counts as an empty one: no bytes, no tokens. Special strings inside a text
    are one token each, as the library has it by default. Every input row gives one row; a null or repeated id stays
    as it is, other columns are not read, and an empty table gives an empty one. The vocabulary (a few MB) is sent to
    the tasks.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(shipped.value)
        for batch in batches:
            texts = plain(batch.column(1))
            found = [counter.counts(texts.slice(a, b - a)) for a, b in slices(texts, BATCH_BYTES)]
            tokens = np.concatenate([np.zeros(0, dtype=np.int64), *found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
