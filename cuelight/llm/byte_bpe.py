"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .chunks import ChunkEncoder, byte_alphabet, tokenizers_encoder


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def definition(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers definition that gives the ids of a rank vocabulary.

    Each byte is written as its character of the byte alphabet. Ranks join any two neighbours whose bytes together
    are a token, so every split of a token into two tokens is a merge, in the order of the ranks; a pre-token that is
    itself a token is taken as it is.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letter = byte_alphabet()
    written = {t: "".join(letter[b] for b in t) for t in ranks}
    merges = [
        (written[t[:i]], written[t[i:]])
        for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={written[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made.to_str()


def char_starts(ids: np.ndarray, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins in its text: in bytes, and in characters. A token that begins inside a character has
    that character's place."""
    sizes = np.array([len(table[i]) for i in ids.tolist()], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(table[i] for i in ids.tolist()), dtype=np.uint8)
    opens = np.cumsum((raw & 0xC0) != 0x80)
    return starts, np.maximum(opens[starts] - 1, 0) if len(raw) else starts


class Decoder:
    """Text of ids given piece by piece; bytes of a character that is split between tokens wait for the rest."""

    def __init__(self, table: list[bytes]):
        self._table = table
        self._text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self._text.decode(b"".join(self._table[i] for i in ids))

    def close(self) -> str:
        return self._text.decode(b"", final=True)


def _shipped(df: DataFrame, ranks_path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast(definition(read_ranks(ranks_path), pattern))


def _encoder(text: str) -> tuple[ChunkEncoder, list[bytes]]:
    from tokenizers import Tokenizer

    encode, table = tokenizers_encoder(Tokenizer.from_str(text))
    return ChunkEncoder(encode, table), table


def _source(df: DataFrame, id_column: str, value: str, name: str) -> tuple[DataFrame, str]:
    source = df.select(F.col(id_column).alias("doc_id"), F.col(value).alias(name))
    return source, source.schema["doc_id"].dataType.simpleString()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``(doc_id, ids, byte_starts, char_starts)``: a text's ids and where each begins.

    One pass without a shuffle; every input row gives one row. A null or empty text has no ids. Null and repeated
    document ids stay as they are; other columns are not read. An empty table gives an empty one.
    """
    shipped = _shipped(docs, ranks_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _encoder(shipped.value)
        for batch in batches:
            for first, ids, offsets in encoder.batches(batch.column(1)):
                places = [char_starts(ids[a:b], table) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                edge = pa.array(offsets, pa.int32())
                lists = [ids.astype(np.int32), *(np.concatenate([p[k] for p in places]).astype(np.int32) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(places)), *(pa.ListArray.from_arrays(edge, pa.array(x)) for x in lists)],
                    names=["doc_id", "ids", "byte_starts", "char_starts"])

    source, kind = _source(docs, id_column, text_column, "text")
    return source.mapInArrow(encode, f"doc_id {kind}, ids array<int>, byte_starts array<int>, char_starts array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Rows ``(doc_id, bytes, text)``: the exact bytes of the ids, and their text, where bytes that are no character
    (ids cut inside one) become U+FFFD. Null ids are an empty list; an unknown id is an error."""
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    shipped = encoded.sparkSession.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shipped.value
        for batch in batches:
            raw = [b"".join(of[i] for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])],
                names=["doc_id", "bytes", "text"])

    source, kind = _source(encoded, id_column, ids_column, "ids")
    return source.mapInArrow(decode, f"doc_id {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str,
               id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text and keep digests only: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, of the
    decimal ids joined by commas and of the bytes that the ids decode to. Rows as in ``encode_documents``."""
    shipped = _shipped(docs, ranks_path, pattern)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _encoder(shipped.value)
        tokens, numbers = pa.array(table, pa.binary()), pa.array([str(i) for i in range(len(table))])

        def joined(values: pa.Array, edge: pa.Array, by) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(edge, values), by)

        def sha256(values: pa.Array) -> list[str]:
            return [hashlib.sha256(v.as_buffer() or b"").hexdigest() for v in values]

        for batch in batches:
            for first, ids, offsets in encoder.batches(batch.column(1)):
                index, edge = pa.array(ids), pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(offsets) - 1), pa.array(np.diff(offsets), pa.int64()),
                    pa.array(sha256(joined(numbers.take(index), edge, ","))),
                    pa.array(sha256(joined(tokens.take(index), edge, b""))),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source, kind = _source(docs, id_column, text_column, "text")
    return source.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
