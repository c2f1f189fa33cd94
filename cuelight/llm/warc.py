"""WARC archives with a two-level capture index.

Tasks write records as gzip members into archive files of the shared folder. Captures are sorted by reversed-host URL key
into index shards; a shard is a file of compressed blocks of captures, with a sparse directory of its blocks (first key,
place) beside it. A look-up finds shards by their bounds, a block by binary search in the directory, captures by binary
search in the block, and reads just the ranges it needs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import plain
from .tables import stored

CAPTURES = "page_id long, key string, file string, offset long, length long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary")
NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of object names
BLOCK = 3000  # captures of a block
RUN, GAP = 4 << 20, 1 << 16  # bytes that are read at once, and of a gap that is read over


def url_key(url: str | None) -> str:
    """Sort key with the host's labels reversed: ``https://a.example.org:80/x?y`` is ``org,example,a:80)/x?y``."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else (url or "")
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, colon, port = rest[:cut].lower().partition(":")
    return ",".join(reversed(host.split("."))) + colon + port + ")" + rest[cut:]


def sha1_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def header_value(text: str) -> str:
    """A header line holds no control characters; they are percent-encoded."""
    return "".join(f"%{b:02X}" if b < 0x20 or b == 0x7F else chr(b) for b in text.encode()).encode("latin-1").decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload, but its digest, its length and what it refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_name(page_id, digest)),
             ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
             ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        lines.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    block = http + payload
    if refers_to is not None:
        block = http
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)),
                  ("X-Payload-Length", str(len(payload)))]
    lines.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def read_record(member: bytes) -> tuple:
    """``RECORDS`` of one gzip member. The digest of a response is computed from its payload and must agree with its
    header; a revisit's is its header's."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    held = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(held["Content-Length"])]
    page = int(held["X-Page-ID"]) if "X-Page-ID" in held else None
    digest = held["WARC-Payload-Digest"].removeprefix("sha1:")
    if held["WARC-Type"] == "revisit":
        return (page, held.get("WARC-Target-URI"), "revisit", int(held["X-Refers-To-Page-ID"]),
                int(held["X-Payload-Length"]), digest, None)
    payload = block.partition(b"\r\n\r\n")[2]
    if sha1_name(payload) != digest:
        raise ValueError(f"payload of page {page} does not match its digest")
    return page, held.get("WARC-Target-URI"), "response", None, len(payload), digest, payload


@dataclass(frozen=True)
class Archive:
    """A written archive: its captures, and its index shards ``(shard, first, last, file, directory)`` in key order,
    at most as many as the ``shards`` it was written with."""

    captures: DataFrame
    shards: DataFrame


def _files(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def _write_archives(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"  # a task that is tried again writes another file
        offset, out = 0, None
        try:
            for batch in batches:
                page, first, digest = (batch.column(i).to_pylist() for i in (0, 3, 4))
                url, html = batch.column(1), plain(batch.column(2))
                rows = []
                for i, p in enumerate(page):
                    if out is None:
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    link = url[i].as_py()
                    member = write_record(p, link, html[i].as_py().encode(), digest[i], first[i])
                    out.write(member)
                    rows.append((p, url_key(link), name, offset, len(member)))
                    offset += len(member)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["page_id", "key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return write


def _write_shard(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, directory, waiting, offset, out, last = f"{uuid.uuid4().hex}.cdx.gz", [], [], 0, None, ""

        def flush(rows: list[dict]) -> None:
            nonlocal offset, out
            out = out or files.open_output_stream(f"{root}/{name}", compression=None)
            block = gzip.compress("".join(json.dumps(r) + "\n" for r in rows).encode(), 6, mtime=0)
            directory.append((rows[0]["key"], offset, len(block)))
            out.write(block)
            offset += len(block)

        for batch in batches:
            waiting += batch.to_pylist()
            while len(waiting) >= BLOCK:
                flush(waiting[:BLOCK])
                last, waiting = waiting[BLOCK - 1]["key"], waiting[BLOCK:]
        if waiting:
            flush(waiting)
            last = waiting[-1]["key"]
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
            f.write("".join(json.dumps(d) + "\n" for d in directory).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([directory[0][0]]), pa.array([last]), pa.array([name]), pa.array([len(directory)], pa.int64())],
            names=["first", "last", "file", "blocks"])

    return write


def digests(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, html, digest)``, null html as an empty text; the digest is bare upper-case base32 SHA-1."""
    html = F.coalesce(F.col(html_column), F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # 40 hexadecimal digits are eight groups of 20 bits, each four letters
    groups = [F.conv(F.substring(F.sha1(html.cast("binary")), 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    digest = F.concat(*[F.substring(F.lit(letters), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
                        for n in groups for k in range(4)])
    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), html.alias("html"), digest.alias("digest"))


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, least_bytes: int = 0,
                   id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> Archive:
    """Write a record per row of ``pages`` and index them all.

    Of rows with equal payloads of ``least_bytes`` or more, that with the smallest id is the response and the others are
    revisits of it; rows that repeat that id are responses too, and so are all if no id is known. Null html is an empty
    payload, a null url has no target and the key ``)``. Rows with a null id of a known payload are revisits. Other
    columns are not read. An empty table writes nothing.

    Payload digests are grouped without the payloads; only digests that occur more than once are joined back, and the
    join splits a digest that very many pages share. The index has ``shards`` shards, or as many as the session shuffles
    into.
    """
    spark = pages.sparkSession
    hashed = digests(pages, id_column, url_column, html_column)
    groups = (hashed.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null"))
    groups = stored(groups.select("digest", "first"), "payloads")
    known = hashed.join(groups, "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"), "digest")
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    captures = stored(known.mapInArrow(_write_archives(folder), CAPTURES), "captures")
    ordered = captures.repartitionByRange(shards or _tasks(pages), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    found = stored(ordered.mapInArrow(_write_shard(folder), "first string, last string, file string, blocks long"), "shards")
    return Archive(captures, found)


def _directory(files, path: str) -> list[list]:
    with files.open_input_file(path) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def _range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def _batch(rows: list[tuple], extra: list | None = None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _captures(block: bytes) -> list[dict]:
    return [json.loads(x) for x in zlib.decompress(block, 31).splitlines()]


def find_captures(archive: Archive, folder: str, keys: DataFrame) -> DataFrame:
    """Rows ``(key, page_id, file, offset, length)``: the captures of ``keys(key)``, each key once.

    The bounds of the shards (a bounded number) go to the tasks, where a key is routed to its shards. Keys are dealt out in
    ranges of their order, so a task searches the directories of few shards and reads a block once for all the keys that it holds; the
    captures of a key are found in their block by binary search.
    """
    bounds = [tuple(r) for r in archive.shards.select("first", "last", "file").orderBy("first", "last").collect()]
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # equal keys may run over the edge of a shard, so shards that touch the key are all asked
            rows = [(shard, key) for key in batch.column(0).to_pylist() for shard in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], names=["shard", "key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        now, directory, starts, handle, held = None, [], [], None, (-1, [], [])
        try:
            for batch in batches:
                rows = []
                for shard, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard != now:
                        if handle:
                            handle.close()
                        now, name = shard, bounds[shard][2]
                        directory, handle = _directory(files, f"{root}/{name}.dir"), files.open_input_file(f"{root}/{name}")
                        starts, held = [d[0] for d in directory], (-1, [], [])
                    for b in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                        if held[0] != b:
                            captures = _captures(_range(handle, *directory[b][1:]))
                            held = b, captures, [c["key"] for c in captures]
                        rows += [(key, c["page_id"], c["file"], c["offset"], c["length"])
                                 for c in held[1][bisect_left(held[2], key):bisect_right(held[2], key)]]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["key", "page_id", "file", "offset", "length"])
        finally:
            if handle:
                handle.close()

    asked = keys.select("key").distinct().mapInArrow(route, "shard int, key string")
    ordered = asked.repartitionByRange(_tasks(keys), "shard", "key").sortWithinPartitions("shard", "key")
    return ordered.mapInArrow(find, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """``(key, …)`` with the columns of ``RECORDS`` for each of ``captures(key, file, offset, length)``. Captures are sorted by file and
    place; records that follow each other closely are read at once, up to ``RUN`` bytes."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        handle, opened, run = None, None, []  # run: captures that are read at once

        def records() -> pa.RecordBatch:
            first = run[0][2]
            raw = _range(handle, first, run[-1][2] + run[-1][3] - first)
            rows = [read_record(raw[c[2] - first:c[2] - first + c[3]]) for c in run]
            one = _batch(rows if keep_payload else [(*r[:-1], None) for r in rows])
            keys = pa.array([c[0] for c in run], pa.string())
            run.clear()
            return pa.RecordBatch.from_arrays([keys, *one.columns], names=["key", *one.schema.names])

        try:
            for batch in batches:
                for capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _, file, offset, length = capture
                    if run and (file != opened or offset - run[-1][2] - run[-1][3] > GAP or offset + length - run[0][2] > RUN):
                        yield records()
                    if file != opened:
                        if handle:
                            handle.close()
                        handle, opened = files.open_input_file(f"{root}/{file}"), file
                    run.append(capture)
            if run:
                yield records()
        finally:
            if handle:
                handle.close()

    rows = captures.select("key", "file", "offset", "length")
    ordered = rows.repartitionByRange(_tasks(captures), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, f"key string, {RECORDS}")


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def url_keys(urls: DataFrame, url_column: str = "url") -> DataFrame:
    """Rows ``(asked, key)`` for the distinct urls; a null url has the key ``)``."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["asked", "key"])

    return urls.select(F.col(url_column).cast("string").alias("asked")).distinct().mapInArrow(keyed, "asked string, key string")


def read_archives(archive: Archive, folder: str, urls: DataFrame, keep_payload: bool = True, url_column: str = "url") -> DataFrame:
    """The records of all captures of the keys of ``urls``, each once, with the columns of ``RECORDS``: keys are searched in
    the index, and records are read in runs. Urls of equal keys, null urls among them, are one key."""
    found = stored(find_captures(archive, folder, url_keys(urls, url_column)), "found")
    return read_records(found, folder, keep_payload).drop("key")


def look_up(archive: Archive, folder: str, urls: DataFrame, url_column: str = "url") -> DataFrame:
    """Records of the asked urls: ``(asked, …)`` with the columns of ``RECORDS``; a url without captures gives no row, a
    repeated url its records once, and a null url none."""
    asked = stored(url_keys(urls, url_column).filter("asked is not null"), "asked")
    found = stored(find_captures(archive, folder, asked), "found")
    return asked.join(read_records(found, folder), "key").drop("key")


def default_folder(spark: SparkSession) -> str:
    from cuelight.plans.session import scratch_path

    return scratch_path(spark, "warc")
