"""WARC archives: writing, normalising a monolithic gzip stream, and reading by a sidecar index.

Each partition of pages becomes archives that are one gzip stream as a whole. The normaliser inflates such a stream
once, rewrites every record as a gzip member of its own, and writes a sidecar index of offsets; the reader takes
records by their offsets. A response's block is an HTTP head and the payload, and a warcinfo record begins each archive. Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id
is a response and the others are revisits without a payload.

Files are reached through pyarrow's file systems at the shared folder, by executors, in names of their own for each
attempt: only archives that a finished task reported are read.

Defined cases: page ids are integers, or become null; a null html is an empty payload; a null url has no target header; repeated page_ids with equal payloads
are all responses if they are the largest, each a record of its own; null ids count as the smallest; empty tables give no archives.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, HOT, bytes_of, collapsed, dealt_join, drop, expanded, row_key, scratch, written

MIN_REVISIT = 1000
#: Inflated bytes after which a partition starts another archive.
ROLL = 256 << 20
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_id(page_id, digest: str, row: str) -> str:
    """A record's name: of the page, its payload, and of its url and number among equal rows."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{row}')}>"


def _target(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&()*+,;=%~")


def record(page_id, row: str, url, payload: bytes, digest: str, size: int, kind: str, refers, refers_row) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers, digest, refers_row)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP.format(size).encode() + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The first record of an archive."""
    body = "software: plumbline\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict, bytes, bytes]]:
    """Headers, block and raw bytes of each record in inflated chunks; holds one record and one chunk at most."""
    buf = bytearray()

    def need(test) -> bool:
        while not test():
            chunk = next(stream, None)
            if chunk is None:
                return False
            buf.extend(chunk)
        return True

    while need(lambda: b"\r\n\r\n" in buf):
        end = buf.index(b"\r\n\r\n") + 4
        lines = bytes(buf[:end]).decode().split("\r\n")
        head = {k: v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)} | {x[:-1]: "" for x in lines[1:] if x.endswith(":")}
        total = end + int(head["Content-Length"]) + 4
        if not need(lambda: len(buf) >= total):
            raise ValueError("an archive ends inside a record")
        raw = bytes(buf[:total])
        del buf[:total]
        yield head, raw[end:-4], raw
    if bytes(buf).strip():
        raise ValueError("an archive ends inside a record's head")


def inflate(file) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in chunks."""
    z = zlib.decompressobj(31)
    while data := file.read(CHUNK):
        while data:
            while out := z.decompress(data, CHUNK):
                yield out
                data = z.unconsumed_tail
            if not z.eof:
                break
            data, z = z.unused_data, zlib.decompressobj(31)


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, row, url, payload, digest, size, kind, refers, refers_row for each page.

    The largest page_id of each repeated payload is found by a pre-aggregated grouping. If the repeated payloads' table
    fits a broadcast, no payload is shuffled; else pages of one payload are dealt over tasks.
    """
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    p = expanded(collapsed(p, row_key(p), "equal", "times").drop("equal"), "times", "number").drop("times")
    of_url = F.xxhash64(F.coalesce("url", F.lit("")))
    p = p.withColumns({"of_url": of_url, "row": F.concat_ws("/", of_url, "number"), "digest": F.sha1("payload"), "size": F.length("payload").cast("bigint")})
    key = p.where(F.col("size") >= MIN_REVISIT).select("page_id", "of_url", "digest")
    top = key.groupBy("digest").agg(F.max(F.struct("page_id", "of_url")).alias("top"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    top = written(top.select("digest", "rows", F.col("top.page_id").alias("top"), F.concat(F.col("top.of_url").cast("string"), F.lit("/0")).alias("top_row")), "repeated")
    if bytes_of(top) <= BROADCAST_BYTES:
        p = p.join(F.broadcast(top.drop("rows")), "digest", "left")
    else:
        large = p.where(F.col("size") >= MIN_REVISIT)
        all_ = written(key.select("digest").distinct().join(top.drop("rows"), "digest", "left"), "payloads")
        hot = written(top.where(F.col("rows") > HOT).select("digest", "rows"), "hot")
        nothing = {"top": F.lit(None).cast("bigint"), "top_row": F.lit(None).cast("string")}
        p = dealt_join(large, all_, "digest", "row", hot).unionByName(p.where(F.col("size") < MIN_REVISIT).withColumns(nothing))
    revisit = F.coalesce((F.col("size") >= MIN_REVISIT) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    refers = [F.when(revisit, F.col(a)).alias(b) for a, b in (("top", "refers"), ("top_row", "refers_row"))]
    return p.select("page_id", "row", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), *refers)


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Writes monolithic archives below folder; path and records of each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out = z = None
        size = n = 0
        path = ""

        def close():
            out.write(z.flush())
            out.close()
            return pd.DataFrame({"path": [path], "records": [n]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    path, z, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(path, compression=None)  # compressed here already
                    out.write(z.compress(warcinfo(path.rsplit("/", 1)[1])))
                ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers)]
                raw = record(ids[0], r.row, r.url, bytes(r.payload), r.digest, r.size, r.kind, ids[1], r.refers_row)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    decided = decided.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers")})  # pandas would make floats of nullable longs
    return decided.mapInPandas(write, "path string, records bigint")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member for every record and a sidecar of offsets; path, index and records of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for source in pdf["path"]:
                name, at, n = f"{base}/{uuid.uuid4().hex}", 0, 0
                with fs.open_input_stream(source, compression=None) as file, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as idx:
                    for head, _, raw in records(inflate(file)):
                        gz = member(raw)
                        out.write(gz)
                        idx.write(json.dumps([head["WARC-Record-ID"], at, len(gz)]).encode() + b"\n")
                        at, n = at + len(gz), n + 1
                yield pd.DataFrame({"path": [f"{name}.warc.gz"], "index": [f"{name}.idx"], "records": [n]})

    return archives.mapInPandas(run, "path string, index string, records bigint")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record, taken by its offset in the sidecar; payloads that are there are held against their digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _fs(folder)
        for pdf in batches:
            for path, index in zip(pdf["path"], pdf["index"], strict=True):
                rows = []
                with fs.open_input_stream(index, compression=None) as idx, fs.open_input_file(path) as file:
                    for line in io.BufferedReader(idx):
                        _, at, length = json.loads(line)
                        file.seek(at)
                        head, block, _ = next(records(iter([zlib.decompress(file.read(length), 31)])))
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        block = block[block.index(b"\r\n\r\n") + 4 :]
                        if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError(f"a record in {path} has another payload than its digest says")
                        rows.append((int(head["X-Page-Id"]) if head.get("X-Page-Id") else None, int(head["X-Payload-Length"]), digest, kind, int(head["X-Refers-To-Page"]) if kind == "revisit" else None, len(block)))
                        if len(rows) >= 10_000:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    return archives.mapInPandas(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, stored_bytes bigint")


def _frame(rows: list) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes"])
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, keep: str | None = None) -> DataFrame:
    """Writes, normalises and reads back; the archives go afterwards unless `keep` names a folder for them."""
    spark = pages.sparkSession
    mono, final = scratch(spark, "warc-mono"), keep or scratch(spark, "warc")
    archives = written(write_archives(decide(pages), mono), "warc-list")  # records: without the warcinfo of each
    done = written(normalise(archives.repartition(max(1, archives.count())), final), "warc-done")
    drop(spark, mono)
    out = written(read_archives(done.repartition(max(1, done.count())), final), "warc-read")
    if not keep:
        drop(spark, final)
    return out


def oracle_sql() -> str:
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> top THEN top END AS refers_to FROM q"""
