"""WARC archives of pages: written with an index, read back by coalesced byte ranges.

Method: index first. Every record is a gzip member of its own, and the index has file, offset, length, URL and digest of each.
Readers take index rows, however selected, deal them by file and part of a file, sort them by offset, and read neighbouring ranges in
one request, whatever else is in the archives.

Of records with equal payloads one is a response, the others revisit it. Digests decide that before anything is written: only ids,
URLs and digests are shuffled. A bitmap of fixed size marks the rows that aren't certainly responses; the few responses among them
travel by their key, and revisits need no payload, so payloads stay where they are read. Names of files are new for each attempt of a
task, and a file counts only if a finished task has put it into the index, so lost executors and repeated tasks leave no wrong record.
Archives are written through Arrow's file systems (file, hdfs, s3, gs, abfs) to the shared folder.

Results: null payloads count as empty. Of equal payloads the row with the largest id is the response (null smallest, then the larger
URL); of rows equal in id, URL and payload one is the response. Blanks and control characters of URLs are percent-encoded in the
archive. Null ids and URLs stay null. An empty table gives an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from . import common

#: A task begins another file beyond this size.
FILE_BYTES = 1 << 30
#: Ranges that stand closer than GAP are read at once, up to RUN bytes; readers get parts of a file of about PART bytes.
GAP, RUN, PART = 64 << 10, 8 << 20, 64 << 20
#: zlib's fastest level.
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, record_type string, id string, url string, payload_bytes long, payload_digest string, refers_to string"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of a text's bytes: 40 bits are eight digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), digits, _ALPHABET)


# --- records ---


def record_id(*parts: object) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, "\n".join(map(str, parts))).urn


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC 1.1 record; fields without value are left out."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, block


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _url(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _page_record(kind: str, page: dict) -> bytes:
    """page: id, url, digest, n_bytes, html of a response, and for a revisit top_id, top_url and copy (its number among equal rows)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['n_bytes']}\r\n\r\n".encode()
    own = record_id(page["id"], page["url"], page["digest"], *([page["copy"]] if kind == "revisit" else []))
    fields: list[tuple[str, object]] = [("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _url(page["url"])), ("WARC-Payload-Digest", f"sha1:{page['digest']}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page["id"]), ("X-Payload-Length", page["n_bytes"])]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(page['top_id'], page['top_url'], page['digest'])}>"), ("WARC-Refers-To-Target-URI", _url(page["top_url"])), ("X-Refers-To-Page-ID", page["top_id"])]
    return record(kind, fields, http + (page["html"].encode() if kind == "response" else b""))


class Writer:
    """Appends records to archives in a folder; a file is begun with the first record, and with the first beyond FILE_BYTES."""

    def __init__(self, folder: str) -> None:
        self.folder, self.out, self.name, self.offset = folder, None, "", 0

    def put(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.offset >= FILE_BYTES:
            self.close()
            fs, at = pa.fs.FileSystem.from_uri(self.folder)
            fs.create_dir(at, recursive=True)
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = fs.open_output_stream(f"{at}/{self.name}", compression=None)
            self.offset = 0
            self._append(member(record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: sievework\r\nformat: WARC File Format 1.1\r\n")))
        offset = self.offset
        self._append(member(raw))
        return f"{self.folder}/{self.name}", offset, self.offset - offset

    def _append(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


# --- writing ---

_PASSED = "sha string, h long, html string"


def _archived(rows: DataFrame, folder: str, kind: str, unsure=None, wanted=None) -> DataFrame:
    """Index rows of the records written, and of rows whose response is not certain those that may have one (with sha, h and html).

    unsure, wanted: bitmaps; without them every row is written.
    """
    context = rows.sparkSession.sparkContext
    held = None if unsure is None else (context.broadcast(unsure), context.broadcast(wanted))
    schema = f"{INDEX}, {_PASSED}"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seen = Writer(folder), set()
        try:
            for b in batches:
                out = []
                if held is not None:
                    hashes = b.column("h").to_numpy(zero_copy_only=False)
                    later, may = common.in_bitmap(held[0].value, hashes), common.in_bitmap(held[1].value, hashes)
                for i, page in enumerate(b.to_pylist()):
                    if held is not None and later[i]:
                        key = (page["h"], page["sha"], page["id"], page["url"])
                        if may[i] and key not in seen:  # of equal rows, one from each task is enough
                            if len(seen) >= 100_000:
                                seen.clear()
                            seen.add(key)
                            out.append([None, None, None, None, page["id"], page["url"], page["n_bytes"], page["digest"], None, page["sha"], page["h"], page["html"]])
                        continue
                    where = writer.put(_page_record(kind, page))
                    out.append([*where, kind, page["id"], page["url"], page["n_bytes"], page["digest"], page.get("top_id"), None, None, None])
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        finally:
            writer.close()

    return common.settled(rows.mapInArrow(common.tidy(run), schema), "archived", 100)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """The index of archives with one record for each row: file, offset, length, record_type, id, url, payload_bytes,
    payload_digest, refers_to (the response's id for revisits). Ids are decimal strings there.

    Payloads of less than `min_bytes` bytes are always responses.
    """
    spark = pages.sparkSession
    folder = folder or tables.new_path(spark, "warc")
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("own"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    rows = rows.select("own", F.col("own").cast("string").alias("id"), "url", "html", "sha", F.xxhash64("own", "url", "sha").alias("h"), base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    same = ["own", "id", "url", "sha", "h", "digest", "n_bytes"]
    keys = common.settled(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("m")), "keys")
    groups = keys.where(F.col("n_bytes") >= min_bytes).groupBy("sha").agg(F.sum("m").alias("n"), F.max(F.struct("own", "id", "url")).alias("top")).where("n > 1")
    groups = common.settled(groups, "groups")
    shared = common.attached(keys.where(F.col("n_bytes") >= min_bytes), groups, "sha")
    first = F.col("own").eqNullSafe(F.col("top.own")) & F.col("url").eqNullSafe(F.col("top.url"))
    shared = common.settled(shared.select(*same, "m", first.alias("first"), F.col("top.id").alias("top_id"), F.col("top.url").alias("top_url")), "shared")
    # rows that the first bitmap doesn't mark are responses; of those that it marks, the second marks all that may be
    unsure = common.bitmap(shared.where("m > 1 OR NOT first").select("h"), "h")
    lost = shared.where("NOT first").select(*same)
    marked = common.keep_marked(keys.select(*same), "h", unsure)
    wanted = marked.join(lost.select("sha", "h", F.col("own").alias("o"), F.col("url").alias("u")), (marked.sha == lost.sha) & (marked.h == lost.h) & F.col("own").eqNullSafe(F.col("o")) & marked.url.eqNullSafe(F.col("u")), "left_anti")
    wanted = common.settled(wanted.select("id", "url", "sha", "h"), "wanted")
    certain = _archived(rows.drop("own"), folder, "response", unsure, common.bitmap(wanted, "h"))
    # one row of each wanted key; copies of a row go before the shuffle
    left = certain.where("file IS NULL").groupBy("id", "url", "sha", "h").agg(F.first("html").alias("html"), F.first("payload_digest").alias("digest"), F.first("payload_bytes").alias("n_bytes"))
    w = wanted.select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("sha").alias("s"), F.col("h").alias("k"))
    left = left.join(w, (left.sha == F.col("s")) & (left.h == F.col("k")) & left.id.eqNullSafe(F.col("i")) & left.url.eqNullSafe(F.col("u")), "left_semi")
    chosen = _archived(left, folder, "response")
    # revisits have no payload; a row with very many copies is dealt over several tasks
    copies = F.col("m") - F.col("first").cast("int")
    again = shared.select("id", "url", "digest", "n_bytes", "h", "top_id", "top_url", copies.alias("m")).where("m > 0")
    again = again.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"), F.lit(1000).cast("long")))).repartition("h", "start")
    again = again.withColumn("copy", F.explode(F.sequence("start", F.least(F.col("start") + 999, F.col("m"))))).drop("m", "start")
    revisits = _archived(again, folder, "revisit")
    index = certain.where("file IS NOT NULL").unionByName(chosen).unionByName(revisits)
    return index.drop("sha", "h", "html")


# --- reading ---


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, stop, [(offset, length)]) of rows in order: neighbours of one file stand together."""
    out: list[tuple[str, int, int, list[tuple[int, int]]]] = []
    for file, offset, length in rows:
        if out and out[-1][0] == file and offset - out[-1][2] <= GAP and offset + length - out[-1][1] <= RUN:
            out[-1][3].append((offset, length))
            out[-1] = (file, out[-1][1], max(out[-1][2], offset + length), out[-1][3])
        else:
            out.append((file, offset, offset + length, [(offset, length)]))
    return out


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the given index rows: id, url, record_type, payload_bytes, payload_digest, refers_to, and payload (null for
    revisits) if asked for. A response whose payload doesn't have the digest of its header is an error."""
    dealt = index.select("file", "offset", "length").withColumn("part", F.floor(F.col("offset") / PART)).repartition("file", "part").sortWithinPartitions("file", "offset")
    schema = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload string" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for path, start, stop, members in ranges(rows):
                if path != name:
                    fs, at = pa.fs.FileSystem.from_uri(path)
                    name, file = path, fs.open_input_file(at)
                data, out = file.read_at(stop - start, start), []
                for offset, length in members:
                    fields, block = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                    body = block.partition(b"\r\n\r\n")[2]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    full = fields["WARC-Type"] == "response"
                    if full and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"the record at {offset} of {path} has another payload than its digest says")
                    row = [fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], len(body) if full else int(fields["X-Payload-Length"]), digest, fields.get("X-Refers-To-Page-ID")]
                    out.append([*row, *([body.decode() if full else None] if payload else [])])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(common.tidy(run), schema)
