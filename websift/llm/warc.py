"""WARC archives: write pages as monolithic gzip archives, normalise them, and read records by offset.

``write_archives`` writes one whole-file gzip stream per archive, as some crawlers do: no record can be read without
inflating all before it.  ``normalise`` inflates each such stream once, rewrites every record as a gzip member of its
own, turns records whose payload another record holds into revisits, and writes a sidecar index of offsets (one JSON
line per record).  ``read_records`` takes any record by its offset.

Tasks stream: an archive's text is never held whole, only one record at a time.  Files go to the shared folder through
``pyarrow.fs`` (local and network file systems); their names carry the task attempt, so a task that is run again
writes new files and only those of the attempt that ended well are named in the tables.

Of records with equal payloads (length and SHA-1) of at least ``min_bytes`` bytes, the one with the largest page_id is
the response and the others revisit it.  Defined results: a null html is an empty payload; of repeated page_ids the one
written last is the largest; null page_ids are the smallest and refer by null; a null url leaves the target out;
an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder, runs

#: Uncompressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
MONOLITHIC_LEVEL, MEMBER_LEVEL = 1, 6
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def _response(page_id, url, payload: bytes, name: str) -> list[tuple[str, str]]:
    out = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE)]
    if url is not None:
        out.append(("WARC-Target-URI", _clean(url)))
    return [*out, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
            ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives; one row per record: page_id, payload_bytes, payload_digest, archive, place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(folder)
        ctx = TaskContext.get()
        fs.create_dir(base, recursive=True)
        out = packer = None
        number = place = size = 0
        for b in batches:
            rows = []
            for pid, address, text in zip(b["page_id"], b["url"], b["html"]):
                pid = None if pd.isna(pid) else int(pid)
                payload = (text or "").encode("utf-8", "surrogatepass")
                if out is None:
                    archive = f"pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number:04d}.warc.gz"
                    out, packer, place, size = fs.open_output_stream(f"{base}/{archive}", compression=None), zlib.compressobj(MONOLITHIC_LEVEL, wbits=31), 0, 0
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                raw = record(_response(pid, address, payload, f"{archive}/{place}"), block)
                out.write(packer.compress(raw))
                rows.append((pid, len(payload), digest(payload), archive, place))
                place, size = place + 1, size + len(raw)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    out, number = None, number + 1
            made = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "archive", "place"])
            yield made.astype({"page_id": "Int64"})
        if out is not None:
            out.write(packer.flush())
            out.close()
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return cut(d.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, archive string, place long"), "records")


def inflate(stream) -> Iterator[bytes]:
    """Records of one whole-file gzip stream (or of several members), each with its headers and block."""
    buf, inflater = bytearray(), zlib.decompressobj(wbits=31)
    need = None  # length of the record at the front of buf, once its headers are known
    while data := stream.read(CHUNK):
        while data:
            buf += inflater.decompress(data)
            data = b""
            if inflater.eof:
                data, inflater = inflater.unused_data, zlib.decompressobj(wbits=31)
        at = 0
        while True:
            if need is None:
                end = buf.find(_END, at)
                if end < 0:
                    break
                need = end + 4 + int(parse_headers(bytes(buf[at:end]))["Content-Length"]) + len(_END) - at
            if len(buf) - at < need:
                break
            yield bytes(buf[at:at + need])
            at, need = at + need, None
        del buf[:at]
    if buf:
        raise ValueError("archive ends inside a record")


def decisions(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with refers (page_id) and refers_name (archive/place) for revisits, null for responses."""
    same = ["payload_digest", "payload_bytes"]
    best = records.where(F.col("payload_bytes") >= min_bytes).groupBy(*same).agg(F.max(F.struct("page_id", "archive", "place")).alias("_best"))
    best = cut(best, "best")  # written before the join: Spark splits a hot key's rows only where both sides are bare shuffles
    d = records.join(best, same, "left")
    revisit = F.col("_best").isNotNull() & ~((F.col("_best.archive") == F.col("archive")) & (F.col("_best.place") == F.col("place")))
    return d.select("archive", "place", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("_best.page_id").alias("refers"),
                    F.concat_ws("/", "_best.archive", F.col("_best.place").cast("string")).alias("refers_name"))


def normalise(source: str, decided: DataFrame, folder: str, archives: int) -> DataFrame:
    """Rewrite the monolithic archives of ``source``; one row per archive: archive, sidecar, records."""
    def rewrite(fs, base, here, there, g: pd.DataFrame) -> tuple[str, str, int]:
        name = g["archive"].iloc[0]
        out_name = name.replace("pages-", f"member-{TaskContext.get().taskAttemptId()}-", 1)
        offset = n = 0
        with here.open_input_file(f"{there}/{name}") as stream, fs.open_output_stream(f"{base}/{out_name}", compression=None) as out, \
                fs.open_output_stream(f"{base}/{out_name}.index", compression=None) as index:
            for raw, revisit, refers, refers_name in zip(inflate(stream), g["revisit"], g["refers"], g["refers_name"]):
                head, _, rest = raw.partition(_END)
                headers = parse_headers(head)
                if revisit:
                    http = rest[:rest.index(_END) + 4]
                    target = uuid.uuid5(uuid.NAMESPACE_URL, refers_name)
                    keep = {k: v for k, v in headers.items() if k != "Content-Length"} | {
                        "WARC-Type": "revisit", "WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{target}>",
                        "X-Refers-To-Page-Id": "" if pd.isna(refers) else str(int(refers))}
                    raw = record(list(keep.items()), http)
                packer = zlib.compressobj(MEMBER_LEVEL, wbits=31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                index.write(json.dumps({"offset": offset, "length": len(member), "id": headers["WARC-Record-ID"],
                                        "type": "revisit" if revisit else "response", "page_id": headers["X-Page-Id"]}).encode() + b"\n")
                offset, n = offset + len(member), n + 1
        if n != len(g):
            raise ValueError(f"{name} holds {n} records, {len(g)} were written")
        return out_name, out_name + ".index", n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(folder)
        here, there = _file_system(source)
        fs.create_dir(base, recursive=True)
        for g in runs(batches, ["archive"]):
            yield pd.DataFrame([rewrite(fs, base, here, there, g)], columns=["archive", "sidecar", "records"])
    dealt = decided.repartition(max(1, archives), "archive").sortWithinPartitions("archive", "place")
    return cut(dealt.mapInPandas(run, "archive string, sidecar string, records long"), "archives")


def read_records(archives: DataFrame, folder: str, count: int) -> DataFrame:
    """Read every record of the normalised archives through the sidecar index, one member at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(folder)
        for b in batches:
            for name, sidecar in zip(b["archive"], b["sidecar"]):
                rows = []
                with fs.open_input_stream(f"{base}/{sidecar}", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(f"{base}/{name}") as f:
                    for e in index:
                        f.seek(e["offset"])
                        head, _, block = zlib.decompress(f.read(e["length"]), wbits=31).partition(_END)
                        h = parse_headers(head)
                        payload = block[block.index(_END) + 4:-len(_END)]
                        page = int(h["X-Page-Id"]) if h["X-Page-Id"].strip() else None
                        if h["WARC-Type"] == "response":
                            rows.append((page, len(payload), digest(payload), "response", None))
                        else:
                            refers = h["X-Refers-To-Page-Id"].strip()
                            rows.append((page, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit",
                                         int(refers) if refers else None))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
    return archives.repartition(max(1, count)).mapInPandas(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Write, normalise and read back all pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    whole, members = new_folder(spark, "warc-whole"), new_folder(spark, "warc-members")
    records = write_archives(pages, whole, **columns)
    count = records.select("archive").distinct().count()
    archives = normalise(whole, decisions(records, min_bytes), members, count)
    return read_records(archives, members, count)
