"""WARC archives: a writer with revisit records and a sequential reader, one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.lineage import checkpoint_dir, cut
from tonewheel.llm.heavy import attach

DATE = "2024-01-01T00:00:00Z"
ROLL = 128 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def shared_folder(spark, name: str) -> str:
    """A new folder below the cluster's shared one, which must be mounted on every machine."""
    root = checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def _record(row) -> Iterator[bytes]:
    """The gzip member of one page, in pieces."""
    payload = row.html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row.refers_to is not None
    body = [http] if revisit else [http, payload]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row.page_id or ''}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if row.url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(row.url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row.refers_to}>"]
    head.append(f"Content-Length: {sum(map(len, body))}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    for piece in ["\r\n".join(head).encode() + b"\r\n\r\n", *body, b"\r\n\r\n"]:
        yield squeeze.compress(piece)
    yield squeeze.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one record for each row of `pages` and returns the stored list of archives (path, records).

    Null html is an empty payload; a null page_id or url leaves its header empty or out. Of equal payloads the largest
    page_id is the response, the rest refer to it; rows repeating that page_id and payload are responses as well, and
    where no page_id is known all are. A task that is run again writes new files; only listed files are ever read.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload", F.sha1(F.encode("html", "UTF-8")))
    groups = cut(rows.groupBy("payload").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")))
    rows = attach(rows, groups, "payload", "n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", refers.cast("string").alias("refers_to"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, records = None, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if file is None:
                    file, records = open(os.path.join(folder, f"{uuid.uuid4().hex}.warc.gz"), "wb"), 0
                for piece in _record(row):
                    file.write(piece)
                records += 1
                if file.tell() >= ROLL:
                    file.close()
                    yield pd.DataFrame({"path": [file.name], "records": [records]})
                    file = None
        if file is not None:
            file.close()
            yield pd.DataFrame({"path": [file.name], "records": [records]})

    return cut(rows.mapInPandas(archive, "path string, records long"))


class Members:
    """The bytes of one gzip file, member by member, inflated a piece at a time."""

    def __init__(self, file):
        self.file, self.held, self.inflate, self.ready = file, b"", None, bytearray()

    def next(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        if self.inflate is not None and not self.inflate.eof:
            raise ValueError("a member was left before its end")
        self.held = self.held or self.file.read(CHUNK)
        self.inflate = zlib.decompressobj(31)
        return bool(self.held)

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        self.held = self.held or self.file.read(CHUNK)
        if not self.held:
            raise ValueError("an archive ends inside a record")
        self.ready += self.inflate.decompress(self.held, CHUNK)
        self.held = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def head(self) -> bytes:
        """Up to and with the first blank line."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record without the end of its headers")
        taken = bytes(self.ready[: end + 4])
        del self.ready[: end + 4]
        return taken

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece = bytes(self.ready[:n])
            del self.ready[: len(piece)]
            n -= len(piece)
            yield piece


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if line)}


def records(path: str, payloads: bool = False) -> Iterator[dict]:
    """Each record of one archive in turn; wrong framing or a wrong digest raises ValueError."""
    with open(path, "rb") as file:
        members = Members(file)
        while members.next():
            head = _headers(members.head())
            http_head = members.head()
            http = _headers(http_head)
            revisit = head["warc-type"] == "revisit"
            sha, n, kept = hashlib.sha1(), 0, []
            for piece in members.take(int(head["content-length"]) - len(http_head)):
                sha.update(piece)
                n += len(piece)
                if payloads:
                    kept.append(piece)
            end = b"".join(members.take(4))
            while not members.ready and members.more():
                pass
            if end != b"\r\n\r\n" or members.ready:
                raise ValueError(f"{path}: a record is longer than its Content-Length")
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if not revisit and (base64.b32encode(sha.digest()).decode() != digest or n != int(http["content-length"])):
                raise ValueError(f"{path}: a payload does not match its digest")
            page = head["warc-record-id"][len("<urn:page:"):-1]
            yield {
                "page_id": int(page) if page else None, "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
                "payload_bytes": int(http["content-length"]), "payload_digest": digest,
                "refers_to": int(head["warc-refers-to"][len("<urn:page:"):-1]) if revisit else None,
                "payload": None if revisit or not payloads else b"".join(kept),
            }


SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives listed in `path`, one archive at a time in a task; payloads only where asked for."""
    fields = [part.split()[0] for part in SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                held = []
                for record in records(path, payloads):
                    held.append(record)
                    if len(held) >= (16 if payloads else 1000):
                        yield _frame(held, fields)
                        held = []
                if held:
                    yield _frame(held, fields)

    paths = archives.select("path")
    return paths.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(scan, SCHEMA)


def _frame(held: list[dict], fields: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(held, columns=fields)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})
