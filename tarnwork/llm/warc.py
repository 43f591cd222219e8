"""WARC/1.1 archives, compressed record by record with a Zstandard dictionary.

Each archive is one file: a skippable frame with a dictionary trained on records of this archive, then one frame per
record, a warcinfo record first. Every frame can be read alone, given the dictionary. A response holds an HTTP block with the
payload; records whose payload another record has already are revisits that refer to that record's id and hold the head of the
block only. Record ids are derived from a page's id and its payload's digest, so that a task that runs again writes the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_be_in, open_at, partitions, scratch, text_of, written

#: The skippable frame that holds a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on records spread evenly over the first HELD ones of its archive (or the first HELD_BYTES), so many
#: of so many bytes at most.
HELD, HELD_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 4_000, 16_000_000, 400, 8_192, 32_768, 3
HOT = 1000
#: The name space of record ids.
IDS = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")


def record(head: dict, payload: bytes) -> bytes:
    """One WARC record, uncompressed; header values must not hold line ends."""
    block = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{block}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def trained(samples: list[bytes]):
    """A dictionary of the samples; None where they are too few or too small to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, steps=1)
    except zstandard.ZstdError:
        return None


def record_id(page, digest_: str) -> str:
    """The id of a page's record; rows that repeat a page and its payload share it."""
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page}:{digest_}')}>"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def info(name: str, date: str) -> bytes:
    """The warcinfo record of an archive."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(IDS, name)}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
    return record(head, b"software: tarnwork\r\nformat: WARC File Format 1.1\r\n")


class Writer:
    """Writes records to a file; the first ones are held back to train the dictionary."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.packer, self.n = out, [], 0, None, 0

    def add(self, raw: bytes):
        self.n += 1
        if self.packer is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if len(self.waiting) >= HELD or self.held >= HELD_BYTES:
                self.start()
        else:
            self.out.write(self.packer.compress(raw))

    def start(self):
        import zstandard

        step = -(-len(self.waiting) // SAMPLE_RECORDS) or 1
        book = trained([r[:SAMPLE_BYTES] for r in self.waiting[::step]])
        if book:
            data = book.as_bytes()
            self.out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=True)
        for raw in self.waiting:
            self.out.write(self.packer.compress(raw))
        self.waiting = []

    def close(self):
        if self.packer is None:
            self.start()
        self.out.close()


def read_records(src):
    """The records of an archive, one after the other; holds one buffer and one record."""
    import zstandard

    head, book, held = src.read(8), None, b""
    if len(head) == 8 and int.from_bytes(head[:4], "little") == DICTIONARY_FRAME:
        book = zstandard.ZstdCompressionDict(src.read(int.from_bytes(head[4:], "little")))
    else:
        held = head
    reader = zstandard.ZstdDecompressor(dict_data=book)
    while True:
        if not held:
            held = src.read(1 << 20)
            if not held:
                return
        one, parts = reader.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else src.read(1 << 20)
            if not one.eof and not held:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _revisits(rows: DataFrame, least: int) -> DataFrame:
    """of_page, of_sha, refers_to: the pages whose payload (of `least` bytes) a smaller page_id has already."""
    keys = written(rows.select("page_id", "sha", F.octet_length("payload").alias("n")).where(F.col("n") >= least), "warc-keys")
    groups = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null")
    groups = written(groups.withColumnRenamed("sha", "of_sha"), "warc-copies")
    bar = keys.count() / HOT
    later = (F.col("sha") == F.col("of_sha")) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    # groups of more than 1/HOT of all rows are fewer than HOT: only they are broadcast
    parts = [keys.join(g, later).select(F.col("page_id").alias("of_page"), "of_sha", "refers_to") for g in (F.broadcast(groups.where(F.col("copies") > bar)), groups.where(F.col("copies") <= bar))]
    return parts[0].unionByName(parts[1]).distinct()


def write_warc(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row; returns the manifest: path, records, one row per archive.

    The payload is the body in UTF-8 (null: empty). Of the records with equal payloads of at least `least` bytes the one with
    the smallest id is the response and the others are revisits; shorter ones are all responses. A null id is larger than all
    others; where it is the only one, and for rows that repeat the smallest id, all are responses. A null url leaves
    out the target URI. An empty table gives no archive; a payload of any length is one record, held whole. Other columns are
    ignored. A task that runs twice leaves a second file; only those of the manifest count.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(body_col).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    revisits = written(_revisits(rows, least), "warc-revisits")
    # only pages that may be revisits meet their flag; the payloads of the others are not shuffled
    sure, doubtful = may_be_in(rows, F.col("page_id"), revisits, F.col("of_page"))
    mine = F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha") == F.col("of_sha"))
    told = doubtful.join(revisits, mine, "left").select("page_id", "url", "payload", F.col("of_sha").isNotNull().alias("revisit"), "refers_to")
    told = sure.select("page_id", "url", "payload", F.lit(False).alias("revisit"), F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to")).unionByName(told)

    def run(batches):
        import pyarrow as pa

        name, writer = f"{uuid.uuid4().hex}.warc.zst", None
        path = f"{folder}/{name}"
        for b in batches:
            for page, url, payload, revisit, to in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    writer = Writer(open_at(path, "wb"))
                    writer.add(info(name, date))
                clean, said = None if url is None else url.translate({10: "%0A", 13: "%0D"}), digest(payload)
                head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page, said), "WARC-Date": date}
                head |= {"WARC-Target-URI": clean} if clean is not None else {}
                head |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{said}", "X-Page-Id": "" if page is None else page}
                if revisit:
                    head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(to, said), "X-Refers-To-Page-Id": "" if to is None else to}
                writer.add(record(head, http_head(len(payload)) + (b"" if revisit else payload)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [writer.n]})

    spark.range(0).write.parquet(f"{folder}/empty")  # makes the folder wherever it is
    return written(told.mapInArrow(run, "path string, records long"), "warc-manifest")


def body_of(block: bytes) -> tuple[int, bytes]:
    """(the length that the HTTP head says, what follows the head)."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    return int(fields[b"Content-Length"]), body


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest: page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload.

    payload_bytes and payload_digest are of the full payload; a response's are computed from what is read and must agree with
    its header. payload is null for revisits.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda s: int(s) if s else None
        for b in batches:
            for path, n in zip(*(c.to_pylist() for c in b.columns)):
                with open_at(path, "rb") as src:
                    rows, size, seen = [], 0, 0
                    for raw in read_records(src):
                        head, block = parsed(raw)
                        seen += 1
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        length, payload = body_of(block)
                        want, revisit, page, to = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit", number(head["X-Page-Id"]), number(head.get("X-Refers-To-Page-Id"))
                        if not revisit and (digest(payload) != want or len(payload) != length):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        if head["WARC-Record-ID"] != record_id(page, want) or revisit and head["WARC-Refers-To"] != record_id(to, want):
                            raise ValueError(f"{path}: a record has another's id")
                        rows.append((page, head["WARC-Type"], head.get("WARC-Target-URI"), length, want, to, None if revisit else payload))
                        size += len(payload)
                        if size > 16_000_000 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                            rows, size = [], 0
                    if seen != n:
                        raise ValueError(f"{path}: {seen} records, {n} were written")
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    out = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    spark = manifest.sparkSession
    files = manifest.count()
    return manifest.repartition(max(1, min(files, 4 * partitions(spark)))).mapInArrow(run, out)


def archive_folder(spark) -> str:
    return scratch(spark, "warc")
