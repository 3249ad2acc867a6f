"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id into runs of near equal bytes; the runs' bounds follow from the table alone (an exact
distributed prefix sum of payload bytes, no sample), and each run rolls to a new file when the compressed size passes the
target.  So the same table gives the same bytes, however it is partitioned and however large the cluster is.  Headers (record ids, lengths, digests, dates, targets) are made
anew from the record.  Of records with equal payloads of at least a given size the one with the largest page_id is the
response, the others are revisits that name it.  A file is written under a temporary name and renamed when complete;
the manifest, written last, lists the files that count with their sizes and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, mapped, new_dir, range_cuts, run_of, written
from .token_files import filesystem

ROLL_BYTES = 64 << 20
RUNS, RUN_BYTES = 64, 4 << 20  # a small table is cut into so many runs, of so many bytes at least; a large one into runs of four files
OVERHEAD = 512  # bytes of a record beside its payload, about
DATE = "2000-01-01T00:00:00Z"  # records carry no date of their own
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
LEVEL = 6


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{turn}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers: tuple[int, str] | None, turn: int) -> bytes:
    """One gzip member: a response, or a revisit that refers to (page_id, record id) and holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, turn)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers[1]}", f"X-Refers-To-Page-ID: {refers[0]}"]
    body = ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # zlib's own gzip header holds no time and no name
    return z.compress(body) + z.flush()


def run_bytes(whole: int, roll_bytes: int = ROLL_BYTES) -> int:
    """Payload bytes of a run for a table of ``whole`` bytes."""
    return min(4 * roll_bytes, max(RUN_BYTES, -(-whole // RUNS)))


def write_warc(pages: DataFrame, roll_bytes: int = ROLL_BYTES, least_bytes: int = 0, parts: int | None = None) -> DataFrame:
    """Writes all pages, returns the manifest: file, records, bytes, sha1.

    A null html is an empty payload; a null url leaves the target out; rows with a null page_id come first, in order of their
    payloads' digests, and revisit the response of an equal payload like others, but are responses where no row with an equal
    payload has an id, being nothing a revisit could name; of repeated rows (page and payload equal) the first is the
    response or refers like the rest, and all stand in one run; an empty table gives an empty
    manifest; other columns are ignored.  ``parts`` asks for a number of runs instead of run_bytes().
    """
    spark = pages.sparkSession
    base = new_dir(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = written(rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("size")), "warc-sizes")
    key = F.concat(id_key("page_id"), "sha")
    cuts = range_cuts(narrow.select(key.alias("key"), (F.col("size") + OVERHEAD).alias("weight")), lambda whole: -(-whole // parts) if parts else run_bytes(whole, roll_bytes))
    known = narrow.where(F.col("size") >= least_bytes).select("page_id", "sha")
    # only ids and digests move here; the largest page_id of each digest that occurs again
    again = known.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    notes = known.join(again, "sha").distinct()
    # notes travel to their page in the one exchange that sorts the pages, so no page is moved twice
    kind = dict(pages.dtypes)["page_id"]
    both = notes.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first").unionByName(
        rows.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast(kind).alias("first"))
    )
    both = both.withColumn("run", run_of(key, cuts)).repartitionById(len(cuts) + 1, F.col("run")).sortWithinPartitions("run", "page_id", "sha", "kind", "url")

    def run(batches):
        fs, folder = filesystem(base)
        out = part = None
        done, note, last, turn, rolled = [], None, None, 0, 0
        attempt = uuid.uuid4().hex[:8]

        def close():
            out.close()
            name = f"part-{part:05d}-{rolled:04d}-{attempt}.warc.gz"
            fs.move(temporary, f"{folder}/{name}")
            done.append((f"{base}/{name}", count, size, sha.hexdigest()))

        for b in batches:
            for page_id, sha_hex, kind, url, html, first, of in zip(*(b.column(c).to_pylist() for c in ("page_id", "sha", "kind", "url", "html", "first", "run"))):
                if of != part:
                    if out is not None:
                        close()
                    out, part, rolled = None, of, 0
                if kind == 0:
                    note = (page_id, sha_hex, first)
                    continue
                turn = turn + 1 if last == (page_id, sha_hex) else 0
                last = (page_id, sha_hex)
                digest = base64.b32encode(bytes.fromhex(sha_hex)).decode()
                refers = None
                if note and note[:2] == last and (note[2] != page_id or turn):
                    refers = (note[2], record_id(note[2], digest, 0))
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    temporary = f"{folder}/.{part:05d}-{rolled}-{attempt}"
                    out, count, size, sha = fs.open_output_stream(temporary, compression=None), 0, 0, hashlib.sha1()
                packed = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, turn)
                out.write(packed)
                sha.update(packed)
                count, size = count + 1, size + len(packed)
                if size >= roll_bytes:
                    close()
                    out, rolled = None, rolled + 1
        if out is not None:
            close()
        if done:
            yield dict(zip(("file", "records", "bytes", "sha1"), zip(*done)))

    return written(mapped(both, run, "file string, records long, bytes long, sha1 string"), "warc-manifest")


def members(file, chunk: int = 1 << 20):
    """Records of a .warc.gz stream, one at a time: memory holds one record."""
    z, data, parts = zlib.decompressobj(31), b"", []
    while True:
        if not data and not (data := file.read(chunk)):
            if parts:
                raise ValueError("a record breaks off at the end of the file")
            return
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parsed(raw: bytes) -> dict:
    """Headers and payload of a record; block digest and length are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(h["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or h["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"damaged record {h.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return h | {"payload": payload, "payload_bytes": length}


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Per record, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to (and url, html).

    Payload digests of responses are computed anew from what was read and must equal the header.  A page written with a null
    id comes back with one, a null html as the empty payload's digest, a null url as null; an empty manifest gives no rows.
    """

    def run(batches):
        cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html")
        for b in batches:
            for uri in b.column("file").to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    rows = []
                    held = 0
                    for raw in members(f):
                        h = parsed(raw)
                        digest, number = h["warc-payload-digest"].removeprefix("sha1:"), lambda k: int(h[k]) if k in h else None  # noqa: B023
                        if h["warc-type"] == "response" and (len(h["payload"]) != h["payload_bytes"] or digest32(h["payload"]) != digest):
                            raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                        html = h["payload"].decode("utf-8", "surrogatepass") if with_payload and h["warc-type"] == "response" else None
                        rows.append((number("x-page-id"), h["payload_bytes"], digest, h["warc-type"], number("x-refers-to-page-id"), h.get("warc-target-uri"), html))
                        held += len(raw)
                        if len(rows) == 5000 or held > 32 << 20:
                            yield dict(zip(cols, zip(*rows)))
                            rows, held = [], 0
                    if rows:
                        yield dict(zip(cols, zip(*rows)))

    form = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, html string" * with_payload
    n = max(1, spark.sparkContext.defaultParallelism)
    return mapped(manifest.select("file").repartition(n), run, form)
