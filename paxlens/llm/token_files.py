"""Token files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file (``part-00042.tok``) holds, in ascending doc_id order,

    one frame per document (a long one takes several): its ids, little-endian, 2 or 4 bytes each
    a skippable frame (magic 0x184D2A5D): the document index, see ``INDEX``
    a skippable frame (magic 0x184D2A5E): the seek table of the public zstd seekable format - for each frame its
    compressed size, size, and the low 32 bits of XXH64 of its content - with the 9-byte footer at the file's end

so any zstd tool unpacks the whole file, and a reader of one document fetches the tail once, then that document's
frames only.  Files come from a range sort by doc_id, whose bounds follow from the table alone and make files of near equal
text bytes; each is written under a temporary name by its task and renamed.
A manifest (a table of one row per file) says which files count, so a task that runs twice leaves nothing behind
that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_key, mapped, new_dir, range_cuts, run_of, written
from .tokens import encoder

FRAME_IDS = 1 << 20  # ids of a frame; longer documents take several
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("frames", "<u4"), ("start", "<u8"), ("n_tokens", "<u8")])
LEVEL = 3
TARGET_BYTES = 96 << 20  # text bytes of a file aimed at
FILES, FILE_BYTES = 64, 8 << 20  # a small table is cut into so many files, of so many text bytes at least
HEAD_BYTES = 24  # of a text, that order rows of one id when files are cut
PART_ROWS = 20000  # documents read by one task


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder: whatever store the cluster shares."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes documents' ids to one file object; close() adds the index and the seek table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table, self.docs, self.bytes, self.tokens = [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, first = len(ids) // self.width, len(self.table)
        for k in range(0, max(len(ids), 1), FRAME_IDS * self.width):
            raw = ids[k : k + FRAME_IDS * self.width]
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(packed)
        self.docs.append((doc_id or 0, doc_id is not None, first, len(self.table) - first, self.tokens, n))
        self.tokens += n

    def close(self) -> None:
        index = zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<II", self.width, len(self.docs)) + np.array(self.docs, INDEX).tobytes())
        seek = b"".join(struct.pack("<III", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        for magic, body in ((INDEX_MAGIC, index + struct.pack("<I", len(index))), (SEEK_MAGIC, seek)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)


class FrameReader:
    """Random access to one file: the tail is read once, then only the frames asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        begin = size - 9 - 12 * n - 8
        table = np.frombuffer(self.at(begin + 8, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes, self.sums = table[:, 1], table[:, 2]
        (length,) = struct.unpack("<I", self.at(begin - 4, 4))
        body = zstandard.ZstdDecompressor().decompress(self.at(begin - 4 - length, length))
        self.width, docs = struct.unpack("<II", body[:8])
        self.docs = np.frombuffer(body, INDEX, docs, 8)
        self.unpack = zstandard.ZstdDecompressor()

    def at(self, start: int, n: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(n))

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frames are read and unpacked, each against its checksum."""
        first, count = int(self.docs["frame"][k]), int(self.docs["frames"][k])
        raw = self.at(self.starts[first], self.starts[first + count] - self.starts[first])
        out = []
        for f in range(first, first + count):
            part = self.unpack.decompress(raw[self.starts[f] - self.starts[first] : self.starts[f + 1] - self.starts[first]], int(self.sizes[f]))
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.sums[f]:
                raise ValueError(f"checksum of frame {f} differs")
            out.append(part)
        return np.frombuffer(b"".join(out), f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encodes whole texts, writes the files, returns the manifest: file, docs, tokens, bytes, start, all by file order.

    doc_id is a long.  Null texts count as empty; null doc_ids come first; repeated ids stand in order of their texts, and
    where they are very many their run is cut between texts that differ in the first ``HEAD_BYTES`` bytes; an empty table
    gives an empty manifest; other columns are ignored.  ``files`` asks for a number of files.
    """
    spark = docs.sparkSession
    base = new_dir(spark, "tokens")
    key = F.concat(id_key("doc_id"), F.hex(F.substring(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 1, HEAD_BYTES)))
    narrow = written(docs.select(key.alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("weight")), "tokens-sizes")
    cuts = range_cuts(narrow, lambda whole: -(-whole // files) if files else min(TARGET_BYTES, max(FILE_BYTES, -(-whole // FILES))))
    rows = docs.select("doc_id", "text", run_of(key, cuts).alias("run"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("run")).sortWithinPartitions("run", "doc_id", "text")

    def run(batches):
        fs, folder = filesystem(base)
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        out = writer = part = None

        def close():
            writer.close()
            out.close()
            name = f"part-{part:05d}-{uuid.uuid4().hex[:8]}.tok"
            fs.move(temporary, f"{folder}/{name}")
            return {"part": [part], "file": [f"{base}/{name}"], "docs": [len(writer.docs)], "tokens": [writer.tokens], "bytes": [writer.bytes]}

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part_ids, texts, runs = (b.column(c).slice(k, 256).to_pylist() for c in ("doc_id", "text", "run"))
                for i, tokens, of in zip(part_ids, enc.encode(texts), runs):
                    if of != part:
                        if writer:
                            yield close()
                        fs.create_dir(folder, recursive=True)
                        part, temporary = of, f"{folder}/.{of:05d}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(temporary)
                        writer = FrameWriter(out, enc.dtype.itemsize)
                    writer.add(i, tokens + end)
        if writer:
            yield close()

    manifest = written(mapped(rows, run, "part int, file string, docs long, tokens long, bytes long"), "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``doc_ids`` asks for some only; no frame of another document is unpacked then.  Documents written with a null id come back
    with one, null and empty texts as the end id alone, repeated rows as often as written; an empty manifest gives no rows.
    """
    pieces = manifest.select("file", "start", F.explode(F.sequence(F.lit(0), F.col("docs") - 1, F.lit(PART_ROWS))).alias("first"))
    wanted = None if doc_ids is None else np.unique(np.array(doc_ids, np.int64))

    def run(batches):
        for b in batches:
            for file, start, first in zip(*(b.column(c).to_pylist() for c in ("file", "start", "first"))):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    reader = FrameReader(f)
                    at = np.arange(first, min(first + PART_ROWS, len(reader.docs)))
                    if wanted is not None:
                        at = at[np.isin(reader.docs["doc_id"][at], wanted) & (reader.docs["known"][at] == 1)]
                    for k in range(0, len(at), 1000):
                        some = at[k : k + 1000]
                        ids = [reader.ids(i) for i in some]
                        d = reader.docs[some]
                        known = pa.array(d["doc_id"], pa.int64(), mask=d["known"] == 0)
                        out = {"doc_id": known, "start": start + d["start"].astype(np.int64), "n_tokens": d["n_tokens"].astype(np.int64), "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                        yield out | {"ids": [x.astype(np.int64) for x in ids]}

    form = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = max(1, spark.sparkContext.defaultParallelism)
    return mapped(pieces.repartition(n), run, form)
