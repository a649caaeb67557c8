"""Media columns: content-addressed payloads in tar shards.

Each task writes its payloads into a tar shard of its own in the shared folder, one member for each distinct payload,
named by its digest. Rows carry digest, shard, offset and length, so a table with media columns stays small. Metadata columns
are filled by range reads of the members' headers alone; features read whole members, one task for each run of a shard.
If several tasks stored one payload, every row with its digest points to the same copy, and the others are garbage that a
compaction may leave out. A retried task writes a shard under a new name, and rows name only shards that were finished.

The stored form is an 8-bit greyscale PNG, 576 samples wide, which keeps the payload bit by bit.

Defined results: null and empty texts are payloads of 576 bytes 255; repeated rows share one payload; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import _common as C

WIDTH, FILLER = 576, 255
#: Bytes after which a task starts another shard, and payloads whose places it remembers; a payload that it forgot is stored again.
SHARD_BYTES, MOST_SEEN = 1 << 30, 1_000_000
#: The PNG signature, and the bytes of signature and first chunk.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILLER]) * (-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png() made."""
    width, height, _ = png_size(data)
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only lines without a filter are read")
    return lines[:, 1:].tobytes()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def store(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the payloads and gives the catalogue: key, digest, shard, offset, length. It is written by the caller, once."""
    source = docs.select(key, text)
    schema = T.StructType([source.schema[key], T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, at, seen = None, "", 0, {}
        for b in batches:
            buf, offsets = C.utf8(b.column(text))
            found = []
            for i in range(len(offsets) - 1):
                payload = payload_of(buf[offsets[i] : offsets[i + 1]].tobytes())
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    if out is not None and at > SHARD_BYTES:
                        out.write(bytes(1024))
                        out.close()
                        out = None
                    if out is None:
                        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.tar"
                        out, at = system.open_output_stream(f"{root}/{name}"), 0
                    data = encode_png(payload)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(data)
                    out.write(member.tobuf(tarfile.USTAR_FORMAT))
                    out.write(data + bytes(-len(data) % 512))
                    seen[digest] = (name, at + 512, len(data))
                    at += 512 + len(data) + -len(data) % 512
                found.append((digest, *seen[digest]))
            digests, shards, starts, lengths = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(digests, pa.binary()), pa.array(shards, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=schema.names)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return C.map_arrow(source, run, schema)


def _by_range(rows: DataFrame, folder: str, read, fields: list[T.StructField]) -> DataFrame:
    """rows (shard, offset, length) with the columns that read(file, offset, length) gives; each shard is opened once in a task."""
    schema = T.StructType([*rows.schema.fields, *fields])

    def run(batches):
        system, root = _open(folder)
        name, file = None, None
        for b in batches:
            got = []
            for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, system.open_input_file(f"{root}/{shard}")
                got.append(read(file, offset, length))
            cols = [pa.array([g[i] for g in got], a) for i, a in enumerate(_arrow(f.dataType) for f in fields)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)
        if file is not None:
            file.close()

    return C.map_arrow(rows, run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind.simpleString()]


def objects(catalogue: DataFrame) -> DataFrame:
    """One row for each digest, with one place of its payload, dealt out and sorted by place."""
    at = catalogue.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return at.select("digest", "at.shard", "at.offset", "at.length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def fill_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """rows with width, height and bits, from range reads of HEADER bytes each."""
    return _by_range(rows, folder, lambda f, offset, _: png_size(f.read_at(HEADER, offset)), [T.StructField(n, T.IntegerType()) for n in ("width", "height", "bits")])


def features(rows: DataFrame, folder: str) -> DataFrame:
    """rows with what is computed from the stored bytes."""

    def read(f, offset: int, length: int):
        data = f.read_at(length, offset)
        payload = decode_png(data)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        p = counts[counts > 0] / len(payload)
        text = f"mean={(counts @ np.arange(256)) / len(payload):.4f};distinct={len(p)};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.4f}"
        return len(payload.rstrip(bytes([FILLER]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), text

    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    return _by_range(rows, folder, read, [T.StructField(n, k) for n, k in kinds.items()])
