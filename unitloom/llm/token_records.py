"""Token ids as length-delimited binary records.

A record file holds one record after another:

    length of the body   u64
    masked checksum of those eight bytes   u32
    body
    masked checksum of the body   u32

All integers are little-endian. A checksum is CRC-32, masked: rotated right by
15 bits, plus 0xa282ead8, so that checksums of data which holds checksums stay
sound. A body is the document's id (i64), a byte (1: the id is null), a byte (bytes for each
token id, 2 or 4) and the token ids. Beside each record file lies an index file of
(offset u64, length of the body u64) for reads in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, range_block, range_bounds, shared_path, stored
from .token_pieces import encoder

MASK = 0xA282EAD8
_HEAD, _CRC, _BODY, _AT = "<Q", "<I", "<qBB", "<QQ"
_BODY_BYTES, _AT_BYTES = 10, 16
MANIFEST = "block int, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    head = struct.pack(_HEAD, len(body))
    return b"".join((head, struct.pack(_CRC, masked(head)), body, struct.pack(_CRC, masked(body))))


def read_frame(stream) -> bytes | None:
    """The next record's body, None at the end. A record that was cut short or changed raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack(_CRC, head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    n = struct.unpack(_HEAD, head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack(_CRC, body[n:])[0] != masked(body[:n]):
        raise ValueError("a record's body is damaged")
    return body[:n]


def write_records(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending id order, file after file, and returns the manifest: block, path, records, tokens, bytes.

    Ids are dealt into ranges, a file and a task each; a hot id stays one range. A
    task writes under a name of its own and renames at the end, so that a task run twice leaves one file.
    """
    n = n_parts(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("block", range_block("id", range_bounds(d, "id", n)))
    d = d.repartitionById(n, F.col("block")).sortWithinPartitions("block", F.col("id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        enc = encoder(tokenizer_path)
        at, top = fs.FileSystem.from_uri(out_dir)
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        block, out, name = None, None, ""
        done, records, tokens, size, index = [], 0, 0, 0, []

        def close() -> None:
            out.close()
            with at.open_output_stream(f"{name}.idx.part") as f:
                f.write(b"".join(index))
            final = f"{top}/part-{block:06d}"
            at.move(f"{name}.idx.part", f"{final}.idx")
            at.move(f"{name}.part", f"{final}.rec")
            done.append((block, f"part-{block:06d}", records, tokens, size))

        for b in batches:
            for doc, text, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block:
                    if out:
                        close()
                    block, name = k, f"{top}/part-{k:06d}-{os.getpid()}-{uuid.uuid4().hex}"
                    out, records, tokens, size, index = at.open_output_stream(f"{name}.part", buffer_size=1 << 20), 0, 0, 0, []
                ids = enc.packed(text or "") + end
                record = frame(struct.pack(_BODY, doc or 0, doc is None, width) + ids)
                index.append(struct.pack(_AT, size, len(record) - 16))
                out.write(record)
                records, tokens, size = records + 1, tokens + len(ids) // width, size + len(record)
        if out:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "path", "records", "tokens", "bytes"), x, strict=True)) for x in done], pa.schema([("block", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    fs_, top_ = fs.FileSystem.from_uri(out_dir)
    fs_.create_dir(top_, recursive=True)
    return stored(d.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame, out_dir: str) -> DataFrame:
    """From the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as u32). Each file is a task."""
    # one row for each file: what the files before it hold
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    n = max(1, n_parts(manifest.sparkSession))
    files = files.repartitionById(n, F.pmod("block", F.lit(n)).cast("int")).select("path", "before", "records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for path, before, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                with at.open_input_stream(f"{top}/{path}.rec", buffer_size=1 << 20) as f:
                    while (body := read_frame(f)) is not None:
                        doc, null, width = struct.unpack_from(_BODY, body)
                        ids = np.frombuffer(body, f"<u{width}", offset=_BODY_BYTES).astype("<u4")
                        rows.append((None if null else doc, before, len(ids), zlib.crc32(ids)))
                        before += len(ids)
                if len(rows) != records:
                    raise ValueError(f"{path} has {len(rows)} records, not {records}")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(out_dir: str, path: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their place in it, in the order asked for, by way of the index: for shuffled reads."""
    at, top = fs.FileSystem.from_uri(out_dir)
    out = []
    with at.open_input_file(f"{top}/{path}.idx") as i, at.open_input_file(f"{top}/{path}.rec") as f:
        for p in places:
            i.seek(p * _AT_BYTES)
            offset, n = struct.unpack(_AT, i.read(_AT_BYTES))
            f.seek(offset)
            body = read_frame(f)
            if body is None or len(body) != n:
                raise ValueError("the index does not fit the records")
            doc, null, width = struct.unpack_from(_BODY, body)
            out.append((None if null else doc, np.frombuffer(body, f"<u{width}", offset=_BODY_BYTES).astype("<u4")))
    return out


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out_dir: str | None = None) -> DataFrame:
    """Encodes, writes, and reads back: doc_id, start, n_tokens, ids_crc32, one row per input row.

    A null text counts as empty and has the end id alone. Null ids come first. Rows with the same id lie by text.
    An empty table gives no files and no rows. Extra columns are not read.
    """
    out_dir = out_dir or shared_path(docs.sparkSession, "records")
    return read_records(write_records(docs, tokenizer_path, out_dir, end_id), out_dir)
