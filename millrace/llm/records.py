"""Token ids as length-delimited binary records, with a separate offset index for reads in any order.

A record is: payload length (u64), its masked CRC-32C (u32), payload, the payload's masked CRC-32C (u32), all little-endian,
the framing of TFRecord files. A payload is doc_id (i64), number of ids (u32), bytes per id (u32) and the ids. A shard's
index file has doc_id (i64), offset (u64) and number of ids (u64) for each of its records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, slices, small_batches, stored
from .tokens import encoder

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
HEAD = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("width", "<u4")])
#: Bytes that one lane of the checksum covers.
LANE = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of CRC-32C for four bytes at once, and for LANE further zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    four = [one]
    for _ in range(3):
        four.append(one[four[-1] & 255] ^ (four[-1] >> 8))
    far = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(LANE):
        far = one[far & 255] ^ (far >> 8)
    return np.stack(four), far


_FOUR, _FAR = _tables()


def masked_crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each data[start:end] of at least 4 bytes, all ranges at once."""
    sizes = ends - starts
    lanes = -(-sizes // LANE)
    first = np.r_[0, np.cumsum(lanes)]
    padded = np.zeros(int(first[-1]) * LANE, np.uint8)
    to = first[1:] * LANE - sizes  # zeros in front don't change a checksum that starts from zero
    shift = np.repeat(to - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    flat = np.arange(int(sizes.sum()))
    padded[flat + shift] = data[flat + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)]
    padded[(to[:, None] + np.arange(4)).ravel()] ^= 255  # as starting from all ones
    crc = np.zeros(int(first[-1]), np.uint32)
    for word in np.ascontiguousarray(padded.view("<u4").reshape(-1, LANE // 4).T):
        crc ^= word
        crc = _FOUR[3][crc & 255] ^ _FOUR[2][(crc >> 8) & 255] ^ _FOUR[1][(crc >> 16) & 255] ^ _FOUR[0][crc >> 24]
    total, at = crc[first[:-1]], np.arange(len(sizes))
    for j in range(1, int(lanes.max(initial=0))):
        at = at[lanes[at] > j]
        x = total[at]
        total[at] = _FAR[0][x & 255] ^ _FAR[1][(x >> 8) & 255] ^ _FAR[2][(x >> 16) & 255] ^ _FAR[3][x >> 24] ^ crc[first[at] + j]
    total = ~total
    return ((total >> 15) | (total << 17)) + np.uint32(0xA282EAD8)


def frames(doc_ids: np.ndarray, ids: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The records of a few documents, and each one's offset."""
    width = ids[0].dtype.itemsize
    counts = np.array([len(x) for x in ids])
    payload = HEAD.itemsize + width * counts
    offsets = np.r_[0, np.cumsum(payload + 16)]
    head = np.zeros(len(ids), HEAD)
    head["doc_id"], head["n"], head["width"] = doc_ids, counts, width
    data = np.zeros(int(offsets[-1]), np.uint8)
    at = offsets[:-1]
    data[(at[:, None] + np.arange(8)).ravel()] = payload.astype("<u8").view(np.uint8)
    data[(at[:, None] + np.arange(12, 12 + HEAD.itemsize)).ravel()] = head.view(np.uint8)
    for a, x in zip((at + 12 + HEAD.itemsize).tolist(), ids, strict=True):
        data[a : a + width * len(x)] = x.view(np.uint8)
    for into, start, end in ((at + 8, at, at + 8), (at + 12 + payload, at + 12, at + 12 + payload)):
        data[(into[:, None] + np.arange(4)).ravel()] = masked_crc32c(data, start, end).astype("<u4").view(np.uint8)
    return data.tobytes(), at


def parse(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(doc_ids, ids) of the records at these offsets; a wrong length or checksum is an error."""
    raw, at = np.frombuffer(data, np.uint8), offsets.astype(np.int64)
    u = lambda where, kind: raw[(where[:, None] + np.arange(np.dtype(kind).itemsize)).ravel()].view(kind)
    size = u(at, "<u8").astype(np.int64)
    if (masked_crc32c(raw, at, at + 8) != u(at + 8, "<u4")).any() or (masked_crc32c(raw, at + 12, at + 12 + size) != u(at + 12 + size, "<u4")).any():
        raise ValueError("a record's checksum is wrong")
    head = u(at + 12, HEAD)
    begin = (at + 12 + HEAD.itemsize).tolist()
    return head["doc_id"], [raw[b : b + int(h["n"]) * int(h["width"])].view(f"<u{h['width']}") for b, h in zip(begin, head, strict=True)]


def write_records(docs: DataFrame, path: str, end_id: int, folder: str | None = None, shard_bytes: int = 1 << 28) -> DataFrame:
    """Writes docs(doc_id, text) in ascending doc_id order and returns the manifest, one row a shard.

    Manifest: shard, records_path, index_path, n_records, n_ids, start (ids in earlier shards). Shards are ranges of doc_id;
    a task names its files anew and only files in the manifest count, so lost or repeated tasks do no harm. Null texts count
    as empty; rows without doc_id are left out; repeated rows have records each; no rows give an empty manifest. There are as
    many shards as shuffle partitions, or more so that each has about `shard_bytes` of text at most.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, tok, index, at, out = TaskContext.get().partitionId(), encoder(path), [], 0, None
        name = f"part-{shard:06d}-{uuid.uuid4().hex}"
        store, base = fs.FileSystem.from_uri(folder)
        for b in slices(batches, 256):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}.rec")
            doc_ids = b.column(0).to_numpy()
            ids = [np.r_[x, end_id].astype(tok.dtype) for x in tok.encode(b.column(1))]
            for i in range(0, len(ids), 128):
                data, offsets = frames(doc_ids[i : i + 128], ids[i : i + 128])
                out.write(data)
                rows = np.zeros(len(offsets), INDEX)
                rows["doc_id"], rows["offset"], rows["n"] = doc_ids[i : i + 128], at + offsets, [len(x) for x in ids[i : i + 128]]
                index.append(rows)
                at += len(data)
        if out is not None:
            out.close()
            table = np.concatenate(index)
            with store.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(table.tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "records_path": f"{folder}/{name}.rec", "index_path": f"{folder}/{name}.idx", "n_records": len(table), "n_ids": int(table["n"].sum())}])

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    sorted_docs = kept.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")  # rows of one doc_id come in the same order in every run
    with small_batches(spark, 256):
        manifest = stored(sorted_docs.mapInArrow(run, "shard long, records_path string, index_path string, n_records long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_records(manifest: DataFrame, at_once: int = 256) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all records, read by their index; start: ids of all records before. An empty manifest gives an empty result; a record whose checksum is wrong is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, name = fs.FileSystem.from_uri(row["index_path"])
                with store.open_input_stream(name) as f:
                    index = np.frombuffer(f.read(), INDEX)
                starts = row["start"] + np.r_[0, np.cumsum(index["n"].astype(np.int64))[:-1]]
                with store.open_input_file(fs.FileSystem.from_uri(row["records_path"])[1]) as f:
                    for i in range(0, len(index), at_once):
                        part = index[i : i + at_once]
                        low = int(part["offset"][0])
                        high = int(index["offset"][i + at_once]) if i + at_once < len(index) else f.size()
                        doc_ids, ids = parse(f.read_at(high - low, low), part["offset"] - np.uint64(low))
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids.astype(np.int64)), pa.array(starts[i : i + at_once]), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
