"""Token ids in files of length-delimited records, with an index of offsets.

A file begins with eight bytes that name the format and the width of an id.
Each record is: length of the payload (8 bytes), masked checksum of those eight
bytes (4), payload, masked checksum of the payload (4), all little-endian. The
payload is the document id (8 bytes), a flag byte (1 if the document id is null)
and the ids. Beside each file lies its index: one fixed entry per record with
offset, number of ids and document id, so records can be read in any order
without scanning the file.

Files are written by the tasks of a range-partitioned job in ascending order of
document id, under a name of the attempt and then renamed, so a lost or repeated
task leaves one whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import STEP_BYTES, col, steps, text_of, utf8
from tabloom.llm.encoding import encoder
from tabloom.session import fresh_path, write_table

MAGIC = b"TBLREC"
ENTRY = np.dtype([("offset", "<i8"), ("n_ids", "<i8"), ("doc_id", "<i8"), ("no_id", "u1")])
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
KEY = struct.Struct("<qB")
SHARD_BYTES = 64 << 20


def masked(data: bytes | memoryview) -> int:
    """Checksum rotated and shifted, so that data which holds checksums is checked as well."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for a local path or any store that Arrow knows."""
    if ":" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = KEY.pack(0 if doc_id is None else doc_id, doc_id is None) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def unframe(data: memoryview, at: int, width: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, ids, and where the next record begins. Raises on a failed check."""
    size, check = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    body = data[at + 12 : at + 12 + size]
    (check,) = TAIL.unpack_from(data, at + 12 + size)
    if masked(body) != check:
        raise ValueError(f"damaged record at {at}")
    doc_id, no_id = KEY.unpack_from(body)
    return None if no_id else doc_id, np.frombuffer(body, f"<u{width}", offset=KEY.size), at + HEAD.size + size + TAIL.size


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made = encoder(tokenizer)
        width = 2 if max(made.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = context.partitionId()
        name, attempt = f"shard-{shard:06d}", f".{context.taskAttemptId()}"
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        entries: list[tuple[int, int, int, bool]] = []
        offset = len(MAGIC) + 2
        with store.open_output_stream(f"{root}/{name}.rec{attempt}") as out:
            out.write(MAGIC + struct.pack("<H", width))
            for whole in batches:
                for batch in steps(whole, "text"):
                    flat, ends = made.column(utf8(batch.column("text")))
                    for doc_id, first, last in zip(batch.column("id").to_pylist(), ends, ends[1:]):
                        record = frame(doc_id, np.append(flat[first:last], np.uint32(end_id)).astype(f"<u{width}"))
                        entries.append((offset, int(last - first) + 1, doc_id or 0, doc_id is None))
                        offset += len(record)
                        out.write(record)
        with store.open_output_stream(f"{root}/{name}.idx{attempt}") as out:
            out.write(np.array(entries, ENTRY).tobytes())
        for kind in ("rec", "idx"):
            store.move(f"{root}/{name}.{kind}{attempt}", f"{root}/{name}.{kind}")
        if entries:
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "name": [name], "records": [len(entries)], "ids": [sum(e[1] for e in entries)], "bytes": [offset]}
            )

    return run


def write_records(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> tuple[str, DataFrame]:
    """Encode and write all documents; the folder, and a table with a row per shard.

    Columns of the table: shard, name, records, ids, bytes, start (ids in earlier
    shards). A null or empty text becomes a record of the end id alone. Null
    document ids come first; repeated rows are written each. The document id
    must be an integer. An empty table gives an empty folder and no rows.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    plain = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    # rows alike in id and text may go to several shards, which changes nothing but the balance
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    spread = plain.withColumns({"h": order[1], "m": order[2]})
    by = [order[0], F.col("h"), F.col("m")]
    sorted_docs = spread.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "text")
    schema = "shard long, name string, records long, ids long, bytes long"
    written = write_table(sorted_docs.mapInArrow(_write(folder, tokenizer, end_id), schema), "shards")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return folder, written.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                yield from _read_shard(store, f"{root}/{name}", start)

    return run


def _read_shard(store: fs.FileSystem, path: str, start: int) -> Iterator[pa.RecordBatch]:
    with store.open_input_stream(f"{path}.idx") as source:
        entries = np.frombuffer(source.read(), ENTRY)
    with store.open_input_file(f"{path}.rec") as source:
        end = source.size()
        head = source.read(len(MAGIC) + 2)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path}.rec is not a file of records")
        (width,) = struct.unpack_from("<H", head, len(MAGIC))
        borders = np.append(entries["offset"], end)
        first = 0
        while first < len(entries):
            last = max(first + 1, int(np.searchsorted(borders, borders[first] + STEP_BYTES, "right")) - 1)
            source.seek(int(borders[first]))
            data = memoryview(source.read(int(borders[last] - borders[first])))
            rows: dict[str, list] = {"id": [], "start": [], "n_tokens": [], "ids": []}
            at = 0
            for entry in entries[first:last]:
                doc_id, ids, at = unframe(data, at, width)
                if len(ids) != entry["n_ids"] or (doc_id or 0) != entry["doc_id"]:
                    raise ValueError(f"{path}: index and records differ")
                for key, value in zip(rows, (doc_id, start, len(ids), ids.astype("<u4").tobytes())):
                    rows[key].append(value)
                start += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], list(rows)
            )
            first = last


def read_records(folder: str, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All records of a written folder: doc_id, start, n_tokens, ids (32-bit, little-endian).

    Every length and payload is held against its checksum, and every record
    against the index. ``start`` counts the ids of all records before it.
    """
    files = shards.select("name", "start").repartition(max(1, shards.count()), "name")
    return files.mapInArrow(_read(folder), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def read_at(folder: str, name: str, positions: Sequence[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard by position, in any order: document id and ids."""
    store, root = open_store(folder)
    with store.open_input_stream(f"{root}/{name}.idx") as source:
        entries = np.frombuffer(source.read(), ENTRY)
    found = []
    with store.open_input_file(f"{root}/{name}.rec") as source:
        (width,) = struct.unpack_from("<H", source.read(len(MAGIC) + 2), len(MAGIC))
        for position in positions:
            source.seek(int(entries[position]["offset"]))
            size = KEY.size + int(entries[position]["n_ids"]) * width
            data = memoryview(source.read(HEAD.size + size + TAIL.size))
            doc_id, ids, _ = unframe(data, 0, width)
            found.append((doc_id, ids))
    return found
