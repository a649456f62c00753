"""Operator 3: token sequences as length-delimited binary records with a separate offset index.

A record is: 8 bytes length, 4 bytes masked CRC-32C of them, payload, 4 bytes masked CRC-32C of the payload, all
little-endian. The payload is a byte of flags, the document's identifier (none for null, 8 bytes for a whole number, 4 bytes
of length and UTF-8 for a text), its number of tokens (4 bytes) and its tokens (2 bytes each, or 4 where the vocabulary needs
them). Each task writes data files under names of its own and reports its records; the index is a Parquet table with Spark's commit protocol, so only what committed attempts wrote is
in it. Data files of lost or repeated attempts are named by no index row and are removed in the end.
"""

from __future__ import annotations

import random
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmesh.llm.common import col, id_types, new_path, ranges, slices
from wordmesh.llm.tokens import VOCABULARY, encode, ship

FILE_BYTES = 256 << 20
CHUNK = 64
MASK = 0xA282EAD8
#: Flags of a payload: what its identifier is, and whether tokens are of 4 bytes.
NULL_ID, INT_ID, TEXT_ID, WIDE = 0, 1, 2, 128
_INDEX = [("n_tokens", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]


def index_sql(kind: str) -> str:
    return f"file string, record bigint, doc_id {kind}, n_tokens int, offset bigint, length bigint, crc bigint"


@lru_cache(maxsize=1)
def _slicing() -> np.ndarray:
    t = np.zeros((8, 256), dtype=np.uint32)
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    t[0] = x
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0][t[k - 1] & np.uint32(255)]
    return t


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    b = np.uint32(255)
    return tables[0][x & b] ^ tables[1][(x >> np.uint32(8)) & b] ^ tables[2][(x >> np.uint32(16)) & b] ^ tables[3][x >> np.uint32(24)]


@lru_cache(maxsize=64)
def _shift(level: int) -> np.ndarray:
    """What CHUNK * 2^level zero bytes do to a state, as four tables of 256."""
    if level == 0:
        t = _slicing()[0]
        at = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(CHUNK):
            at = (at >> np.uint32(8)) ^ t[at & np.uint32(255)]
        return at.reshape(4, 256)
    half = _shift(level - 1)
    return _apply(half, half.ravel()).reshape(4, 256)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part (of 4 bytes at least), all parts at once.

    The sum is linear: parts are set flush right on a grid of chunks, behind zeros, all chunks are summed together,
    and the chunks of a part are then combined in pairs.
    """
    if not parts:
        return np.zeros(0, np.uint32)
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    count = -(-n // CHUNK)
    ends = np.cumsum(count) * CHUNK
    grid = np.zeros(int(ends[-1]), np.uint8)
    for p, a, b in zip(parts, (ends - n).tolist(), ends.tolist()):
        grid[a:b] = np.frombuffer(p, np.uint8)
    first = (ends - n)[:, None] + np.arange(4)
    grid[first] ^= 255
    words = grid.view("<u4").reshape(-1, CHUNK // 4)
    t, state, b = _slicing(), np.zeros(len(words), np.uint32), np.uint32(255)
    for k in range(0, CHUNK // 4, 2):
        lo, hi = words[:, k] ^ state, words[:, k + 1]
        state = t[7][lo & b] ^ t[6][(lo >> np.uint32(8)) & b] ^ t[5][(lo >> np.uint32(16)) & b] ^ t[4][lo >> np.uint32(24)]
        state ^= t[3][hi & b] ^ t[2][(hi >> np.uint32(8)) & b] ^ t[1][(hi >> np.uint32(16)) & b] ^ t[0][hi >> np.uint32(24)]
    level = 0
    while count.max() > 1:
        start, after = np.cumsum(count) - count, (count + 1) // 2
        p = ranges(after)
        right = np.repeat(start + count - 1, after) - 2 * (np.repeat(after, after) - 1 - p)
        left = right - 1
        some = left >= np.repeat(start, after)
        merged = state[right]
        merged[some] ^= _apply(_shift(level), state[left[some]])
        state, count, level = merged, after, level + 1
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frame(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The records of payloads, and the masked checksums of the payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)), masked(crc32c(payloads))
    return [h + struct.pack("<I", x) + p + struct.pack("<I", y) for h, x, p, y in zip(heads, a.tolist(), payloads, b.tolist())], b


def unframe(record: bytes) -> bytes:
    """The payload of one record; raises ValueError if a length or checksum doesn't hold."""
    if len(record) < 20:
        raise ValueError("record cut short")
    (n,), (a,) = struct.unpack("<Q", record[:8]), struct.unpack("<I", record[8:12])
    if len(record) != n + 16 or masked(crc32c([record[:8]]))[0] != a:
        raise ValueError("wrong length")
    payload = record[12:-4]
    if masked(crc32c([payload]))[0] != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("wrong checksum")
    return payload


def payload_of(doc_id: int | str | None, tokens: np.ndarray) -> bytes:
    """One document as bytes; ``tokens`` are of 2 or 4 bytes each."""
    wide = WIDE if tokens.itemsize == 4 else 0
    if doc_id is None:
        head = struct.pack("<B", NULL_ID | wide)
    elif isinstance(doc_id, int):
        head = struct.pack("<Bq", INT_ID | wide, doc_id)
    else:
        raw = doc_id.encode("utf-8", "surrogatepass")
        head = struct.pack("<BI", TEXT_ID | wide, len(raw)) + raw
    return head + struct.pack("<I", len(tokens)) + tokens.tobytes()


def parse(payload: bytes) -> tuple[int | str | None, list[int]]:
    """The identifier and the tokens of a payload."""
    kind, at, doc_id = payload[0] & ~WIDE, 1, None
    if kind == INT_ID:
        (doc_id,), at = struct.unpack_from("<q", payload, 1), 9
    elif kind == TEXT_ID:
        (n,) = struct.unpack_from("<I", payload, 1)
        doc_id, at = payload[5 : 5 + n].decode("utf-8", "surrogatepass"), 5 + n
    (n,) = struct.unpack_from("<I", payload, at)
    return doc_id, np.frombuffer(payload, "<u4" if payload[0] & WIDE else "<u2", n, at + 4).tolist()


def write_records(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records below ``path``/data, the index to ``path``/index, and returns the index.

    A null or empty text is a record of no tokens; a null identifier is null in the record and in the index, and identifiers may be of any type.
    Repeated rows, as ties, are each written; a very long text is one long record; an empty table gives an empty index. Only the two named
    columns are read, so others' names don't matter.
    """
    spark = docs.sparkSession
    raw = ship(spark, vocabulary)
    id_name, kind = id_types(docs, key)
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("doc_id", kind), *_INDEX])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        out, name, offset, record = None, "", 0, 0
        wide = "<u4" if raw.value.count(b"\n") > 65536 else "<u2"
        try:
            for batch in batches:
                for b in slices(batch, "text"):
                    flat, n = encode(b.column("text"), raw.value)
                    cast, ends, ids = flat.astype(wide), np.cumsum(n).tolist(), b.column("id").to_pylist()
                    records, crc = frame([payload_of(i, cast[e - k : e]) for i, e, k in zip(ids, ends, n.tolist())])
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset, record = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0
                        out = fs.open_output_stream(f"{root}/data/{name}")
                    out.write(b"".join(records))
                    size = np.fromiter(map(len, records), np.int64, len(records))
                    at = offset + np.cumsum(size) - size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(ids)), pa.array(np.arange(record, record + len(ids))), b.column("id"), pa.array(n, pa.int32()), pa.array(at), pa.array(size), pa.array(crc.astype(np.int64))], schema=schema
                    )
                    offset, record = offset + int(size.sum()), record + len(ids)
        finally:
            if out is not None:
                out.close()

    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{root}/data", recursive=True)
    own = docs.select(col(key).cast(id_name).alias("id"), col(text).cast("string").alias("text"))
    own.mapInArrow(run, index_sql(id_name)).write.parquet(f"{path}/index")
    index = spark.read.schema(index_sql(id_name)).parquet(f"{path}/index")
    named = {r.file for r in index.select("file").distinct().toLocalIterator()}
    for f in fs.get_file_info(pafs.FileSelector(f"{root}/data")):
        if f.base_name not in named:
            fs.delete_file(f.path)
    return index


def read_records(path: str, index: DataFrame, seed: int | None = None) -> DataFrame:
    """(doc_id, tokens) of the records that ``index`` names, read by offset and checked; shuffled where a seed is given."""
    name, kind = id_types(index, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        opened: dict[str, pafs.NativeFile] = {}
        for b in batches:
            ids, tokens = [], []
            for r in b.to_pylist():
                f = opened.get(r["file"]) or opened.setdefault(r["file"], fs.open_input_file(f"{root}/data/{r['file']}"))
                f.seek(r["offset"])
                i, t = parse(unframe(f.read(r["length"])))
                ids.append(i)
                tokens.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    if seed is not None:
        order = F.xxhash64(F.lit(seed), "file", "record")
        index = index.withColumn("__o", order).repartitionByRange("__o").sortWithinPartitions("__o").drop("__o")
    return index.mapInArrow(run, f"doc_id {name}, tokens array<int>")


def shuffled_batches(index_rows: list, seed: int, size: int) -> Iterator[list]:
    """A driver-side epoch over an index that fits in memory: batches of index rows in an order that ``seed`` settles."""
    rows = list(index_rows)
    random.Random(seed).shuffle(rows)
    for a in range(0, len(rows), size):
        yield rows[a : a + size]


def record_index(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the whole table as records to the shared folder and returns their index."""
    return write_records(docs, new_path(docs.sparkSession, "records"), key, text, vocabulary)

