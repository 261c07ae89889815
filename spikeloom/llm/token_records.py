"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A folder holds one data file and one index file a write task, and a manifest that names them in
order. A record in a data file is framed as

    length of the payload   unsigned 64 bit
    masked checksum         of the eight bytes before, unsigned 32 bit
    payload
    masked checksum         of the payload, unsigned 32 bit

all little-endian. The checksum is CRC-32C, turned right by 15 bits and moved by a constant, as
public readers of such files expect, so these can walk the files. A payload is a header of 16 bytes
(bytes of an id, whether there is a document id, six zero bytes, the document id as a signed 64-bit
integer) and the ids, of two bytes each where all of the record's fit and four where not. An index
file holds three unsigned 64-bit integers a record: where its frame begins, the payload's length,
and the number of ids before it in the data file. The manifest, written on commit, has every file's
counts; so a reader knows the number of ids before any record, and where it is, without a scan.

Files are written and read by a Spark data source, `token_records`. A task writes files named after
its attempt, and only those of successful attempts enter the manifest: a lost executor leaves files
that nobody reads. Reading goes in order, in ranges of bounded size; or, with the option `seed`, in
a permutation of all records that needs no memory: each task takes a range of the permuted numbers
and finds its records by the index.

Defined results: a null text counts as empty and has the end id alone; rows with a null id come
first; rows that share an id follow each other in the order of their texts' hash; a broken frame or
index ends the read with an error; an empty table gives a manifest without files, and no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spikeloom.llm.common import keyed
from spikeloom.llm.packing import Vocabulary, default_vocabulary, tokenizer

END_ID = 2
MANIFEST = "manifest.json"
HEADER = struct.Struct("<BB6xq")
INDEX = np.dtype([("at", "<u8"), ("length", "<u8"), ("before", "<u8")])
#: Bytes that a read task takes in order, records that one takes in a permuted read, and bytes of a batch.
READ_BYTES = 64 << 20
READ_RECORDS = 16_384
BATCH_BYTES = 4 << 20

RECORD = "record long, doc_id long, start long, n_tokens long, ids binary"

# -- checksums

POLYNOMIAL = 0x82F63B78  # CRC-32C, bits reversed
MASK = 0xA282EAD8
CHUNK = 512


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For a word's low and high half: its checksum after the word; and for each byte of a checksum: what it is after CHUNK zero bytes."""
    one = np.arange(256, dtype="u4")
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype("u4")
    step = lambda crc: one[crc & 0xFF] ^ (crc >> 8)
    half = np.arange(65536, dtype="u4")
    low, high = half, half << 16
    for _ in range(4):
        low, high = step(low), step(high)
    far = [np.arange(256, dtype="u4") << (8 * i) for i in range(4)]
    for _ in range(CHUNK):
        far = [step(x) for x in far]
    return low, high, far


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once: each is laid out in chunks that end where it ends, all
    chunks advance together by words, and the chunks of a string are joined after."""
    low, high, far = _tables()
    zeros = lambda crc: far[0][crc & 0xFF] ^ far[1][(crc >> 8) & 0xFF] ^ far[2][(crc >> 16) & 0xFF] ^ far[3][crc >> 24]
    sizes = np.array([len(p) for p in parts], "int64")
    if not len(sizes):
        return np.zeros(0, "u4")
    chunks = np.maximum(-(-sizes // CHUNK), 1)
    ends = np.cumsum(chunks)
    laid = np.zeros(int(ends[-1]) * CHUNK, "u1")
    for part, end in zip(parts, (ends * CHUNK).tolist()):
        laid[end - len(part) : end] = np.frombuffer(part, "u1")
    words = np.ascontiguousarray(laid.view("<u4").reshape(-1, CHUNK // 4).T)
    crc = np.zeros(int(ends[-1]), "u4")
    for word in words:
        crc ^= word
        crc = low[crc & 0xFFFF] ^ high[crc >> 16]
    first, total = ends - chunks, np.zeros(len(parts), "u4")
    for k in range(int(chunks.max())):
        more = np.flatnonzero(chunks > k)
        total[more] = zeros(total[more]) ^ crc[first[more] + k]
    return total ^ _start(sizes) ^ np.uint32(0xFFFFFFFF)


def _start(sizes: np.ndarray) -> np.ndarray:
    """What the start value (all ones) is after so many zero bytes, by repeated squaring of the step."""
    out, rest = np.full(len(sizes), 0xFFFFFFFF, "u4"), sizes.copy()
    for power in _powers():
        odd = (rest & 1).astype(bool)
        if odd.any():
            bits = (out[odd][:, None] >> np.arange(32, dtype="u4")) & 1
            out[odd] = np.bitwise_xor.reduce(np.where(bits, power, 0).astype("u4"), axis=1)
        rest >>= 1
        if not rest.any():
            break
    return out


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """Of 1, 2, 4, ... zero bytes: what each bit of a checksum becomes."""
    bits = np.uint32(1) << np.arange(32, dtype="u4")
    step = bits.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype("u4")
    out = [step]
    for _ in range(47):
        last = out[-1]
        set_bits = (last[:, None] >> np.arange(32, dtype="u4")) & 1
        out.append(np.bitwise_xor.reduce(np.where(set_bits, last, 0).astype("u4"), axis=1))
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


# -- records


def pack_record(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or int(ids.max()) < 65536 else 4
    return HEADER.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack_record(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = HEADER.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=HEADER.size).astype("<u4")


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, t.tobytes())) for n, h, p, t in zip(lengths, heads, payloads, tails)]


def payloads_of(data: bytes, offsets: list[int], lengths: list[int]) -> list[bytes]:
    """The payloads of the frames at these offsets, checked."""
    heads, payloads, sums = [], [], []
    for at, n in zip(offsets, lengths):
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        sums += [data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]]
    found = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2) if all(len(s) == 4 for s in sums) else np.zeros((0, 2), "u4")
    told = np.frombuffer(b"".join(heads), "<u8") if all(len(h) == 8 for h in heads) else np.zeros(0, "u8")
    fine = len(told) == len(lengths) and (told == np.array(lengths, "u8")).all() and len(found) == len(lengths)
    if not (fine and (found[:, 0] == masked(crc32c(heads))).all() and (found[:, 1] == masked(crc32c(payloads))).all()):
        raise ValueError("a record is broken: its frame, length or checksum does not fit")
    return payloads


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 by a Feistel network, walked on until a number is in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = np.random.default_rng(seed).integers(0, 2**63, 6, "u8")
    out, todo = numbers.astype("u8"), np.arange(len(numbers))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & (2**half - 1)
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(7)) & np.uint64(2**half - 1)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype("int64")


# -- the data source


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str
    records: int
    tokens: int
    size: int


@dataclass
class Range(InputPartition):
    """Records first .. stop of a file, or permuted numbers first .. stop (file is -1)."""

    file: int
    first: int
    stop: int

    def __init__(self, file: int, first: int, stop: int):
        self.file, self.first, self.stop = file, first, stop


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path there: local or mounted ones, or those of a URI."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = store(self.path)
        system.create_dir(root)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        entries, at, tokens = [], 0, 0
        with system.open_output_stream(f"{root}/{name}.records") as data:
            for batch in iterator:
                ids = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
                payloads = [pack_record(d, x) for d, x in zip(batch.column("doc_id").to_pylist(), ids)]
                for x, payload, frame in zip(ids, payloads, frames(payloads)):
                    entries.append((at, len(payload), tokens))
                    data.write(frame)
                    at, tokens = at + len(frame), tokens + len(x)
        with system.open_output_stream(f"{root}/{name}.index") as index:
            index.write(np.array(entries, INDEX).tobytes())
        return Written(context.partitionId(), name, len(entries), tokens, at)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        system.create_dir(root)
        files = sorted((m for m in messages if m and m.records), key=lambda m: m.task)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"files": [{"name": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.size} for m in files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        for m in messages:
            for kind in ("records", "index"):
                if m and system.get_file_info(f"{root}/{m.name}.{kind}").is_file:
                    system.delete_file(f"{root}/{m.name}.{kind}")


class RecordReader(DataSourceReader):
    def __init__(self, path: str, seed: int | None):
        system, root = store(path)
        self.path, self.seed = path, seed
        with system.open_input_stream(f"{root}/{MANIFEST}") as file:
            self.files = json.loads(file.readall())["files"]
        self.records = [0, *accumulate(f["records"] for f in self.files)]
        self.tokens = [0, *accumulate(f["tokens"] for f in self.files)]

    def partitions(self) -> list[Range]:
        if self.seed is not None:
            return [Range(-1, at, min(at + READ_RECORDS, self.records[-1])) for at in range(0, self.records[-1], READ_RECORDS)]
        out = []
        for k, f in enumerate(self.files):
            step = max(1, f["records"] * READ_BYTES // max(f["bytes"], 1))
            out += [Range(k, at, min(at + step, f["records"])) for at in range(0, f["records"], step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no records at all
            return
        system, root = store(self.path)
        opened: dict[str, object] = {}

        def file(name: str):
            if name not in opened:
                if len(opened) >= 64:
                    opened.pop(next(iter(opened))).close()
                opened[name] = system.open_input_file(f"{root}/{name}")
            return opened[name]

        def entries(k: int, first: int, stop: int) -> np.ndarray:
            raw = file(f"{self.files[k]['name']}.index").read_at((stop - first) * INDEX.itemsize, first * INDEX.itemsize)
            if len(raw) != (stop - first) * INDEX.itemsize:
                raise ValueError("an index file is too short")
            return np.frombuffer(raw, INDEX)

        def batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            rows = [(n, before, *unpack_record(p)) for n, before, p in found]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3].tobytes() for r in rows], pa.binary()),
            ]
            return pa.record_batch(columns, names=["record", "doc_id", "start", "n_tokens", "ids"])

        try:
            if partition.file >= 0:
                k, data = partition.file, file(f"{self.files[partition.file]['name']}.records")
                for first in range(partition.first, partition.stop, READ_RECORDS):
                    held = entries(k, first, min(first + READ_RECORDS, partition.stop))
                    # runs of neighbours of bounded size are read at once
                    runs = np.flatnonzero(np.diff((held["at"] - held["at"][0]) // BATCH_BYTES, prepend=-1))
                    for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(held)]):
                        run = held[a:b]
                        begin, end = int(run["at"][0]), int(run["at"][-1] + run["length"][-1]) + 16
                        found = payloads_of(data.read_at(end - begin, begin), (run["at"] - run["at"][0]).tolist(), run["length"].tolist())
                        yield batch([(self.records[k] + first + a + i, self.tokens[k] + int(run["before"][i]), p) for i, p in enumerate(found)])
                return
            numbers = permuted(np.arange(partition.first, partition.stop), self.records[-1], self.seed).tolist()
            found, size = [], 0  # number, ids before it, frame
            for n in numbers:
                k = bisect.bisect_right(self.records, n) - 1
                entry = entries(k, n - self.records[k], n - self.records[k] + 1)[0]
                frame = file(f"{self.files[k]['name']}.records").read_at(int(entry["length"]) + 16, int(entry["at"]))
                found.append((n, self.tokens[k] + int(entry["before"]), frame))
                size += len(frame)
                if size >= BATCH_BYTES or len(found) >= 256 or n == numbers[-1]:
                    sizes = [len(frame) for _, _, frame in found]
                    whole = payloads_of(b"".join(frame for _, _, frame in found), [0, *accumulate(sizes[:-1])], [n - 16 for n in sizes])
                    yield batch([(n, before, payload) for (n, before, _), payload in zip(found, whole)])
                    found, size = [], 0
        finally:
            for f in opened.values():
                f.close()


class TokenRecords(DataSource):
    """spark.read.format("token_records").option("seed", 7).load(folder), and the same to write (doc_id, ids)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options["seed"]) if "seed" in self.options else None)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


# -- the operator


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every document, the end id last."""
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = tokenizer(vocabulary).encode
        return pd.Series([own(t or "").tobytes() + end for t in texts])

    return keyed(docs, doc_id=doc_id, text=text).select("doc_id", encode("text").alias("ids"))


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes every document's ids, in ascending order of the ids of documents over all files.

    Documents are dealt by ranges of their ids, so a file holds a range, and files follow each
    other; the number of files is Spark's number of shuffle partitions unless given."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    order = ["doc_id", "_tie"]
    dealt = keyed(docs, doc_id=doc_id, text=text).withColumn("_tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    encoded(dealt, vocabulary=vocabulary, end_id=end_id).write.format("token_records").mode("append").save(path)


def read(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """record (its number), doc_id, start (ids before it in all records), n_tokens and ids of every
    record; with a seed, in a permuted order over all files."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records")
    return (reader if seed is None else reader.option("seed", seed)).load(path)


def output(docs: DataFrame, path: str, **how) -> DataFrame:
    """What the files hold after writing: doc_id, start, n_tokens and ids_crc32."""
    write(docs, path, **how)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
