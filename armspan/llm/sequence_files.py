"""Token ids as Arrow stream files of equal-length sequences and masks.

A file is an Arrow IPC stream. Each row is one sequence: ``ids`` (fixed-size list of unsigned
16-bit integers, 32-bit if the vocabulary needs them), ``mask`` (fixed-size list of booleans:
false for padding), ``ends`` (places of the last tokens of documents in the sequence) and
``doc_ids`` (those documents). Documents follow one another without gaps; only the last
sequence of a file is padded. All batches but the last
hold the same number of sequences, so a sequence is found by arithmetic and, in a mapped file,
read without a copy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armspan.llm.common import arrow_map, pick, stored
from armspan.llm.words import WordEncoder, parts, token_bytes
from armspan.session import fresh_path

_BATCH_SEQUENCES = 256
# Tasks that read files back, at most.
_READERS = 20_000
_FILE = "part int, number int, path string, n_docs bigint, n_tokens bigint, n_sequences bigint"
_DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def sequence_schema(length: int, id_type: np.dtype) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(id_type), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("ends", pa.list_(pa.int32())),
            ("doc_ids", pa.list_(pa.int64())),
        ]
    )


def write_sequences(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    length: int = 512,
    file_tokens: int = 16_777_216,
    path: str | None = None,
) -> DataFrame:
    """Writes all texts in ascending doc_id order; returns one row per file, with its place.

    Columns: part and number (the order of the files), path, n_docs, n_tokens (end ids
    included), n_sequences and start (the tokens in all files before). ``path`` is a folder
    that executors share, by default a new one in the scratch folder. Rows are range-partitioned
    by doc_id once and encoded as they are written, short texts in batches of about a megabyte, a
    long one part by part, so only one batch of texts and of sequences is held. A file is closed at the first end of a document after
    ``file_tokens``. Files have unique names and count once the row that names them is stored,
    so what a lost or repeated task leaves behind is never read.

    A null or empty text is the end id alone. Null ids come first; rows of one id are ordered
    by a hash of the text; repeated rows are written again. Extra columns are ignored. An empty
    table writes no file.
    """
    root = (path or fresh_path(df.sparkSession, "sequences")).rstrip("/")
    keys = ["doc_id", "_hash", "_tie"]
    rows = pick(df, "doc_id", "text").select(
        "*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_tie")
    )
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def each(given: Iterator[dict]) -> Iterator[tuple]:
        encoder = token_bytes(tokenizer)
        part, number, out = TaskContext.get().partitionId(), 0, None
        for doc_id, portions in _encoded(given, encoder):
            if out is None:
                out = _Writer(f"{root}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrows", length, encoder.id_type)
            for ids in portions:
                out.add(ids)
            out.end(doc_id, end_id)
            if out.n_tokens >= file_tokens:
                yield part, number, *out.close()
                out, number = None, number + 1
        if out is not None:
            yield part, number, *out.close()

    files = stored(arrow_map(ordered, each, _FILE), "sequence-files")
    # One row a file: bounded by tokens / file_tokens and the number of partitions.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return stored(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "sequence-index")


def _encoded(
    rows: Iterator[dict], encoder: WordEncoder, part_chars: int = 262_144, batch_chars: int = 1_048_576
) -> Iterator[tuple[int | None, Iterable[bytes]]]:
    """doc_id and portions of the ids of each row, in order; words new to a batch are encoded together."""
    held: list[tuple[int | None, str]] = []
    weight = 0

    def batch() -> Iterator[tuple[int | None, Iterable[bytes]]]:
        for (doc_id, _), found in zip(held, encoder.values([text for _, text in held]), strict=True):
            yield doc_id, [b"".join(found)]

    for row in rows:
        text = row["text"] or ""
        if len(text) > part_chars:
            yield from batch()
            held, weight = [], 0
            yield row["doc_id"], (b"".join(encoder.values([piece])[0]) for piece in parts(text, part_chars))
            continue
        held.append((row["doc_id"], text))
        weight += len(text)
        if weight >= batch_chars:
            yield from batch()
            held, weight = [], 0
    yield from batch()


def read_documents(files: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens and ids_crc32.

    ``start`` counts the ids of all documents before; ids_crc32 is the checksum of the ids as
    little-endian unsigned 32-bit integers. Files are spread over tasks and read batch by batch.
    """

    def each(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            yield from _documents(row["path"], row["start"])

    # A given number of partitions is kept: adaptive execution would put the few short rows into one task.
    spread = files.select("path", "start").repartition(max(1, min(files.count(), _READERS)))
    return arrow_map(spread, each, _DOCUMENT)


def open_sequences(path: str) -> pa.Table:
    """A file as a table; a local file is mapped, and its columns are views of the mapping."""
    return pa.ipc.open_stream(_source(path)).read_all()


def sequence(table: pa.Table, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of one sequence, without a copy."""
    found = []
    for name in ("ids", "mask"):
        column = table.column(name)
        size = len(column.chunk(0))
        chunk = column.chunk(number // size)
        width = chunk.type.list_size
        found.append(chunk.flatten().slice(number % size * width, width))
    return found[0].to_numpy(zero_copy_only=True), found[1]


def _source(path: str) -> pa.NativeFile:
    store, place = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(place)
    return store.open_input_file(place)


def _documents(path: str, start: int) -> Iterator[tuple]:
    crc, n = 0, 0
    with _source(path) as source:
        for batch in pa.ipc.open_stream(source):
            ids = batch.column("ids").flatten().to_numpy()
            real = pc.sum(batch.column("mask").flatten()).as_py()
            doc_ids = batch.column("doc_ids").flatten().to_pylist()
            ends = batch.column("ends")
            width = len(ids) // batch.num_rows
            rows = np.repeat(np.arange(batch.num_rows), ends.value_lengths().to_numpy())
            at = 0
            for doc_id, last in zip(doc_ids, (rows * width + ends.flatten().to_numpy()).tolist(), strict=True):
                crc = zlib.crc32(ids[at : last + 1].astype("<u4").data, crc)
                n += last + 1 - at
                yield doc_id, start, n, crc
                start, n, crc, at = start + n, 0, 0, last + 1
            # The document at the end of the batch goes on in the next.
            crc = zlib.crc32(ids[at:real].astype("<u4").data, crc)
            n += real - at


class _Writer:
    """One file: ids are added in any portions and leave in batches of whole sequences."""

    def __init__(self, path: str, length: int, id_type: np.dtype):
        self._path, self._length, self._type = path, length, id_type
        self._schema = sequence_schema(length, id_type)
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self._file = store.open_output_stream(place)
        self._stream = pa.ipc.new_stream(self._file, self._schema)
        self._ids = bytearray()
        # Ends of documents that have not left yet: place after the last written token, and id.
        self._ends: list[tuple[int, int | None]] = []
        self._batch_tokens = _BATCH_SEQUENCES * length
        self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, ids: bytes) -> None:
        self._ids += ids
        self.n_tokens += len(ids) // self._type.itemsize
        while self._held() > self._batch_tokens:
            self._flush(self._batch_tokens)

    def end(self, doc_id: int | None, end_id: int) -> None:
        self.add(np.array([end_id], self._type).tobytes())
        self._ends.append((self._held(), doc_id))
        self.n_docs += 1

    def close(self) -> tuple[str, int, int, int]:
        while self._ids:
            self._flush(min(self._batch_tokens, self._held()))
        self._stream.close()
        self._file.close()
        return self._path, self.n_docs, self.n_tokens, self.n_sequences

    def _held(self) -> int:
        return len(self._ids) // self._type.itemsize

    def _flush(self, tokens: int) -> None:
        rows, used = -(-tokens // self._length), tokens * self._type.itemsize
        ids, mask = np.zeros(rows * self._length, self._type), np.zeros(rows * self._length, bool)
        ids[:tokens] = np.frombuffer(bytes(self._ids[:used]), self._type)
        mask[:tokens] = True
        done = [(place - 1, doc_id) for place, doc_id in self._ends if place <= tokens]
        places = np.array([place for place, _ in done], "i8")
        offsets = pa.array(np.searchsorted(places, np.arange(rows + 1) * self._length), pa.int32())
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self._length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self._length),
            pa.ListArray.from_arrays(offsets, pa.array(places % self._length, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array([doc_id for _, doc_id in done], pa.int64())),
        ]
        self._stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self._schema))
        del self._ids[:used]
        self._ends = [(place - tokens, doc_id) for place, doc_id in self._ends[len(done) :]]
        self.n_sequences += rows
