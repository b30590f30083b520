"""Token ids in Arrow files of equal-length sequences (operator 11).

Documents are range-partitioned and sorted by id, so the files of the tasks in order hold the
documents in order; a task encodes its texts and appends the ids of each document and an end id to
its current file.  A file is in Arrow's IPC file format (the stream format with a footer of batch
offsets): columns ``ids`` and ``mask``, fixed-size lists of ``length`` numbers and bits, in batches of
``per_batch`` sequences, uncompressed.  So sequence k of a file is row k % per_batch of batch
k // per_batch: an offset, mapped from disk without a copy.  The mask is 1 for ids of documents and 0
for the filling of a file's last sequence.  A second Arrow file beside it says where each document
starts and how many ids it has.  A file ends with the document that brings it to ``file_tokens`` ids.

Recovery: every attempt of a task writes files of its own name; only those that the manifest lists, a
table Spark commits, count.  Leftovers of lost attempts are never read.

Speed: with a byte-level BPE vocabulary a token never holds a blank after a character that is none, so a text is
cut before such blanks, and each distinct piece is encoded once and kept (short ones, in a bounded
table).  Other vocabularies get whole texts.
Memory of a task: the texts of one Arrow batch, one record batch of ids, and that table.

Defined results: a null text counts as empty, an empty text is the end id alone; null ids come first;
rows with one id follow each other by a hash of the text, equal rows have a place each; a document
longer than a sequence goes on in the next; an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .io import shared_folder, table, written

#: Bytes up to which an encoded piece is kept, and pieces kept at most.
SHORT, KEPT = 48, 1 << 20
#: Bytes of text encoded at once: the more, the fewer pieces occur for the first time.
AT_ONCE = 4 << 20
_BLANK, _PRINTABLE = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_PRINTABLE[0x21:0x7F] = True
#: First two bytes of the three-byte characters among which Unicode's blanks are (those of two bytes start with C2).
_WIDE_BLANKS = np.zeros((256, 256), bool)
_WIDE_BLANKS[[0xE1, 0xE2, 0xE2, 0xE3], [0x9A, 0x80, 0x81, 0x80]] = True


class Encoder:
    """Ids of whole Arrow string arrays by a tokenizer given as JSON."""

    def __init__(self, spec: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        parts = json.loads(spec)
        before = parts.get("pre_tokenizer") or {}
        self.cuts = (
            parts.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and parts["model"].get("type") == "BPE"
            and all(a["special"] for a in parts.get("added_tokens", ()))
            and (special_as_text or not parts.get("added_tokens"))
        )
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = self.tokenizer.encode_batch_fast(pieces.cast(pa.large_string()).to_pylist(), add_special_tokens=False)
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return sizes, np.fromiter(chain.from_iterable(e.ids for e in out), self.kind, int(sizes.sum()))

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start: at rows, and at blanks after characters that are none."""
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        if self.cuts and len(data) > 2:
            at = np.flatnonzero(_BLANK[data[2:]]) + 2
            one, two, three = data[at - 1], data[at - 2], data[np.maximum(at - 3, 0)]
            wide = (one >= 0x80) & ~((two == 0xC2) | _WIDE_BLANKS[three, two])
            start[at[_PRINTABLE[one] | wide]] = True
        return np.flatnonzero(start[: len(data)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each row, and the ids of all rows."""
        n = len(offsets) - 1
        starts = self._starts(data, offsets)
        bounds = np.append(starts, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary
        if len(self.known) + len(distinct) > KEPT:
            self._forget()
        slots = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacking = np.flatnonzero(slots < 0)
        length = pc.binary_length(distinct).to_numpy()[lacking]
        for found, keep in ((lacking[length <= SHORT], True), (lacking[length > SHORT], False)):
            new = distinct.take(pa.array(found))
            sizes, ids = self._encoded(new)
            slots[found] = len(self.sizes) + np.arange(len(found))
            sizes, pool = np.concatenate((self.sizes, sizes)), np.concatenate((self.pool, ids))
            if keep:
                self.known, self.sizes, self.pool = pa.concat_arrays([self.known, new]), sizes, pool
        at = (np.cumsum(sizes) - sizes)[slots]
        slot = pieces.indices.to_numpy()
        size = sizes[slots][slot]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        place = np.arange(total) + np.repeat(at[slot] - (upto - size), size)
        # a piece lies in one row, rows without bytes have none
        rows = np.searchsorted(offsets, bounds[1:], "left") - 1
        return np.bincount(rows, weights=size, minlength=n).astype(np.int64), pool[place]

    def documents(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() with ``end`` after each row."""
        counts, ids = self.encode(data, offsets)
        out = np.empty(len(ids) + len(counts), self.kind)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        out[np.cumsum(counts + 1) - 1] = end
        return counts + 1, out


@lru_cache(maxsize=2)
def _encoder(spec: str, special_as_text: bool) -> Encoder:
    return Encoder(spec, special_as_text)


class _Writer:
    """One file of sequences and the file of its documents' places."""

    def __init__(self, folder: str, name: str, ids: pa.DataType, kind: np.dtype, length: int, per_batch: int, fill: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.name, self.length, self.room, self.fill = f"{root}/{name}", name, length, length * per_batch, fill
        number = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(number, length)), ("mask", pa.list_(pa.bool_(), length))], {"sequences_in_a_batch": str(per_batch)})
        self.sink = self.fs.open_output_stream(f"{self.path}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.places = self.fs.open_output_stream(f"{self.path}.documents.arrow")
        self.listed = pa.ipc.new_file(self.places, pa.schema([("id", ids), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.documents = 0

    def add(self, ids: pa.Array, counts: np.ndarray, tokens: np.ndarray) -> None:
        start = self.tokens + np.cumsum(counts) - counts
        self.listed.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(counts)], schema=self.listed_schema(ids)))
        self.tokens += len(tokens)
        self.documents += len(counts)
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held >= self.room:
            held = np.concatenate(self.waiting)
            whole = len(held) - len(held) % self.room
            for a in range(0, whole, self.room):
                self._batch(held[a : a + self.room], self.room)
            self.waiting, self.held = [held[whole:]], len(held) - whole

    @staticmethod
    def listed_schema(ids: pa.Array) -> pa.Schema:
        return pa.schema([("id", ids.type), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def _batch(self, tokens: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (tokens, np.arange(len(tokens)) < real)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> dict:
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint16)
        if len(rest):
            padded = np.full(-(-len(rest) // self.length) * self.length, self.fill, rest.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        for f in (self.out, self.sink, self.listed, self.places):
            f.close()
        return {"name": self.name, "n_documents": self.documents, "n_tokens": self.tokens, "n_sequences": -(-self.tokens // self.length)}


_MANIFEST = "part int, number int, name string, n_documents long, n_tokens long, n_sequences long"
_MANIFEST_SCHEMA = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])


def write_tokens(
    df: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 0, length: int = 2048, per_batch: int = 256, file_tokens: int = 1 << 26, special_as_text: bool = True
) -> DataFrame:
    """Writes the ids of all rows, in ascending order of id, below ``folder``; returns the manifest.

    ``tokenizer`` is the JSON of a ``tokenizers`` vocabulary; it goes to the tasks, which need no file of it.
    The manifest has one row a file: part, number (their order is the documents'), name, n_documents,
    n_tokens and n_sequences.
    """
    spec = df.sparkSession.sparkContext.broadcast(tokenizer)

    def write(batches):
        encoder = _encoder(spec.value, special_as_text)
        part, number, writer = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for at, n, data, offsets in K.string_chunks(batch.column(1), AT_ONCE):
                counts, tokens = encoder.documents(data, offsets, end)
                upto, a = np.concatenate(([0], np.cumsum(counts))), 0
                while a < n:
                    if writer is None:
                        writer = _Writer(folder, f"{part:06d}-{number:06d}-{uuid.uuid4().hex}", batch.column(0).type, encoder.kind, length, per_batch, end)
                    b = min(n, int(np.searchsorted(upto, upto[a] + file_tokens - writer.tokens)))
                    b = max(b, a + 1)
                    writer.add(batch.column(0).slice(at + a, b - a), counts[a:b], tokens[upto[a] : upto[b]])
                    a = b
                    if writer.tokens >= file_tokens:
                        yield pa.RecordBatch.from_pylist([{"part": part, "number": number} | writer.close()], _MANIFEST_SCHEMA)
                        number, writer = number + 1, None
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "number": number} | writer.close()], _MANIFEST_SCHEMA)

    keys = [F.col("id").asc_nulls_first(), F.col("_tie").asc(), F.col("_row").asc()]  # equal rows may be any number: their places tell them apart
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(placed.select("id", "text").mapInArrow(write, _MANIFEST))


class TokenFile:
    """One written file, opened for random access; local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._files = [pa.memory_map(f"{root}/{name}{x}") if local else fs.open_input_file(f"{root}/{name}{x}") for x in (".arrow", ".documents.arrow")]
        self.reader, self.places = (pa.ipc.open_file(f) for f in self._files)
        self.per_batch = int(self.reader.schema.metadata[b"sequences_in_a_batch"])
        self.length = self.reader.schema.field("ids").type.list_size
        batches = self.reader.num_record_batches
        self.n_sequences = (batches - 1) * self.per_batch + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of batch ``k``, flat, without a copy; the mask has a bit an id."""
        ids, mask = self.reader.get_batch(k).columns
        return ids.flatten().to_numpy(zero_copy_only=True), mask.flatten()

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``, views of the file."""
        if not 0 <= k < self.n_sequences:
            raise IndexError(k)
        ids, mask = self.batch(k // self.per_batch)
        a = k % self.per_batch * self.length
        return ids[a : a + self.length], mask.slice(a, self.length)

    def close(self) -> None:
        for f in self._files:
            f.close()


def locate(manifest: DataFrame, sequence: int) -> tuple[str, int]:
    """Name of the file that holds a sequence of the whole output, and its number there."""
    upto = F.sum("n_sequences").over(Window.orderBy("part", "number"))
    row = manifest.withColumn("_first", upto - F.col("n_sequences")).filter((F.col("_first") <= sequence) & (F.col("_first") + F.col("n_sequences") > sequence)).first()
    if row is None:
        raise IndexError(sequence)
    return row["name"], sequence - row["_first"]


def read_documents(manifest: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """Every document as the files hold it: (id, start, n_tokens, ids_crc32), read by a task a file.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the crc32 of its ids as
    little-endian 32-bit numbers.  ``kind`` is the SQL type of the ids.
    """

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(folder, name)
                room, k, held = f.per_batch * f.length, -1, None
                for b in range(f.places.num_record_batches):
                    placed = f.places.get_batch(b)
                    start, count = placed.column("start").to_numpy(), placed.column("n_tokens").to_numpy()
                    crcs = np.zeros(len(start), np.int64)
                    for i, (a, z) in enumerate(zip(start.tolist(), (start + count).tolist(), strict=True)):
                        crc = 0
                        while a < z:
                            if a // room != k:
                                k = a // room
                                ids, mask = f.batch(k)
                                if not pc.all(mask.slice(0, z - k * room)).as_py():
                                    raise ValueError(f"{name}: a document reaches into the filling")
                                held = ids.astype("<u4")
                            stop = min(z, (k + 1) * room)
                            crc = zlib.crc32(held[a - k * room : stop - k * room], crc)
                            a = stop
                        crcs[i] = crc
                    yield pa.RecordBatch.from_arrays([placed.column("id"), pa.array(start + base), pa.array(count), pa.array(crcs)], ["id", "start", "n_tokens", "ids_crc32"])
                f.close()

    before = F.sum("n_tokens").over(Window.orderBy("part", "number")) - F.col("n_tokens")  # one row a file
    files = manifest.withColumn("base", before).select("name", "base")
    return files.repartition(max(1, manifest.count())).mapInArrow(read, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the byte-level vocabulary of 50,257 ids, end id 0, read back from the files."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    return read_documents(manifest, folder).withColumnRenamed("id", "doc_id")
