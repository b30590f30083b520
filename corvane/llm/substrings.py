"""Substring deduplication with Rabin-Karp window hashes (operator 3).

Plan, with the amount that each step shuffles per window of ``width`` words:

1. Every task hashes all windows of its documents (numpy, two independent polynomials), keeps
   one entry (7-byte key, document) per key and task batch, and deals the entries to buckets
   chosen by the other polynomial.  Occurrences beyond the first in a batch are known to be
   repeats at once, so a passage that a third of all documents share costs one entry a batch.
2. Each bucket finds the smallest document of each key; every other document of the key gets
   the key back as a *repeat* (6 bytes), packed by group of documents.
3. Groups of documents are co-grouped with their repeats; a document looks its windows up among
   its repeats, adds the windows that repeat inside itself, and merges them into maximal
   intervals of words to remove.

Bucket and group counts follow the bytes of text, so each stays at a few MB at any input size.
A key has 56 bits besides the bucket's, so a false repeat is expected once per 10**11 windows.

Defined results: a null text has no words; texts shorter than a window lose nothing except
where they repeat themselves (they can't); a null id counts as smaller than all others; rows
that repeat an id are one document, so equal rows don't count against each other and removals
found in one apply to all of them; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .io import table

BASE_C = 0xA0761D6478BD642F
NULL_ID = -(2**63)
KEY_MASK, REPEAT_MASK = np.uint64(2**56 - 1), np.uint64(2**48 - 1)
BUCKET_BYTES, GROUP_BYTES, LEAST_PARTS = 4 << 20, 1 << 20, 1024
FLUSH = 1 << 20


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _pack(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as zstd-compressed differences; small for ids in ascending order."""
    raw = np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_ids(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<i8"))


def _window_hashes(data, offsets, width):
    """Word starts, ends and rows, and first words, keys and bucket hashes of the windows."""
    starts, ends, rows = K.words(data, offsets)
    hashes = K.span_hashes(K.prefix_sums(data), starts, ends)
    at, first = K.windows(hashes, rows, width)
    _, second = K.windows(hashes, rows, width, BASE_C)
    return starts, ends, rows, at, K.mix(first, 1), K.mix(second, 2)


def _rows(parts: np.ndarray, *columns) -> list:
    """Slices of the columns, which are sorted by part: [(part, slice, ...)]."""
    cuts = np.flatnonzero(np.diff(parts)) + 1
    edges = [0, *cuts.tolist(), len(parts)] if len(parts) else []
    return [(int(parts[a]), *(c[a:b] for c in columns)) for a, b in zip(edges, edges[1:], strict=False)]


def _by_group(keys, ids, groups) -> list[dict]:
    """Repeats packed by group of documents."""
    group = np.mod(ids, groups)
    order = np.lexsort((ids, group))
    return [{"part": g, "group": g, "keys": _pack(k, 6), "ids": _pack_ids(i)} for g, k, i in _rows(group[order], keys[order], ids[order])]


_PACKED = pa.schema([("part", pa.int64()), ("group", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])


def _deal(buckets: int, groups: int, width: int):
    def flush(found):
        keys, seconds, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(ids) and (np.diff(ids) < 0).any():
            order = np.argsort(ids, kind="stable")
            keys, seconds, ids = keys[order], seconds[order], ids[order]
        keys = keys & KEY_MASK
        order = np.argsort(keys, kind="stable")
        sorted_keys, sorted_ids = keys[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        least = sorted_ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        repeat = sorted_ids != least
        repeat[1:] &= new[1:] | (sorted_ids[1:] != sorted_ids[:-1])  # once for each document
        out = _by_group(sorted_keys[repeat] & REPEAT_MASK, sorted_ids[repeat], groups) if repeat.any() else []
        first = np.sort(order[new])
        bucket = (seconds[first] % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
        order = np.argsort(bucket, kind="stable")
        first = first[order]
        out += [{"part": b, "group": None, "keys": _pack(k, 7), "ids": _pack_ids(i)} for b, k, i in _rows(bucket[order], keys[first], ids[first])]
        return pa.RecordBatch.from_pylist(out, _PACKED)

    def deal(batches):
        found, n = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for at, _, data, offsets in K.string_chunks(batch.column("text")):
                _, _, rows, first, keys, seconds = _window_hashes(data, offsets, width)
                found.append((keys, seconds, ids[at + rows[first]]))
                n += len(first)
                if n >= FLUSH:
                    yield flush(found)
                    found, n = [], 0
        if n:
            yield flush(found)

    return deal


def _meet(groups: int):
    def meet(bucket: pa.Table) -> pa.Table:
        passed = bucket.filter(pa.compute.is_valid(bucket["group"]))
        dealt = bucket.filter(pa.compute.is_null(bucket["group"]))
        out = [passed.cast(_PACKED)]
        if len(dealt):
            keys = np.concatenate([_unpack(b, 7) for b in dealt["keys"].to_pylist()])
            ids = np.concatenate([_unpack_ids(b) for b in dealt["ids"].to_pylist()])
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(ids, starts)[np.cumsum(new) - 1] if len(starts) else ids
            repeat = ids != least
            if repeat.any():
                out.append(pa.Table.from_pylist(_by_group(keys[repeat] & REPEAT_MASK, ids[repeat], groups), _PACKED))
        return pa.concat_tables(out)

    return meet


_KEPT = pa.schema([("id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_KEPT_DDL = "id long, kept_text string, n_words long, removed array<struct<start: long, end: long>>"


def _tagged(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Key and document as one number."""
    with np.errstate(over="ignore"):
        return keys + K.mix(ids.astype(np.uint64), 3)


def _remove(width: int):
    def remove(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        if len(repeats):
            known = np.unique(_tagged(np.concatenate([_unpack(b, 6) for b in repeats["keys"].to_pylist()]), np.concatenate([_unpack_ids(b) for b in repeats["ids"].to_pylist()])))
        else:
            known = np.zeros(0, np.uint64)
        ids = docs["id"].to_numpy()
        out_id, out_text, out_n, out_removed = [], [], [], []
        for at, n, data, offsets in K.string_chunks(docs["text"]):
            _, _, rows, first, keys, _ = _window_hashes(data, offsets, width)
            keys = _tagged(keys & REPEAT_MASK, ids[at + rows[first]])
            repeat = np.isin(keys, known)
            if len(keys):  # within a document the first occurrence stays
                by_row = _tagged(keys, rows[first])
                order = np.argsort(by_row, kind="stable")
                again = np.zeros(len(order), bool)
                again[order[1:]] = by_row[order[1:]] == by_row[order[:-1]]
                repeat |= again
            change = np.zeros(len(rows) + 1, np.int32)
            change[: len(rows) + 1] += np.bincount(first[repeat], minlength=len(rows) + 1).astype(np.int32)
            change -= np.bincount(first[repeat] + width, minlength=len(rows) + 1).astype(np.int32)[: len(rows) + 1]
            gone = np.cumsum(change)[:-1] > 0
            word_at = K.row_starts(rows, n)
            raw = data.tobytes()
            any_gone = np.add.reduceat(np.append(gone, False), word_at[:-1]) if n else []
            for i in range(n):
                a, b = word_at[i], word_at[i + 1]
                kept, spans = raw[offsets[i] : offsets[i + 1]].split(), []
                if b > a and any_gone[i]:
                    g = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], g, [False]))))
                    spans = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
                    kept = [w for w, x in zip(kept, g.tolist(), strict=True) if not x]
                out_id.append(int(ids[at + i]))
                out_text.append(b" ".join(kept).decode())
                out_n.append(int(b - a))
                out_removed.append(spans)
        return pa.Table.from_pydict({"id": out_id, "kept_text": out_text, "n_words": out_n, "removed": out_removed}, _KEPT)

    return remove


def remove_repeated_windows(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts earlier.

    Earlier means in a document with a smaller id, or in the same document before it.  Returns
    per row: the id, ``kept_text`` (kept words joined by one space), ``n_words`` and ``removed``,
    the maximal intervals of removed words (start, end exclusive).
    """
    docs = df.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_PARTS, size // BUCKET_BYTES)
    groups = _prime_from(max(LEAST_PARTS, size // GROUP_BYTES))
    packed = "part long, group long, keys binary, ids binary"
    dealt = docs.mapInArrow(_deal(buckets, groups, width), packed)
    repeats = dealt.groupBy("part").applyInArrow(_meet(groups), packed)
    grouped = docs.withColumn("group", F.pmod("id", F.lit(groups)))
    kept = grouped.groupBy("group").cogroup(repeats.groupBy("group")).applyInArrow(_remove(width), _KEPT_DDL)
    return kept.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id), "kept_text", "n_words", "removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words over all documents, as digests of the kept texts."""
    kept = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start), F.lit(0)).alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )
