"""Token ids in binary files with a minimal perfect hash index, for access by document key in constant time.

A file holds raw ids in ascending order of documents, then the index: bit sets whose ranks number the keys without
gaps (Limasset et al., "Fast and scalable minimal perfect hashing for massive key sets", SEA 2017), and per key a
stored fingerprint, the offset and the number of its ids. Keys are not stored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.common import LEAST, range_of
from corpusfold.llm.tokens import encoder
from corpusfold.session import working_root, write_shared

MAGIC = b"IDS1"
SHARD_BYTES = 32 << 20
# The manifest has a row per file and goes to the driver: so many files at most, larger ones beyond.
MAX_SHARDS = 8192
PART_IDS = 16 << 20
_LEVELS = 32
_SPREAD = 2.0

MANIFEST = "file string, first_key bigint, documents bigint, ids bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def key_hashes(ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each key: the id (or that it is null), and which of the rows with that id."""
    mixed = _mix(ids.astype(np.int64).view(np.uint64), 1) ^ np.where(nulls, np.uint64(0x5555), np.uint64(0))
    return _mix(mixed + _mix(occurrence.astype(np.uint64), 2), 3)


class PerfectHash:
    """Numbers from 0 without gaps for a fixed set of 64-bit hashes."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        base, self.ranks = 0, []
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64) - 1 + base
            base += int(bits.sum())
            self.ranks.append(rank)
        self.base = base

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left) and len(levels) < _LEVELS:
            size = max(64, int(_SPREAD * len(left)))
            at = (_mix(left, len(levels) + 11) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 or any number for a hash outside the set."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for i, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (_mix(hashes[open_], i + 11) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, hashes[open_])
            hit = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == hashes[open_])
            out[open_[hit]] = self.base + at[hit]
        return out


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each; equal keys are neighbours."""
    at = np.arange(len(keys))
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(keys) else at


def _index(keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    hashes = key_hashes(keys, nulls, _occurrences(keys))
    perfect = PerfectHash.build(hashes)
    slot = perfect(hashes)
    starts = np.cumsum(lengths) - lengths
    table = np.zeros(len(keys), [("mark", "<u4"), ("start", "<u8"), ("length", "<u8")])
    table["mark"][slot] = (_mix(hashes, 7) >> np.uint64(32)).astype(np.uint32)
    table["start"][slot], table["length"][slot] = starts, lengths
    parts = [np.packbits(bits).tobytes() for bits in perfect.levels] + [perfect.rest.astype("<u8").tobytes(), table.tobytes()]
    head = json.dumps({"levels": [len(b) for b in perfect.levels], "rest": len(perfect.rest), "keys": len(keys)}).encode()
    body = head + b"".join(parts)
    return body + len(head).to_bytes(8, "little") + len(body).to_bytes(8, "little")


class TokenFile:
    """A file opened for reading; the index is read at once, ids only where they are asked for."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        end = self.file.size()
        tail = self.file.read_at(17, end - 17)
        self.width, head, body = tail[16], int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        data = self.file.read_at(body, end - 17 - body)
        info, at, levels = json.loads(data[:head]), head, []
        for size in info["levels"]:
            step = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=size).astype(bool))
            at += step
        rest = np.frombuffer(data, "<u8", info["rest"], at)
        self.table = np.frombuffer(data, [("mark", "<u4"), ("start", "<u8"), ("length", "<u8")], info["keys"], at + 8 * info["rest"])
        self.perfect = PerfectHash(levels, rest)

    def find(self, ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether each key is there, and the start and number of its ids."""
        hashes = key_hashes(ids, nulls, occurrence)
        slot = self.perfect(hashes)
        if not len(self.table):
            return slot >= 0, slot, slot
        row = self.table[np.maximum(slot, 0)]
        here = (slot >= 0) & (row["mark"] == (_mix(hashes, 7) >> np.uint64(32)).astype(np.uint32))
        return here, row["start"].astype(np.int64), row["length"].astype(np.int64)

    def ids(self, start: int, length: int) -> bytes:
        """As little-endian unsigned 32-bit integers."""
        data = self.file.read_at(length * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4").tobytes()


def write_token_files(docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of all texts, ``end_id`` after each, in ascending order of ids; the manifest of the files.

    ``file, first_key, documents, ids``, a row per file. Null texts are empty, null ids come first, rows of
    one id are numbered in the order of a hash of their texts. Files are written under names of
    their own by each attempt of a task, and only those in the manifest count, so lost tasks do no harm.
    Ids take two bytes where the vocabulary allows. An empty table gives an empty manifest.
    """
    root = root or f"{working_root(docs.sparkSession)}/corpusfold/{uuid.uuid4().hex}/ids"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-size // shard_bytes)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, inner = fs.FileSystem.from_uri(root)
        out, keys, nulls, lengths, path = None, [], [], [], f"{uuid.uuid4().hex}.ids"
        for batch in batches:
            if out is None:
                store.create_dir(inner, recursive=True)
                out = store.open_output_stream(f"{inner}/{path}")
                out.write(MAGIC)
            for data in encode.stream(batch.column(1)):
                out.write(np.frombuffer(data + end, "<u4").astype(f"<u{width}").tobytes())
                lengths.append(len(data) // 4 + 1)
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            keys.append(batch.column(0).fill_null(LEAST).to_numpy())
        if out is not None:
            all_keys, counts = np.concatenate(keys), np.array(lengths, np.int64)
            out.write(_index(all_keys, np.concatenate(nulls), counts))
            out.write(bytes([width]))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{root}/{path}"]), pa.array([int(all_keys[0])]), pa.array([len(all_keys)]),
                 pa.array([int(counts.sum())])], names=["file", "first_key", "documents", "ids"])

    # By id alone, so that all rows of an id lie in one file.
    return write_shared(rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
                        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
                        .mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the keys asked for, by the index of the file that would hold each.

    ``start`` counts the ids of all documents before. A key that was never written gives no row; a key
    asked for n times gives the first n of the documents written with it.
    """
    spark = manifest.sparkSession
    # MAX_SHARDS rows at most.
    files = sorted(manifest.collect(), key=lambda r: r["first_key"])
    if not files:
        return spark.createDataFrame([], ROWS)
    names, before = [r["file"] for r in files], np.cumsum([0] + [r["ids"] for r in files]).tolist()

    def look_up(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        ids = np.sort(group["doc_id"].fill_null(LEAST).to_numpy())
        n_null = group["doc_id"].null_count
        nulls = np.arange(len(ids)) < n_null
        book = TokenFile(names[shard])
        here, start, length = book.find(ids, nulls, _occurrences(ids))
        ids, nulls, start, length = ids[here], nulls[here], start[here], length[here]
        return pa.table({"doc_id": pa.array(ids, mask=nulls), "start": start + before[shard], "n_tokens": length,
                         "ids": pa.array([book.ids(s, n) for s, n in zip(start.tolist(), length.tolist())], pa.binary())})

    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST))
    shard = range_of([r["first_key"] for r in files][1:], key)
    # A task returns the ids of one part of a file.
    parts = -(-max(r["ids"] for r in files) // PART_IDS)
    return (keys.select(F.col(id_col).cast("bigint").alias("doc_id"), shard.alias("shard"))
            .groupBy("shard", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).applyInArrow(look_up, ROWS))
