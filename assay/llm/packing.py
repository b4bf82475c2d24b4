"""Rows of token ids for training: best-fit-decreasing packing into rows of one length.

A document longer than a row is split without loss: full rows first, then a rest. Rests and short
documents are taken longest first, each into the open row with the least room that still holds it.
Open rows are kept by their room, and a segment tree over the rooms finds the smallest that is large
enough. Rows are packed in blocks of a bounded number of tokens within a Spark partition, so
documents never move and a task holds one block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.texts import named, text_or_empty

#: tokens of a row, and of a block that is packed at once
ROW, BLOCK = 2048, 1 << 22

SCHEMA = ("shard string, row long, ids binary, n_tokens long, cu_seqlens array<long>, doc_ids array<long>, "
          "doc_offsets array<long>, position_resets array<long>")


class RoomTree:
    """Which rooms open rows have: a segment tree whose leaf ``r`` counts the rows with room ``r``."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, room: int) -> int | None:
        """The smallest room of an open row that is at least ``room``."""
        at = self.size + room
        if self.count[at]:
            return room
        while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(sizes: np.ndarray, row: int = ROW) -> list[list[int]]:
    """Pieces of each row, by number; every size is from 1 to ``row``. Ties: first come, first placed."""
    tree, rooms, rows = RoomTree(row), {}, []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        room = tree.least(size)
        if room is None:
            at, room = len(rows), row
            rows.append([])
        else:
            at = rooms[room].pop()
            tree.add(room, -1)
        rows[at].append(piece)
        if room > size:
            rooms.setdefault(room - size, []).append(at)
            tree.add(room - size, 1)
    return rows


def pack(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", row: int = ROW, pad: int = 0,
         id_bytes: int = 2, block: int = BLOCK) -> DataFrame:
    """Packed rows: (shard, row, ids, n_tokens, cu_seqlens, doc_ids, doc_offsets, position_resets).

    ``ids`` has ``row`` little-endian unsigned integers of ``id_bytes`` (2 or 4) bytes, filled up with
    ``pad`` behind ``n_tokens``. Segment i of a row covers ``cu_seqlens[i]`` to ``cu_seqlens[i + 1]``,
    belongs to ``doc_ids[i]`` and begins ``doc_offsets[i]`` tokens into that document, so all
    documents can be put together again. ``position_resets`` are the places where positions start
    again from 0. ``shard`` names the partition and block. Documents without tokens (null or empty
    lists) fill no segment. Null ids are kept as null; repeated rows are packed as often as they
    occur; an empty table gives no rows. An id that does not fit ``id_bytes`` is an error.
    """
    rows = encoded.select(named(id_col).cast("long").alias("doc_id"),
                          F.coalesce(named(ids_col), F.array().cast("array<int>")).alias("ids"))
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for doc, s, e in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                yield doc, flat[s:e].copy()

    return rows.mapInArrow(_packer(pairs, row, pad, id_bytes, block), SCHEMA)


def pack_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               row: int = ROW, pad: int = 0, id_bytes: int = 2, block: int = BLOCK) -> DataFrame:
    """``pack`` over texts, encoded in the task that packs them, so that ids are never moved.

    ``path`` and ``pattern`` name a rank file and its splitting pattern; texts are encoded without
    special tokens. Null and empty texts fill no segment. Only the two named columns are read.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        encode = _coder(path, pattern).encode_ordinary
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                yield doc.as_py(), np.array(encode(text.as_py()), np.int32)

    return rows.mapInArrow(_packer(pairs, row, pad, id_bytes, block), SCHEMA)


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("rows", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _packer(pairs, row: int, pad: int, id_bytes: int, block: int):
    """The task: documents with their ids, packed a block at a time."""
    if id_bytes not in (2, 4) or row < 1:
        raise ValueError("id_bytes must be 2 or 4, and row at least 1")
    names = ["shard", "row", "ids", "n_tokens", "cu_seqlens", "doc_ids", "doc_offsets", "position_resets"]
    longs = pa.list_(pa.int64())
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), longs, longs, longs, longs]

    def packed(shard: str, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pieces = [(doc, at, ids[at:at + row]) for doc, ids in docs for at in range(0, len(ids), row)]
        order = best_fit(np.array([len(p[2]) for p in pieces], np.int64), row)
        for low in range(0, len(order), 256):
            out = {n: [] for n in names}
            for i, members in enumerate(order[low:low + 256], low):
                own = [pieces[m] for m in members]
                ends = np.cumsum([len(p[2]) for p in own])
                line = np.full(row, pad, np.int64)
                line[:ends[-1]] = np.concatenate([p[2] for p in own])
                if line.min() < 0 or line.max() >= 1 << 8 * id_bytes:
                    raise ValueError(f"a token id does not fit {id_bytes} bytes")
                values = (shard, i, line.astype(f"<u{id_bytes}").tobytes(), int(ends[-1]), [0, *ends.tolist()],
                          [p[0] for p in own], [p[1] for p in own], [0, *ends[:-1].tolist()])
                for n, v in zip(names, values):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, done = TaskContext.get().partitionId(), [], 0, 0
        for doc, ids in pairs(batches):
            held.append((doc, ids))
            size += len(ids)
            if size >= block:
                yield from packed(f"{part}-{done}", held)
                held, size, done = [], 0, done + 1
        if size:
            yield from packed(f"{part}-{done}", held)

    return scan


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files; a row's ``ids`` column is its line of the id matrix."""
    packed.write.parquet(path)
