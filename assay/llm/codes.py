"""Compressing vectors to a few codebook indexes: product quantisation in whole numbers.

A vector is cut into equal parts, and every part becomes the index of the nearest entry of its
codebook. A round of fitting assigns all parts and moves every entry to the floor of its parts'
mean; each task sums its own parts, so what comes to the driver is the codebooks and nothing else.

Nearest entries are looked up in a grid. A part falls into a coarse cell (a box); the entries that
can be nearest to any point of the box are those whose least distance from it does not exceed the
smallest of all entries' greatest distances. They are worked out once for a cell and kept, and only
they are measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.hot import join_counted
from assay.llm.texts import named

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: cells whose candidates a part keeps in memory; when they are full, all are forgotten
CELLS = 1 << 15
#: components up to this size have distances that 64 bits hold, for up to 2048 of them
LARGEST = 1 << 15
#: numbers that one step of the search holds at once
STEP = 1 << 20


class Grid:
    """The entries of one part's codebook, searched by cells of ``width`` in every component."""

    def __init__(self, entries: np.ndarray, width: int | None = None, cells: int = CELLS) -> None:
        self.entries, self.cells, self.memo = np.asarray(entries, np.int64), cells, {}
        self.width = width or self._width()

    def _width(self) -> int:
        """A third of the usual distance to a neighbouring entry, spread over the components."""
        if len(self.entries) < 2:
            return 1
        e = self.entries[:64].astype(np.float64)
        apart = ((e[:, None] - e[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.inf)
        near = apart.min(axis=1)
        near = near[np.isfinite(near) & (near > 0)]
        return max(1, int(math.sqrt(np.median(near) / e.shape[1]) / 3)) if len(near) else 1

    def candidates(self, boxes: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that no other entry beats everywhere in its box, ascending."""
        found, step = [], max(1, STEP // len(self.entries))
        for at in range(0, len(boxes), step):
            some = boxes[at:at + step]
            least = np.zeros((len(some), len(self.entries)), np.int64)
            most = np.zeros_like(least)
            for one, values in zip(some.T, self.entries.T):  # few intervals a component, so few rows to work out
                starts, place = np.unique(one, return_inverse=True)
                low = starts[:, None] * self.width
                below, above = low - values, values - (low + self.width - 1)
                least += (np.maximum(np.maximum(below, above), 0) ** 2)[place]
                most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[place]
            kept = least <= most.min(axis=1, keepdims=True)
            found += np.split(np.nonzero(kept)[1], np.cumsum(kept.sum(axis=1))[:-1])
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; ties go to the lower index."""
        index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        boxes, cell = np.unique(x // self.width, axis=0, return_inverse=True)
        cell = cell.ravel()
        order = np.argsort(cell, kind="stable")
        sizes = np.bincount(cell, minlength=len(boxes))
        start = 0
        for at in range(0, len(boxes), 4096):  # what these cells keep is dropped with the block
            block, count = boxes[at:at + 4096], sizes[at:at + 4096]
            keys = [b.tobytes() for b in block]
            new = [i for i, key in enumerate(keys) if key not in self.memo]
            if len(self.memo) + len(new) > self.cells:
                self.memo.clear()
                new = list(range(len(keys)))
            self.memo |= zip([keys[i] for i in new], self.candidates(block[new]))
            lists = [self.memo[key] for key in keys]
            rows = order[start:start + int(count.sum())]
            start += len(rows)
            self._measure(x, rows, np.repeat(np.arange(len(lists)), count), lists, index, distance)
        return index, distance

    def _measure(self, x: np.ndarray, rows: np.ndarray, cell: np.ndarray, lists: list[np.ndarray],
                 index: np.ndarray, distance: np.ndarray) -> None:
        """Exact distances of ``rows`` to their cells' candidates only."""
        long = np.array([len(c) for c in lists])
        pool, begins = np.concatenate(lists), np.cumsum(long) - long
        width = long[cell]
        step = max(1, STEP // (len(self.entries) * x.shape[1]) * 4)
        for at in range(0, len(rows), step):
            some, many = rows[at:at + step], width[at:at + step]
            ends = np.cumsum(many)
            firsts = ends - many
            entry = pool[np.arange(ends[-1]) - np.repeat(firsts - begins[cell[at:at + step]], many)]
            gap = np.repeat(x[some], many, axis=0) - self.entries[entry]
            apart = np.einsum("ij,ij->i", gap, gap)
            best = np.minimum.reduceat(apart, firsts)
            # of the candidates at that distance the first: all others count as beyond every index
            index[some] = np.minimum.reduceat(
                np.where(apart == np.repeat(best, many), entry, len(self.entries)), firsts)
            distance[some] = best


def _fit(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))


def _whole(batch: pa.RecordBatch, column: str, parts: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, (row, part, component)."""
    lists = batch.column(column)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(lists), parts, -1)


def first_codebooks(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, component): the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = np.array([r.vector for r in first], np.float64).reshape(len(first), parts, dim // parts)
    return np.floor(x * SCALE).astype(np.int64).swapaxes(0, 1)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry goes to the floor of the mean of the parts that are nearest to it."""
    parts, entries, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book) for book in books]
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _whole(batch, "vector", parts)
            for p, grid in enumerate(grids):
                index, _ = grid.nearest(x[:, p])
                np.add.at(total[p], index, x[:, p])
                count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"])

    found = rows.select("vector").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    columns = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(size)]
    books = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():  # parts * entries
        books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(size)]
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, dim: int | None = None) -> DataFrame:
    """One row per kept vector: vec_id, label, codes (array), error, label_error, codebooks.

    Left out are vectors that are null or hold a null, an infinite or not-a-number component, one
    beyond ``LARGEST`` (whose distances no longer fit 64 bits), or another number of components than
    ``dim`` (by default that of the smallest kept id). Null ids come last among the first entries;
    of equal ids the smaller vector comes first. With fewer vectors than ``entries`` the codebooks
    are shorter. ``error`` is the squared distance summed over the parts, ``label_error`` its sum
    over the rows of the same label (nulls are one label), ``codebooks`` the fitted entries' numbers
    as text. Repeated rows count each and get one row each; an empty table gives no rows; other
    columns are not read.
    """
    rows = vectors.select(named(id_col).alias("vec_id"), named(vector_col).alias("vector"),
                          named(label_col).alias("label")).where(_fit(F.col("vector")) & (F.size("vector") > 0))
    if dim is None:
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
        dim = first[0] if first else parts
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == dim)
    books = first_codebooks(rows, dim, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books)
    text = ",".join(map(str, books.ravel().tolist()))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book) for book in books]
        for batch in batches:
            x = _whole(batch, "vector", parts)
            found = [grid.nearest(x[:, p]) for p, grid in enumerate(grids)]
            index = np.stack([f[0] for f in found], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(list(index), pa.list_(pa.int64())),
                 pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "codes", "error"])

    schema = rows.select("vec_id", "label", F.lit(None).cast("array<long>").alias("codes"),
                         F.lit(None).cast("long").alias("error")).schema
    coded = rows.mapInArrow(codes, schema)
    # nulls are a label of their own, and a join key must not be null
    coded = coded.withColumns({"no_label": F.col("label").isNull(), "key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    labels = coded.groupBy("no_label", "key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_counted(coded, labels, ["no_label", "key"], "n").select(
        "vec_id", "label", "codes", "error", "label_error", F.lit(text).alias("codebooks"))

