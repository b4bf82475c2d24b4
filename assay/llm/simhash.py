"""Near duplicates by SimHash, linked through counts of set bits.

A fingerprint's 64 bits are 32 segments of two bits; the number of set bits of each segment places
it on a grid with 32 coordinates from 0 to 2. One differing bit moves one coordinate by at most
one, so the Manhattan distance on the grid never exceeds the number of differing bits. Three bits
or fewer are at most one grid step apart in the first or in the second 16 coordinates: a range
join of radius one on each half (its *cells*) finds every link, and the fingerprints decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.components import components
from assay.llm.texts import named, text_or_empty
from assay.session import cut_lineage

#: differing bits up to which a grid step in one half is sure to be at most one
MOST_BITS = 3
SEED = 42
#: shingles whose bits are counted at once, which bounds memory for very long texts
CHUNK = 1 << 16


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """Unsigned SimHash of word shingles (fewer words: the whole sequence; none: 0)."""
    if not words:
        return 0
    shingles = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, shingles, CHUNK):
        part = words[start:start + min(CHUNK, shingles - start) + width - 1]
        grams = zip(*[part[i:] for i in range(width)]) if len(part) >= width else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = 3) -> DataFrame:
    """(doc_id, bits, n_words) of every row; ``bits`` is the fingerprint as a signed long."""
    rows = docs.select(named(id_col).alias("doc_id"),
                       text_or_empty(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, sizes = [], []
            for text in batch.column(1):
                words = text.as_py().lower().split()  # of bytes: A-Z and ASCII white space only
                bits.append(fingerprint(words, width))
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(bits, np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int64())], ["doc_id", "bits", "n_words"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, bits long, n_words long")


def _cells(bits: Column) -> Column:
    """The cells a fingerprint visits in each half, as keys (half above 32 packed bits).

    An even number of set bits in the half: its own cell. Odd: its own cell and the cells one step
    away. One step changes parity, so each pair within a step still meets, and the even half of all
    fingerprints needs one row only.
    """
    found = []
    for half in (0, 1):
        part = (F.shiftrightunsigned(bits, 32) if half else bits).bitwiseAND(F.lit(0xFFFFFFFF))
        own = part - F.shiftrightunsigned(part, 1).bitwiseAND(F.lit(0x55555555))  # 16 counts, packed
        tag = F.lit(half << 32)
        steps = [own + tag]
        for i in range(16):
            one, value = F.lit(1 << 2 * i), F.shiftrightunsigned(own, 2 * i).bitwiseAND(F.lit(3))
            steps += [F.when(value < 2, own + one + tag), F.when(value > 0, own - one + tag)]
        odd = F.bit_count(part) % 2 == 1
        found.append(F.when(odd, F.array_compact(F.array(*steps))).otherwise(F.array(own + tag)))
    return F.concat(*found)


def _own(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which rows stand in their own cell."""
    grid = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
    upper = keys >> 32 == 1
    return np.where(upper, grid >> np.uint64(32), grid & np.uint64(0xFFFFFFFF)) == (keys & 0xFFFFFFFF)


def _forest(bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that span each cluster of one cell: at most one for each member.

    From a member to all that are not yet reached, then from those: a dense cloud is reached in a
    few steps and none of its many other links is written.
    """
    left, links = bits, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= most
            if near.any():
                reached = left[near]
                links += [(int(here), int(x)) for x in reached]
                queue += list(reached)
                left = left[~near]
    return links


def fingerprint_links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b): links between different fingerprints of at most ``most`` (0 to 3) differing bits.

    The links connect exactly what all such pairs connect. ``prints`` needs the column ``bits``.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"most must be from 0 to {MOST_BITS}")
    visits = prints.select("bits").distinct().select(
        F.explode(_cells(F.col("bits"))).alias("cell"), "bits")
    ordered = visits.repartition("cell").sortWithinPartitions("cell")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_bits = np.empty(0, np.int64), np.empty(0, np.uint64)

        def flush(keys: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            ends = np.r_[starts[1:], len(keys)].astype(int) if len(keys) else []
            own, links = np.r_[0, np.cumsum(_own(keys, bits))], []
            for s, e in zip(starts, ends):
                if e - s > 1 and own[e] > own[s]:
                    links += _forest(bits[s:e], most)
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.r_[held_keys, batch.column(0).to_numpy()]
            bits = np.r_[held_bits, batch.column(1).to_numpy().view(np.uint64)]
            cut = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on in the next batch
            yield flush(keys[:cut], bits[:cut])
            held_keys, held_bits = keys[cut:], bits[cut:]
        yield flush(held_keys, held_bits)

    return ordered.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, bits, component_id) of every row.

    ``component_id`` is the smallest id reachable over links of at most ``most`` differing bits,
    the row's own included. Null and empty texts have fingerprint 0 and are linked like any other;
    null ids never name a component unless it has no other id. Repeated rows share a component. An
    empty table gives no rows. Other columns are neither read nor returned.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width))
    firsts = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    labels = components(fingerprint_links(firsts, most))
    linked = firsts.join(labels.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first", F.coalesce("label", "bits").alias("label"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    known = linked.join(smallest, "label").select("bits", "component_id")
    return prints.join(known, "bits").select("doc_id", "bits", "component_id")
