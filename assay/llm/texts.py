"""What the document operators share: null texts, white space, lower case, folds, fresh names, key filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the white space that separates words: a space and the control characters 9 to 13
WHITE = " \t\n\x0b\x0c\r"
#: bits at most that tell which rows need not be moved to meet some keys (8 MB)
KEY_BITS = 1 << 26


def text_or_empty(column: str) -> Column:
    """The text of a column by its literal name (dots allowed); null counts as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, WHITE, "")


def fold_of(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(named(column).cast("string"), F.lit("")).cast("binary")),
                  F.lit(folds))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_bits(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A bit for the hash of each of ``n`` keys, in bytes: 16 to 32 bits a key, at most ``KEY_BITS``."""
    size = min(KEY_BITS, 1 << max(15, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(size))
    found = keys.groupBy(F.shiftright(at, 15).alias("place")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(1 << 15))).alias("bits"))
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in found.collect():  # size / 32768 rows at most
        bits[r["place"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def may_be_among(bits: np.ndarray, column: str) -> Column:
    """Whether a key of the same type can be one that ``bits`` were made of; never false for one that is."""
    @F.arrow_udf("boolean")
    def run(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return run(F.pmod(F.xxhash64(column), F.lit(8 * len(bits))))
