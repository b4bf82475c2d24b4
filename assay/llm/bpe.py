"""Byte-level BPE by recursive queries: each Spark task merges and decodes in a DuckDB of its own.

A task splits its texts by the tokenizer's pattern and keeps each distinct word once. Words that are
not a token themselves become rows (word, position, token), one for each byte. A recursive query
joins neighbouring rows to the merge table and contracts, in every word, the leftmost pair of the
smallest rank, until no pair of any word is in the table. Decoding joins token rows to the pieces
and aggregates them in the order of their positions.

DuckDB runs inside the task's Python process, in memory, on one thread and with a memory limit. The
word table is bounded too: when it is full it starts anew.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.texts import named, text_or_empty

#: memory of one task's DuckDB; bytes of words merged in one query; words and chunks kept by a task
MEMORY, MERGED, KEPT = "200MB", 1 << 18, 300_000
#: tokens decoded in one query; bytes from which a word is merged alone, and rounds of such a query
DECODED, LONG, ROUNDS = 1 << 18, 512, 16
#: characters of chunks and words that a task keeps
KEPT_CHARACTERS = 1 << 24
#: white space that is more than one space between two words
_GAP = re.compile(r"(\s{2,}|[^\S ])")

# States of all words, one round after the other. A row is a token at a position of a word, packed as
# word << 32 | position; ``best`` has each word's smallest rank, then leftmost position, packed alike.
MERGE = """
WITH RECURSIVE state(wp, token, round) AS (
    SELECT wp, token, 0 FROM bytes
    UNION ALL
    (WITH best AS (
        SELECT l.wp >> 32 AS word, min(m.merged << 32 | (l.wp & 4294967295)) AS pair
        FROM state l JOIN state r ON r.wp = l.wp + 1 JOIN merges m ON m.pair = (l.token << 32 | r.token)
        GROUP BY 1)
    SELECT s.wp - CASE WHEN (s.wp & 4294967295) > (b.pair & 4294967295) THEN 1 ELSE 0 END,
        CASE WHEN (s.wp & 4294967295) = (b.pair & 4294967295) THEN b.pair >> 32 ELSE s.token END,
        s.round + 1
    FROM state s JOIN best b ON s.wp >> 32 = b.word
    WHERE (s.wp & 4294967295) <> (b.pair & 4294967295) + 1))
SELECT word, token FROM (SELECT wp, token, round, wp >> 32 AS word FROM state)
JOIN (SELECT wp >> 32 AS word, max(round) AS round FROM state GROUP BY 1) USING (word, round)
ORDER BY wp"""

# The same for one long word, so that rounds stay few: a round contracts pairs of the smallest rank
# from the left and without overlaps, up to the first whose new token could at once join a neighbour
# at a smaller rank still. Contracting them one by one would take the same pairs in the same order.
MERGE_LONG = f"""
WITH RECURSIVE state(p, token, round) AS (
    SELECT p, token, 0 FROM bytes
    UNION ALL
    (WITH pairs AS (
        SELECT l.p, m.merged FROM state l JOIN state r ON r.p = l.p + 1
        JOIN merges m ON m.pair = (l.token << 32 | r.token)),
    hits AS (
        SELECT p, merged, p - row_number() OVER (ORDER BY p) AS run FROM pairs
        WHERE merged = (SELECT min(merged) FROM pairs)),
    apart AS (
        SELECT p, merged FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p) AS i FROM hits)
        WHERE i % 2 = 1),
    sooner AS (
        SELECT c.p FROM apart c LEFT JOIN apart e ON e.p = c.p - 2
        LEFT JOIN state x ON x.p = c.p - 1 LEFT JOIN state y ON y.p = c.p + 2
        LEFT JOIN merges before ON before.pair = (coalesce(e.merged, x.token) << 32 | c.merged)
        LEFT JOIN merges after ON after.pair = (c.merged << 32 | y.token)
        WHERE least(before.merged, after.merged) < c.merged),
    chosen AS (SELECT * FROM apart WHERE p <= coalesce((SELECT min(p) FROM sooner), p))
    SELECT row_number() OVER (ORDER BY s.p) - 1, coalesce(c.merged, s.token), s.round + 1
    FROM state s LEFT JOIN chosen c ON c.p = s.p LEFT JOIN chosen d ON d.p + 1 = s.p
    WHERE d.p IS NULL AND s.round < {ROUNDS} AND (SELECT count(*) FROM chosen) > 0))
SELECT token, round FROM state WHERE round = (SELECT max(round) FROM state) ORDER BY p"""

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS bytes FROM tokens JOIN pieces USING (token)
GROUP BY doc ORDER BY doc"""


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file. The single bytes must all be tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no token for the bytes {missing[:5]}")
    return ranks


class Spelled:
    """Token ids of strings, end to end in one array; a string is a number into its starts and sizes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def add(self, strings: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New strings, with the ids of all of them one after the other."""
        first, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * self.used)
        self.ids[first:self.used] = ids
        n = len(self.number)
        if n + len(strings) > len(self.starts):
            self.starts, self.sizes = (np.resize(x, 2 * (n + len(strings))) for x in (self.starts, self.sizes))
        self.sizes[n:n + len(strings)] = sizes
        self.starts[n:n + len(strings)] = first + np.cumsum(sizes) - sizes
        self.number.update(zip(strings, range(n, n + len(strings))))

    def take(self, lists: list[list]) -> list[np.ndarray]:
        """For each list of strings the ids of its strings, joined."""
        if not lists:
            return []
        get = self.number.__getitem__
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        number = np.fromiter((get(x) for strings in lists for x in strings), np.int64, counts.sum())
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[number] - ends + sizes, sizes)]
        return np.split(ids, np.r_[0, ends][np.cumsum(counts)[:-1]])


class ByteBpe:
    """One task's tokenizer: its DuckDB with merge and piece tables, and the words it has met."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pair = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._table("merges", pair=pair, merged=np.array(merged, np.int64))
        # a byte is a character of the same number here, so that pieces may end inside a character
        self._table("pieces", token=np.array(list(self.ranks.values()), np.int64),
                    piece=[t.decode("latin-1") for t in self.ranks])
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.words, self.chunks = Spelled(), Spelled()
        self.spelt: list[bytes] = []  # what the ids of the chunks decode to, as far as it was asked for
        self.size = 0

    def _table(self, name: str, **columns) -> None:
        self.db.register("arrow_rows", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def _merge_long(self, word: bytes) -> np.ndarray:
        tokens = self.single[np.frombuffer(word, np.uint8)]
        while True:
            self._table("bytes", p=np.arange(len(tokens)), token=tokens)
            rows = self.db.sql(MERGE_LONG).to_arrow_table()
            tokens = rows["token"].to_numpy()
            if rows["round"][0].as_py() < ROUNDS:  # the last round found no pair
                return tokens.astype(np.uint32)

    def _merge(self, words: list[bytes]) -> None:
        """Tokens of new words, by as many recursive queries as their bytes need."""
        for word in [w for w in words if len(w) > LONG]:
            ids = self._merge_long(word)
            self.words.add([word], ids, np.array([len(ids)]))
        words, start = [w for w in words if len(w) <= LONG], 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and (end == start or size + len(words[end]) <= MERGED):
                size += len(words[end])
                end += 1
            part, sizes = words[start:end], np.array([len(w) for w in words[start:end]])
            position = np.arange(size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            word = np.repeat(np.arange(len(part)), sizes)
            self._table("bytes", wp=word << 32 | position,
                        token=self.single[np.frombuffer(b"".join(part), np.uint8)])
            rows = self.db.sql(MERGE).to_arrow_table()
            self.words.add(part, rows["token"].to_numpy(), np.bincount(rows["word"].to_numpy(), minlength=len(part)))
            start = end

    def _learn(self, chunks: list[str]) -> None:
        """Tokens of new chunks, each the join of its words' tokens."""
        split = [[w.encode() for w in self.pattern.findall(c)] for c in chunks]
        new = {w for words in split for w in words}.difference(self.words.number)
        whole = [w for w in new if w in self.ranks]
        self.words.add(whole, np.array([self.ranks[w] for w in whole], np.uint32), np.ones(len(whole), np.int64))
        self._merge(sorted(new.difference(whole)))
        ids = self.words.take(split)
        self.chunks.add(chunks, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _chunks_of(self, text: str) -> list[str]:
        """Pieces of a text that the pattern splits alike alone and in place.

        A cut is made before a single space between two characters that are no white space: the
        pattern starts a new word there whatever surrounds it. Other texts stay whole up to such a cut.
        """
        out, open_ = [], ""
        for i, part in enumerate(_GAP.split(text)):
            words = part.split(" ") if i % 2 == 0 else [part]
            open_ += words[0]
            if len(words) > 1:
                out.append(open_)
                out += [" " + w for w in words[1:-1]]
                open_ = " " + words[-1]
        out.append(open_)
        if text[:1] == " ":  # one space at the start or the end of the text is no cut
            out[:2] = ["".join(out[:2])]
        if len(out) > 1 and out[-1] == " ":
            out[-2:] = ["".join(out[-2:])]
        return out

    def _numbered(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of them known."""
        split = [self._chunks_of(t) for t in texts]
        if max(len(self.chunks.number), len(self.words.number)) > KEPT or self.size > KEPT_CHARACTERS:
            self.chunks.clear(), self.words.clear(), self.spelt.clear()
            self.size = 0
        new = {c for chunks in split for c in chunks}.difference(self.chunks.number)
        if new:
            self.size += sum(map(len, new))
            self._learn(sorted(new))
        return split

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        return self.chunks.take(self._numbered(texts))

    def round_trip(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Token ids of each text, and the bytes that they decode to.

        A text's ids are those of its chunks, one after the other, so each different chunk's ids are
        decoded once and a text's bytes are those of its chunks.
        """
        split = self._numbered(texts)
        known, chunks = len(self.spelt), self.chunks
        more = [chunks.ids[s:s + n] for s, n in zip(chunks.starts[known:len(chunks.number)], chunks.sizes[known:len(chunks.number)])]
        self.spelt += self.decode(more)
        get, spelt = chunks.number.__getitem__, self.spelt
        return chunks.take(split), [b"".join([spelt[get(c)] for c in own]) for own in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, in the order of the ids; an unknown id is an error."""
        out: list[bytes] = []
        start = 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and (end == start or size + len(ids[end]) <= DECODED):
                size += len(ids[end])
                end += 1
            out += self._decode(ids[start:end])
            start = end
        return out

    def _decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(x) for x in ids])
        flat = np.concatenate(ids).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
        if len(flat) and not np.isin(np.unique(flat), np.fromiter(self.ranks.values(), np.int64)).all():
            raise ValueError("an id is not in the vocabulary")
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids)), sizes),
                                             "pos": np.arange(len(flat)), "token": flat}))
        rows = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(ids)
        for doc, text in zip(rows["doc"].to_pylist(), rows["bytes"].to_pylist()):
            out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """This Python worker's tokenizer; workers run one task at a time."""
    return ByteBpe(path, pattern)


def _batches(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about ``most`` characters, so a batch stays small."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_column(path: str, pattern: str, text_col: str = "text") -> Column:
    """Token ids of a text as array<int>, as the rank file's tokenizer gives without special tokens.

    Null counts as empty, and an empty text has no tokens. ``path`` must be readable by executors.
    """
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        values, ids = texts.to_pylist(), []
        for start, end in _batches(values):
            ids += tokenizer(path, pattern).encode(values[start:end])
        return _lists(ids)

    return run(text_or_empty(text_col))


def decode_column(path: str, pattern: str, ids: Column) -> Column:
    """The bytes of a column of token ids; a null list counts as empty."""
    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        out, offsets = [], lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        rows = [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
        for start in range(0, len(rows), 256):
            out += tokenizer(path, pattern).decode(rows[start:start + 256])
        return pa.array(out, pa.binary())

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows or [np.empty(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
                     ) -> DataFrame:
    """Every row's id as ``doc_id``, with the named columns: ``n_tokens``; ``ids`` as array<int>;
    ``ids_le``, the ids as little-endian 32-bit integers; ``decoded``, the bytes that the ids decode to;
    ``round_trip``, whether these are the text's.

    Null and empty texts give no tokens and no bytes. Repeated rows and ids are encoded alike. An
    empty table gives no rows. Only the two named columns are read. ``path`` must be readable by
    the executors.
    """
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_le": "binary", "decoded": "binary",
             "round_trip": "boolean"}
    make = {
        "n_tokens": lambda texts, ids, back: pa.array([len(x) for x in ids], pa.int64()),
        "ids": lambda texts, ids, back: _lists(ids),
        "ids_le": lambda texts, ids, back: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
        "decoded": lambda texts, ids, back: pa.array(back, pa.binary()),
        "round_trip": lambda texts, ids, back: pa.array([t.encode() == b for t, b in zip(texts, back)], pa.bool_()),
    }
    decodes = not {"decoded", "round_trip"}.isdisjoint(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _batches(texts):
                some = texts[start:end]
                ids, back = own.round_trip(some) if decodes else (own.encode(some), None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), *[make[c](some, ids, back) for c in columns]],
                    ["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, ", ".join([f"doc_id {kind}", *[f"{c} {kinds[c]}" for c in columns]]))
