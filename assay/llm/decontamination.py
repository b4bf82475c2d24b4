"""Benchmark items found in training text: BM25 over an inverted index of the items.

The index holds test items; the queries are overlapping passages of every training document. An
item's score for a passage is the share of the item's own BM25 score that the passage's words
earn (of an item longer than a passage, the share of what a passage of it earns on average), so
one threshold holds for all items. Block-max WAND skips what cannot reach it: a block of
items by the largest impact of each of the passage's words in that block, then single items by the
same bounds while the posting lists of the block are read. What is retrieved is verified in the text: overlap with the item's question and its answer.

The index is cut into parts by a bound on its postings, statistics being those of all items; each
part is broadcast and visits all documents in turn. Documents never move.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.texts import named, text_or_empty
from assay.session import cut_lineage

#: words of a passage (the next begins half a passage later), and items of a posting block
PASSAGE, BLOCK = 64, 4
#: share of an item's own score that retrieves it; overlaps that verify it
THRESHOLD, QUESTION, ANSWER = 0.5, 0.5, 0.5
#: postings of one broadcast part of the index
POSTINGS = 500_000
#: (passage, word) pairs whose blocks are summed at once
CHUNK = 1 << 18
K1, B, GRAM = 1.2, 0.75, 3
#: bytes of words: ASCII letters in lower case, digits and all bytes beyond ASCII; the rest separates
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

LEAKS = ("array<struct<item_id: string, score: double, question_overlap: double, "
         "answer_overlap: double, start_word: long, end_word: long>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence; of a single sentence the last third."""
    parts = [w for w in map(words_of, re.split(rb"[.!?]+\s", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Word trigrams; of a shorter text the whole."""
    n = min(GRAM, len(words))
    return set(zip(*[words[i:] for i in range(n)])) if n else set()


def overlap(wanted: set[tuple[bytes, ...]], words: list[bytes]) -> float:
    """Share of the wanted grams that occur in the words; nothing wanted is fully found."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    return len(wanted & set(zip(*[words[i:] for i in range(n)]))) / len(wanted)


@dataclass
class _Cursor:
    """The part of a posting list that lies in one block: items ascending, impacts, their maximum."""

    items: np.ndarray
    impacts: np.ndarray
    most: float
    at: int = 0

    def item(self) -> int:
        return int(self.items[self.at])


class ItemIndex:
    """Inverted index of one part of the items; a block is a range of BLOCK neighbouring items.

    ``starts`` has each term's first block entry, ``blocks`` and ``most`` the block and the largest
    impact of each entry, ``firsts`` its first posting.
    """

    def __init__(self, postings: Iterator[tuple[bytes, str, float]], texts: dict[str, bytes],
                 shown: dict[str, str | None] | None = None):
        self.names = sorted(texts)
        #: the item id that is reported for each name
        self.shown = [shown[n] for n in self.names] if shown else self.names
        number = {name: i for i, name in enumerate(self.names)}
        rows = sorted((term, number[name], impact) for term, name, impact in postings)
        self.items = np.array([r[1] for r in rows], np.int64)
        self.impacts = np.array([r[2] for r in rows], np.float64)
        self.terms: dict[bytes, int] = {}
        term = np.array([self.terms.setdefault(r[0], len(self.terms)) for r in rows], np.int64)
        entry = term * (1 + len(self.names) // BLOCK) + self.items // BLOCK
        self.firsts = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if rows else np.empty(0, int)
        self.blocks = self.items[self.firsts] // BLOCK
        self.most = np.maximum.reduceat(self.impacts, self.firsts) if rows else np.empty(0)
        self.starts = np.searchsorted(term[self.firsts], np.arange(len(self.terms) + 1))
        self.firsts = np.r_[self.firsts, len(rows)]
        halves = [question_and_answer(texts[n]) for n in self.names]
        self.asked, self.answers = [grams(q) for q, _ in halves], [grams(a) for _, a in halves]
        self.lengths = [len(q) + len(a) for q, a in halves]

    def passages(self, ids: np.ndarray, passage: int, threshold: float) -> Iterator[tuple[int, int]]:
        """(first word, block) wherever the summed block maxima can reach the threshold."""
        n_blocks = 1 + len(self.names) // BLOCK
        for offset in (0, passage // 2):
            known = offset + np.flatnonzero(ids[offset:] >= 0)
            pairs = np.unique((known - offset) // passage * len(self.terms) + ids[known])  # words count once
            for cut in range(0, len(pairs), CHUNK):  # a passage that is cut in two is seen whole below
                low = cut and cut - min(cut, passage)
                place, word = np.divmod(pairs[low:cut + CHUNK + passage], len(self.terms))
                n = self.starts[word + 1] - self.starts[word]
                entry = np.arange(n.sum()) + np.repeat(self.starts[word] - np.cumsum(n) + n, n)
                key = np.repeat(place - place[0], n) * n_blocks + self.blocks[entry]
                for hit in np.flatnonzero(np.bincount(key, self.most[entry]) >= threshold):
                    yield int(hit // n_blocks + place[0]) * passage + offset, int(hit % n_blocks)

    def retrieve(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of a block whose summed impacts reach the threshold, by WAND."""
        cursors = []
        for term in terms:
            low, high = self.starts[term], self.starts[term + 1]
            at = low + int(np.searchsorted(self.blocks[low:high], block))
            if at < high and self.blocks[at] == block:
                own = slice(self.firsts[at], self.firsts[at + 1])
                cursors.append(_Cursor(self.items[own], self.impacts[own], float(self.most[at])))
        found: list[tuple[int, float]] = []
        while True:
            cursors = sorted((c for c in cursors if c.at < len(c.items)), key=_Cursor.item)
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c.most
                if bound >= threshold:
                    pivot = c.item()
                    break
            if pivot is None:  # what is left cannot reach the threshold
                return found
            if cursors[0].item() == pivot:
                here = [c for c in cursors if c.item() == pivot]
                score = float(sum(c.impacts[c.at] for c in here))
                if score >= threshold:
                    found.append((pivot, score))
                for c in here:
                    c.at += 1
            else:
                for c in cursors:
                    if c.item() >= pivot:
                        break
                    c.at += int(np.searchsorted(c.items[c.at:], pivot))

    def leaks(self, text: bytes, passage: int, threshold: float, question: float,
              answer: float) -> list[dict]:
        """Verified items of a text, each with its best place."""
        words = words_of(text)
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple] = {}
        for start, block in self.passages(ids, passage, threshold - 1e-9) if self.terms else ():
            terms = np.unique(ids[start:start + passage])
            for item, score in self.retrieve(terms[terms >= 0].tolist(), block, threshold - 1e-9):
                low, high = max(0, start - self.lengths[item]), start + passage + self.lengths[item]
                near = words[low:high]
                q, a = overlap(self.asked[item], near), overlap(self.answers[item], near)
                if q >= question and a >= answer:
                    best[item] = max(best.get(item, (-1.0,)), (score, q, a, -low, min(high, len(words))))
        return [{"item_id": self.shown[i], "score": s, "question_overlap": q, "answer_overlap": a,
                 "start_word": -low, "end_word": high} for i, (s, q, a, low, high) in sorted(best.items())]


def item_impacts(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 passage: int = PASSAGE) -> DataFrame:
    """(item_id, term, impact): BM25 impacts of each item's words as shares of its own score.

    Document frequencies, the number of items and their mean length count all items.
    """
    rows = items.select(named(id_col).cast("string").alias("item_id"),
                        text_or_empty(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, tf = words_of(text), defaultdict(int)
                for w in words:
                    tf[w] += 1
                out += [(name, term, n, len(words)) for term, n in tf.items()]
            names, terms, tfs, sizes = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(terms, pa.binary()), pa.array(tfs, pa.int64()),
                 pa.array(sizes, pa.int64())], ["item_id", "term", "tf", "size"])

    counts = cut_lineage(rows.mapInArrow(count, "item_id string, term binary, tf long, size long"))
    sizes = counts.groupBy("item_id").agg(F.max("size").alias("size"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    n, mean = totals["n"], totals["mean"] or 1.0
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    scored = counts.join(df, "term").select("item_id", "term", "size", (idf * tf).alias("raw"))
    own = scored.groupBy("item_id").agg(
        (F.sum("raw") * F.least(F.lit(1.0), passage / F.max("size"))).alias("own"))
    return scored.join(own, "item_id").select("item_id", "term", (F.col("raw") / F.col("own")).alias("impact"))


def item_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 passage: int = PASSAGE, postings: int = POSTINGS) -> Iterator[ItemIndex]:
    """The index in parts of about ``postings`` postings each, one at a time.

    Every different (id, text) row is an item of its own, rows with a null id included, so a
    repeated id loses nothing. Items without a word are left out.
    """
    own_id, body = named(id_col).cast("string"), text_or_empty(text_col)
    name = F.concat(F.coalesce(F.concat(F.lit("+"), own_id), F.lit("-")), F.lit(" "), F.sha2(body, 256))
    texts = cut_lineage(items.select(name.alias("name"), own_id.alias("item_id"), body.alias("text")).distinct())
    impacts = cut_lineage(item_impacts(texts, "name", "text", passage))
    parts = max(1, -(-impacts.count() // postings))
    for i in range(parts):
        own = impacts.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).toArrow()
        if own.num_rows:
            rows = texts.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).toArrow().to_pylist()
            rows = [r for r in rows if words_of(r["text"].encode())]
            yield ItemIndex(zip(own["term"].to_pylist(), own["item_id"].to_pylist(), own["impact"].to_pylist()),
                            {r["name"]: r["text"].encode() for r in rows}, {r["name"]: r["item_id"] for r in rows})


def _leaks_udf(shared, options: tuple[int, float, float, float]):
    @F.arrow_udf(LEAKS)
    def run(texts: pa.Array) -> pa.Array:
        rows = [shared.value.leaks(t.as_py(), *options) for t in texts]
        return pa.array(rows, pa.list_(pa.struct([
            ("item_id", pa.string()), ("score", pa.float64()), ("question_overlap", pa.float64()),
            ("answer_overlap", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])))

    return run


def _scans(docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str,
           passage: int, threshold: float, question: float, answer: float, postings: int) -> Iterator[tuple]:
    """(the column of verified leaks, its broadcast) of one part of the index after the other.

    The driver and the executors hold one part at a time, however many there are: who takes a part
    writes what it found, then releases the broadcast, before the next one is built.
    """
    for index in item_indexes(items, item_id_col, item_text_col, passage, postings):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index
        yield _leaks_udf(shared, (passage, threshold, question, answer))(text_or_empty(text_col).cast("binary")), shared


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", passage: int = PASSAGE, threshold: float = THRESHOLD,
          question: float = QUESTION, answer: float = ANSWER, postings: int = POSTINGS) -> DataFrame:
    """One row for each (document row, benchmark item) that is verified.

    Null and empty texts are clean; an empty item table makes every text clean. Every different
    (id, text) of the items is searched, null ids too (reported as null); items of equal text are
    all reported. Repeated documents are reported alike; other columns are not read. The index is
    searched in parts of about ``postings`` postings; each part's leaks are written before the next.
    """
    found = None
    for column, shared in _scans(docs, items, text_col, item_id_col, item_text_col, passage, threshold,
                                 question, answer, postings):
        part = cut_lineage(docs.select(named(id_col).alias("doc_id"), F.inline(column)))
        shared.unpersist()
        found = part if found is None else found.unionAll(part)
    if found is None:
        none = docs.where(F.lit(False)).select(named(id_col).alias("doc_id"), F.inline(F.array().cast(LEAKS)))
        return none
    return found


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", passage: int = PASSAGE, threshold: float = THRESHOLD,
                  question: float = QUESTION, answer: float = ANSWER, postings: int = POSTINGS) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds no item, with all their columns.

    Between parts of the index the rows that are still clean are written; the last part is a filter.
    """
    last = None
    for column, shared in _scans(docs, items, text_col, item_id_col, item_text_col, passage, threshold,
                                 question, answer, postings):
        if last is not None:
            docs = cut_lineage(docs.where(F.size(last[0]) == 0))
            last[1].unpersist()
        last = column, shared
    return docs if last is None else docs.where(F.size(last[0]) == 0)
