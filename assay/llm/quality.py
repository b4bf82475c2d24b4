"""A quality score learned from preferences: Bradley-Terry ranking of documents by their shape.

A document of label 1 is preferred to one of label 0. The chance that it wins is the logistic of
the difference of two linear scores, and the weights are fitted to such pairs of all training rows.
What counts as good enough is a quantile of the training scores: the share of label 0 among all training labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.orderstats import quantile_row
from assay.llm.texts import fold_of, key_bits, may_be_among, named, text_or_empty
from assay.session import cut_lineage

#: score from which a document passes
PASS = 0.7
#: bins of byte pairs; training labels that are fitted in the driver, and pairs for each row there
BINS, SMALL, PARTNERS = 512, 1000, 20
#: bins that scores are compared by, and scans at most, where rows are fitted where they lie
STEPS, ROUNDS = 256, 12
#: bytes whose pairs are counted at once; rows whose features a task holds in double precision at once
CHUNK, HELD = 1 << 20, 512
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ",
            b"\t\n\x0b\x0c\r", b".,;:?'\"()-", bytes(range(128, 256))]
FEATURES = BINS + len(_CLASSES) + 8


def features(text: bytes) -> np.ndarray:
    """Shares of byte pairs and byte classes, repetition of words and lines, lengths."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    data, pairs, single = np.frombuffer(text, np.uint8), np.zeros(BINS), np.zeros(256)
    for start in range(0, len(data), CHUNK):
        part = data[start:start + CHUNK + 1].astype(np.int64)
        pairs += np.bincount((part[:-1] * 257 + part[1:] * 31) % BINS, minlength=BINS)
        single += np.bincount(part[:CHUNK], minlength=256)
    out[:BINS] = np.sqrt(pairs / max(1, len(data) - 1))
    share = single / len(data)
    out[BINS:BINS + len(_CLASSES)] = [share[list(c)].sum() for c in _CLASSES]
    words, lines = text.lower().split(), [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    bigrams = list(zip(words, words[1:]))
    out[BINS + len(_CLASSES):] = [
        np.log1p(len(words)), np.log1p(len(lines)), sizes.mean() / 10, sizes.std() / 10,
        len(set(words)) / max(1, len(words)), len(set(bigrams)) / max(1, len(bigrams)),
        len(set(lines)) / max(1, len(lines)), len(re.findall(rb"[A-Za-z\x80-\xff]\b", text)) / len(text)]
    return out


@dataclass(frozen=True)
class QualityModel:
    """Standardised linear score; ``cut`` is the score a document needs, ``scale`` its unit."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; PASS exactly at the cut."""
        raw = ((x - self.mean) / self.std) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) / self.scale, -30, 30)) * (1 - PASS) / PASS)


def fit_pairs(x: np.ndarray, label: np.ndarray, share_bad: float, partners: int = PARTNERS,
              steps: int = 300, decay: float = 1e-3, seed: int = 0) -> QualityModel:
    """Logistic loss on feature differences of (preferred, other) pairs, by Adam on all pairs.

    Without a pair (one label only, or no rows) the weights are zero and every text scores PASS.
    """
    if not len(x):
        x = np.zeros((1, FEATURES), np.float32)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    good, bad, w = np.flatnonzero(label == 1), np.flatnonzero(label == 0), np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return QualityModel(mean, std, w, 0.0, 1.0)
    rng, z = np.random.default_rng(seed), ((x - mean) / std).astype(np.float64)
    win = np.r_[np.repeat(good, partners), rng.choice(good, partners * len(bad))]
    lose = np.r_[rng.choice(bad, partners * len(good)), np.repeat(bad, partners)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s = z @ w
        pull = 1 / (1 + np.exp(np.clip(s[win] - s[lose], -30, 30)))  # chance given to the wrong order
        by_row = (np.bincount(lose, pull, len(z)) - np.bincount(win, pull, len(z))) / len(win)
        grad = by_row @ z + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w - 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    s = z @ w
    weight = np.where(label == 1, (1 - share_bad) / len(good), share_bad / len(bad))
    order = np.argsort(s, kind="stable")
    reach = np.cumsum(weight[order])
    at = int(np.searchsorted(reach, share_bad + 1e-12))
    cut = (s[order[max(0, at - 1)]] + s[order[min(at, len(s) - 1)]]) / 2
    return QualityModel(mean, std, w, float(cut), float(s.std() / 4 + 1e-9))


def _slices(rows):
    """Runs of at most ``HELD`` rows of an array; one empty run of an empty one."""
    return [rows[at:at + HELD] for at in range(0, max(1, len(rows)), HELD)]


def _features_of(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.empty((len(texts), FEATURES), np.float32)
        for i, text in enumerate(texts):
            rows[i] = features(text.as_py())
        offsets = pa.array(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))

    return run(text.cast("binary"))


def _preferred(rows: DataFrame, votes: DataFrame, n: int) -> DataFrame:
    """(id, label, x) of the training rows: one row of an id, of its texts the smallest.

    ``n`` is the number of votes. Only texts whose id can have one are moved to meet it.
    """
    if rows.schema["id"].dataType == votes.schema["id"].dataType:  # equal ids of other types hash apart
        rows = rows.where(may_be_among(key_bits(votes, "id", n), "id"))
    firsts = rows.join(votes, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return firsts.select("id", "label", _features_of(F.col("text")).alias("x"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), HELD):
            part = batch.slice(at, HELD)
            x = pc.list_flatten(part.column("x")).to_numpy(zero_copy_only=False).reshape(len(part), -1)
            yield part.column("label").to_numpy(), x.astype(np.float64)


def _sum_by_key(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """(label, place) -> sum of the vectors of all tasks; the number of keys does not depend on the rows."""
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py()) for v in table["v"]], axis=0)
        return pa.table({"label": table["label"][:1], "place": table["place"][:1], "v": pa.array([total.tobytes()])})

    found = parts.groupBy("label", "place").applyInArrow(add, _PARTS).collect()
    return {(r["label"], r["place"]): np.frombuffer(r["v"]) for r in found}


_PARTS = "label int, place int, v binary"


def _part_batch(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["label", "place", "v"])


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """label -> sums of products of (1, features), in one scan: number, sums and second moments of its rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + FEATURES, 1 + FEATURES))
        for label, x in _arrays(batches):
            x = np.column_stack([np.ones(len(x)), x])
            for value in (0, 1):
                own = x[label == value]
                total[value] += own.T @ own
        yield _part_batch({(v, i): total[v, i] for v in (0, 1) for i in range(1 + FEATURES)})

    found = _sum_by_key(rows.select("label", "x").mapInArrow(add, _PARTS))
    zero = np.zeros(1 + FEATURES)
    return {v: np.array([found.get((v, i), zero) for i in range(1 + FEATURES)]) for v in (0, 1)}


def _binned(rows: DataFrame, mean: np.ndarray, std: np.ndarray, w: np.ndarray, width: float) -> dict[int, np.ndarray]:
    """label -> (number, sums of standardised features) of the rows in each bin of scores, in one scan."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STEPS, 1 + FEATURES))
        for label, x in _arrays(batches):
            z = (x - mean) / std
            at = np.clip(np.floor(z @ w / width + STEPS / 2), 0, STEPS - 1).astype(np.int64)
            np.add.at(total, (label, at), np.column_stack([np.ones(len(z)), z]))
        yield _part_batch({(v, i): total[v, i] for v in (0, 1) for i in range(STEPS) if total[v, i, 0]})

    found = _sum_by_key(rows.select("label", "x").mapInArrow(add, _PARTS))
    zero = np.zeros(1 + FEATURES)
    return {v: np.array([found.get((v, i), zero) for i in range(STEPS)]) for v in (0, 1)}


def fit_all_pairs(rows: DataFrame, share_bad: float, rounds: int = ROUNDS, decay: float = 1e-3) -> QualityModel:
    """The loss of ``fit_pairs`` over all pairs of a preferred and another row of (label, x).

    How strongly a row is pulled depends on its own score and on how the scores of the other label lie,
    so a scan that adds up the rows of each label by bins of their scores gives the gradient of all
    pairs; bins are compared at their mean scores. A step is Newton's, with the curvature between the bins
    and, inside them, that of their pooled second moments; where the loss rises, half of it is taken back.
    What comes to the driver has a fixed size. The cut is the exact quantile of all scores.
    """
    m = _moments(rows)
    both = m[0] + m[1]
    n = both[0, 0]
    if not n:
        return QualityModel(np.zeros(FEATURES), np.full(FEATURES, 1e-6), np.zeros(FEATURES), 0.0, 1.0)
    mean = both[0, 1:] / n
    std = np.sqrt(np.maximum(np.diag(both)[1:] / n - mean ** 2, 0)) + 1e-6
    w = np.zeros(FEATURES)
    if not m[0][0, 0] or not m[1][0, 0]:
        return QualityModel(mean, std, w, 0.0, 1.0)

    def standardised(part: np.ndarray) -> np.ndarray:
        centre = part[0, 1:] / part[0, 0] - mean
        second = part[1:, 1:] / part[0, 0] - np.outer(mean, mean) - np.outer(mean, centre) - np.outer(centre, mean)
        return second / np.outer(std, std)

    bad2, good2 = standardised(m[0]), standardised(m[1])
    spread = (m[0][0, 0] * bad2 + m[1][0, 0] * good2) / n
    last, before = np.inf, w
    for _ in range(rounds):
        width = 12 * np.sqrt(max(w @ spread @ w, 1e-12)) / STEPS
        by_label = _binned(rows, mean, std, w, width)
        (f0, x0), (f1, x1) = ((b[:, 0] / b[:, 0].sum(), b[:, 1:] / np.maximum(b[:, :1], 1)) for b in (by_label[0], by_label[1]))
        apart, pairs = (x1 @ w)[:, None] - (x0 @ w)[None, :], f1[:, None] * f0[None, :]
        loss = (np.logaddexp(0, -apart) * pairs).sum() + decay * (w @ w) / 2
        if loss > last:
            w = (w + before) / 2
            continue
        pull = 1 / (1 + np.exp(np.clip(apart, -30, 30)))
        curve, pull = pull * (1 - pull) * pairs, pull * pairs
        grad = pull.sum(axis=0) @ x0 - pull.sum(axis=1) @ x1 + decay * w
        across = x1.T @ curve @ x0
        bins = (x1.T * curve.sum(axis=1)) @ x1 + (x0.T * curve.sum(axis=0)) @ x0 - across - across.T
        inside = good2 + bad2 - (x1.T * f1) @ x1 - (x0.T * f0) @ x0
        step = np.linalg.solve(bins + curve.sum() * inside + decay * np.eye(FEATURES), grad)
        last, before, w = loss, w, w - step
        if step @ spread @ step <= 1e-4 * (w @ spread @ w):
            break
    scored = cut_lineage(rows.select(_raw_score(mean, std, w)("x").alias("s")))
    facts = quantile_row(scored, {"cut": ("s", share_bad)}, also={"std": F.stddev_pop("s")}).first()
    return QualityModel(mean, std, w, facts["cut"], facts["std"] / 4 + 1e-9)


def _raw_score(mean: np.ndarray, std: np.ndarray, w: np.ndarray):
    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        rows = pc.list_flatten(x).to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return pa.array(np.concatenate([((part - mean) / std) @ w for part in _slices(rows)]))

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 4, held_out: int = 2, small: int = SMALL) -> QualityModel:
    """Learn from all labelled rows whose crc32(id) modulo ``folds`` is not ``held_out``.

    Up to ``small`` training labels are fitted in the driver (``fit_pairs``), more where they lie
    (``fit_all_pairs``); no row is left out of either. Null labels and ids, values other than 0 and 1,
    and ids with contradicting labels are left out; repeated labels and rows count once: of the texts of
    one id the smallest is learned from.
    """
    votes = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(
        F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    votes = cut_lineage(votes.where(fold_of("id", folds) != held_out).select("id", "label"))
    facts = votes.agg(F.avg(1 - F.col("label")), F.count("*")).first()
    share = float(facts[0] or 0.0)
    rows = _preferred(docs.select(named(id_col).alias("id"), text_or_empty(text_col).alias("text")), votes, facts[1])
    if facts[1] > small:
        return fit_all_pairs(cut_lineage(rows.select("label", "x")), share)
    table = rows.toPandas().sort_values("id")  # one row of an id
    x = np.array(table["x"].tolist(), np.float32).reshape(-1, FEATURES)
    return fit_pairs(x, table["label"].to_numpy(), share)


def score_column(model: QualityModel, text_col: str = "text") -> Column:
    """The score of a text, 0 to 1; null counts as empty, and an empty text has a score as well."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        scores = [model.score(np.array([features(t.as_py()) for t in part], np.float32).reshape(-1, FEATURES))
                  for part in _slices(texts)]
        return pa.array(np.concatenate(scores).astype(np.float64))

    return run(text_or_empty(text_col).cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 4, held_out: int = 2,
                   small: int = SMALL) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; see ``fit`` and ``score_column``.

    Scores depend on the text alone. Repeated rows are scored alike; an empty table gives no rows;
    other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col, folds, held_out, small)
    return docs.select(
        named(id_col).alias("doc_id"), (fold_of(id_col, folds) == held_out).alias("held_out"),
        score_column(model, text_col).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= PASS, 1).otherwise(0))
