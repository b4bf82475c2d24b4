"""Quality ranking and LM scores: held-out accuracy, exact counts, gradients, one score per token."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from assay.llm import lm, quality, texts
from assay.llm.quality import FEATURES, PASS, features, fit, fit_all_pairs, fit_pairs, quality_scores
from assay.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_rows(spark):
    found = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert len(found) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= PASS) for r in found.values())
    labels = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(q, r) for q, r in labels if r.held_out]
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.9
    good, bad = [r.score for q, r in held if q], [r.score for q, r in held if not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_held_out_labels_change_nothing(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    before, after = (sorted(map(tuple, quality_scores(documents, x).collect())) for x in (labels, flipped))
    assert before == after


def test_quality_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, 0), (7, None), (None, 1), (2, 0), (2, 1), (99, 5)], "doc_id long, quality int")
    found = quality_scores(odd, labels, held_out=-1).collect()
    assert [r.doc_id for r in found] == [i for i, _ in odd_rows]
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert quality_scores(empty, labels).count() == 0
    alone = quality_scores(odd, labels.where("quality = 1"), held_out=-1).collect()
    assert {r.predicted for r in alone} == {1}  # without a preference nothing is rejected


def test_repeated_ids_reach_the_driver_once_whatever_their_order(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    collected, plain = [], DataFrame.toPandas

    def counted(frame):
        collected.append(plain(frame))
        return collected[-1]

    monkeypatch.setattr(DataFrame, "toPandas", counted)
    rows = [(1, "good text number one"), (2, "BAD!!! 9 9 9"), *[(1, f"other text {n} !!") for n in range(300)], (3, "fine words here")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    models = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        models.append(fit(docs, labels, held_out=-1))
        assert sorted(collected[-1]["id"]) == [1, 2, 3]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].cut == models[1].cut
    one = spark.createDataFrame([(1, min(t for i, t in rows if i == 1)), *[r for r in rows if r[0] > 1]], "doc_id long, text string")
    assert np.array_equal(fit(one, labels, held_out=-1).mean, models[0].mean)


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_only_texts_that_can_have_a_label_are_moved(spark, monkeypatch, most):
    monkeypatch.setattr(texts, "KEY_BITS", most)
    votes = spark.range(0, 60000, 3).withColumnRenamed("id", "n").selectExpr("n AS id", "1 AS label")
    rows = spark.range(60000).selectExpr("if(id % 1000 = 1, null, id) AS id", "'x' AS text")
    moved = rows.where(texts.may_be_among(texts.key_bits(votes, "id", 20000), "id"))
    assert moved.join(votes, "id").count() == rows.join(votes, "id").count() > 19000
    assert moved.count() < (25000 if most > 1 << 15 else 45000)
    found = quality._preferred(rows.limit(300).selectExpr("cast(id AS int) AS id", "text"), votes, 20000)
    assert found.count() == rows.limit(300).join(votes, "id").count()  # ids of another type


def test_pairs_learn_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    label = (x @ np.array([2, -1, 0, 0, 1]) > 0.8).astype(int)
    model = fit_pairs(x, label, float(1 - label.mean()))
    assert ((model.score(x) >= PASS) == (label == 1)).mean() > 0.95


def test_all_training_rows_are_fitted_where_they_lie(spark, monkeypatch):
    """The gradient of the loss over all pairs vanishes, and no row comes to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(2)
    x = np.zeros((300, FEATURES))
    x[:, :6] = rng.normal(size=(300, 6))
    label = (x[:, :6] @ np.array([2, -1, 0, 0, 1, 0]) + rng.normal(size=300) > 0.5).astype(int)
    rows = spark.createDataFrame([(int(y), v.tolist()) for y, v in zip(label, x)], "label int, x array<float>")
    monkeypatch.setattr(DataFrame, "toPandas", None)
    model = fit_all_pairs(rows.repartition(5), float(1 - label.mean()))
    z = (x.astype(np.float32) - model.mean) / model.std
    good, bad = z[label == 1], z[label == 0]
    pull = 1 / (1 + np.exp((good @ model.weights)[:, None] - (bad @ model.weights)[None, :])) / (len(good) * len(bad))
    grad = pull.sum(axis=0) @ bad - pull.sum(axis=1) @ good + 1e-3 * model.weights
    assert np.abs(grad).max() < 2e-3 < np.abs(bad.mean(axis=0) - good.mean(axis=0)).max() / 2
    assert ((model.score(x) >= PASS).mean() - label.mean()) < 0.01
    again = fit_all_pairs(rows.repartition(2), float(1 - label.mean()))
    assert np.allclose(again.weights, model.weights, atol=1e-6) and abs(again.cut - model.cut) < 1e-6


def test_quality_holds_few_rows_at_once(monkeypatch):
    """Tasks take batches of any size in runs of HELD rows; the rows and their scores are the same."""
    rng, n = np.random.default_rng(3), 40
    x, label = rng.normal(size=(n, FEATURES)).astype(np.float32), rng.integers(0, 2, n).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(label), pa.array(x.tolist(), pa.list_(pa.float32()))], ["label", "x"])
    monkeypatch.setattr(quality, "HELD", 16)
    parts = list(quality._arrays([batch, batch.slice(0, 0)]))
    assert [len(a) for a, _ in parts] == [16, 16, 8]
    assert (np.concatenate([a for a, _ in parts]) == label).all() and (np.concatenate([b for _, b in parts]) == x).all()
    assert [len(p) for p in quality._slices(x)] == [16, 16, 8] and [len(p) for p in quality._slices(x[:0])] == [0]


def test_quality_of_held_out_rows_fitted_where_they_lie(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), labels, small=0)
    held = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.quality == r.predicted for r in held) / len(held) > 0.9


def test_features_of_long_texts_do_not_depend_on_parts(monkeypatch):
    text = ("Some wörds, and lines.\n" * 300).encode()
    whole = features(text)
    monkeypatch.setattr("assay.llm.quality.CHUNK", 11)
    assert np.allclose(features(text), whole) and not features(b"").any() and len(whole) == FEATURES


def test_lm_counts_and_base_against_brute_force(spark):
    found = {r.doc_id: r for r in QUERIES["op6_lm_scores"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in rows}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert -12 * len(ws) * 3 < r.score < 0
    uniform = -math.log10(50257)
    mean = sum(found[i].score for i in held) / sum(len(public_ids(words[i])) for i in held)
    assert mean > uniform / 1.8  # far better than guessing among the ids, on texts not learned from


def public_ids(words):
    speller = public_ids.__dict__.setdefault("speller", lm.Speller(PATH, PATTERN))
    return speller.texts([[w for w in words if w is not None]])[0]


def test_words_spelled_together_are_spelled_as_alone():
    speller = lm.Speller(PATH, PATTERN)
    texts = ["plain words, and 12-34 more's", "ünï cödé 🙂 中文", "a\xa0b \u3000c d\u3000 e", "", "\x1c \x85 x"]
    for text in texts:
        words = text.encode().lower().split()
        alone = [speller.coder.encode_ordinary(" " + w.decode()) for w in words]
        assert speller.texts([words])[0].tolist() == [i for ids in alone for i in ids] + [speller.end]


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 50257).astype(float)
    alphabet = lm.Alphabet.of(counts, lm.vocabulary(PATH, PATTERN)[2])
    return alphabet, lm.first_weights(alphabet, seed) * 1.5, rng


def test_ids_have_a_distribution_and_each_is_scored_once():
    alphabet, flat, rng = small_model()
    assert np.allclose(np.bincount(alphabet.group, np.exp(alphabet.share)), 1)
    model = lm.AttentionModel(flat, alphabet)
    x, target, text = lm.windows([rng.integers(0, 50257, n).astype(np.int32) for n in (1, 16, 17, 100)], alphabet.unit, model.start)
    assert np.bincount(text, (target >= 0).sum(axis=1)).tolist() == [1, 16, 17, 100]
    every = np.zeros(len(x))
    for group in range(lm.CLASSES):  # one id of each class stands for the class
        one = np.flatnonzero(alphabet.group == group)[0]
        every += np.exp(model.ids(x, np.full_like(target, one)) - alphabet.share[one])[:, 3]
    assert np.allclose(every, 1, atol=1e-4)


def test_no_look_ahead_and_overlap():
    alphabet, flat, rng = small_model(1)
    model = lm.AttentionModel(flat, alphabet)
    ids = rng.integers(0, 50257, 60).astype(np.int32)
    x, target, _ = lm.windows([ids], alphabet.unit, model.start)
    changed = ids.copy()
    changed[41] = (changed[41] + 77) % 50257
    y, other, _ = lm.windows([changed], alphabet.unit, model.start)
    a, b = model.ids(x, target).ravel()[:60], model.ids(y, other).ravel()[:60]
    assert np.allclose(a[:41], b[:41]) and not np.allclose(a[42:58], b[42:58])


def test_attention_model_agrees_with_its_training_form_and_gradient():
    alphabet, flat, rng = small_model(2)
    trainer, model = lm.Trainer(flat, alphabet), lm.AttentionModel(flat, alphabet)
    x, target, _ = lm.windows([rng.integers(0, 50257, 70).astype(np.int32)], alphabet.unit, model.start)
    loss, grad = trainer.gradient(x, target)
    classes = model.ids(x, target)[target >= 0] - alphabet.share[target[target >= 0]]
    assert math.isclose(loss, -classes.mean(), rel_tol=1e-4)
    trainer.flat = trainer.flat.astype(np.float64)
    for at in rng.choice(np.flatnonzero(np.abs(grad) > 1e-4), 25):
        kept, step = trainer.flat[at], 1e-4
        trainer.flat[at] = kept + step
        up = trainer.gradient(x, target)[0]
        trainer.flat[at] = kept - step
        down = trainer.gradient(x, target)[0]
        trainer.flat[at] = kept
        assert math.isclose((up - down) / (2 * step), grad[at], rel_tol=0.02, abs_tol=1e-5)
    big = lm.AttentionModel(flat * 40, alphabet)
    assert not big.small and np.isfinite(big.ids(x, target)).all()


def test_training_lowers_the_loss():
    alphabet, flat, _ = small_model(3)
    ids = np.tile(np.arange(9, dtype=np.int32) * 31, 60)
    trainer = lm.Trainer(flat, alphabet)
    x, target, _ = lm.windows([ids], alphabet.unit, len(lm.unpack(flat)["embed"]) - 1)
    losses = [trainer.step(x, target) for _ in range(60)]
    assert losses[-1] < losses[0] / 4


def test_every_training_text_is_walked_once(spark):
    alphabet, flat, _ = small_model(4)
    for n in range(3):  # alone, a text that is left out would leave the weights as they are
        texts = spark.createDataFrame([(5 * n, f"text number {n} of some words".encode())], "mark long, text binary")
        moved = [not np.array_equal(lm.fit_round(texts, flat, alphabet, PATH, PATTERN, turn), flat)
                 for turn in range(lm.ROUNDS)]
        assert moved == [turn == n % lm.ROUNDS for turn in range(lm.ROUNDS)]


def test_scores_do_not_depend_on_the_layout(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 3000)  # several shards
    few, many = (sorted(map(tuple, lm.score_texts(d, PATH, PATTERN).collect()))
                 for d in (documents.coalesce(1), documents.repartition(5, "text")))
    assert [r[:5] for r in few] == [r[:5] for r in many]
    assert np.allclose([r[5:] for r in few], [r[5:] for r in many], rtol=1e-6)


def test_lm_odd_rows(odd, odd_rows, empty):
    found = lm.score_texts(odd, PATH, PATTERN).collect()
    assert len(found) == len(odd_rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score_texts(empty, PATH, PATTERN).count() == 0
    held = lm.score_texts(odd.where("doc_id = 4"), PATH, PATTERN, folds=1, held_out=0).first()
    assert held.train_tokens == 0 and held.n_known == 0 and held.held_out
