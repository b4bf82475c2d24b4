"""The stages, one by one, against brute force over the rows they were given."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as pipeline
from assay.llm import overlap
from assay.llm.bpe import read_ranks
from assay.llm.decontamination import leaks
from assay.llm.quality import PASS, quality_scores
from assay.session import cut_lineage
from tests.llm.test_dedup import plain_fingerprint, smallest_reachable, squeeze

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def kept(spark, sf_dir, documents):
    """The rows before the first stage and after each."""
    frames = [cut_lineage(documents)]
    for _, stage in pipeline.STAGES:
        frames.append(cut_lineage(stage(spark, frames[-1], sf_dir)))
    return frames


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stages_and_columns(kept, documents):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    for frame in kept[1:-1]:
        assert frame.columns == documents.columns
    assert kept[0].count() > kept[1].count() > kept[2].count() >= kept[3].count() > kept[4].count() == kept[5].count()


def test_quality_stage(spark, sf_dir, kept):
    scores = quality_scores(kept[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in scores.collect() if r.score >= PASS}
    assert rows(kept[1]) == [r for r in rows(kept[0]) if r[0] in good]


def test_exact_stage(kept):
    best = {}
    for r in sorted(rows(kept[1]), key=lambda r: (-len(r[1]), r[0])):
        best.setdefault(squeeze(r[1]), r)
    assert rows(kept[2]) == sorted(best.values())


def plain_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar_reach(texts):
    """{position: smallest position reachable} over all pairs of 5-word Jaccard 0.8 or more."""
    sets, best = [plain_shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)
             if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while any(best[a] != best[b] for a, b in pairs):
        for a, b in pairs:
            best[a] = best[b] = min(best[a], best[b])
    return best


def copies():
    """A text with up to 9 words changed, long and short, and a large group of near copies of it."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    out = [" ".join(words)]
    for n in range(1, 10):
        near = list(words)
        for at in rng.sample(range(200), n):
            near[at] = f"new{n}"
        out.append(" ".join(near))
    other = [f"v{rng.randrange(5000)}" for _ in range(60)]
    for n in range(120):  # a chain: neighbours are alike, the ends are not
        other[n % 60] = f"u{n}"
        out.append(" ".join(other))
    hot = "one line that stands in very many texts of the table "
    return out + [hot * 3 + " ".join(f"x{rng.randrange(9)}" for _ in range(k % 4 + 1)) for k in range(90)] + ["", "a b", "A  b", "c"]


@pytest.mark.parametrize("small, stars", [(32, 3), (2, 1), (1, 0)])
def test_near_stage_against_five_word_jaccard(spark, sf_dir, monkeypatch, small, stars):
    monkeypatch.setattr("assay.llm.overlap.SMALL", small)
    monkeypatch.setattr("assay.llm.overlap.STARS", stars)
    texts = list(dict.fromkeys(copies()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reach = similar_reach(texts)
    got = {r.doc_id for r in pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert got == {i for i in range(len(texts)) if reach[i] == i} and len(got) < len(texts) - 100


def test_near_stage_on_documents(spark, sf_dir, documents):
    before = sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
    reach = similar_reach([t for _, t in before])
    got = {r.doc_id for r in pipeline.near_dedup(spark, documents, sf_dir).collect()}
    assert got == {d for i, (d, _) in enumerate(before) if reach[i] == i}


def test_near_stage_moves_only_texts_that_are_compared(spark, monkeypatch):
    from assay.llm import overlap

    asked, plain = [], overlap.key_bits

    def counted(keys, column, n):
        asked.append(n)
        return plain(keys, column, n)

    monkeypatch.setattr(overlap, "key_bits", counted)
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(20))) for i in range(50)] + [(100, words), (101, words + " end")]
    found = {r.doc_id: r.component_id for r in overlap.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: min(i, 100) for i, _ in rows} and asked == [2]


def test_decontamination_stage(spark, sf_dir, kept):
    found = {r.doc_id for r in leaks(kept[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert rows(kept[4]) == [r for r in rows(kept[3]) if r[0] not in found]


def test_encoding_stage_and_run(spark, sf_dir, kept):
    library = tiktoken.Encoding("own", pat_str=pipeline.public_tokenizers.PATTERN,
                                mergeable_ranks=read_ranks(pipeline.RANKS), special_tokens={})
    want = sorted((r[0], library.encode_ordinary(r[1])) for r in rows(kept[4]))
    got = sorted((r.doc_id, r.ids) for r in kept[5].collect())
    assert got == want and kept[5].where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    assert sorted((r.doc_id, r.ids) for r in pipeline.run(spark, sf_dir).collect()) == want


def test_odd_rows_pass_through_every_stage(spark, sf_dir, odd, empty):
    docs = odd
    for _, stage in pipeline.STAGES[1:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        assert docs.columns == odd.columns
    texts = sorted((r.doc_id or -1, (r.text or "").strip()[:12]) for r in docs.collect())
    # one empty text (the longest, the blank one), one of the long, small and coded ones
    assert texts == [(3, ""), (4, "alpha beta g"), (6, "One small te"), (7, "Ünï cödé 🙂 x")]
    assert pipeline.encode(spark, docs, sf_dir).where("round_trip").count() == 4
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("assay/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert not re.search(r"assay\.llm|corpus_pipeline", path.read_text()), path


def test_sketches_rule_out_only_sets_that_are_apart():
    rng = np.random.default_rng(5)
    for n, m, common in ((0, 0, 0), (1, 0, 0), (1, 1, 1), (40, 50, 40), (900, 1100, 880), (1000, 1000, 0), (130, 128, 100), (3, 700, 2)):
        pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = pool[:n], pool[n - common:n - common + m]
        apart, low = n + m - 2 * common, overlap.least_apart(overlap.sketch(a), overlap.sketch(b))
        assert low <= apart and low == overlap.least_apart(overlap.sketch(b), overlap.sketch(a))
        assert (apart - low) % 2 == 0
        if n == m == 1000:
            assert low > 2 * n / 9  # sets without a common hash are never compared


def test_whole_sets_go_to_pairs_that_may_be_alike(spark, monkeypatch):
    """Texts that share a few frequent shingles meet as candidates, but only their sketches move."""
    rng = np.random.default_rng(6)
    whole = [np.unique(rng.integers(0, 1 << 62, 300, dtype=np.int64)) for _ in range(20)]
    whole.append(np.sort(np.r_[whole[0][:290], whole[1][:10]]))
    sets = spark.createDataFrame(
        [(i, len(h), h.tolist(), bytearray(overlap.sketch(h.view(np.uint64)))) for i, h in enumerate(whole)],
        "node long, n long, hashes array<long>, sketch binary")
    pairs = spark.createDataFrame([(i, j) for j in range(21) for i in range(j)], "a long, b long")
    written, cut = [], overlap.cut_lineage
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: written.append(df.count()) or cut(df))
    assert [tuple(r) for r in overlap._close(pairs, sets, overlap.LEAST).collect()] == [(0, 20)]
    assert written == [1, 1]
