"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from assay.llm.components import components
from assay.llm.exact_dedup import exact_duplicates
from assay.llm.queries import ORACLE, QUERIES
from assay.llm.simhash import fingerprint, fingerprint_links, near_duplicates
from assay.llm.texts import WHITE
from tests.oracle import compare, connect


def squeeze(text):
    return (text or "").translate({ord(c): None for c in WHITE})


def test_exact_against_sql(spark, sf_dir):
    assert compare(QUERIES["op9_exact_dedup"](spark, sf_dir), connect(sf_dir), ORACLE["op9_exact_dedup"]) is None


def check_exact(found, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0))
    assert len(found) == len(rows)
    for body, members in groups.items():
        digest = hashlib.sha256(body.encode()).hexdigest()
        own = [r for r in found if r.text_sha256 == digest]
        best = min(members)
        assert len(own) == len(members) and sum(r.kept for r in own) == 1
        assert {r.group_size for r in own} == {len(members)}
        assert {r.keep_id for r in own} == {None if best[1] else best[2]}
        assert all(r.doc_id == r.keep_id for r in own if r.kept)


def test_exact_odd_rows(odd, odd_rows, empty):
    check_exact(exact_duplicates(odd).collect(), odd_rows)
    assert exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_exact_hot_group_over_many_runs(spark, fan_in):
    rng = random.Random(fan_in)
    rows = [(i, "same  text" if i % 3 == 0 else rng.choice("abcdefgh") * rng.randint(1, 9)) for i in range(600)]
    found = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(11), fan_in=fan_in)
    check_exact(found.collect(), rows)


def test_exact_needs_two_runs_to_merge(odd):
    with pytest.raises(ValueError):
        exact_duplicates(odd, fan_in=1)


def plain_fingerprint(text):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints):
    """{position: smallest position reachable} over all pairs."""
    best = list(range(len(prints)))
    values, changed = np.array(prints, np.uint64), True
    while changed:
        changed = False
        for i, v in enumerate(values):
            low = min(best[j] for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 3))
            changed |= low < best[i]
            best[i] = min(best[i], low)
    return best


def test_near_against_brute_force(spark, sf_dir, texts):
    found = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    best = smallest_reachable(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {
        i: (f"{p:016x}", ids[b]) for i, p, b in zip(ids, prints, best)}


def test_long_texts_are_counted_in_parts(monkeypatch):
    words = [b"%d" % (i % 37) for i in range(500)]
    whole = fingerprint(words)
    monkeypatch.setattr("assay.llm.simhash.CHUNK", 7)
    assert fingerprint(words) == whole
    assert fingerprint([b"a", b"b"]) == xxhash.xxh64_intdigest(b"a b", 42) and fingerprint([]) == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_lose_no_connection(spark, seed):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for center in rng.sample(sorted(prints), 20):  # clouds and chains around some
        for _ in range(20):
            for _ in range(rng.randint(0, 4)):
                center ^= 1 << rng.randrange(64)
            prints.add(center)
    prints = sorted(prints)
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    links = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "bits long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 3 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)
    labels = list(range(len(prints)))
    at = {s: i for i, s in enumerate(signed)}
    for _ in range(len(prints)):
        before = list(labels)
        for r in links:
            low = min(labels[at[r.a]], labels[at[r.b]])
            labels[at[r.a]] = labels[at[r.b]] = low
        if before == labels:
            break
    assert labels == smallest_reachable(prints)


def test_near_odd_rows(odd, odd_rows, empty):
    found = near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    blank = [r for r in found if r.doc_id in (1, 2, 3)]
    assert {r.bits for r in blank} == {0} and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in found if r.doc_id == 6} == {6}
    assert near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        fingerprint_links(near_duplicates(empty), most=4)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(9)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
