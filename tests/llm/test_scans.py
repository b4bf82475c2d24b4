"""Personal data, licences, token counts and benchmark leaks against brute force and planted cases."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from assay.llm import decontamination as dec
from assay.llm.licenses import TEMPLATES, TemplateIndex, align, gram_hashes, license_matches, winnow
from assay.llm.pii import personal_data, score_patterns, spans_text
from assay.llm.queries import QUERIES
from assay.llm.token_counts import LongestMatch, automaton, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and (not 12 <= len(digits) <= 19 or total % 10)
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def test_base_spans_of_the_table(spark, sf_dir, texts):
    found = {r.doc_id: r for r in QUERIES["op1_pii"](spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        want, r = plain_spans(text), found[i]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k, _ in PLAIN]
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) or not want


def test_base_spans_of_strange_texts(spark):
    rng = random.Random(4)
    pieces = ["a@b.co", "x", "@", ".", "-", "+", " ", "1", "22", "255", "256", "1.2.3.4", "4539 1488 0343 6467", "🙂é",
              "4539148803436467", "(555)", "+1 ", "000001.2.3.004", "a.b+c%d@e-f.g-h", "..", "\n", "79927398713", "0"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 14)))) for i in range(1500)]
    rows.append((9999, "7" * 20000 + " " + "a" * 20000 + "@b" + ".c" * 5000))
    found = personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.base for r in found.select("doc_id", spans_text(found.base).alias("base")).collect()}
    assert got == {i: joined(plain_spans(t)) for i, t in rows}


def test_places_of_very_many_matches(spark):
    from pyspark.sql import functions as F

    from assay.llm.pii import base_spans
    words = [f"ü user{i}@host.org" if i % 3 else f"10.0.0.{i % 300}" for i in range(9000)]
    text = "\n".join(words)
    rows = spark.createDataFrame([(text,), ("",), ("a@b.c",)], "text string").select(base_spans(F.col("text"))).collect()
    at, want = 0, []
    for i, w in enumerate(words):
        if i % 3:
            want.append((at + 2, "email", at + len(w)))
        elif i % 300 < 256:
            want.append((at, "ip", at + len(w)))
        at += len(w) + 1
    assert [(s.start, s.kind, s.end) for s in rows[0][0]] == want
    assert rows[1][0] == [] and [(s.start, s.end) for s in rows[2][0]] == [(0, 5)]


def test_contexts_find_what_no_pattern_knows(spark):
    people = [(i, f"some words here mailbox user{i}@host.example.org ends and more text {i % 3}") for i in range(20)]
    unseen = [(100, "now the mailbox joe77-at-host ends and more"), (101, "an address joe77-at-host alone"),
              (102, "the words and 42 more text")]
    found = personal_data(spark.createDataFrame(people + unseen, "doc_id long, text string"))
    added = {r.doc_id: r.found for r in found.select("doc_id", spans_text(found.found).alias("found")).collect() if r.found}
    text = dict(unseen)[100]
    at = text.index("joe77")
    assert added == {100: f"context:{at}:{at + len('joe77-at-host')}"}


def added_spans(spark, rows):
    found = personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r.doc_id: [(s.start, s.end) for s in r.found] for r in found.collect()}
    return {i: [t[a:b] for a, b in got[i]] for i, t in rows if got[i]}


def test_two_sided_contexts_of_common_words(spark):
    rows = [(i, f"Please reach our agent at user{i}@host{i % 4}.org or call back") for i in range(20)]
    rows += [(50, "ü please  reach our agent at\n(jane(at)host.org), or call back"), (51, "please reach our agent at j_doe or call back")]
    rows += [(100 + i, f"we met at noon{'' if i % 2 else ' or'} later, agent or not, at {i} places; call our host") for i in range(60)]
    assert added_spans(spark, rows) == {50: ["jane(at)host.org"], 51: ["j_doe"]}


def test_found_words_induce_patterns(spark):
    rows = [(i, f"mailbox user{i}@host.org ends") for i in range(30)]
    # both contexts share the words j0 to j8; the second never holds a seed
    rows += [(100 + i, f"mailbox j{i} signs here") for i in range(9)]
    rows += [(200 + i, f"the clerk k{i} signs here") for i in range(2)] + [(300, "nobody here signed it")]
    assert added_spans(spark, rows) == {**{100 + i: [f"j{i}"] for i in range(9)}, **{200 + i: [f"k{i}"] for i in range(2)}}


def test_marked_texts(spark):
    from pyspark.sql import functions as F

    from assay.llm.pii import base_spans, marked_text
    texts = ["ü call +1 555 010 9999 now\x01", "a@1.2.3.4 🙂 b@c.de,f@g.hi", "", "none", "x 4539 1488 0343 6467"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        marked_text(F.col("text"), base_spans(F.col("text")))).collect()
    assert [r[0] for r in rows] == ["ü call \x01+1\x02555\x02010\x029999 now\x03", "\x01a@1.2.3.4 🙂 \x01b@c.de,\x01f@g.hi", "",
                                    "none", "x \x014539\x021488\x020343\x026467"]


def test_pattern_scores_by_hand(spark):
    edges = spark.createDataFrame([("p", "a", True, 3), ("p", "x", False, 1), ("q", "x", False, 2)],
                                  "pattern string, filling string, seed boolean, n long")
    totals = spark.createDataFrame([("p", 4), ("q", 4)], "pattern string, total long")
    assert {r.pattern: r.worth for r in score_patterns(edges, totals, 1).collect()} == {"p": 3 / 5}
    two = {r.pattern: round(r.worth, 9) for r in score_patterns(edges, totals, 2).collect()}
    assert two == {"p": round((3 + 0.6) / 5, 9), "q": round(2 * 0.6 / 5, 9)}


def test_personal_data_odd_rows(odd, odd_rows, empty):
    assert sorted((r.doc_id or 0, len(r.base) + len(r.found)) for r in personal_data(odd).collect()) == sorted(
        (i or 0, 0) for i, _ in odd_rows)
    assert personal_data(empty).count() == 0


def test_licences_with_spans(spark):
    notice = TEMPLATES["MIT permission"]
    changed = notice.replace("free of charge, ", "").replace("publish", "print").upper()
    rows = [(1, f"é intro. {TEMPLATES['GPL-3.0']} Then\nlicensed under the apache license,\n version 2.0!"),
            (2, "Some text\n" + changed + "\nmore"), (3, "A license is a license, version 2 of the work is licensed."),
            (4, TEMPLATES["MIT"] + " x " + TEMPLATES["MIT"])]
    found = license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.license, dict(rows)[r.doc_id][r.start:r.end]) for r in found}
    assert {g[:2] for g in got} == {(1, "GPL-3.0"), (1, "Apache-2.0"), (2, "MIT permission"), (4, "MIT")}
    assert (1, "Apache-2.0", "licensed under the apache license,\n version 2.0") in got
    assert len([r for r in found if r.doc_id == 4]) == 2
    partly = next(r for r in found if r.doc_id == 2)
    assert 0.8 < partly.coverage < 1 and rows[1][1][partly.start:partly.end] == changed.rstrip(":")


def test_every_planted_licence_line(spark, sf_dir, texts):
    lines = {k: TEMPLATES[k].rstrip(".") for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    want = Counter((i, k) for i, t in texts.items() for k, v in lines.items() for _ in range(t.count(v)))
    got = Counter((r.doc_id, r.license) for r in QUERIES["op2_licenses"](spark, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_the_longest_common_subsequence_in_the_band(seed):
    rng = np.random.default_rng(seed)
    a, b, shift, band = rng.integers(0, 6, 15), rng.integers(-1, 6, 25), int(rng.integers(-3, 8)), int(rng.integers(0, 6))
    best = np.zeros((16, 26), int)
    for i in range(15):
        for j in range(25):
            same = a[i] == b[j] and abs(j - i - shift) <= band
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + same)
    matched, first, end = align(a, b, shift, band)
    assert matched == best[15, 25]
    assert not matched or (0 <= first < end <= 25 and b[first] in a and b[end - 1] in a)


def test_winnowing_shares_a_fingerprint_of_every_long_enough_run():
    rng = np.random.default_rng(7)
    for _ in range(50):
        run = rng.integers(0, 100, 4)
        texts = [np.r_[rng.integers(-1, 100, rng.integers(0, 9)), run, rng.integers(-1, 100, rng.integers(0, 9))] for _ in range(2)]
        a, b = (set(gram_hashes(t)[winnow(gram_hashes(t))].tolist()) for t in texts)
        assert a & b


def test_licence_edges(odd, empty):
    assert license_matches(odd).count() == 0 and license_matches(empty).count() == 0
    with pytest.raises(ValueError):
        TemplateIndex({"short": "two words"})


def naive_pieces(word, tokens):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(min(len(word) - at, 40), 0, -1) if word[at:at + k] in tokens), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_token_counts_against_naive_longest_match(spark, sf_dir, texts):
    tokens = {base64.b64decode(line.split()[0]) for line in open(PATH, "rb")}
    for r in QUERIES["op3_token_counts"](spark, sf_dir).collect():
        counts = [naive_pieces(b" " + w, tokens) for w in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_tokens, r.longest_word) == (len(counts), sum(counts), max(counts, default=0))


@pytest.mark.parametrize("seed", range(4))
def test_automaton_over_small_vocabularies(seed):
    rng = random.Random(seed)
    tokens = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(12)}
    machine = LongestMatch(tokens)
    for _ in range(300):
        word = bytes(rng.choices(b"abcd", k=rng.randint(0, 12)))
        assert machine.count(word) == naive_pieces(word, tokens), (word, tokens)


def test_token_count_edges(odd, odd_rows, empty):
    found = token_counts(odd, PATH).collect()
    assert [(r.doc_id, r.n_words) for r in found] == [(i, len((t or "").encode().split())) for i, t in odd_rows]
    assert token_counts(empty, PATH).count() == 0 and automaton(PATH).count(b"") == 0


def brute_scores(index, terms):
    scores = Counter()
    for t in terms:
        for p in range(index.firsts[index.starts[t]], index.firsts[index.starts[t + 1]]):
            scores[int(index.items[p])] += float(index.impacts[p])
    return scores


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5])
def test_block_max_wand_retrieves_all_above_the_threshold(spark, sf_dir, texts, threshold):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    [index] = dec.item_indexes(items)
    for text in list(texts.values())[:60]:
        words = dec.words_of(text.encode())
        ids = np.array([index.terms.get(w, -1) for w in words], np.int64)
        got, want = set(), set()
        for start, block in index.passages(ids, 64, threshold):
            terms = np.unique(ids[start:start + 64])
            got |= {(start, i) for i, _ in index.retrieve(terms[terms >= 0].tolist(), block, threshold)}
        for start in range(0, len(words), 32):
            terms = np.unique(ids[start:start + 64])
            scores = brute_scores(index, terms[terms >= 0].tolist())
            want |= {(start, i) for i, s in scores.items() if s >= threshold + 1e-9}
            got -= {(start, i) for i, s in scores.items() if abs(s - threshold) <= 1e-9}
        assert got == want


def test_leaks_of_the_table(spark, sf_dir, texts):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    items = {str(r.item_id): b" ".join(dec.words_of(r.text.encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = {i: b" ".join(dec.words_of(t.encode())) for i, t in texts.items()}
    assert found >= {(i, n) for i, t in plain.items() for n, item in items.items() if item in t}
    clean = {i for i, t in plain.items() if not any(
        item[k:k + 40] in t for item in items.values() for k in range(0, max(1, len(item) - 40), 20))}
    assert not clean & {i for i, _ in found}


def test_leak_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "What is the colour of the sea? It is deep blue green."), (2, None), (None, "x y z"), (3, ""),
                                   (4, "What is the colour of the sea? It is deep blue green.")], "item_id long, text string")
    asked = spark.createDataFrame([(1, "Intro words. what is the COLOUR of the sea it is deep -- blue green, they say"),
                                   (2, "What is the colour of the sea? Nobody knows that at all."), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dec.leaks(asked, items).collect()} == {(1, "1"), (1, "4")}
    assert dec.leaks(odd, items).count() == 0 and dec.leaks(empty, items).count() == 0
    assert dec.leaks(asked, items.where("false")).count() == 0
    many = spark.createDataFrame([(i, f"item {i} asks q{i} r{i} s{i} t{i}. answer u{i} v{i}.") for i in range(50)], "item_id long, text string")
    parts = list(dec.item_indexes(many, postings=100))
    assert len(parts) > 2 and sum(len(p.names) for p in parts) == 50


def test_every_item_is_searched(spark):
    """Repeated and null ids; in one part and in many, kept rows and found rows alike."""
    texts = ["Which river runs through the old mill town? The green river Ards.",
             "Who first crossed the northern ice on foot? The captain Orla Venn.",
             "What metal do the bells of Harrow hold? A little silver and tin."]
    items = spark.createDataFrame([("a", texts[0]), ("a", texts[1]), (None, texts[2]), ("a", texts[0])], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"Some words before. {t} Some words after.", "x") for i, t in enumerate(texts)]
                                 + [(9, "Nothing of the sort is found here.", "y")], "doc_id long, text string, leaks string")
    for postings in (5, 10_000):
        found = dec.leaks(docs, items, postings=postings).collect()
        assert sorted((r.doc_id, r.item_id or "") for r in found) == [(0, "a"), (1, "a"), (2, "")]
        assert [tuple(r)[0::2] for r in dec.without_leaks(docs, items, postings=postings).collect()] == [(9, "y")]
