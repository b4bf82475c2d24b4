"""Hosts, phrases and vector codes beside SQL and brute force, and on odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import queries
from assay.llm.codes import Grid, vector_codes
from assay.llm.collocations import Block, build_filter, collocations, words_of
from assay.llm.hosts import domain_columns, judge_urls
from assay.functions.hot import join_counted
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", ["op11_url_reputation", "op12_collocations", "op13_vector_codes"])
def test_against_sql(name, spark, sf_dir):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


@pytest.mark.parametrize("block", [40, 1 << 22])
def test_phrases_against_sql(spark, sf_dir, block):
    """Lower counts and tiny blocks: phrases that cross from one block into the next count once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sql = queries.ORACLE["op12_collocations"].replace("a >= 100", "a >= 4")
    con = connect(sf_dir)
    if block == 40:
        docs = docs.where("doc_id < 30")
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet' WHERE doc_id < 30")
    assert compare(collocations(docs, least=4, block=block), con, sql) is None


def brute_phrases(rows, least, top):
    """Plain counting, and every longer phrase asked whether it holds the shorter one."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            lowered = lowered.replace(c, "\n")
        for piece in lowered.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    many = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in many.items():
        if any(m == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (m, q), b in many.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))
        ranked += [(lang, i, r[3], r[2], r[4], r[5], r[6], r[1]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def test_phrases_brute_force(spark):
    """Repeated words, other white space, upper case, a hot language, nulls; one word in most places."""
    rng = random.Random(3)
    words = ["the"] * 8 + ["Of", "a", "red", "fox", "ünder", "x\u00a0y", "ran", "off"]
    rows = [(rng.choice(["en", "en", "en", "fr", None]),
             "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r", ", "]) for _ in range(60)))
            for _ in range(60)] + [("en", None), (None, ""), ("fr", " . "), ("xx", "alone")]
    df = spark.createDataFrame([(t, lang, "x", 1) for lang, t in rows], "text string, lang string, phrase string, n int")
    for block in (23, 1 << 22):
        got = sorted(tuple(r) for r in collocations(df, least=5, top=40, block=block).collect())
        assert got == brute_phrases(rows, 5, 40)


def test_only_what_may_be_frequent_leaves_a_task(spark):
    """A pair needs both words to be frequent; a prefix that nothing frequent follows makes no row."""
    known = build_filter(spark.createDataFrame([("en", "a"), ("en", "b"), ("en", "c")], "lang string, phrase string"))
    block = Block("en", [2], known, {})
    block.add(b"a b x1 a x2 c \xff b x3 c a b".split() + [b"\xff"])
    rows = [r for batch in block.rows(0) for r in batch.to_pylist()]
    assert sorted((r["prefix"], r["word"], r["n"]) for r in rows) == [(b"a", [b"b"], [2]), (b"c", [b"a"], [1])]


def test_phrases_of_nothing(spark, empty):
    assert collocations(empty).collect() == []
    one = spark.createDataFrame([(None, None)], "text string, lang string")
    assert collocations(one).collect() == []


def test_long_texts_come_in_chunks():
    text = (b"Aa bb\tcc. " * 300_000)
    words = [w for part in words_of(text) for w in part]
    assert Counter(words) == Counter({b"aa": 300_000, b"bb": 300_000, b"cc": 300_000, b"\xff": 300_001})


def test_big_products(spark):
    """1000 a n passes 64 bits long before the counts do; Spark's decimals stay exact."""
    a, n, l, r = 10 ** 12 + 7, 10 ** 14 + 3, 3 * 10 ** 12, 2 * 10 ** 12 + 1
    big = "decimal(19,0)"
    got = spark.range(1).select(F.call_function("div", F.lit(1000 * a).cast(big) * F.lit(n).cast(big),
                                                F.lit(l).cast(big) * F.lit(r).cast(big)).alias("x")).first().x
    assert got == 1000 * a * n // (l * r)


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, path string")


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net/EN/x"), (3, "https://b.example.com/de/1"),
            (4, "ftp://x.org/fr/"), (5, None), (6, "no scheme"), (7, "http://net?x"), (8, "://u.co.uk:80/a://b"),
            (9, "http://notexample.com/de/"), (7, "http://net?x"), (None, "http://net/"), (10, "http://É.net")]
    rules = queries.RULES
    none = spark.createDataFrame([], "key long, bad boolean")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict)
           for r in judge_urls(urls(spark, [(*r, "x", "x") for r in rows]), none, rules).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/EN/x", "net/", "block"),
        (3, "b.example.com", "/de/1", "example.com/de/", "block"), (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "net", "", None, "allow"),
        (8, "u.co.uk:80", "/a://b", None, "allow"), (9, "notexample.com", "/de/", None, "allow"),
        (None, "net", "/", "net/", "block"), (10, "É.net", "", None, "allow")}


def test_reputation_shrinks(spark):
    """Many bad pages block a host; one of two does not; a new host of a bad domain is blocked."""
    rows, bad = [], []
    for host, n, share in [("a.bad.com", 200, 0.97), ("b.bad.com", 150, 0.95), ("c.bad.com", 180, 0.96), ("d.bad.com", 90, 0.99),
                           *[(f"h{i}.good{i}.org", 60, 0.05) for i in range(40)], ("few.other.net", 2, 0.5)]:
        for _ in range(n):
            page = len(rows)
            rows.append((page, f"http://{host}/{page}", None, None))
            bad.append((page, (page * 7919) % 100 < share * 100))
    rows.append((10 ** 6, "http://new.bad.com/", None, None))
    found = {r.host: r for r in judge_urls(urls(spark, rows), spark.createDataFrame(bad, "key long, bad boolean"), ()).collect()}
    assert {h for h, r in found.items() if r.verdict == "block"} == {"a.bad.com", "b.bad.com", "c.bad.com", "d.bad.com", "new.bad.com"}
    assert found["new.bad.com"].labelled == 0 and found["few.other.net"].labelled == 2
    alike = [(i, i % 20 in (0, 1, 2, 3)) for i in range(4000)] + [(5000, True), (5001, True)]
    rows = [(i, f"http://h{i // 100}.net/", None, None) for i in range(4000)] + [(5000, "http://two.net", None, None), (5001, "http://two.net", None, None)]
    two = judge_urls(urls(spark, rows), spark.createDataFrame(alike, "key long, bad boolean"), ()).where("host = 'two.net'").first()
    assert two.verdict == "allow" and 0.2 < two.bad_share < 0.5  # where hosts hardly differ, two pages say little
    assert judge_urls(urls(spark, []), spark.createDataFrame(bad, "key long, bad boolean"), ()).collect() == []


def test_registered_domains(spark):
    want = {"a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
            "host": ("host", "host"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "me@a.b.org:1": ("b.org", "org"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = domain_columns(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want


def test_join_counted(spark):
    """A key of half the rows and keys of one row meet their figures alike."""
    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(200)], "k long, v long")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    for hot in (1, 3, 10_000):
        got = join_counted(rows, keys, ["k"], "n", hot)
        assert sorted(got.collect()) == sorted(rows.join(keys.drop("n"), "k").collect())


def brute_codes(vectors, entries=256, rounds=4):
    """All distances to all entries, in Python's whole numbers."""
    parts = {i: [[math.floor(1024 * x) for x in v[k * len(v) // 4:(k + 1) * len(v) // 4]] for k in range(4)]
             for i, (_, v) in enumerate(vectors)}
    order = sorted(parts, key=lambda i: vectors[i][0])
    books = [[list(parts[i][k]) for i in order[:entries]] for k in range(4)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(4):
            groups = {}
            for p in parts.values():
                groups.setdefault(nearest(k, p[k])[1], []).append(p[k])
            for i, members in groups.items():
                books[k][i] = [sum(c) // len(members) for c in zip(*members)]
    found = {i: [nearest(k, p[k]) for k in range(4)] for i, p in parts.items()}
    return [([e for _, e in f], sum(d for d, _ in f)) for f in found.values()], ",".join(str(x) for b in books for e in b for x in e)


def test_codes_brute_force(spark):
    """Few entries, ties, repeated rows and odd vectors."""
    rng = np.random.default_rng(5)
    good = [(i, (rng.integers(-6, 6, 8) / 1024).tolist()) for i in range(60)]
    good += [(100 + i, v) for i, (_, v) in enumerate(good[:20])] + [(7, good[3][1])]
    odd = [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (505, [0.0] * 4)]
    labels = [None, "", "a"]
    df = spark.createDataFrame([(i, v, labels[n % 3], "x") for n, (i, v) in enumerate(good + odd)],
                               "vec_id long, embedding array<float>, label string, codes string")
    # of the two rows with id 7 the smaller vector comes first
    ordered = sorted(good, key=lambda r: (r[0], r[1]))
    for entries in (5, 256):
        want, books = brute_codes(ordered, entries)
        got = vector_codes(df, entries=entries).collect()
        assert {r.codebooks for r in got} == {books}
        assert sorted((r.codes, r.error) for r in got) == sorted(want)
        sums = Counter()
        for r in got:
            sums[r.label] += r.error
        assert len(sums) == 3 and all(r.label_error == sums[r.label] for r in got)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes(df).collect() == []
    assert vector_codes(df.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 7, 40, 1000])
def test_grid_is_exact(width):
    """Any width, a memory that overflows, equal entries and far points."""
    rng = np.random.default_rng(width)
    book = rng.integers(-300, 300, (40, 5))
    book[11] = book[3]
    x = np.vstack([rng.integers(-400, 400, (3000, 5)), rng.integers(-30_000, 30_000, (50, 5)), book])
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, distance = Grid(book, width, cells=500).nearest(x)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
