"""The registered queries of the document operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.bpe import encode_documents
from assay.llm.codes import vector_codes
from assay.llm.collocations import collocations
from assay.llm.decontamination import leaks
from assay.llm.exact_dedup import exact_duplicates
from assay.llm.hosts import LOWER, SUFFIXES, THRESHOLD, UPPER, Z, judge_urls
from assay.llm.licenses import license_matches
from assay.llm.lm import score_texts
from assay.llm.packing import pack_texts
from assay.llm.pii import KINDS, personal_data, spans_text
from assay.llm.quality import quality_scores
from assay.llm.simhash import near_duplicates
from assay.llm.token_counts import token_counts
from assay.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).alias(k) for k in KINDS]
    counts = [(F.size("base") - c).cast("long").alias(f"n_{k}") for c, k in zip(counts, KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.array_sort(F.concat("base", "found"))).alias("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), RANKS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(
        table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, columns=("n_tokens", "ids_le", "decoded"))
    return found.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


#: what is known of some hosts and paths, as (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: the path of a page names the document that it shows
PAGE_DOCUMENT = "/[a-z][a-z]/([0-9]+)"


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document that its path names is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("key"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    document = F.regexp_extract(F.coalesce("url", F.lit("")), PAGE_DOCUMENT, 1).try_cast("long")
    found = judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES, key=document)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error",
                        F.sha2("codebooks", 256).alias("codebooks_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_licenses": op2_licenses,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_bpe": op5_bpe,
    "op6_lm_scores": op6_lm_scores,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_url_reputation": op11_url_reputation,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}


def _reputation_sql() -> str:
    """Rules first; else the bound of a beta posterior under moment-fitted priors, level by level."""
    def correlation(units: str, prior: str) -> str:
        p = f"greatest(least({prior}, 1 - 1e-6), 1e-6)"
        return (f"(SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 0.5 ELSE least(0.999, greatest(1e-4, "
                f"sum((bad - n * {p}) ** 2 / (n * {p} * (1 - {p})) - 1) / sum(n - 1))) END FROM {units} WHERE n > 0)")
    return rf"""
        WITH cut AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p FROM pages),
        rest AS (SELECT page_id, u, CASE WHEN p > 0 THEN substr(u, p + 3) ELSE '' END AS r FROM cut),
        page AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
            try_cast(regexp_extract(u, '{PAGE_DOCUMENT}', 1) AS bigint) AS key FROM rest),
        known AS (SELECT doc_id AS key, max(CAST(quality = 0 OR toxic = 1 AS int)) AS bad FROM labels
            WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
        hosts AS (SELECT host, count(known.key) AS n, coalesce(sum(bad), 0) AS bad,
            regexp_replace(host, '^.*@|:[0-9]*$', '') AS bare FROM page LEFT JOIN known USING (key) GROUP BY 1),
        named AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^([0-9.]+|\[.*\])$') AS addr FROM hosts),
        level AS (SELECT host, n, bad, addr, bare, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three,
            l[-1] AS last FROM named),
        unit AS (SELECT host, n, bad, CASE WHEN addr THEN bare WHEN two IN {SUFFIXES} THEN two ELSE last END AS suffix,
            CASE WHEN addr THEN bare WHEN two IN {SUFFIXES} OR two = last THEN three ELSE two END AS domain FROM level),
        top AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS prior FROM unit),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM unit, top GROUP BY 1),
        sk AS (SELECT *, {correlation('s', 'prior')} AS rho FROM s),
        sp AS (SELECT suffix, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS prior FROM sk),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior
            FROM unit JOIN sp USING (suffix) GROUP BY 1, 2),
        dk AS (SELECT *, {correlation('d', 'prior')} AS rho FROM d),
        dp AS (SELECT domain, suffix, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS prior FROM dk),
        h AS (SELECT host, n, bad, prior FROM unit JOIN dp USING (domain, suffix)),
        hk AS (SELECT *, {correlation('h', 'prior')} AS rho FROM h),
        hm AS (SELECT host, n, (1 - rho) / rho AS k, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS m FROM hk),
        bound AS (SELECT host, m - {Z} * sqrt(m * (1 - m) / (n + k + 1)) AS bound FROM hm),
        ruled AS (SELECT page_id, host, path, CASE
            WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM page)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow' WHEN bound > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled JOIN bound USING (host)"""


def _collocations_sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {size} AS words, array_to_string(w[i:i + {size - 1}], ' ') AS phrase, count(*) AS a "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {size - 2})) AS i FROM piece) GROUP BY 1, 2, 3"
        for size in range(1, 6))
    return rf"""
        WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?
]')) AS p FROM documents),
        piece AS (SELECT lang, list_filter(string_split_regex(p, '[ 	]+'), lambda x: x <> '') AS w FROM cut),
        every AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY 1),
        f AS (SELECT * FROM ({grams}) WHERE a >= 100),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
        sub AS (SELECT DISTINCT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a FROM (
            SELECT lang, w, a, words, k, unnest(range(1, words - k + 2)) AS i FROM (
                SELECT *, unnest(range(2, words)) AS k FROM cand))),
        kept AS (SELECT c.* FROM cand c LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM sub GROUP BY 1, 2) s
            USING (lang, phrase) WHERE coalesce(100 * most < 100 * c.a, true)),
        cuts AS (SELECT *, unnest(range(1, words)) AS k FROM kept),
        sides AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n,
                CAST((1000 * c.a::hugeint * n::hugeint) // (x.a::hugeint * y.a::hugeint) AS bigint) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
            JOIN every e ON e.lang = c.lang),
        best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
            CAST(n AS bigint) AS n, score FROM best QUALIFY rank <= 2000"""


def _codes_sql() -> str:
    """Four rounds written out: assign, move; then assign once more."""
    def nearest(book: str) -> str:
        return (f"SELECT rid, part, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) ** 2))"
                f"::bigint, 'e': entry}}) AS m FROM part p JOIN {book} b USING (part) GROUP BY 1, 2")
    rounds = ""
    for i in range(4):
        rounds += f"""
        n{i} AS MATERIALIZED ({nearest(f'b{i}')}),
        c{i} AS (SELECT part, entry, list(s ORDER BY pos) AS v FROM (
            SELECT part, m.e AS entry, pos, CAST(floor(sum(x)::hugeint / count(*)) AS bigint) AS s FROM (
                SELECT n.part, n.m, unnest(p.v) AS x, unnest(range(len(p.v))) AS pos FROM n{i} n JOIN part p USING (rid, part))
            GROUP BY 1, 2, 3) GROUP BY 1, 2),
        b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(c.v, b.v) AS v FROM b{i} b LEFT JOIN c{i} c USING (part, entry)),"""
    return f"""
        WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid,
                list_transform(embedding, lambda x: CAST(floor(x::double * 1024) AS bigint)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT rid, k AS part, v[k * len(v) // 4 + 1:(k + 1) * len(v) // 4] AS v
            FROM kept, range(4) t(k)),
        b0 AS (SELECT part, rid - 1 AS entry, v FROM part WHERE rid <= 256),{rounds}
        last AS ({nearest('b4')}),
        coded AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS bigint) AS error
            FROM last GROUP BY 1),
        book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS d FROM b4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
            d AS codebooks_sha256 FROM kept JOIN coded USING (rid), book"""


ORACLE = {
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY body) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k""",
    "op11_url_reputation": _reputation_sql(),
    "op12_collocations": _collocations_sql(),
    "op13_vector_codes": _codes_sql(),
}
