import itertools
import random

import pytest

from assay.operators.matching import common_subsequences
from assay.functions.similarity import common_subsequence, token_set_ratio
from assay.operators import text as x
from assay.operators import usage as u


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if ch == d else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 90))) for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)


def test_token_set_ratio():
    assert token_set_ratio("what drives profit", "profit what drives drives") == 100
    assert token_set_ratio("profit by region", "profit") == 100
    assert token_set_ratio("", "") == 100 and token_set_ratio("a", "") == 0
    assert token_set_ratio("abc", "xyz") == 0
    # shared "profit" against "profit zzzz": 1 - 5 / 17
    assert token_set_ratio("profit zzzz", "profit qqqqqqqq") == pytest.approx(100 * (1 - 5 / 17))


def words(s):
    return sorted(set("".join(c if c.isalnum() or c == "_" else " " for c in s.lower()).split()))


def brute(new, past, threshold):
    """Every pair scored, none left out beforehand. Rows are (id, text, key) and (id, text, sign, key)."""
    best = {}
    for (i, a, k), (j, b, sign, m) in itertools.product(new, past):
        wa, wb = words(a), words(b)
        if not wa or not wb or k != m:
            continue
        s = token_set_ratio(" ".join(wa), " ".join(wb))
        if s >= threshold and ((i, sign) not in best or (-s, j) < best[(i, sign)]):
            best[(i, sign)] = (-s, j)
    return {k: (j, -s) for k, (s, j) in best.items()}


@pytest.mark.parametrize("hot", [5, 100_000])
def test_nearest_past_questions_equal_brute_force(frame, hot):
    rng = random.Random(11)
    vocabulary = ["revenue"] * 12 + "profit region by month top five products of the what drives cost in".split()
    def sentence():
        return " ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) + rng.choice(["", "?", "!"])
    keys = [None, "", "u1", "u1", "u1"]
    new = [(i, sentence(), rng.choice(keys)) for i in range(40)] + [(99, "??", "u1")]
    past = [(i, sentence(), rng.choice(["positive", "negative"]), rng.choice(keys)) for i in range(80)]
    for by in (None, "user"):
        out = x.similar_questions(frame("id int, text string, user string", new),
                                  frame("id int, text string, sign string, user string", past), hot=hot, by=by).collect()
        got = {(r["id"], r["sign"]): (r["past_id"], r["score"]) for r in out}
        plain = lambda rows: rows if by else [(*r[:-1], 0) for r in rows]
        want = brute(plain(new), plain(past), 65)
        assert got.keys() == want.keys() and len(got) == len(out)
        for k in want:
            assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])


@pytest.mark.parametrize("threshold", [40, 65, 90, 100])
def test_pairs_spelled_alike_without_a_common_word(frame, threshold):
    rng = random.Random(threshold)
    stems = ["profit", "region", "showing", "month", "averages", "über", "x"]
    def sentence():
        return " ".join(rng.choice(stems) + rng.choice(["", "s", "es", "al"]) for _ in range(rng.randint(1, 4)))
    new = [(i, sentence()) for i in range(30)] + [(50, "show profits per regions"), (51, "z" * 150)]
    past = [(i, sentence(), "positive") for i in range(50)] + [(60, "shows profit per region", "positive"), (61, "z" * 140, "positive")]
    out = x.similar_questions(frame("id int, text string", new), frame("id int, text string, sign string", past), threshold)
    got = {(r["id"], r["sign"]): (r["past_id"], r["score"]) for r in out.collect()}
    want = brute([(*r, 0) for r in new], [(*r, 0) for r in past], threshold)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    if threshold == 90:
        assert got[50, "positive"][0] == 60 and got[51, "positive"][0] == 61


def test_common_subsequences_at_once():
    rng = random.Random(1)
    for n in (1, 5, 63, 64, 65, 130, 300):
        a = "".join(rng.choice("abcdeé🙂 ") for _ in range(n))
        others = ["".join(rng.choice("abcdeé🙂z ") for _ in range(rng.randint(0, 200))) for _ in range(30)] + [a, ""]
        assert common_subsequences(a, others).tolist() == [common_subsequence(a, b) for b in others]


def test_tags_take_the_most_confident_rule(frame):
    rules = [("ranking", [r"\btop\b", r"\bbest\b"], 0.86), ("trend", [r"\bover time\b"], 0.87),
             ("summary", [r"\bbest\b"], 0.86)]
    df = frame("q string", [("Top sales over time",), ("the BEST one",), ("hello",), (None,)])
    got = [(r["tag"], r["confidence"]) for r in x.tag_text(df, "q", rules).collect()]
    assert got == [("trend", .87), ("ranking", .86), ("unknown", 0.0), ("unknown", 0.0)]


def test_tokens_and_pairs(frame):
    df = frame("q string", [("Show me units sold, units sold by Région!",), ("a",), ("",)])
    assert [r["tokens"] for r in x.tokens(df, "q").collect()] == [
        ["units", "sold", "région", "units_sold", "sold_units"], [], []]


def test_thresholds(frame):
    df = frame("q string", [("price exceeds 100",), ("ABOVE 50.5 or below 3",), ("at most  7",), ("is 9",)])
    assert [r["threshold"] for r in x.extract_thresholds(df, "q").collect()] == [100.0, 50.5, 7.0, None]


def test_dictionary_lookup(frame):
    df = frame("t string", [("revenue",), ("revenu",), ("zzzz",), ("sale_date",), (None,), ("revenue",)])
    rows = {r["token"]: r for r in x.fuzzy_lookup(df, "t", ["revenue", "region", "sales_date", "sale_data"])
            .collect()}
    assert set(rows) == {"revenue", "revenu", "sale_date"}
    assert rows["revenue"]["best"] == "revenue" and rows["revenue"]["status"] == "clear"
    assert rows["sale_date"]["status"] == "ambiguous"


def test_large_dictionaries_with_aliases(frame):
    """Every token against every name, in a plain double loop; names of more than one word."""
    rng = random.Random(2)
    stems = ["sale", "date", "unit", "price", "order", "region", "cost"]
    names = {f"{rng.choice(stems)}{rng.choice(['_', ' ', ''])}{rng.choice(stems)}{rng.choice(['', 's', i % 7])}": f"col{i % 90}" for i in range(400)}
    tokens = ["".join(rng.choice(stems) + rng.choice(["", "_", " ", "x"]) for _ in range(rng.randint(1, 2))) for _ in range(60)]
    got = {r["token"]: r for r in x.fuzzy_lookup(
        frame("t string", [(t,) for t in tokens] + [("",)]), "t", frame("alias string, entry string", list(names.items()) + [(None, "c")])).collect()}
    for token in set(tokens):
        scores = {}
        for alias, entry in names.items():
            s = token_set_ratio(token, alias)
            if s >= 55:
                scores[entry] = max(s, scores.get(entry, 0))
        order = sorted(scores.items(), key=lambda e: (-e[1], e[0]))
        assert (token in got) == bool(order)
        if order:
            assert got[token]["best"] == order[0][0] and got[token]["score"] == pytest.approx(order[0][1])
            assert got[token]["candidates"] == [e for e, s in order if s >= order[0][1] - 8][:10]


def test_activity_is_not_multiplied_by_the_joins(frame):
    users = frame("user_id int, created_at int", [(1, 5), (2, 9), (3, 1)])
    sessions = frame("session_id int, user_id int", [(1, 1), (2, 1), (2, 1), (3, None)])
    queries = frame("query_id int, user_id int", [(i, 1) for i in range(4)] + [(9, 2)])
    rows = [tuple(r) for r in u.activity_rollup(users, sessions, queries).collect()]
    assert rows == [(2, 9, 0, 1), (1, 5, 2, 4), (3, 1, 0, 0)]


def test_anonymous_feedback_is_one_group(frame):
    feedback = frame("user_id int, sign string", [(1, "positive"), (None, "negative"), (None, "positive")])
    rows = {r["user_id"]: r for r in u.feedback_by_user(
        feedback, frame("user_id int, email string", [(1, "a@b")])).collect()}
    assert rows[None]["total"] == 2 and rows[None]["user_email"] is None
    assert rows[1]["positive"] == 1 and rows[1]["user_email"] == "a@b"


def test_stored_sessions_win(frame):
    schema = "session_id string, name string"
    out = u.merge_sessions(frame(schema, [("a", "stored"), ("x__clean", "stored")]),
                           frame(schema, [("a", "live"), ("b", "live")])).collect()
    assert sorted(tuple(r) for r in out) == [("a", "stored"), ("b", "live")]
