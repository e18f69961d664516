"""Near-duplicate removal where one doc_id has several texts; spellings of assigned secrets."""

import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import jaccard_join, secret_scan  # noqa: E402


def kept(spark, rows, columns="doc_id long, text string", **how):
    got = jaccard_join.deduplicate(spark.createDataFrame(rows, columns), **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


A, B, C = "a b c d e f g h i j", "one two three four five six seven eight", "k l m n o p q r"


def test_no_text_goes_that_exists_nowhere_else(spark):
    assert kept(spark, [(1, A), (5, B), (5, A)]) == [(1, A), (5, B)]
    assert kept(spark, [(5, A), (5, B), (5, C), (3, C)]) == sorted([(3, C), (5, A), (5, B)], key=str)
    # both texts of 5 stand for themselves; a link of one is none of the other
    got = kept(spark, [(5, A), (5, B), (3, A), (9, B)])
    assert len(got) == 2 and {t for _, t in got} == {A, B} and (3, A) in got


def test_each_text_stays_once_and_odd_rows_stay(spark):
    rows = [(i % 4, t) for i, t in enumerate([A, B, C, A, B, C, A, None, "", "  ", B])] + [(None, A), (None, None)]
    got = kept(spark, rows)
    assert sorted(t for i, t in got if i is not None and t and t.strip()) == sorted([A, B, C])
    assert {(i, t) for i, t in got if i is None} == {(None, A), (None, None)} and {t for _, t in got} >= {None, "", "  "}
    assert kept(spark, []) == []


def test_clashing_columns(spark):
    rows = [(5, A, 1, 2, 3, "x"), (5, B, 1, 2, 3, "y"), (1, A, 1, 2, 3, "z")]
    got = jaccard_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, first int, last int, component_id int, n_shingles string"))
    assert got.columns == ["doc_id", "text", "first", "last", "component_id", "n_shingles"]
    assert sorted((r["doc_id"], r["text"], r["n_shingles"]) for r in got.collect()) == [(1, A, "z"), (5, B, "y")]


def near(i):
    words = [f"w{k}" for k in range(120)]
    words[i] = "x"
    return " ".join(words)


def test_near_copies_under_one_id(spark):
    got = kept(spark, [(7, near(i)) for i in (3, 40)] + [(7, B)], size=5, percent=80)
    assert len(got) == 2 and (7, B) in got


@pytest.mark.parametrize("line", [
    'token =      "{}"', "password          : {}", "password := {}", "api key: {}", "Authorization: Bearer {}", "authorization = Basic {}", "access key => '{}'", "private key:\n  {}", "auth: {}", "API-KEY={}", "token :=\t\t{}",
])
def test_spellings_of_assignments(line):
    value = "Zk39dPq81xab"
    text = "first words. " + line.format(value) + "\nlast words"
    assert [text[a:b] for kind, a, b in secret_scan.candidates(text) if kind == "keyed"] == [value]


def test_gaps_of_spaces_are_searched_in_linear_time():
    text = ("token" + " " * 2_000) * 300 + "token = Zk39dPq81x"
    assert [text[a:b] for _, a, b in secret_scan.candidates(text)] == ["Zk39dPq81x"]


def test_coverage_knows_long_words_and_is_quick_on_long_values():
    words = {"internationalisation", "key", "extraordinarily"}
    assert secret_scan.coverage("internationalisation", words) == 1.0
    assert secret_scan.coverage("xkey9extraordinarily--", words) == pytest.approx((3 + 15) / 22)
    assert secret_scan.coverage("k1e2y3", words) == 0 and secret_scan.coverage("", words) == 0
    assert secret_scan.coverage("Ab3dE5" * 200_000, words) == 0
