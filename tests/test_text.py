from pyspark.sql import functions as F

from coppice.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


def test_normalizes_mixed_punctuation(spark):
    assert one(spark, X.normalize_text, "VPN_DOWN!! Für User") == "vpn down für user"
    assert one(spark, X.normalize_text, "  ") == ""
    assert one(spark, X.normalize_text, "ΟΔΟΣ") == "οδοσ"


def test_tokens_count_bytes_and_drop_stopwords(spark):
    words = lambda c: X.tokens(X.normalize_text(c))
    assert one(spark, words, "The ü x user printer für") == ["ü", "printer", "für"]
    assert one(spark, words, "") == []


def test_bigrams_bridge_removed_words(spark):
    assert one(spark, lambda c: X.bigrams(X.tokens(X.normalize_text(c))), "reset of the password portal") == [
        "reset password",
        "password portal",
    ]
    assert one(spark, lambda c: X.bigrams(X.tokens(X.normalize_text(c))), "reset") == []


def test_terms_of_the_worked_example(spark):
    terms = one(spark, X.feature_terms, "Password reset failure")
    assert len(terms) == 16
    assert {"password reset", "char:pass"} <= set(terms)
    assert one(spark, X.feature_terms, "abcd") == ["abcd"]


def test_trim_and_blank(spark):
    assert one(spark, X.trimmed, "\t a b \n") == "a b"
    assert one(spark, X.trimmed, None) == ""
    assert one(spark, X.null_if_blank, "  ") is None
    assert one(spark, X.blank_display, "") == "(blank)"


def test_sentence_case_and_codes(spark):
    assert one(spark, X.sentence_case, "vpn Down") == "Vpn Down"
    assert one(spark, X.sentence_case, "") == "Similar incidents"
    codes = spark.createDataFrame([(0,), (7,), (12345,)], "i long").select(X.cluster_code(F.col("i"))).collect()
    assert [r[0] for r in codes] == ["Unclustered", "C0007", "C12345"]


def test_dates(spark):
    cases = {
        "2024-01-05": "2024-01-05",
        "5.1.2024": "2024-01-05",
        "03/04/2024": "2024-04-03",
        "02/13/2024": "2024-02-13",
        "2024-01-05 10:00": None,
        "": None,
        "soon": None,
    }
    for cell, expected in cases.items():
        got = one(spark, X.parse_date, cell)
        assert (str(got) if got else None) == expected, cell


def test_contains_and_durations(spark):
    assert one(spark, lambda c: X.contains_ignoring_case(c, "PoRt"), "Portal")
    assert one(spark, lambda c: X.contains_ignoring_case(c, ""), "Portal")
    assert [X.format_duration(s) for s in (0.25, 3.5, 125)] == ["250ms", "3.500s", "2m 05s"]
