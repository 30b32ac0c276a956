"""Small tables with the awkward cases that every text operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level int, name string, k1 long"


def awkward(spark, extra=()):
    rows = [
        (1, None, "en", "s0"), (2, "", "en", None), (3, " \t\n ", None, "s1"), (4, "a b c d e", "en", "s0"),
        (5, "a b c d e", "en", "s1"), (5, "a b c d e", "en", "s1"), (6, "a  b c d e", "en", "s2"), (7, "abcde " * 9000, "en", "s0"),
        (8, "abcde " * 9000, "en", "s1"), (9, "abcde " * 9000 + "x", "en", "s1"), (10, "É" * 30000, "fr", "s3"), (None, "a b c", None, None), *extra,
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "clash", 3) for i, t, lang, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
