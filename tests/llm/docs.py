"""Small documents with the awkward cases: nulls, empty, very long, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, w string, k int"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from a tall and very old oak tree. "
ROWS = [
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 9, "x", 1),
    (3, " \n\t ", "en", "a", 4, 9, "x", 1),
    (4, LONG, "en", "a", len(LONG), 9, "x", 1),
    (5, PROSE * 4, "en", "b", 1, 9, "x", 1),
    (6, PROSE * 4, "en", "b", 1, 9, "x", 1),
    (6, PROSE * 4, "en", "b", 1, 9, "x", 1),
    (7, "na na na na na na na", "en", None, 1, 9, "x", 1),
    (8, "one two", "en", "c", 1, 9, "x", 1),
    (9, "mail a.b@c.org or +49 (30) 123-4567 8 from 10.0.0.255, card 4111 1111 1111 1111", "en", "c", 1, 9, "x", 1),
    (10, "### $$$ %%% &&& ***\nline one\nline one\nline one\n\nline one\r", "en", "ü", 1, 9, "x", 1),
    (None, "Straße x y z Straße x y z", "de", "ü", 1, 9, "x", 1),
]


def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
