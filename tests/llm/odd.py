"""Rows that every document operator has to cope with."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs.\nIt never comes back again to us.", "a", 84),
    (2, None, "a", None),
    (3, "", None, 0),
    (4, " \n\t \n", "b", 5),
    (5, "one", "b", 3),
    (6, LONG, "c", len(LONG)),
    (7, "same text here twice for this row", "a", 33),
    (7, "same text here twice for this row", "a", 33),
    (8, "one id with two texts, this is one", "a", 34),
    (8, "one id with two texts, this is the other", "b", 40),
    (None, "a row without an id", "c", 19),
    (None, None, None, None),
    (9, "é ü 日本語 \x00 \x1c x y", "a", 15),
]
# names that operators use inside
CLASHES = ["_id", "_th", "_row", "_block", "_range", "lines", "_lines", "node", "slot", "_slot", "h", "g", "key", "pattern", "kept", "url"]


def odd_documents(spark, repeat: int = 1):
    df = spark.createDataFrame(ROWS * repeat, SCHEMA)
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHES)])


def no_documents(spark):
    return odd_documents(spark).where("doc_id = -5")


def text_of(row):
    return row[1] or ""


def word(number: int) -> str:
    """A word of letters for each number."""
    return "tree" + str(number).translate(str.maketrans("0123456789", "abcdefghij"))
