"""Whole texts pass through hand-made CSV lines."""

from rarespark.catalog.inputs import with_line_ends, without_line_ends
from rarespark.catalog.queries import csv_whole_text

TEXTS = ["", "a,b", "x" * 40 + ', "quoted", NA,\n\r\nnull,"', "\\n \\s\\\\ \n\\", '"' * 50, "\n" * 70, "y" * 200_000, " padded \t"]


def test_line_marks_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(1)
    rows = df.select("text", without_line_ends(df.text).alias("m"), with_line_ends(without_line_ends(df.text)).alias("back")).collect()
    assert all(r.back == r.text and "\n" not in r.m and "\r" not in r.m for r in rows)


def test_no_text_is_cut(spark, tmp_path):
    rows = [(i, t, "en", len(t)) for i, t in enumerate(TEXTS)] + [(90, None, "de", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.title for r in csv_whole_text(spark, str(tmp_path)).collect()}
    assert got == {i: f'<{t or ""}, "{lang}">' for i, t, lang, _ in rows}
