"""Quotes of awkward lines."""

from gneiss.operators import citations


def test_first_sentence_keeps_digits_of_the_line_number(spark):
    rows = [(1, "0123 is a number that begins a line. More."), (2, "short\n 1 of 2 lines that end with 11"), (3, "short"), (4, None)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: r.s for r in df.select("i", citations.first_sentence(df["text"]).alias("s")).collect()}
    assert got == {1: "0123 is a number that begins a line.", 2: "1 of 2 lines that end with 11", 3: None, 4: None}
