"""Rows that every operator must take: nulls, empties, ties, repeats, long texts, clashing names."""

import pyarrow.dataset as ds

LONG = "alpha beta gamma delta\n" * 3000
HARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"),
    (6, "A\nB\nC\nD\nA\nB\nC\nD"), (7, "a x\n\nb y\nc z\nlast"), (8, "zero\na x\nb y\n\nc z"), (9, LONG), (10, LONG + "end"),
    (11, "x # y | z & 10% <b>" * 9), (12, "é ß 漢字 mixed\u0085 words " * 30), (13, "the of and to " * 40), (None, "no id here"), (14, LONG),
]
SCHEMA = "doc_id long, text string, fp string, words string, lines string, n_chars long"


def hard(spark):
    return spark.createDataFrame([(i, t, "x", None, "y", 0) for i, t in HARD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf):
    return [(r["doc_id"], r["text"]) for r in ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
