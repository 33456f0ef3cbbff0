"""Items of replies and a site's own repositories, case by case."""

import json

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import review as rv


def test_recall_items(spark):
    good = {"checkId": "1", "url": "u", "quote": "q", "state": "pass"}
    raws = {
        "none": None, "blank": " ", "prose": "no json here", "number": "3", "object": '{"a": 1}', "no array": '{"items": {"a": 1}}', "empty": "[]", "empty object": '{"items": []}',
        "bare": json.dumps([good, {**good, "state": "claimed", "quote": "é"}]), "fenced": "x ```json\n" + json.dumps({"items": [good]}) + "\n``` y", "braces": "so " + json.dumps({"items": [good]}) + " there",
        "odd": json.dumps([1, "s", None, {}, {**good, "checkId": "8"}, {**good, "checkId": 1}, {**good, "state": "fail"}, {**good, "url": 5}, {**good, "quote": " \n"}, {**good, "quote": None}]),
        "mixed": json.dumps([1, {**good, "extra": [1]}, {**good, "checkId": "8"}]),
    }
    got = {r.id: (r.outcome, [tuple(x) for x in r["items"]]) for r in rv.recall_items(spark.createDataFrame(list(raws.items()), "id string, raw string"), ["1", "2"]).collect()}
    one = [("1", "u", "q", "pass")]
    assert got == {
        "none": ("unreadable", []), "blank": ("unreadable", []), "prose": ("unreadable", []), "number": ("no items array", []), "object": ("no items array", []), "no array": ("no items array", []),
        "empty": ("empty", []), "empty object": ("empty", []), "bare": ("items", [*one, ("1", "u", "é", "claimed")]), "fenced": ("items", one), "braces": ("items", one), "odd": ("no valid items", []), "mixed": ("items", one),
    }
    assert rv.recall_items(spark.createDataFrame([], "id string, raw string"), ["1"]).collect() == []


def test_own_repository(spark):
    cases = [
        ("https://www.mquark.com/", "m-quark", "x", None, None, True), ("https://mquark.com", "a", "M_Quark", None, False, True), ("https://mquark.com", "mquark", "x", None, True, False),
        ("https://mquark.co.uk", "mquark", "x", None, False, True), ("https://mquark.com", "a", "b", "docs.mquark.com/x", False, True), ("https://mquark.com", "a", "b", "https://other.com", False, False),
        ("https://mquark.com", "a", "b", " ", False, False), ("https://10.0.0.1/", "10001", "10", None, False, False), ("https://me.github.io", "a", "b", "https://you.github.io", False, False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, owner string, repo string, homepage string, fork boolean, want boolean")
    own = tx.own_repository(F.col("owner"), F.col("repo"), F.col("homepage"), F.col("fork"), tx.boundary(F.col("url")))
    assert [r.i for r in df.select("i", "want", own.alias("own")).collect() if r.own != r.want] == []
