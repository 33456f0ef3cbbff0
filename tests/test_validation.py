"""Nulls, empties, ties and repeats in what people and collectors hand in."""

import pytest

from plumbline.operators import validation as vl

EDIT = "edit_id long, project long, check_id string, state string, span_ids array<string>"
EDITED = "project long, check_id string, at long, ord long, state string, actor string"
DECISION = "decision_id long, project long, check_id string, decision string, actor string"


@pytest.fixture
def ground(spark):
    return spark.createDataFrame([("1",), ("2",)], "check_id string"), spark.createDataFrame([(1, True), (1, True), (2, False), (3, None)], "project long, unlocked boolean")


def test_edits(spark, ground):
    rows = [
        (1, 1, "1", "pass", ["a", "b"]), (2, 1, "1", "unknown", ["a"]), (3, 1, "1", "claimed", []), (4, 1, "2", "fail", None), (5, 2, "9", "pass", ["a"]), (6, 3, "1", "pass", ["a"]),
        (7, 1, "9", "odd", ["z"]), (8, 1, None, "pass", []), (9, 1, "2", None, ["z"]), (10, 1, "2", "pass", ["a", "y", "z"]), (11, 1, "2", "pass", ["a", None]), (12, None, "1", "pass", []),
    ]
    spans = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "z")], "project long, span_id string")
    got = {r.edit_id: (r.fault, r.filtered_state, r.filtered_spans) for r in vl.edit_faults(spark.createDataFrame(rows, EDIT), spans, *ground).collect()}
    assert got == {
        1: (None, "pass", ["a", "b"]), 2: (None, "unknown", []), 3: (None, "unknown", []), 4: (None, "unknown", None), 5: ("gold locked", None, None), 6: ("gold locked", None, None),
        7: ("unknown check id: 9", None, None), 8: ("unknown check id: ", None, None), 9: ("invalid state: ", None, None), 10: ("unknown span id: y", None, None), 11: ("unknown span id: ", None, None),
        12: ("gold locked", None, None),
    }
    assert vl.edit_faults(spark.createDataFrame([], EDIT), spans, *ground).count() == 0


def test_decisions(spark, ground):
    model = spark.createDataFrame([(1, "1", "pass"), (1, "2", "fail"), (2, "1", "pass")], "project long, check_id string, state string")
    edits = spark.createDataFrame([(1, "2", 5, 1, "claimed", "ann"), (1, "2", 5, 2, "fail", "bob"), (1, "2", 4, 0, "pass", "cy")], EDITED)
    rows = [
        (1, 1, "1", "confirmed", "ann"), (2, 1, "1", "downgraded", "ann"), (3, 1, "1", "rejected", "ann"), (4, 1, "2", "confirmed", "ann"), (5, 1, "2", "confirmed", "bob"),
        (6, 1, "2", "downgraded", "bob"), (7, 2, "1", "confirmed", "bob"), (8, 1, "3", "confirmed", "bob"), (9, 1, "1", "confirmed", None),
    ]
    got = {r.decision_id: (r.fault, r.confirmed_state) for r in vl.decision_faults(spark.createDataFrame(rows, DECISION), model, edits, *ground).collect()}
    assert got == {
        1: (None, "pass"), 2: (None, "claimed"), 3: (None, None), 4: ("cannot decide on own edit", None), 5: (None, "claimed"), 6: ("downgrade only from pass", None), 7: ("gold locked", None),
        8: ("unknown check id: 3", None), 9: (None, "pass"),
    }
    plain = {r.decision_id: r.fault for r in vl.decision_faults(spark.createDataFrame(rows, DECISION), model.where("check_id = '2'"), edits.limit(0), *ground).collect()}
    assert plain[1] == "no model state for 1" and plain[5] == "not a positive: fail"


def test_quotes_differ_in_words_only(spark):
    quotes = [spark.createDataFrame([(1, t) for t in ts], "project long, quote string") for ts in (["A b", " a  B\n", "a.b", "", None], ["a b", "A.B", "c", "﻿"])]
    pages = [spark.createDataFrame([], "project long, url string")] * 2
    states = [spark.createDataFrame(rows, "project long, check_id string, state string") for rows in ([(1, "1", "pass"), (1, "2", "fail"), (1, "3", None)], [(1, "1", "pass"), (1, "4", "fail")])]
    projects = spark.createDataFrame([(1,), (1,), (2,)], "project long")
    got = {r.project: r.asDict() for r in vl.cross_check(projects, tuple(pages), tuple(quotes), tuple(states)).collect()}
    assert (got[1]["left_quotes"], got[1]["right_quotes"], got[1]["shared"], got[1]["checks"], got[1]["agree"], got[1]["jaccard"]) == (2, 3, 2, 3, 1, 1.0)
    assert got[2]["checks"] == 0 and len(got) == 2
    assert vl.cross_check_figure(vl.cross_check(projects.limit(0), tuple(pages), tuple(quotes), tuple(states))).first().asDict() == {"n": 0, "mean_jaccard": 0.0, "agreement": 0.0}


def test_audit_without_records(spark):
    none = spark.createDataFrame([(None, True, None)], "assessable boolean, include boolean, reason string")
    row = vl.screening_audit(none).first()
    assert (row.n, row.assessable, row.not_assessable, row.errors, row.error_rate, row.low, row.high, row.within) == (1, 0, 1, 0, 0.0, 0.0, 0.0, True)
    log = spark.createDataFrame([("excluded", None), ("included", "duplicate")], "kind string, reason string")
    assert [tuple(r) for r in vl.audit_histogram(none, log).collect()] == [("original", "unknown", 1)]


def test_amounts(spark):
    caps = spark.createDataFrame([("s", 5.0, "h", 9.0), ("t", 5.0, "h", 9.0)], "stage string, cap double, host string, host_cap double")
    ledger = spark.createDataFrame([("s", 5.0, 1.0, 2.0, 3.0), ("t", 5.0, 0.0, float("nan"), 0.0), ("u", 1.0, 0.0, 0.0, 0.0)], "stage string, cap double, estimated double, spent double, reserved double")
    got = {r.stage: r.fault for r in vl.budget_ledger(ledger, caps).collect()}
    assert got == {"s": None, "t": "invalid amount", "u": "unknown stage"}
    prices = spark.createDataFrame([("m", 2.0, 3.0, 1.0)], "model string, prompt double, completion double, cached_prompt double")
    calls = spark.createDataFrame([("m:cloud", 4, 1, 3), ("m", 4, 1, None), ("m", 4, 1, 5), ("m", 4, 1, -1), ("x", 4, 1, 1)], "model string, input long, output long, cached long")
    assert sorted(((r.list_cost or -1, r.measured_cost or -1) for r in vl.call_costs(calls, prices).collect())) == [(-1, -1), (11.0, 8.0), (11.0, 11.0), (11.0, 11.0), (11.0, 11.0)]
