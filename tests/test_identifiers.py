"""Identifier scans, suffix rules and whitelists, against plain code and the cases that must not leak."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import pages as pg
from plumbline.operators import domains, identifiers


def plain_hits(text, ids):
    t = text.lower()
    sides = {"title": "a-z0-9", "hostname": "a-z0-9-", "hn-id": "0-9"}
    whole = lambda rule, v: v in t if rule == "url" else re.search(f"(?<![{sides[rule]}]){re.escape(v)}(?![{sides[rule]}])", t)
    return {(rule, v.lower()) for rule, v in ids if v and whole(rule, v.lower())}


def frames(spark, texts, ids):
    return spark.createDataFrame(list(enumerate(texts)), "file long, text string"), spark.createDataFrame(ids, "rule string, value string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_scan_equals_plain_search(spark, block_bytes):
    rng = random.Random(1)
    words = ["ab", "a", "abab", "é", "日本", "日本語アプリ", "t.me", "a-b.c", "12", "123", "x y", "Ab"]
    rules = ["title", "hostname", "hn-id", "url"]
    ids = [(rng.choice(rules), rng.choice(words) + rng.choice(["", "", rng.choice(words)])) for _ in range(60)] + [("title", ""), ("title", None), ("other", "ab")]
    texts = ["".join(rng.choice([*words, " ", "-", ".", "\n", "Z"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", None]
    files, given = frames(spark, texts, ids)
    known = [(r, v) for r, v in ids if v and r != "other"]
    numbers = {r.id: (r.rule, r.v) for r in identifiers.numbered(given).collect()}
    got = {}
    for r in identifiers.occurrences(files, given, block_bytes).collect():
        assert numbers[r.id] not in got.setdefault(r.file, set())
        got[r.file].add(numbers[r.id])
    assert got == {i: h for i, t in enumerate(texts) if t and (h := plain_hits(t, known))}


def test_other_scripts_and_short_ones_are_found(spark):
    files, ids = frames(spark, ["neu: 日本語アプリ!", "x日本語アプリ版", "q", "set.method", "app.zq.me", "xzq.me", "count 1900000712", "item?id=90000071&x", "from GitHub.com/o/r/issues"], [
        ("title", "日本語アプリ"), ("title", "Q"), ("hostname", "t.me"), ("hostname", "zq.me"), ("hn-id", "90000071"), ("url", "github.com/o/r")])
    got = {(r.file, r.rule, r.hits) for r in identifiers.identifier_scan(files, ids).collect()}
    assert got == {(0, "title", 1), (2, "title", 1), (4, "hostname", 1), (7, "hn-id", 1), (8, "url", 1)}
    assert identifiers.identifier_scan(files, ids.limit(0)).count() == 0 == identifiers.identifier_scan(files.limit(0), ids).count()


def test_baseline_drops_titles_and_hosts_by_its_text_only(spark):
    files, ids = frames(spark, ['<meta name="viewport">', "vp-tool.example", "see github.com/o/r 77"], [("title", "Viewport"), ("hostname", "vp-tool.example"), ("hostname", "method.me"), ("url", "github.com/o/r"), ("hn-id", "77")])
    base = spark.createDataFrame([("a viewport meta tag",), ("x.method.me and github.com/o/r or 77",), (None,)], "text string")
    left = {tuple(r) for r in identifiers.without_baseline(ids, base).collect()}
    assert left == {("hostname", "vp-tool.example"), ("url", "github.com/o/r"), ("hn-id", "77")}
    assert {(r.file, r.rule) for r in identifiers.identifier_scan(files, ids, base).collect()} == {(1, "hostname"), (2, "url"), (2, "hn-id")}


def test_file_names_are_scanned_and_withheld(spark):
    files = spark.createDataFrame([("pages/s-07.example.html", "clean"), ("v1/release.json", "see S-07.EXAMPLE and acme widget"), ("b", "x")], "file string, text string")
    ids = spark.createDataFrame([("hostname", "s-07.example"), ("title", "Acme Widget")], "rule string, value string")
    got = sorted(tuple(r) for r in identifiers.scan_files(files, ids).collect())
    assert got == [("(file name withheld)", "hostname"), ("v1/release.json", "hostname"), ("v1/release.json", "title")]


def test_identifier_set(spark):
    rows = [("90000081", "Show HN: Synthetic Widget – a tool", ["https://github.com/synth-org/synth-repo/"]), ("90000091", "Tiny", ["https://synth-app.vercel.app/"]), (None, None, ["https://www.own.co.uk/", "no url"])]
    suffixes = spark.createDataFrame([(r,) for r in ("com", "app", "vercel.app", "co.uk")], "rule string")
    got = {tuple(r) for r in identifiers.identifier_set(spark.createDataFrame(rows, "hn_id string, title string, urls array<string>"), suffixes).collect()}
    assert got == {
        ("hn-id", "90000081"), ("hn-id", "90000091"), ("title", "show hn: synthetic widget – a tool"), ("title", "synthetic widget – a tool"), ("title", "synthetic widget"),
        ("url", "github.com/synth-org/synth-repo"), ("hostname", "synth-app.vercel.app"), ("hostname", "own.co.uk"),
    }


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "list.txt").write_text("// comment\n\ncom\nck\n*.ck  anything after a blank\n!www.ck\nco.uk\nuk\n*.kobe.jp\n!city.kobe.jp\njp\n")
    rules = domains.read_suffixes(spark, str(tmp_path / "list.txt"))
    want = {
        "a.b.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "com": ("com", None), "x.y.ck": ("y.ck", "x.y.ck"), "y.ck": ("y.ck", None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"),
        "s.own.co.uk": ("co.uk", "own.co.uk"), "own.uk": ("uk", "own.uk"), "b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp"), "x.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "a.unlisted": ("unlisted", "a.unlisted"), "localhost": ("localhost", None),
        "10.0.0.1": (None, "10.0.0.1"),
    }
    hosts = spark.createDataFrame([(h.upper() if i % 2 else h,) for i, h in enumerate([*want, *want])] + [(None,), ("",)], "host string")
    assert {r.host: (r.suffix, r.domain) for r in domains.registrable_domains(hosts, rules).collect()} == want


def test_numbers_only_lets_no_text_through(spark):
    lines = [
        '{"n": "secret name", "inner": {"n": 5}}', '{"n": 5, "inner": {"n": "x"}}', '{"n": true}', '{"n": "true"}', '{"n": null}', '{"n": [1]}', '{"n": {"a": 1}}', '{"n": 1.5e3}', '[{"n": 5}]', "5", "no json", None, '{"n": 5, "n": "x"}', '{"a": "\\"n\\": 5,", "n": "y"}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, j string").select("i", pg.numbers_only(F.col("j"), ["n", "it's"]).alias("m"))
    got = {r.i: (r.m or {}).get("n") for r in df.collect()}
    assert {i for i, v in got.items() if v is not None} == {1, 2, 7} and got[1] == "5" and got[2] == "true" and float(got[7]) == 1500
