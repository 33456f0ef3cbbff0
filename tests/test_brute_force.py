"""Queries that SQL cannot express, against plain Python over the same tables."""

import hashlib
import hmac
import re

import pyarrow.dataset as ds

from plumbline.plans import catalogue


def rows(sf, name, columns):
    return ds.dataset(f"{sf}/{name}.parquet").to_table(columns=columns).to_pylist()


def test_pseudonyms(spark, sf):
    letters = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    want = {}
    for r in rows(sf, "customer", ["c_custkey"]):
        bits = int.from_bytes(hmac.new(b"secret", str(r["c_custkey"]).encode(), hashlib.sha256).digest()[:4]) >> 7
        want[r["c_custkey"]] = "".join(letters[bits >> 5 * k & 31] for k in (4, 3, 2, 1, 0))
    assert {r.c_custkey: r.pseudonym for r in catalogue.QUERIES["pseudonyms"](spark, sf).collect()} == want


def lines(text):
    out = []
    for x in (text or "").split("\n"):
        x = re.sub("[ \t\r]+", " ", x).strip(" ")
        if len(x) >= 2 and (not out or out[-1] != x):
            out.append(x)
    return out


def test_chunk_pack(spark, sf):
    got = {(r.project, r.span_ix): r.chunk for r in catalogue.QUERIES["chunk_pack"](spark, sf).collect()}
    want, cap = {}, 4000
    for r in rows(sf, "documents", ["doc_id", "text"]):
        chunk, room, spans = 0, cap, lines(r["text"])
        for at in range(0, len(spans), 3):
            page = spans[at : at + 3]
            if room < cap and sum(map(len, page)) > room:
                chunk, room = chunk + 1, cap
            for i, x in enumerate(page):
                if room < cap and len(x) > room:
                    chunk, room = chunk + 1, cap
                room -= len(x)
                want[r["doc_id"], at + i] = chunk
    assert got == want and got


def test_split_oversized(spark, sf):
    cap, by_doc = 1500, {}
    for r in catalogue.QUERIES["split_oversized"](spark, sf).orderBy("project", "span_ix").collect():
        by_doc.setdefault(r.project, []).append(r.text)
    assert by_doc
    for r in rows(sf, "documents", ["doc_id", "text"]):
        spans = by_doc.get(r["doc_id"], [])
        assert all(2 <= len(s) <= cap or len(s) == 1 for s in spans)
        blocks = [re.sub("[ \t]+", " ", b).strip() for b in re.split(r"\r?\n[ \t]*\r?\n\s*", r["text"] or "")]
        blocks = [b for i, b in enumerate(blocks) if len(b) >= 2 and (i == 0 or b != blocks[i - 1])]
        if not any(b.startswith("#") or "\n#" in b for b in blocks):
            squeeze = lambda xs: "".join("".join(xs).split())
            assert squeeze(spans) == squeeze(blocks)


def test_redacted_texts_hold_no_addresses(spark, sf):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    source, seen = {r["doc_id"]: r["text"] or "" for r in rows(sf, "documents", ["doc_id", "text"])}, 0
    for r in catalogue.QUERIES["redact_personal_data"](spark, sf).collect():
        seen += r.emails
        assert not email.search(r.text) and r.emails == len(email.findall(source[r.doc_id]))
        assert r.text.count("[phone redacted]") - source[r.doc_id].count("[phone redacted]") == r.phones
        plain = re.sub(r"\[(email|phone|handle) redacted\]", "", r.text)
        assert len(plain) <= len(source[r.doc_id])
    assert seen


def test_masked_quotes(spark, sf):
    """Each word left is a function word, or used by three projects or more; runs of six words belong to another project, too."""
    from plumbline.constants import COMMON_WORDS

    word = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
    talk = rows(sf, "conversations", ["conv_id", "turn", "text"])
    users: dict = {}
    for r in talk:
        for w in set(word.findall(r["text"].lower())):
            users.setdefault(w, set()).add(r["conv_id"] % 20)
    found = catalogue.QUERIES["mask_quotes"](spark, sf).collect()
    assert len(found) == len(talk)
    for r in found:
        for w in word.findall(re.sub(r"\[(?:product|domain|repo|url|\w+ redacted)\]", " ", r.masked.lower()).replace("▇▇", " ")):
            assert w in COMMON_WORDS or len(users.get(w, ())) >= 3, (r.id, w)
