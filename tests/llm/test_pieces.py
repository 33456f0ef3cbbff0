import random
from collections import Counter

import pytest
import sentencepiece

from plumbline.llm import pieces as pc

from .rows import HARD, documents, empty, hard

ODD = ["  two  spaces ", " ", "   ", "①x\x00y　z", "a▁b", "Hello\n\tworld  ", "é漢字 😀😀", "x" * 200 + " " + "ab" * 90, "▁", "tail   "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.DEFAULT_MODEL)


def test_units():
    for t in ODD + [t or "" for _, t in HARD]:
        assert "".join(pc.SPACE + u for u in pc._split(t)) == (pc.SPACE + t.replace(" ", pc.SPACE) if t else "")


def test_equals_library(spark, sf, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate([t for _, t in documents(sf)[:120]] + [t for _, t in HARD])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: library.encode(t or "") for i, t in rows}
    for table_rows in (pc.TABLE, 50):
        got = pc.decode(pc.encode(df, table_rows=table_rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            text = dict(rows)[r.doc_id] or ""
            assert r.ids == want[r.doc_id], text
            assert r.decoded == text.replace(pc.SPACE, " ") == library.decode(r.ids)


def test_edges(spark):
    got = pc.decode(pc.encode(hard(spark)))
    assert Counter((r.doc_id, r.decoded) for r in got.collect()) == Counter((i, t or "") for i, t in HARD)
    assert pc.decode(pc.encode(empty(spark))).count() == 0


def viterbi(unit, score):
    best = [(0.0, [])] + [None] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(e):
            w = unit[s:e]
            x = score[w] if w in score else -1e6 if e == s + 1 else None
            if x is not None and (best[e] is None or best[s][0] + x > best[e][0]):
                best[e] = (best[s][0] + x, best[s][1] + [w])
    return best[-1]


def test_viterbi_fold_equals_brute_force(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)} - {"c"}
    model = pc.Pieces([(p, i, -rng.random() * 9) for i, p in enumerate(sorted(names))], sorted(names), list(range(900, 1156)), 0, "unigram")
    score = {p: s for p, _, s in model.rows}
    units = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 15))) for _ in range(60)})
    df = spark.createDataFrame([(u, 1) for u in units], "unit string, n long")
    for r in pc.fold_viterbi(pc.lattice(df, model)).collect():
        total, path = viterbi(r.unit, score)
        assert [r.unit[x:y] for x, y in zip([0, *r.cuts], r.cuts)] == path
        assert pc._by_score(r.unit, model) == [k for w in path for k in pc._ids_of(w, model)]
    ids = {r.unit: r.ids for r in pc.encode_units(df, model).collect()}
    assert len(ids) == len(units)


def test_one_pass_of_merges_and_those_that_come_late(spark):
    """Random merges, also out of order, against the heap; the late ones must be among them."""
    rng, seen = random.Random(7), 0
    for seed in range(6):
        names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(14)})
        order = rng.sample(range(len(names)), len(names))
        model = pc.Pieces([(p, i, -float(o)) for i, (p, o) in enumerate(zip(names, order))], names, list(range(900, 1156)), 0)
        seen += len(pc.turns_late(model))
        units = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))) for _ in range(80)})
        df = spark.createDataFrame([(u, 1) for u in units], "unit string, n long")
        for r in pc.encode_units(df, model).collect():
            assert r.ids == pc._by_heap(r.unit, model), r.unit
    assert seen


def test_units_are_cut_where_no_piece_crosses(spark, sf, library):
    """The parts of a unit have the ids that it has, and only distinct parts are segmented, not each way that they are put together."""
    model = pc.Pieces.load()
    cut = pc._cutter(model)
    units = sorted({u for t in ODD + [t for _, t in documents(sf)[:60]] for u in pc._split(t)})
    parts, at = cut(units)
    assert len(at) == len(units) + 1 and len(parts) > len(units)
    for u, x, y in zip(units, at, at[1:]):
        assert "".join(parts[x:y]) == pc.SPACE + u
        assert [i for p in parts[x:y] for i in pc._by_heap(p, model)] == pc._by_heap(pc.SPACE + u, model), u
    assert cut([])[0] == []
    unigram = pc.Pieces(model.rows, model.names, model.byte_ids, model.unk, "unigram")
    assert pc._cutter(unigram)(["a.\nB", ""])[0] == [pc.SPACE + "a.\nB", pc.SPACE]


def test_parts_are_segmented_once_however_they_are_put_together(spark, library, monkeypatch):
    names = [a + b + c for a in "bdfgk" for b in "aeio" for c in "lmn"]
    rows = [(i, " ".join(f"{x}.\n{y}" for y in names)) for i, x in enumerate(names)]
    df, seen, segmented = spark.createDataFrame(rows, "doc_id long, text string"), [], pc._segmented
    monkeypatch.setattr(pc, "_segmented", lambda units, pieces: seen.append(units) or segmented(units, pieces))
    got = {r.doc_id: r.ids for r in pc.encode(df, table_rows=20).collect()}
    assert got == {i: library.encode(t) for i, t in rows}
    rare = seen[-1].count()
    assert 0 < rare <= 2 * len(names) + 3  # not the 3,600 units


def test_equal_rows_share_their_rare_parts(spark, library):
    rows = [(1, "abc.\nxyz qqq.\nrst"), (1, "abc.\nxyz qqq.\nrst"), (1, "other text"), (2, "abc.\nxyz qqq.\nrst"), (None, "qqq.\nabc"), (None, "qqq.\nabc"), (3, None)]
    got = pc.encode(spark.createDataFrame(rows, "doc_id long, text string"), table_rows=1).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
