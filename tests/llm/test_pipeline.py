"""The whole pipeline against a plain one: SQL, all pairs, all alignments and the public tokenizer, one after the other."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline
from plumbline.llm import decontaminate, oracles, pieces, stages

from ..oracle import TABLES
from .test_decontaminate import norm, within
from .test_resemblance import brute_components, edited

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def corpus():
    rng = random.Random(8)
    words = lambda n: [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else rng.choice("bdfgklmnprst") + "".join(rng.choice(["a", "e", "ion", "or", "ti", "un"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    line = lambda: " ".join(words(rng.randrange(8, 14)))
    bench = [(i, " ".join(words(25))) for i in range(5)] + [(9, "tiny item"), (10, None)]
    shared = [line() for _ in range(4)]
    texts = [None, "", "too short", "spam # & | % spam " * 30]
    for i in range(24):
        text = [line() for _ in range(rng.randrange(7, 12))]
        if i % 6 == 0:
            text[2:2] = shared
        if i % 5 == 1:
            text[3:3] = [edited(rng, bench[i % 5][1], i % 3)]
        texts.append("\n".join(text))
    texts += [edited(rng, t.replace("\n", " \n "), e).replace("\n", " ") for t, e in zip(texts[5:11], (0, 1, 2, 3, 5, 30))]
    texts += [texts[6], texts[7]]
    return [(i, t) for i, t in enumerate(texts)], bench


def write(folder, docs, bench):
    folder.mkdir()
    rows = [dict(doc_id=i, text=t, lang="x", source="s", n_chars=len(t or "")) for i, t in docs]
    pq.write_table(pa.Table.from_pylist(rows, SCHEMA), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in bench], pa.int64()), "text": pa.array([t for _, t in bench], pa.string())}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([4, 5], pa.int64()), "quality": pa.array([1, 1], pa.int64()), "toxic": pa.array([0, 0], pa.int64())}), f"{folder}/labels.parquet")


def sql(query, folder):
    import duckdb

    con = duckdb.connect()
    for t in set(TABLES) & {"documents", "labels", "benchmark"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def plain(docs, bench, tmp_path):
    write(tmp_path / "first", docs, bench)
    kept = {r["doc_id"] for r in sql(oracles.ORACLES["op4_quality_rules"], tmp_path / "first") if r["kept"]}
    docs = [(i, t) for i, t in docs if i in kept]
    write(tmp_path / "second", docs, bench)
    docs = sorted((r["doc_id"], r["text"]) for r in sql(oracles.ORACLES["op2_line_dedup"], tmp_path / "second"))
    classes = brute_components(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i]
    held = lambda x, t: within(x, t) <= decontaminate.budget(len(x)) if len(x) >= decontaminate.EXACT else f" {x} " in f" {t} "
    items = [norm(t) for _, t in bench if norm(t)]
    docs = [(i, t) for i, t in docs if not any(held(x, norm(t)) for x in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    return {i: library.encode(t) for i, t in docs}


def test_pipeline_equals_plain_steps(spark, tmp_path):
    docs, bench = corpus()
    want = plain(docs, bench, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path / "first")).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert 8 < len(want) < len(docs) - 8 and all(r.n_ids == len(r.ids) for r in got)


def test_columns_of_any_name_are_kept(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "a", "b", "c"), (2, words + " end", "d", "e", "f"), (3, "another text\nof two lines", None, "g", "h"), (4, None, "i", "j", "k")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "row_key", "row_key_", "x.y `z`"])
    kept = stages.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[0], rows[2], rows[3]}
    lines = stages.line_dedup(spark, docs, "")
    assert lines.columns == docs.columns and {r[0]: r[2:] for r in map(tuple, lines.collect())} == {r[0]: r[2:] for r in rows}
