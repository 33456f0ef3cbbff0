"""What the review of round 3 found in the corpus operators."""

from plumbline.llm import licenses, resemblance, simhash, stages


def test_near_dedup_follows_fingerprints_too(spark):
    """a repeated passage rules the fingerprint, though the ends make the sets of shingles unlike."""
    ends = ["one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen", "a b c d e f g"]
    texts = ["the same words again and " * 60 + e for e in ends] + ["quite another text of a few words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert all(bin((fps[0] ^ x) & (1 << 64) - 1).count("1") <= simhash.MAX_DISTANCE for x in fps[1:3])
    assert sorted(r.doc_id for r in resemblance.keep_one(docs).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.doc_id for r in stages.near_dedup(spark, docs, "").collect()) == [0, 3, 4]


def test_license_scan_plan_reads_each_step_once(spark, tmp_path):
    """op3: the plan held every step as often as it was used, down to the scan, which the driver's memory had to hold."""
    docs = spark.createDataFrame([(100, "Released under the MIT License.", "s"), (101, "no more", "s"), (102, None, "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = licenses.scan(licenses.files_of_documents(spark.read.parquet(f"{tmp_path}/documents.parquet")), licenses.templates(spark))
    assert {r.id: (r.license_id, r.found) for r in found.collect()} == {100: ("MIT", "own"), 101: ("MIT", "inherited"), 102: ("MIT", "inherited")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Aggregate") <= 8, plan
