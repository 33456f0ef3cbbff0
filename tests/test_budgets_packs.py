"""Reservations in batch, as a stream and by plain code; running totals over split keys; packs whose files were tampered with."""

import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import budgets, jobs
from plumbline.plans import q_jobs
from plumbline.sources import packs
from plumbline.streaming import events as se


def plain(rows):
    """By recounting everything before each event."""
    out, open_, log = [], {}, []  # log: parent, child, spent, reserved deltas
    total = lambda p, c=None: [sum(x[i] for x in log if x[0] == p and c in (None, x[1])) for i in (2, 3)]
    for p, c, o, kind, key, usd, ccap, pcap in sorted(rows, key=lambda r: (r[0], r[2])):
        usd, granted = max(usd or 0.0, 0.0), None
        if kind == "reserve":
            granted = (p, key) not in open_ and sum(total(p, c)) + usd <= ccap + 1e-12 and sum(total(p)) + usd <= pcap + 1e-12
            if granted:
                open_[p, key] = (c, usd)
                log.append((p, c, 0.0, usd))
        elif kind in ("settle", "expire"):
            owner, held = open_.pop((p, key), (c, 0.0))
            log.append((p, owner, usd if kind == "settle" else 0.0, -held))
        out.append((p, c, o, kind, granted, *(round(x, 6) for x in (*total(p, c), *total(p)))))
    return out


def rounded(rows):
    return sorted((r.parent, r.child, r.ord, r.kind, r.granted, *(round(x, 6) + 0.0 for x in (r.spent, r.reserved, r.parent_spent, r.parent_reserved))) for r in rows)


def test_batch_equals_plain_code(spark, sf):
    events = q_jobs.budget_events(spark, sf)
    rows = [tuple(r[c] for c in budgets.COLUMNS) for r in events.collect()]
    rng = random.Random(1)
    rows += [(90 + i % 2, rng.choice("ab"), i, rng.choice(["reserve", "settle", "expire", "other"]), str(rng.randint(0, 9)), rng.choice([None, -1.0, 0.0, 1.5, 2.25]), 6.0, 9.0) for i in range(300)]
    got = rounded(budgets.reservations(spark.createDataFrame(rows, events.schema)).collect())
    assert got == sorted(plain(rows)) and {r[4] for r in got} == {True, False, None}
    assert budgets.reservations(events.limit(0)).count() == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    events = q_jobs.budget_events(spark, sf)
    for i, part in enumerate(("ord < 400", "ord >= 400 AND ord < 410", "ord >= 410")):
        events.where(part).repartition(1).write.parquet(f"{tmp_path}/in/{i}")
        stamp = 1_000_000_000 + i
        for f in os.listdir(f"{tmp_path}/in/{i}"):
            os.utime(f"{tmp_path}/in/{i}/{f}", (stamp, stamp))
    source = se.read_events(spark, f"{tmp_path}/in/*", events.schema)
    q = budgets.streamed_reservations(source).writeStream.outputMode("append").format("memory").queryName("budgets").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rounded(spark.table("budgets").collect()) == rounded(budgets.reservations(events).collect())


def test_running_totals_split_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, (i * 7) % 11 - 3, None if i % 10 == 0 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, x long, y long")
    want, sums = {}, {}
    for k, o, x, y in rows:
        a, b = sums.get(k, (0, 0))
        sums[k] = want[o] = (a + x, b + (y or 0))
    for n in (1, 7):
        assert {r.o: (r.sum_x, r.sum_y) for r in jobs.running_totals(df, ["k"], "o", ["x", "y"], n).collect()} == want


def test_packs_refuse_changed_files(spark, tmp_path):
    path = f"{tmp_path}/a.pack+1"
    packs.write_pack({"nums": spark.range(50).repartition(3), "names": spark.createDataFrame([("x",)], "s string")}, path)
    assert packs.pack_refusals(spark, path).count() == 0
    assert packs.load_pack(spark, path, ["nums", "names"])["nums"].agg(F.sum("id")).first()[0] == 1225
    files = sorted(f for f in os.listdir(f"{path}/nums") if f.startswith("part-"))
    with open(f"{path}/nums/{files[0]}", "r+b") as f:
        f.seek(30)
        b = f.read(1)
        f.seek(30)
        f.write(bytes([b[0] ^ 1]))
    os.remove(f"{path}/nums/.{files[0]}.crc")  # the local file system's own check
    os.remove(f"{path}/nums/{files[1]}")
    with open(f"{path}/names/more.bin", "wb") as f:
        f.write(b"x")
    got = {(r.file, r.problem) for r in packs.pack_refusals(spark, path).collect()}
    assert got == {(f"nums/{files[0]}", "changed"), (f"nums/{files[1]}", "missing"), ("names/more.bin", "extra")}
    with pytest.raises(ValueError, match="not as it was written"):
        packs.load_pack(spark, path, ["nums"])
