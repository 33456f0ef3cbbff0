"""Document fingerprints: weighted SimHash, neighbours in a sequence, and search by permuted block tables. Native: built-in functions only.

Terms are each word (A-Z lower-cased) with its successor, the last word alone. A term's hash is XXH64 of its words one after the
other, its weight the number of its code points, `MAX_WEIGHT` at most; a bit is 1 if terms of over half the weight have it set. Votes
of two bits are added in one long (lanes of 32 bits), so that a term costs 32 additions in generated code; a text may have 2^26 terms.

`with_next` puts every text beside the next one in descending order of ids without a window over the whole table: cut points are the
last keys of range partitions over keys alone, texts are dealt once into the ranges, sorted there, and the last row of each range
also goes to the range after it as a guest. The key ends with the row's number, so repeated rows are cut apart like others.

`search` looks query fingerprints up among all. With `blocks` blocks of bits, two fingerprints within `radius` bits agree on
blocks - radius whole blocks; there is a table for each choice of these. A pair is counted in the first table where it meets only.

Nulls are empty texts with fingerprint zero. Null ids come last in descending order. Rows of one id follow each other by the SHA-256
of their texts; repeated rows are each other's next. A single row is its own next; an empty table gives an empty result. Extra
columns are not looked at.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, id_text, partitions

MAX_WEIGHT, RADIUS, BLOCKS = 32, 3, 6
_LANES = 0x0000000100000001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), f"{SPACE_CLASS}+"), "")


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, fp) of (*keys, text): `keys` name rows. Rows are grouped by them, without a shuffle if `texts` is dealt by some of them."""
    split = texts.select(*keys, words(F.col("text")).alias("ws"))
    pairs = split.select(*keys, F.explode_outer(F.arrays_zip(F.col("ws").alias("a"), F.expr("slice(ws, 2, size(ws))").alias("b"))).alias("t")).select(*keys, "t.a", "t.b")
    weight = F.when(F.col("a").isNull(), 0).otherwise(F.least(F.lit(MAX_WEIGHT), F.length("a") + F.coalesce(F.length("b"), F.lit(0)))).cast("long")
    terms = pairs.select(*keys, F.xxhash64("a", "b").alias("h"), weight.alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes)
    fp: Column = F.lit(0).cast("long")
    for i in range(32):
        for bit, lane in ((i, F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            fp = fp.bitwiseOR(F.when(2 * lane > F.col("total"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, fp.alias("fp"))


def _keys(keys: list, kind: str) -> Column:
    """An array constant of sort keys."""
    return F.array(*(F.struct(F.lit(k.doc_id).cast(kind).alias("doc_id"), F.lit(bytes(k.digest)).alias("digest"), F.lit(k.row).cast("long").alias("row")) for k in keys))


def _range_of(key: Column, last: list, kind: str) -> Column:
    """How many of the sorted keys `last` lie before `key`: first among every step-th of them, then within one step."""
    step = max(1, math.isqrt(len(last)))
    before = lambda keys: F.size(F.filter(keys, lambda k: k < key))
    skipped = before(_keys(last[step - 1 :: step], kind)) * step
    return skipped + before(F.slice(_keys(last, kind), skipped + 1, F.lit(step)))


def with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(range, place, doc_id, text, next_text, guest), dealt by `range` and numbered there: guests are another range's rows, for `next_text` only."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Ranges are equal in rows, not in bytes: more of them than partitions, so that a partition gets several.
    # Ascending, with nulls first: what comes before a row here is its next in descending order.
    rows = rows.withColumn("key", F.struct(F.col("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"), F.col("row")))
    cuts = rows.select("key").repartitionByRange(n_ranges or 4 * partitions(spark, docs), "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    last = [r.key for r in cuts.orderBy("key").collect()]  # a key for each range
    if not last:
        return spark.createDataFrame([], f"range int, place int, doc_id {kind}, text string, next_text string, guest boolean")
    placed = rows.withColumn("range", _range_of(F.col("key"), last, kind))
    visit = F.when(F.get(_keys(last, kind), F.col("range")) == F.col("key"), F.struct(((F.col("range") + 1) % len(last)).alias("range"), F.lit(True).alias("guest")))
    homes = F.array_compact(F.array(F.struct("range", F.lit(False).alias("guest")), visit))
    dealt = placed.select("doc_id", "text", "key", F.explode(homes).alias("home")).select("doc_id", "text", "key", "home.range", "home.guest")
    order = Window.partitionBy("range").orderBy(F.desc("guest"), "key")
    return dealt.select("range", F.row_number().over(order).alias("place"), "doc_id", "text", F.lag("text").over(order).alias("next_text"), "guest")


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of `other`, or all of them."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def compare(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next): texts against their edited form and the next text."""
    lost = F.raise_error(F.lit("rows came in another order when read again: write the table first")).cast("string")
    change = F.when(F.col("guest"), F.lit("")).when(F.col("next_text").isNull(), lost).otherwise(edited(F.col("text"), F.col("next_text")))
    both = with_next(docs, n_ranges).withColumn("change", change)
    # All below is grouped by `range` and more: the texts are shuffled once.
    keys = ["range", "place", "guest", "doc_id", "n_chars", "digest"]
    forms = F.array(*(F.struct(F.lit(i).alias("form"), F.col(c).alias("text")) for i, c in enumerate(("text", "change"))))
    texts = both.select("range", "place", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("change", 256)).alias("digest"), F.explode(forms).alias("t"))
    fps = fingerprints(texts.select(*keys, "t.form", "t.text"), [*keys, "form"])
    lines = fps.groupBy(*keys).agg(*(F.max(F.when(F.col("form") == i, F.col("fp"))).alias(c) for i, c in enumerate(("fp", "edited_fp"))))
    found = lines.withColumn("next_fp", F.lag("fp").over(Window.partitionBy("range").orderBy("place"))).where("NOT guest")
    return found.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def search(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n_near) for the fingerprints of (fp, n, asked) that are asked: rows, `n` for each fingerprint, within `radius` bits, its own included."""
    size = -(-64 // blocks)
    bands = [((1 << min(size, 64 - at)) - 1) << at for at in range(0, 64, size)]
    masks = [sum(c) for c in itertools.combinations(bands, len(bands) - radius)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("k")
    tables = distinct.select("fp", "n", keys).select("fp", "n", "k.choice", "k.key")
    asked = distinct.where("asked").select("fp", keys).select(F.col("fp").alias("q"), "k.choice", "k.key")
    apart = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)))
    hits = asked.join(tables, ["choice", "key"]).where((F.bit_count(apart) <= radius) & (first == F.col("choice")))
    return hits.groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_near"))
