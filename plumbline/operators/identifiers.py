"""Identifier scans: which texts and file names hold identifiers, without ever giving away which.

All identifiers go into one Aho-Corasick automaton, and every text is read once against it, whatever script its identifiers are in and
however short they are. Identifiers are dealt into blocks of at most about `BLOCK_BYTES`; a block is what the driver holds and
broadcasts at a time. With more than one block the texts are read once for each, and what a block found is checkpointed.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import sliced
from ..functions.text import host, title_forms, url_key
from ..sources.tables import checkpointed
from .domains import registrable_domains

BLOCK_BYTES = 32 << 20
WITHHELD = "(file name withheld)"
#: Hosts under which many projects live, so that only addresses with a path tell one from another.
SHARED_HOSTS = ["github.com", "gitlab.com", "huggingface.co", "ycombinator.com", "reddit.com", "redd.it", "youtube.com", "x.com", "twitter.com", "google.com", "t.me"]
#: What may not stand next to an identifier of a rule; addresses (`url`) count anywhere.
NEIGHBOURS = {
    "title": "abcdefghijklmnopqrstuvwxyz0123456789",
    "hostname": "abcdefghijklmnopqrstuvwxyz0123456789-",
    "hn-id": "0123456789",
    "url": "",
}


def _search(texts: DataFrame, block: pa.Table) -> DataFrame:
    """(file, rule, id) of one block over texts (file, t), each identifier once for each text."""
    handle = texts.sparkSession.sparkContext.broadcast(block.sort_by("v").combine_chunks())
    edges = [frozenset(signs) for signs in NEIGHBOURS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        # The automaton holds a number for each value, arrays what belongs to it: a worker has no Python object for each identifier.
        block, ids = handle.value, handle.value.column("id").to_numpy()
        rules = pc.index_in(block.column("rule"), pa.array(list(NEIGHBOURS))).to_numpy()
        automaton, first, sizes, last = ahocorasick.Automaton(ahocorasick.STORE_INTS), array("q"), array("q"), None
        for at in range(0, block.num_rows, 4096):
            for row, v in enumerate(block.column("v").slice(at, 4096).to_pylist(), at):
                if v != last:
                    automaton.add_word(v, len(first))
                    first.append(row), sizes.append(len(v))
                    last = v
        first.append(block.num_rows)
        automaton.make_automaton()
        for b in sliced(batches):
            files, texts = b.column("file"), b.column("t").to_pylist()
            at, kinds, found = [], [], []
            for row, t in enumerate(texts):
                seen: set[int] = set()
                for end, k in automaton.iter(t) if sizes and t else ():
                    size = sizes[k]
                    around = t[end - size : end - size + 1] if end >= size else "", t[end + 1 : end + 2]
                    for i in range(first[k], first[k + 1]):
                        if i not in seen and not (around[0] in edges[rules[i]] or around[1] in edges[rules[i]]):
                            seen.add(i)
                            at.append(row), kinds.append(rules[i]), found.append(ids[i])
            named = pa.array(list(NEIGHBOURS)).take(pa.array(kinds, pa.int32()))
            yield pa.record_batch([files.take(pa.array(at, pa.int64())), named, pa.array(found, pa.int64())], ["file", "rule", "id"])

    return texts.mapInArrow(run, f"file {texts.schema['file'].dataType.simpleString()}, rule string, id long")


def occurrences(texts: DataFrame, identifiers: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, rule, id): identifiers (rule, value), by a number each, that texts (file, text) hold; nulls hold and are nothing."""
    ids = numbered(identifiers)
    low = texts.select("file", F.coalesce(F.lower("text"), F.lit("")).alias("t"))
    total = ids.agg(F.sum(F.octet_length("v") + 64)).first()[0] or 0  # with what an entry takes beside its text
    n = max(1, math.ceil(total / block_bytes))
    found = None
    for b in range(n):
        block = ids.where(F.pmod(F.xxhash64("v"), F.lit(n)) == b) if n > 1 else ids
        hits = _search(low, block.toArrow())
        hits = checkpointed(hits) if n > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    return found


def numbered(identifiers: DataFrame) -> DataFrame:
    """(rule, v, id): lower-cased identifiers and a number for each."""
    low = identifiers.select("rule", F.lower("value").alias("v")).where("v <> ''").distinct()
    return low.where(F.col("rule").isin(*NEIGHBOURS)).withColumn("id", F.xxhash64("rule", "v"))


def without_baseline(identifiers: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rule, value): without titles and hosts that texts (text) made of nothing private hold; addresses and numbers always stay."""
    ids = numbered(identifiers)
    common = occurrences(baseline.select(F.lit(0).alias("file"), "text"), identifiers.where(F.col("rule").isin("title", "hostname"))).select("id").distinct()
    return ids.join(common, "id", "left_anti").select("rule", F.col("v").alias("value"))


def identifier_set(projects: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(rule, value) of projects (hn_id, title, urls): numbers, forms of titles, addresses with a path, hosts and their registrable domains.

    Hosts that many projects share, and public suffixes by the rules (rule) of `suffixes`, are nobody's.
    """
    row = lambda rule, values: projects.select(F.lit(rule).alias("rule"), F.explode(values).alias("value"))
    numbers, titles = row("hn-id", F.array(F.col("hn_id").cast("string"))), row("title", title_forms(F.col("title")))
    urls = projects.select(F.explode("urls").alias("url"))
    paths = urls.select(F.lit("url").alias("rule"), url_key(F.col("url")).alias("value")).where(F.contains("value", F.lit("/")))
    domains = registrable_domains(urls.select(host(F.col("url")).alias("host")), suffixes).where("domain IS NOT NULL").where(~F.col("domain").isin(SHARED_HOSTS))
    names = domains.select(F.explode(F.array("host", "domain")).alias("h"))
    hosts = names.select(F.lit("hostname").alias("rule"), F.regexp_replace("h", r"^www\.", "").alias("value"))
    return numbers.unionByName(titles).unionByName(paths).unionByName(hosts).where("value <> ''").distinct()


def identifier_scan(files: DataFrame, identifiers: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(file, rule, hits): how many identifiers of a rule the text of (file, text) holds; which ones is never returned."""
    identifiers = without_baseline(identifiers, baseline) if baseline is not None else identifiers
    return occurrences(files, identifiers).groupBy("file", "rule").agg(F.countDistinct("id").alias("hits"))


def scan_files(files: DataFrame, identifiers: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(file, rule) hits of names and texts, one for each file and rule. A name that holds an identifier itself is withheld."""
    identifiers = without_baseline(identifiers, baseline) if baseline is not None else identifiers
    names = files.select("file", F.lit(True).alias("is_name"), F.col("file").cast("string").alias("text"))
    texts = files.select("file", F.lit(False).alias("is_name"), "text")
    both = names.unionByName(texts).select(F.struct("file", "is_name").alias("file"), "text")
    hits = occurrences(both, identifiers).select("file.*", "rule")
    by_file = hits.groupBy("file", "rule").agg(F.max("is_name").alias("in_name")).withColumn("withheld", F.max("in_name").over(Window.partitionBy("file")))
    return by_file.select(F.when(F.col("withheld"), WITHHELD).otherwise(F.col("file").cast("string")).alias("file"), "rule")
