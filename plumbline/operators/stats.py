"""Agreement, bootstrap, hypothesis tests, recall and the release gate."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import AC1_MIN, AUDIT_BAR, ESTIMABLE_PASSES, H2_GROUP_MIN, PRECISION_MIN, RECALL_BAR, RECALL_CONTRIBUTING
from ..functions.numbers import ratio, seeded_uniform


def _binary_metrics(tt: Column, tf: Column, ft: Column, ff: Column) -> dict[str, Column]:
    """From counts (coder, gold) of true and false; null where a denominator is zero."""
    n = (tt + tf + ft + ff).cast("double")
    pa = F.try_divide(tt + ff, n)
    q = F.try_divide((tt + tf) + (tt + ft), 2 * n)
    chance = 2 * q * (1 - q)
    pe = F.try_divide((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff), n * n)
    return {
        "pa": pa, "ac1": F.try_divide(pa - chance, 1 - chance), "kappa": F.when(pe < 1, F.try_divide(pa - pe, 1 - pe)),
        "precision": ratio(tt, tt + tf), "recall": ratio(tt, tt + ft),
    }


def binary_agreement(pairs: DataFrame, by: list[str] = (), pooled: bool = False) -> DataFrame:
    """(by, n, coder_passes, gold_passes, pa, ac1, kappa, precision, recall) of boolean a (coder) and b (gold).

    `pooled` adds the row over all groups, from the same pass (grouping sets).
    """
    a, b = F.col("a"), F.col("b")
    counts = {"tt": a & b, "tf": a & ~b, "ft": ~a & b, "ff": ~a & ~b}
    grouped = pairs.groupingSets([[pairs[c] for c in by], []], *by) if pooled else pairs.groupBy(*by)
    c = grouped.agg(*(F.count_if(v).alias(k) for k, v in counts.items()))
    m = _binary_metrics(*(F.col(k) for k in counts))
    n = F.col("tt") + F.col("tf") + F.col("ft") + F.col("ff")
    return c.select(*by, n.alias("n"), (F.col("tt") + F.col("tf")).alias("coder_passes"), (F.col("tt") + F.col("ft")).alias("gold_passes"), *(v.alias(k) for k, v in m.items()))


def four_state_agreement(pairs: DataFrame, states: list[str]) -> DataFrame:
    """(n, pa, ac1, kappa) of nominal a and b over a fixed list of states."""
    k = len(states)
    c = pairs.agg(
        F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"),
        *(F.count_if(F.col(x) == s).alias(f"{x}{i}") for i, s in enumerate(states) for x in "ab"),
    )
    n = F.col("n").cast("double")
    pa = F.try_divide(F.col("same"), n)
    share = [F.try_divide(F.col(f"a{i}") + F.col(f"b{i}"), 2 * n) for i in range(k)]
    chance = sum((p * (1 - p) for p in share[1:]), share[0] * (1 - share[0])) / (k - 1)
    pe = sum((F.try_divide(F.col(f"a{i}") * F.col(f"b{i}"), n * n) for i in range(1, k)), F.try_divide(F.col("a0") * F.col("b0"), n * n))
    return c.select("n", pa.alias("pa"), F.try_divide(pa - chance, 1 - chance).alias("ac1"), F.when(pe < 1, F.try_divide(pa - pe, 1 - pe)).alias("kappa"))


def positive_agreement(pairs: DataFrame) -> DataFrame:
    both, one = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") != F.col("b"))
    return pairs.agg(ratio(2 * both, 2 * both + one).alias("positive_agreement"))


def bootstrap_draws(spark: SparkSession, clusters: DataFrame, seed: str, draws: int) -> DataFrame:
    """(draw, cluster, weight): how often each cluster (cluster, ix from 0) is drawn. Weights, so no row is copied.

    The uniform of drawing j in draw b is number b * n + j of the seed's stream.
    """
    n = clusters.count()
    i = spark.range(draws * n)
    ix = F.floor(seeded_uniform(seed, F.col("id")) * n).cast("long")
    picked = i.select(F.floor(F.col("id") / max(n, 1)).cast("long").alias("draw"), ix.alias("ix")).groupBy("draw", "ix").agg(F.count("*").alias("weight"))
    return picked.join(clusters, "ix").select("draw", "cluster", "weight")


def bootstrap_ci(pairs: DataFrame, seed: str, draws: int = 2000, by: list[str] = (), pooled: bool = False) -> DataFrame:
    """Percentile intervals of all five metrics over clusters (column `cluster`): (by, metric, low, high).

    Pairs shrink to four counts for each cluster and group before the draws are joined, and all metrics share the draws.
    `pooled` adds the intervals over all groups, from the same draws.
    """
    spark = pairs.sparkSession
    a, b = F.col("a"), F.col("b")
    counts = {"tt": a & b, "tf": a & ~b, "ft": ~a & b, "ff": ~a & ~b}
    cells = pairs.groupBy(*by, "cluster").agg(*(F.count_if(v).alias(k) for k, v in counts.items()))
    if pooled:
        whole = cells.groupBy("cluster").agg(*(F.sum(k).alias(k) for k in counts))
        cells = cells.unionByName(whole.select(*(F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in by), "cluster", *counts))
    clusters = pairs.select("cluster").distinct().withColumn("ix", F.row_number().over(Window.orderBy("cluster")).cast("long") - 1)
    drawn = cells.join(bootstrap_draws(spark, clusters, seed, draws), "cluster")
    sums = drawn.groupBy(*by, "draw").agg(*(F.sum(F.col(k) * F.col("weight")).alias(k) for k in counts))
    metrics = _binary_metrics(*(F.col(k) for k in counts))
    long = sums.select(*by, "draw", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()))).alias("m")).select(*by, "m.*").where("value IS NOT NULL")
    values = long.groupBy(*by, "metric").agg(F.sort_array(F.collect_list("value")).alias("v"))  # one number for each draw
    m = F.size("v")
    at = lambda i: F.element_at("v", (i + 1).cast("int"))
    return values.select(*by, "metric", at(F.floor(0.025 * (m - 1))).alias("low"), at(F.ceil(0.975 * (m - 1))).alias("high"))


def _binomial_upper(k: str) -> Column:
    """P(X >= k) of n fair coins, over the column n; each term from the one nearer to the middle, relative to the middle one, all in one pass.

    Beyond the middle the tail is added up, before it that of the other side is taken from one.
    """
    middle, w = "(n div 2)", "s.w * (n - i + 1) / i"
    far = f"IF({k} > {middle}, {k}, n - {k} + 1)"
    state = f"struct({w} AS w, s.every + {w} AS every, s.tail + IF(i >= {far}, {w}, 0D) AS tail)"
    # Both halves: an even n has one middle term, an odd one two, the first of which the pass begins with.
    every = "IF(n % 2 = 0, 2 * s.every - 1, 2 * (s.every - 1))"
    tail = f"aggregate(sequence({middle} + 1, greatest(n, {middle} + 1)), struct(1D AS w, 1D AS every, 0D AS tail), (s, i) -> {state}, s -> s.tail / {every})"
    return F.expr(f"CASE WHEN {k} <= 0 THEN 1D WHEN {k} > n THEN 0D WHEN {k} > {middle} THEN {tail} ELSE 1 - {tail} END")


def binomial_tails(rows: DataFrame) -> DataFrame:
    """`upper` = P(X >= k) and `lower` = P(X <= k) of n fair coins, for (n, k)."""
    return rows.withColumn("upper", _binomial_upper("k")).withColumn("lower", _binomial_upper("(n - k)"))


def holm(tests: DataFrame) -> DataFrame:
    """`p_holm` of tests (id, p): the running maximum of min(1, (m - j) p) in order of p. Few rows: one window."""
    w = Window.orderBy("p", "id")
    m = F.count("*").over(Window.partitionBy())
    step = tests.withColumn("step", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p")))
    return step.withColumn("p_holm", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def adverse_counts(c: Column, n: Column, recall: Column, direction: str) -> Column:
    """Counts under the recall bound: fewer by floor(c r) or more by ceil(c / r), n at most."""
    return F.floor(c * recall + 1e-9).cast("long") if direction == "fewer" else F.least(n.cast("double"), F.ceil(c / recall - 1e-9)).cast("long")


def omnibus(rows: DataFrame) -> DataFrame:
    """(statistic, n, checks, groups): chi-squared summed over checks of (check_id, grp, positive); constant checks count nothing."""
    cell = rows.groupBy("check_id", "grp").agg(F.count("*").alias("n"), F.count_if("positive").alias("c"))
    total = cell.groupBy("check_id").agg(F.sum("n").alias("nn"), F.sum("c").alias("cc"))
    e = F.col("n") * F.col("cc") / F.col("nn").cast("double")
    e0 = F.col("n") - e
    part = (F.col("c") - e) * (F.col("c") - e) * (1 / e + 1 / e0)
    terms = cell.join(total, "check_id").where("cc > 0 AND cc < nn").withColumn("part", part)
    return terms.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("statistic"), F.max("nn").alias("n"), F.countDistinct("check_id").alias("checks"), F.countDistinct("grp").alias("groups"))


def cramers_v(statistic: Column, n: Column, checks: Column, groups: Column) -> Column:
    """Effect size of the summed statistic; two rows a table, so the smaller dimension less one is one."""
    return F.sqrt(F.try_divide(statistic, n * checks * F.least(F.lit(1), groups - 1)))


#: Uniforms made together, and projects of a sample from which on swaps are made many at a time.
_UNIFORMS, _MANY = 1 << 16, 2048


def _uniforms(stream: bytes) -> Callable[[int, int], np.ndarray]:
    """A function to the uniforms first..last of a seed's stream; its calls go upward, so that what lies before is forgotten."""
    made, digest = {}, hashlib.sha256

    def take(first: int, last: int) -> np.ndarray:
        parts = range(first // _UNIFORMS, -(-last // _UNIFORMS))
        for p in [p for p in made if p < parts.start]:
            del made[p]
        for p in parts:
            if p not in made:
                found = b"".join([digest(b"%b%d" % (stream, i)).digest() for i in range(p * _UNIFORMS, (p + 1) * _UNIFORMS)])
                made[p] = (np.frombuffer(found, ">u8")[::4] >> np.uint64(12)).astype(float) / (1 << 52)  # the first 13 hex digits
        whole = np.concatenate([made[p] for p in parts]) if parts else np.zeros(0)
        at = first - parts.start * _UNIFORMS
        return whole[at : at + last - first]

    return take


def _shuffles(sizes: Iterable[int], stream: bytes, first: int, last: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(n, draw, picks) of the seeded Fisher-Yates shuffles first..last of each size: what the places n - 1 to 1 are swapped with.

    A shuffle of n takes the next n - 1 uniforms of the stream, so in order of the stream all sizes share them.
    """
    take = _uniforms(stream)
    for start, n, draw in sorted((draw * max(n - 1, 0), n, draw) for n in {*sizes} for draw in range(first, last)):
        yield n, draw, (take(start, start + max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int32)


def _swap(picks: np.ndarray, arrays: list[np.ndarray]) -> None:
    """One shuffle of each array, in place.

    Swaps that have no place in common with others among the next few can be made at once; the rest follow in order.
    """
    high, at = len(picks), 0
    seen, twice = np.zeros(high + 1, np.int32), np.zeros(high + 1, bool)
    while high > _MANY:
        size = min(int(6 * high**0.5), high - _MANY)
        pick, nth = picks[at : at + size], np.arange(size, dtype=np.int32)
        met = pick > high - size  # one of these very places
        met[high - pick[met]] = True
        seen[pick] = nth
        again = pick[seen[pick] != nth]
        twice[again] = True
        met |= twice[pick]
        twice[again] = False
        alone, rest = np.flatnonzero(~met), np.flatnonzero(met)
        here, there = high - alone, pick[alone]
        pairs = list(zip((high - rest).tolist(), pick[rest].tolist(), strict=True))
        for a in arrays:
            a[here], a[there] = a[there], a[here]
            for j, k in pairs:
                a[j], a[k] = a[k], a[j]
        high, at = high - size, at + size
    last = picks[at:].tolist()
    for a in arrays:
        few = a[: high + 1].tolist()
        for j, k in zip(range(high, 0, -1), last, strict=True):
            few[j], few[k] = few[k], few[j]
        a[: high + 1] = few


class _Omnibus:
    """The omnibus statistic of projects, whose positives are a row of `kinds` (kinds x checks) each, under the group numbers that they get."""

    def __init__(self, labels: np.ndarray, kinds: np.ndarray, kind_of: np.ndarray):
        n, kinds = len(labels), np.asarray(kinds, float)
        totals = np.bincount(kind_of, minlength=len(kinds)) @ kinds
        live = (totals > 0) & (totals < n)
        self.kinds, self.kind_of, self.groups = kinds[:, live], kind_of, int(labels.max(initial=0)) + 1
        sizes = np.bincount(labels, minlength=self.groups).astype(float)[:, None]
        self.expected = sizes * (totals[live] / max(n, 1))
        self.weight = 1 / self.expected + 1 / (sizes - self.expected)

    def __call__(self, labels: np.ndarray) -> float:
        k = len(self.kinds)
        if self.groups * k <= max(4 * len(labels), 1 << 16):
            c = np.bincount(labels * k + self.kind_of, minlength=self.groups * k).reshape(-1, k) @ self.kinds
        else:
            c = np.array([np.bincount(labels, x[self.kind_of], self.groups) for x in self.kinds.T]).reshape(-1, self.groups).T
        return float(((c - self.expected) ** 2 * self.weight).sum())


def _reaches(statistic, observed):
    """Whether a shuffle's statistic is the observed one or more, but for rounding."""
    return statistic >= observed - 1e-9 * max(1.0, observed)


def permutation_p(labels: list[int], positives: np.ndarray, seed: str, draws: int = 2000) -> tuple[float, float]:
    """(statistic, p) of one family in memory, shuffle by shuffle; `permutation_test` gives the same over many."""
    now, hits = np.array(labels, np.int64), 0
    statistic = _Omnibus(now, positives, np.arange(len(now)))
    t = statistic(now)
    for _, _, picks in _shuffles([len(now)], f"{seed}:bootstrap:".encode(), 0, draws):
        _swap(picks, [now])
        hits += _reaches(statistic(now), t)
    return t, (1 + hits) / (draws + 1)


#: Checks that share one long for each project, and shuffles that one task makes.
_SLICE, _BLOCK = 62, 50


def _family_samples(rows: DataFrame, by: str) -> DataFrame:
    """(by, slice, labels, bits, n, checks, groups, least): a sample's projects in order, their group numbers and a bit for each check.

    Counted before they are gathered: what is gathered is two numbers for each project and slice of checks.
    """
    rows = rows.where("project IS NOT NULL AND grp IS NOT NULL AND check_id IS NOT NULL")
    key = F.struct(by)  # equal to itself where it is null
    checks = rows.select(key.alias("f"), "check_id").distinct().withColumn("ix", F.row_number().over(Window.partitionBy("f").orderBy("check_id")) - 1)
    sizes = checks.groupBy("f").agg(F.count("*").alias("checks"))
    yes = rows.select(key.alias("f"), "project", "grp", "check_id", F.col("positive").cast("int").alias("yes"))
    bit = F.call_function("shiftleft", F.coalesce("yes", F.lit(0)).cast("long"), (F.col("ix") % _SLICE).cast("int"))
    masks = yes.join(checks, ["f", "check_id"]).groupBy("f", "project", "grp", F.floor(F.col("ix") / _SLICE).alias("slice")).agg(F.bit_or(bit).alias("mask"))
    people = masks.groupBy("f", "project", "grp").agg(F.map_from_entries(F.collect_list(F.struct("slice", "mask"))).alias("masks"))
    groups = people.groupBy("f", "grp").agg(F.count("*").alias("size")).groupBy("f").agg(F.array_sort(F.collect_list("grp")).alias("names"), F.min("size").alias("least"))
    known = people.join(sizes.join(groups, "f"), "f")
    slices = known.withColumn("slice", F.explode(F.sequence(F.lit(0), F.floor((F.col("checks") - 1) / _SLICE).cast("int"))))
    one = F.struct("project", "grp", (F.array_position("names", F.col("grp")) - 1).cast("int").alias("label"), F.coalesce(F.try_element_at("masks", F.col("slice").cast("long")), F.lit(0)).alias("mask"))
    gathered = slices.groupBy("f", "slice").agg(F.array_sort(F.collect_list(one)).alias("x"), F.first("checks").alias("checks"), F.first(F.size("names")).alias("groups"), F.first("least").alias("least"))
    return gathered.select(F.col(f"f.{by}").alias(by), "slice", F.col("x.label").alias("labels"), F.col("x.mask").alias("bits"), F.size("x").alias("n"), "checks", "groups", "least")


def permutation_test(rows: DataFrame, seed: str, draws: int = 2000, by: str = "family") -> DataFrame:
    """(by, tested, reason, statistic, p, v) for each family of (by, project, grp, check_id, positive).

    A family of fewer than two groups, or with a group of fewer than H2_GROUP_MIN projects, is not tested and has a reason instead of figures.
    A check that a project lacks counts as not positive; rows without project, group or check are left out.

    Each shuffle goes on from the last, so a draw is a product of all shuffles before it. Blocks of shuffles are multiplied out apart,
    their products multiplied by those of the blocks before in one task for each size, and each block then goes on from its own start: a task has
    one block of all families, so that each uniform is made once, and holds their projects' numbers, or one number for each project of a size and block.
    """
    stream = f"{seed}:h2-permutation:bootstrap:".encode()
    samples = _family_samples(rows, by)
    few = F.when(F.col("groups") < 2, "fewer than two groups").when(F.col("least") < H2_GROUP_MIN, f"a group has fewer than {H2_GROUP_MIN} projects")
    refused = samples.where("slice = 0").select(by, few.alias("reason")).where("reason IS NOT NULL")
    tested = samples.where(few.isNull())
    n_blocks = -(-draws // _BLOCK)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0))))
    kind = rows.schema[by].dataType.simpleString()

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, part in pdf.groupby("block"):
                orders = {n: np.arange(n, dtype=np.int32) for n in part["n"].tolist()}
                for n, _, picks in _shuffles(orders, stream, block * _BLOCK, min(draws, (block + 1) * _BLOCK)):
                    _swap(picks, [orders[n]])
                yield pd.DataFrame({"n": list(orders), "block": block, "product": list(orders.values())})

    # Shuffles know only how many are shuffled, so families of one size share them.
    tasks = tested.select("n").distinct().select("n", blocks.alias("block")).repartitionById(max(n_blocks, 1), "block")
    product = tasks.mapInPandas(products, "n int, block int, product array<int>")

    def multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
        before, starts = None, []
        for product in pdf.sort_values("block")["product"]:
            before = product if before is None else before[product]
            starts.append(before)
        return pd.DataFrame({"n": pdf["n"].to_numpy(), "block": np.sort(pdf["block"].to_numpy()) + 1, "start": starts})

    starts = product.groupBy("n").applyInPandas(multiplied, "n int, block int, start array<int>")

    def statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, part in pdf.groupby("block"):
                first, last = block * _BLOCK, min(draws, (block + 1) * _BLOCK)
                of_size = {n: [] for n in part["n"].tolist()}
                for r in part.itertuples(index=False):
                    labels, (bits, kind_of) = np.array(r.labels, np.int32), np.unique(np.asarray(r.bits, np.int64), return_inverse=True)
                    width = min(_SLICE, r.checks - _SLICE * r.slice)
                    statistic = _Omnibus(labels, bits[:, None] >> np.arange(width) & 1, kind_of.astype(np.int32))
                    of_size[r.n].append((r, statistic, statistic(labels), labels if r.start is None else labels[r.start], []))
                # Families of a block share its uniforms, those of one size its shuffles, too.
                for n, _, picks in _shuffles(of_size, stream, first, last):
                    _swap(picks, [labels for _, _, _, labels, _ in of_size[n]])
                    for _, statistic, _, labels, each in of_size[n]:
                        each.append(statistic(labels))
                for r, _, observed, _, each in (x for xs in of_size.values() for x in xs):
                    yield pd.DataFrame({by: [r[0]] * len(each), "draw": range(first, last), "part": each, "observed": observed, "size": r.n * r.checks})

    work = tested.select(by, "slice", "labels", "bits", "n", "checks", blocks.alias("block")).join(starts.hint("merge"), ["n", "block"], "left")
    work = work.select(by, "slice", "labels", "bits", "n", "checks", "block", "start").repartitionById(max(n_blocks, 1), "block")
    parts = work.mapInPandas(statistics, f"`{by}` {kind}, draw long, part double, observed double, size long")
    drawn = parts.groupBy(by, "draw").agg(F.sum("part").alias("part"), F.sum("observed").alias("t"), F.first("size").alias("size"))
    near = F.col("part") >= F.col("t") - 1e-9 * F.greatest(F.lit(1.0), F.col("t"))
    sums = drawn.groupBy(by).agg(F.first("t").alias("t"), F.count_if(near).alias("hits"), F.first("size").alias("size"))
    found = sums.select(by, F.lit(True).alias("tested"), F.lit(None).cast("string").alias("reason"), F.col("t").alias("statistic"), ((F.col("hits") + 1) / (draws + 1)).alias("p"), F.sqrt(F.col("t") / F.col("size")).alias("v"))
    nothing = F.lit(None).cast("double")
    return found.unionByName(refused.select(by, F.lit(False).alias("tested"), "reason", nothing.alias("statistic"), nothing.alias("p"), nothing.alias("v")))


def recall_figure(projects: DataFrame) -> DataFrame:
    """(items, found, contributing, recall, accepted) of (project, items, found); recall is zero without items."""
    sums = projects.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.count_if(F.col("items") > 0).alias("contributing"))
    r = F.coalesce(ratio(F.col("found"), F.col("items")), F.lit(0.0))
    return sums.withColumn("recall", r).withColumn("accepted", (r >= RECALL_BAR) & (F.col("contributing") >= RECALL_CONTRIBUTING))


def audit_figure(records: DataFrame) -> DataFrame:
    """(audited, errors, error_rate, within_bar) of (screened, audited) verdicts."""
    sums = records.agg(F.count("*").alias("audited"), F.count_if(F.col("screened") != F.col("verdict")).alias("errors"))
    r = ratio(F.col("errors"), F.col("audited"))
    return sums.withColumn("error_rate", r).withColumn("within_bar", F.coalesce(r <= AUDIT_BAR, F.lit(False)))


def gate_ladder(metrics: DataFrame) -> DataFrame:
    """`status` and `reason` of each check's agreement, later rungs over earlier ones.

    A person's coding counts before the withholding after a miss, as in the reference, whatever the agreement. Needs n, gold_passes, ac1, precision and the flags withheld, person_coded, revalidated (all nullable booleans).
    """
    within = F.coalesce((F.col("ac1") >= AC1_MIN) & (F.col("precision") >= PRECISION_MIN), F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = F.when(F.col("n") == 0, "missed").when(F.col("gold_passes") < ESTIMABLE_PASSES, "released-not-estimable").when(within, "released").otherwise("missed")
    status = F.when(flag("person_coded"), "person-coded").when(flag("withheld") & (base == "missed"), "withheld").when(flag("revalidated"), "corrected-revalidated").otherwise(base)
    reason = (
        F.when(status == "released", "both thresholds met").when(status == "released-not-estimable", "fewer than 10 gold passes").when(status == "withheld", "withheld after a miss")
        .when(status == "person-coded", "coded by a person").when(status == "corrected-revalidated", "passed after correction").otherwise("a threshold missed, or no pairs")
    )
    return metrics.withColumn("status", status).withColumn("reason", reason)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(ratio(F.size(F.array_intersect(a, b)), union))


def nearest_rank(values: Column, p: float) -> Column:
    """Element ceil(n p) of the sorted values; null for none."""
    v = F.sort_array(values)
    return F.try_element_at(v, F.greatest(F.lit(1), F.ceil(F.size(v) * p)).cast("int"))
