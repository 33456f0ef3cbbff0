"""Aggregate releases: shares, partitions, disclosure control, rows, lint, identifier scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FLOOR, MIN_VALUES, SOURCE_GROUP_MIN, TOP_SOURCES
from ..functions.numbers import feasible_values, primary_suppressed, round_half_up, wilson
from ..functions.text import EVALUATIVE, TREND, ascii_edges, lint_text


def check_shares(states: DataFrame, projects: DataFrame, domain: DataFrame, state: str) -> DataFrame:
    """(check_id, partition, c, n): counts of a state over all projects, each quarter and each source; zero-filled.

    Memberships are exploded after states shrank to one flag for each (project, check), and n comes from the projects alone.
    """
    parts = F.explode(F.array(F.lit("all"), F.concat(F.lit("q"), F.col("quarter").cast("string")), F.concat(F.lit("src:"), F.col("source")))).alias("partition")
    member = projects.select("project", parts)
    sizes = member.groupBy("partition").agg(F.count("*").alias("n"))
    hits = states.where(F.col("state") == state).select("project", "check_id").join(projects.select("project", "quarter", "source"), "project")
    counts = hits.select("check_id", parts).groupBy("check_id", "partition").agg(F.count("*").alias("c"))
    dense = sizes.crossJoin(F.broadcast(domain))  # checks x partitions: hundreds of rows
    return dense.join(counts, ["check_id", "partition"], "left").select("check_id", "partition", F.coalesce("c", F.lit(0)).cast("long").alias("c"), "n")


def any_state(states: DataFrame, projects: DataFrame, checks: list[str], wanted: list[str]) -> DataFrame:
    """(c, n): projects with one of the states in one of the checks."""
    hit = states.where(F.col("check_id").isin(checks) & F.col("state").isin(wanted)).select("project").distinct().join(projects.select("project"), "project", "left_semi")
    return hit.agg(F.count("*").alias("c")).crossJoin(projects.agg(F.count("*").alias("n")))


def decision_shares(gated: DataFrame, projects: DataFrame) -> DataFrame:
    """(decision, partition, c, n) of PASS."""
    rows = gated.join(projects.select("project", "quarter"), "project")
    parts = F.explode(F.array(F.lit("all"), F.concat(F.lit("q"), F.col("quarter").cast("string")))).alias("partition")
    return rows.select("decision", "status", parts).groupBy("decision", "partition").agg(F.count_if(F.col("status") == "PASS").alias("c"), F.count("*").alias("n"))


def source_partitions(projects: DataFrame, least: int = SOURCE_GROUP_MIN) -> DataFrame:
    """(source, n, shown): sources are shown if each has the least size, else none is."""
    sizes = projects.groupBy("source").agg(F.count("*").alias("n"))
    smallest = sizes.agg(F.min("n").alias("smallest"))
    return sizes.crossJoin(F.broadcast(smallest)).select("source", "n", (F.col("smallest") >= least).alias("shown"))


def top_sources(members: DataFrame, top: int = TOP_SOURCES) -> DataFrame:
    """(source, n): projects for each source type; beyond the top ones, all distinct projects of the rest as `other`."""
    distinct = members.select("project", "source").distinct()
    counts = distinct.groupBy("source").agg(F.count("*").alias("n"))
    best = counts.where("source <> 'other'").orderBy(F.desc("n"), "source").limit(top)
    rest = distinct.join(F.broadcast(best.select("source")), "source", "left_anti").agg(F.countDistinct("project").alias("n"))
    return best.unionByName(rest.where("n > 0").select(F.lit("other").alias("source"), "n"))


def suppress(shares: DataFrame, floor: int = FLOOR) -> DataFrame:
    return shares.withColumn("suppressed", primary_suppressed(F.col("c"), F.col("n"), floor))


def resolve_rows(shares: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Display rows: state, c, n, pct and interval. A row that is not released carries no number.

    Needs c, n and `available` (withheld if false, absent if null); `closed` marks cells that closure suppressed, if there.
    """
    closed = F.coalesce("closed", F.lit(False)) if "closed" in shares.columns else F.lit(False)
    primary = primary_suppressed(F.col("c"), F.col("n"), floor)
    state = (
        F.when(F.col("available").isNull(), "absent").when(~F.col("available"), "withheld").when(primary & (F.col("c") < floor), "lt10")
        .when(primary | closed, "suppressed").otherwise("released")
    )
    low, high = wilson(F.col("c"), F.col("n"))
    shown = lambda x: F.when(F.col("row_state") == "released", x)
    others = [c for c in shares.columns if c not in ("c", "n", "available", "closed")]
    return shares.withColumn("row_state", state).select(
        *others, "row_state", shown(F.col("c")).alias("c"), shown(F.col("n")).alias("n"),
        shown(round_half_up(100.0 * F.col("c") / F.col("n"))).alias("pct"),
        shown(round_half_up(low, 3)).alias("ci_low"), shown(round_half_up(high, 3)).alias("ci_high"),
    )


def sum_constraints(shares: DataFrame, family: str = "check_id") -> DataFrame:
    """(row_id, tuple_id, coef, sense, rhs): for each family, the quarters' counts sum to that of all, and so do the sources'."""
    kind = F.when(F.col("partition").startswith("src:"), "source").otherwise("quarter")
    tuple_id = F.concat_ws("|", F.col(family), "partition")
    parts = shares.where("partition <> 'all'").select(F.concat_ws("|", F.col(family), kind).alias("row_id"), tuple_id.alias("tuple_id"), F.lit(1).alias("coef"))
    pooled = shares.where("partition = 'all'").select(F.col(family).alias("f"), F.explode(F.array(F.lit("quarter"), F.lit("source"))).alias("k"), tuple_id.alias("tuple_id"))
    return parts.unionByName(pooled.select(F.concat_ws("|", "f", "k").alias("row_id"), "tuple_id", F.lit(-1).alias("coef"))).withColumn("sense", F.lit("=")).withColumn("rhs", F.lit(0))


def check_constraints(terms: DataFrame, tuples: DataFrame) -> DataFrame:
    """(row_id, value, holds) of rows over the true counts."""
    sums = terms.join(tuples.select("tuple_id", "c"), "tuple_id").groupBy("row_id", "sense", "rhs").agg(F.sum(F.col("coef") * F.col("c")).cast("long").alias("value"))
    ok = F.when(F.col("sense") == "=", F.col("value") == F.col("rhs")).when(F.col("sense") == "<=", F.col("value") <= F.col("rhs")).otherwise(F.col("value") >= F.col("rhs"))
    return sums.select("row_id", "value", ok.alias("holds"))


def fold_published(terms: DataFrame, tuples: DataFrame) -> DataFrame:
    """Rows over suppressed cells only: published counts move to the right side: (row_id, tuple_id, coef, sense, rhs)."""
    joined = terms.join(tuples.select("tuple_id", "c", "suppressed"), "tuple_id")
    known = joined.groupBy("row_id").agg(F.sum(F.when(~F.col("suppressed"), F.col("coef") * F.col("c")).otherwise(0)).alias("known"))
    return joined.where("suppressed").join(known, "row_id").select("row_id", "tuple_id", "coef", "sense", (F.col("rhs") - F.col("known")).cast("long").alias("rhs"))


def cell_components(folded: DataFrame) -> DataFrame:
    """(tuple_id, component): suppressed cells that rows link, named by the smallest id. By rounds of least labels.

    Cells of a release are few; rows with thousands of cells do not occur. A round's labels are kept until the next has its own.
    """
    member = folded.select("row_id", "tuple_id").distinct().cache()
    label = member.select("tuple_id", F.col("tuple_id").alias("component")).distinct()
    while True:
        of_row = member.join(label, "tuple_id").groupBy("row_id").agg(F.min("component").alias("m"))
        new = member.join(of_row, "row_id").groupBy("tuple_id").agg(F.min("m").alias("component")).cache()
        changed = new.join(label.withColumnRenamed("component", "old"), "tuple_id").where("component <> old").limit(1).count()
        label.unpersist()
        label = new
        if not changed:
            return label


def lone_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("values", feasible_values(F.col("c"), F.col("n")))


def _propagate(domain: list[list[int]], rows: list[tuple[list[tuple[int, int]], str, int]]) -> bool:
    """Shrink ranges [low, high] by interval reasoning; false if one empties."""
    changed = True
    while changed:
        changed = False
        for terms, sense, rhs in rows:
            low = sum(k * domain[i][0 if k > 0 else 1] for i, k in terms)
            high = sum(k * domain[i][1 if k > 0 else 0] for i, k in terms)
            if sense in ("=", "<=") and low > rhs or sense in ("=", ">=") and high < rhs:
                return False
            for i, k in terms:
                a, b = domain[i]
                rest_low, rest_high = low - k * (a if k > 0 else b), high - k * (b if k > 0 else a)
                if sense in ("=", "<="):  # k x <= rhs - rest_low
                    a, b = (a, min(b, (rhs - rest_low) // k)) if k > 0 else (max(a, -((rest_low - rhs) // k)), b)
                if sense in ("=", ">="):  # k x >= rhs - rest_high
                    a, b = (max(a, -((rest_high - rhs) // k)), b) if k > 0 else (a, min(b, (rhs - rest_high) // k))
                if a > b:
                    return False
                if [a, b] != domain[i]:
                    domain[i], changed = [a, b], True
                    low = sum(q * domain[j][0 if q > 0 else 1] for j, q in terms)
                    high = sum(q * domain[j][1 if q > 0 else 0] for j, q in terms)
    return True


def _solvable(domain: list[list[int]], rows) -> bool:
    domain = [list(d) for d in domain]
    if not _propagate(domain, rows):
        return False
    wide = [i for i, (a, b) in enumerate(domain) if a < b]
    if not wide:
        return True
    i = min(wide, key=lambda j: domain[j][1] - domain[j][0])
    a, b = domain[i]
    middle = (a + b) // 2
    for part in ([a, middle], [middle + 1, b]):
        if _solvable([*domain[:i], part, *domain[i + 1 :]], rows):
            return True
    return False


def _start_ranges(c: int, n: int, floor: int) -> list[tuple[int, int]]:
    """What a reader knows of a primarily suppressed count: below the floor, or within a floor of n."""
    if n < floor:
        return [(0, n)]
    low, high = (0, floor - 1), (max(floor, n - floor + 1), n)
    return [low] if high[0] <= low[1] + 1 and low[1] >= n else [low, high]


def _exact_by_propagation(rows: list[tuple[list[tuple[int, int]], str, int]]) -> bool:
    """Unit coefficients and no cycle of rows and cells: then shrunken ranges hold feasible values only."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r, (terms, _, _) in enumerate(rows):
        for i, k in terms:
            a, b = find(("row", r)), find(("cell", i))
            if abs(k) != 1 or a == b:
                return False
            root[a] = b
    return True


def _picks(domain: list[list[int]], choices: list[list[tuple[int, int]]], rows, at: int = 0):
    """Shrunken domains of each choice of one range for every cell; a choice that the rows rule out is not gone on with."""
    domain = [list(d) for d in domain]
    if not _propagate(domain, rows):
        return
    while at < len(choices) and len(choices[at]) == 1:
        at += 1
    if at == len(choices):
        yield domain
        return
    for low, high in choices[at]:
        a, b = max(low, domain[at][0]), min(high, domain[at][1])
        if a <= b:
            yield from _picks([*domain[:at], [a, b], *domain[at + 1 :]], choices, rows, at + 1)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def feasible_ranges(tuples: dict[str, tuple[int, int]], suppressed: dict[str, str], rows: list[tuple[dict[str, int], str, int]], floor: int = FLOOR) -> dict[str, list[tuple[int, int]]]:
    """The ranges of values that each suppressed cell may take given the published ones: exact.

    `suppressed` maps ids to "primary" or "complementary"; rows that name no suppressed cell are dropped. Linked cells are solved
    together: propagation gives ranges' ends; only where rows form cycles or have other coefficients are values searched.
    """
    folded, linked = [], {t: {t} for t in suppressed}
    for terms, sense, rhs in rows:
        unknown = {t: k for t, k in terms.items() if t in suppressed}
        if unknown:
            folded.append((unknown, sense, rhs - sum(k * tuples[t][0] for t, k in terms.items() if t not in suppressed)))
            group = set().union(*(linked[t] for t in unknown))
            for t in group:
                linked[t] = group
    out: dict[str, list[tuple[int, int]]] = {}
    for t in sorted(suppressed):
        if t in out:
            continue
        ids = sorted(linked[t])
        at = {x: i for i, x in enumerate(ids)}
        near = [([(at[x], k) for x, k in terms.items()], s, r) for terms, s, r in folded if next(iter(terms)) in at]
        choices = [_start_ranges(*tuples[x], floor) if suppressed[x] == "primary" else [(0, tuples[x][1])] for x in ids]
        exact, found = _exact_by_propagation(near), [[] for _ in ids]
        for domain in _picks([[min(r[0] for r in c), max(r[1] for r in c)] for c in choices], choices, near):
            for i, (a, b) in enumerate(domain):
                found[i] += [(a, b)] if exact else [(v, v) for v in range(a, b + 1) if _solvable([*domain[:i], [v, v], *domain[i + 1 :]], near)]
        out.update((x, _merged(f)) for x, f in zip(ids, found, strict=True))
    return out


def feasible_sets(tuples: dict[str, tuple[int, int]], suppressed: dict[str, str], rows: list[tuple[dict[str, int], str, int]], floor: int = FLOOR) -> dict[str, list[int]]:
    """All values of `feasible_ranges`."""
    return {t: [v for a, b in r for v in range(a, b + 1)] for t, r in feasible_ranges(tuples, suppressed, rows, floor).items()}


def close_release(tuples: dict[str, tuple[int, int]], rows: list[tuple[dict[str, int], str, int]], floor: int = FLOOR, least: int = MIN_VALUES) -> dict[str, str]:
    """Suppressions (id -> primary or complementary) after which every suppressed cell has `least` feasible values, or all its own.

    Adds, one at a time, the published cell of the smallest count (ties: the smaller id) in a row with a failing cell.
    """
    state = {t: "primary" for t, (c, n) in tuples.items() if n < floor or c < floor or n - c < floor}
    while True:
        sizes = {t: sum(b - a + 1 for a, b in r) for t, r in feasible_ranges(tuples, state, rows, floor).items()}
        prior = {t: sum(b - a + 1 for a, b in _start_ranges(*tuples[t], floor)) if state[t] == "primary" else tuples[t][1] + 1 for t in state}
        failing = {t for t, v in sizes.items() if v < min(least, prior[t])}
        if not failing:
            return state
        options = [(tuples[t][0], t) for terms, _, _ in rows if failing & set(terms) for t in terms if t not in state]
        if not options:
            raise ValueError(f"no cell is left to suppress for {sorted(failing)}")
        state[min(options)[1]] = "complementary"


def disclosure(shares: DataFrame, close: bool, family: str = "check_id") -> DataFrame:
    """(tuple_id, kind, n_values): the suppressed cells of all partitions and how many counts each may hold.

    With `close` after complementary suppression. No row links two families, so each family is a task of its own.
    """
    cells = shares.select(family, F.concat_ws("|", family, "partition").alias("tuple_id"), "c", "n")
    terms = sum_constraints(shares, family).join(cells, "tuple_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tuples = {r.tuple_id: (int(r.c), int(r.n)) for r in pdf.itertuples()}
        rows = [({r.tuple_id: int(r.coef) for r in g.itertuples()}, g["sense"].iloc[0], int(g["rhs"].iloc[0])) for _, g in pdf.groupby("row_id")]
        state = close_release(tuples, rows) if close else {t: "primary" for t, (c, n) in tuples.items() if n < FLOOR or c < FLOOR or n - c < FLOOR}
        found = feasible_ranges(tuples, state, rows)
        return pd.DataFrame([(t, state[t], sum(b - a + 1 for a, b in r)) for t, r in sorted(found.items())], columns=["tuple_id", "kind", "n_values"])

    return terms.groupBy(family).applyInPandas(run, "tuple_id string, kind string, n_values long")


def ledger_union(ledger: DataFrame, published: DataFrame, version: str) -> DataFrame:
    """Append-only: what is new joins the ledger under the version; ids that are there stay as they are."""
    new = published.join(ledger.select("id"), "id", "left_anti").select("id", "n", "c", F.lit(version).alias("version"))
    return ledger.select("id", "n", "c", "version").unionByName(new)


def pinned(ledger: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Ids a ledger has already published that a release would suppress: must be empty."""
    return ledger.select("id").join(suppressed.select("id"), "id", "left_semi")


def lint_statements(statements: DataFrame) -> DataFrame:
    """(id, rule) violations of (id, kind, text): findings get all rules, statements on cohorts the trend rule."""
    t, finding = lint_text(F.col("text")), F.col("kind") == "finding"
    rules = F.array(
        F.when(finding & t.rlike(ascii_edges(EVALUATIVE)), "evaluative-term"), F.when(finding & ~t.rlike("(?i)publicly evidence"), "missing-publicly-evidence"),
        F.when((finding | F.col("id").startswith("cohort")) & t.rlike(ascii_edges(TREND)), "trend-wording"),
    )
    return statements.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def shared_strings(strings: DataFrame, n_views: int) -> DataFrame:
    """Strings that every one of the views has."""
    return strings.select("view", "s").distinct().groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") == n_views).select("s")


def pseudonym(key: Column, secret: str) -> Column:
    """Five Crockford characters from the top 25 bits of an HMAC-SHA-256."""
    import hashlib

    k = secret.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in k).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(key.cast("string"), "UTF-8")), 256)
    mac = F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)
    bits = F.shiftright(F.conv(F.substring(mac, 1, 8), 16, 10).cast("bigint"), 7)
    letters = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    return F.concat(*(F.substr(letters, (F.shiftright(bits, 5 * (4 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(5)))


def figure_parts(rows: DataFrame, most: int = 16) -> DataFrame:
    """(figure, decision, part, parts): figures of over `most` rows are split by decision, in order of first rows."""
    first = rows.groupBy("figure", "decision").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("figure")
    total = F.sum("n").over(whole)
    part = F.when(total > most, F.row_number().over(whole.orderBy("first"))).otherwise(1)
    parts = F.when(total > most, F.count("*").over(whole)).otherwise(1)
    return first.select("figure", "decision", part.cast("long").alias("part"), parts.cast("long").alias("parts"))


def row_sentence(label: Column, state: Column, c: Column, n: Column, pct: Column) -> Column:
    return (
        F.when(state == "released", F.format_string("%s: %d of %d (%d%%)", label, c, n, pct.cast("int"))).when(state == "lt10", F.concat(label, F.lit(": fewer than 10")))
        .when(state == "suppressed", F.concat(label, F.lit(": suppressed"))).when(state == "withheld", F.concat(label, F.lit(": withheld"))).otherwise(F.concat(label, F.lit(": not available")))
    )


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def assert_rules(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, key, detail): the violations of rules, each a DataFrame (key, detail) that must be empty."""
    parts = [d.select(F.lit(name).alias("rule_id"), F.col("key").cast("string").alias("key"), F.col("detail").cast("string").alias("detail")) for name, d in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
