"""The constraint model of a release: linking rows of all its families, published counts folded in, and what stays possible.

A row is Σ coef · tuple (sense) rhs, in long form (row_id, tuple_id, coef, sense, rhs); `requires` (row_id, tuple_id) names tuples that a
row was derived from, without which nobody outside can know it. Suppressed tuples that rows link are solved together, each such
component by one task: a release has hundreds of tuples, however many projects are counted in them.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FLOOR
from ..sources.tables import checkpointed
from .release import _start_ranges, cell_components


def linking_rows(tuples: DataFrame, decision_of: DataFrame, h1: list[str], h3: list[str], rely: str, facts: DataFrame) -> DataFrame:
    """(row_id, tuple_id, coef, sense, rhs) of the tuples (tuple_id, n, c) of a release.

    Parts sum to their whole; a decision passes no more often than each of its checks; a share hypothesis lies between the largest of
    its checks and their sum, the `rely` decision under h3; leaving `excluded` projects out lowers a count by as many at most; what confirmation
    changed adds up, by kind and by check, to `changed`. `facts` is the one row (excluded, changed) of process figures.
    """
    p = F.split("tuple_id", r"\|")
    known = tuples.select("tuple_id", p.alias("p"))
    text = lambda *parts: F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else x for x in parts))

    def rows(df: DataFrame, row_id, terms: list[tuple], sense: str, rhs=None) -> DataFrame:
        each = F.explode(F.array(*(F.struct(t.alias("tuple_id"), F.lit(k).alias("coef")) for t, k in terms)))
        rhs = F.lit(0).cast("long") if rhs is None else rhs.cast("long")
        return df.select(row_id.alias("row_id"), each.alias("t"), F.lit(sense).alias("sense"), rhs.alias("rhs")).select("row_id", "t.tuple_id", "t.coef", "sense", "rhs")

    me = F.col("tuple_id")
    last, stem = F.element_at("p", -1), F.array_join(F.slice("p", 1, F.size("p") - 1), "|")
    counted = known.where(F.get("p", 0).isin("chk", "dec")).select("*", stem.alias("stem"), last.alias("part"))
    kind = F.when(F.col("part").startswith("src:"), "source").otherwise("quarter")
    parts = counted.where("part <> 'all'").withColumn("kind", kind)
    wholes = parts.select("stem", "kind").distinct()
    sums = [rows(parts, text("sum", F.col("stem"), F.col("kind")), [(me, 1)], "="), rows(wholes, text("sum", F.col("stem"), F.col("kind")), [(text(F.col("stem"), "all"), -1)], "=")]
    needs = known.where("get(p, 0) = 'dec'").select("tuple_id", F.get("p", 1).alias("decision"), F.get("p", 2).alias("part")).join(F.broadcast(decision_of), "decision")  # a codebook's checks
    under = rows(needs, text("le", me, F.col("check_id")), [(me, 1), (text("chk", F.col("check_id"), "pass", F.col("part")), -1)], "<=")
    shares = []
    for h, checks, state in (("h1", h1, "claimed"), ("h3", h3, "pass")):
        mine = known.where((F.get("p", 0) == "chk") & F.get("p", 1).isin(checks) & (F.get("p", 2) == state) & (F.get("p", 3) == "all"))
        whole = known.where(me == f"{h}|all")
        shares += [rows(mine, text("le", h, me), [(me, 1), (F.lit(f"{h}|all"), -1)], "<="), rows(mine, F.lit(f"ge|{h}"), [(me, 1)], ">="), rows(whole, F.lit(f"ge|{h}"), [(me, -1)], ">=")]
    relied = rows(known.where(me == f"dec|{rely}|all"), text("le", me, "h3"), [(me, 1), (F.lit("h3|all"), -1)], "<=")
    sens = known.where("get(p, 0) = 'sens'").withColumn("of", F.expr("substring(tuple_id, 6)")).crossJoin(F.broadcast(facts))  # one row
    left = [rows(sens, text(name, me), [(F.col("of"), 1), (me, -1)], sense, rhs) for name, sense, rhs in (("ge", ">=", None), ("le", "<=", F.col("excluded")))]
    conf = known.where("get(p, 0) = 'conf'").crossJoin(F.broadcast(facts))  # one row
    changes = rows(conf, F.when(F.get("p", 1) == "chk", "sum|conf|chk").otherwise("sum|conf|kind"), [(me, 1)], "=", F.col("changed"))
    return reduce(DataFrame.unionByName, [*sums, under, *shares, relied, *left, changes])


def fold(terms: DataFrame, tuples: DataFrame, requires: DataFrame | None = None) -> DataFrame:
    """(row_id, tuple_id, coef, sense, rhs) over suppressed tuples: published counts go to the right side, equal tuples of a row are added up.

    Rows that require a suppressed tuple are dropped. A row that names an unknown tuple, and a row without unknown counts that does not
    hold, raise an error: published values contradict each other.
    """
    if requires is not None:
        hidden = requires.join(tuples.where("suppressed").select("tuple_id"), "tuple_id", "left_semi").select("row_id").distinct()
        terms = terms.join(hidden, "row_id", "left_anti")
    met = terms.join(tuples.select("tuple_id", "c", "suppressed"), "tuple_id", "left")
    unknown = F.raise_error(F.concat(F.lit("a constraint names an unknown tuple: "), "tuple_id")).cast("boolean")
    met = met.withColumn("open", F.when(F.col("suppressed").isNull(), unknown).otherwise(F.col("suppressed")))
    cells = met.groupBy("row_id", "sense", "rhs", "tuple_id", "open").agg(F.sum("coef").alias("coef"), F.max("c").alias("c"))
    live = F.filter(F.collect_list(F.when(F.col("open"), F.struct("tuple_id", "coef"))), lambda x: x["coef"] != 0)  # a row's own terms
    known = F.coalesce(F.sum(F.when(~F.col("open"), F.col("coef") * F.col("c"))), F.lit(0))
    sums = cells.groupBy("row_id", "sense", "rhs").agg(live.alias("live"), known.alias("known")).withColumn("left", (F.col("rhs") - F.col("known")).cast("long"))
    holds = F.when(F.col("sense") == "=", F.col("left") == 0).when(F.col("sense") == "<=", F.col("left") >= 0).otherwise(F.col("left") <= 0)
    broken = F.raise_error(F.concat(F.lit("published values contradict the row "), "row_id")).cast("boolean")
    kept = sums.where(F.when((F.size("live") == 0) & ~holds, broken).otherwise(F.size("live") > 0))
    return kept.select("row_id", F.explode("live").alias("t"), "sense", F.col("left").alias("rhs")).select("row_id", "t.tuple_id", "t.coef", "sense", "rhs")


class Component:
    """Cells with sets of values, as bits of integers, and rows over them.

    A row keeps those values of a cell that some values of its other cells go with: for sums by the reachable sums before and after the
    cell, also bits, for inequalities by ends. Where no rows form a cycle, what all rows keep is exactly what is possible; else values
    are tried by branching on the cell with the fewest.
    """

    def __init__(self, ranges: list[list[tuple[int, int]]], rows: list[tuple[list[tuple[int, int]], str, int]]):
        self.start = [sum(((1 << (b - a + 1)) - 1) << a for a, b in r) for r in ranges]
        self.rows = rows
        self.of_cell: list[list[int]] = [[] for _ in ranges]
        for r, (terms, _, _) in enumerate(rows):
            for i, _ in terms:
                self.of_cell[i].append(r)

    def _cycle(self) -> bool:
        root: dict[tuple[str, int], tuple[str, int]] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r, (terms, _, _) in enumerate(self.rows):
            for i, _ in terms:
                a, b = find(("row", r)), find(("cell", i))
                if a == b:
                    return True
                root[a] = b
        return False

    @staticmethod
    def _ends(bits: int, k: int) -> tuple[int, int]:
        """Least and greatest of k times a value."""
        low, high = (bits & -bits).bit_length() - 1, bits.bit_length() - 1
        return (k * low, k * high) if k > 0 else (k * high, k * low)

    def _equal(self, terms: list[tuple[int, int]], rhs: int, domain: list[int]) -> list[int]:
        """The kept values of each term's cell, where the terms must sum to `rhs`."""
        ends = [self._ends(domain[i], k) for i, k in terms]
        shifts = [[(v, k * v - low) for v in range(domain[i].bit_length()) if domain[i] >> v & 1] for (i, k), (low, _) in zip(terms, ends, strict=True)]
        target = rhs - sum(low for low, _ in ends)
        if target < 0:
            return [0] * len(terms)

        def reachable(parts):
            sums = [1]
            for part in parts:
                total = 0
                for _, d in part:
                    total |= sums[-1] << d
                sums.append(total)
            return sums

        before, after, kept = reachable(shifts), reachable(shifts[::-1])[::-1], []
        for j, part in enumerate(shifts):
            turned = int(f"{after[j + 1] & ((2 << target) - 1):0{target + 1}b}"[::-1], 2)  # bit target - x for each sum x after the cell
            kept.append(sum(1 << v for v, d in part if d <= target and before[j] & (turned >> d)))
        return kept

    def _unequal(self, terms: list[tuple[int, int]], sense: str, rhs: int, domain: list[int]) -> list[int]:
        ends, at = [self._ends(domain[i], k) for i, k in terms], int(sense == ">=")
        total = sum(e[at] for e in ends)
        fits = (lambda x: x >= rhs) if at else (lambda x: x <= rhs)
        return [sum(1 << v for v in range(domain[i].bit_length()) if domain[i] >> v & 1 and fits(total - e[at] + k * v)) for (i, k), e in zip(terms, ends, strict=True)]

    def shrink(self, domain: list[int], touched: list[int]) -> bool:
        """Let rows take values out of `domain` until none does; false if a cell has none left."""
        todo, waiting = list(touched), set(touched)
        while todo:
            r = todo.pop()
            waiting.discard(r)
            terms, sense, rhs = self.rows[r]
            kept = self._equal(terms, rhs, domain) if sense == "=" else self._unequal(terms, sense, rhs, domain)
            for (i, _), bits in zip(terms, kept, strict=True):
                if not bits:
                    return False
                if bits != domain[i]:
                    domain[i] = bits
                    more = [q for q in self.of_cell[i] if q != r and q not in waiting]
                    todo += more
                    waiting.update(more)
        return True

    def solve(self, domain: list[int], touched: list[int]) -> list[int] | None:
        """Values of all cells that satisfy the rows, or none."""
        stack = [(list(domain), touched)]
        while stack:
            domain, touched = stack.pop()
            if not self.shrink(domain, touched):
                continue
            wide = [i for i, bits in enumerate(domain) if bits & (bits - 1)]
            if not wide:
                return [bits.bit_length() - 1 for bits in domain]
            i = min(wide, key=lambda j: domain[j].bit_count())
            first = domain[i] & -domain[i]
            for part in (domain[i] ^ first, first):
                stack.append(([*domain[:i], part, *domain[i + 1 :]], self.of_cell[i]))
        return None

    def feasible(self) -> list[set[int]]:
        """The values that each cell can take; with cycles every solution found settles a value of every cell."""
        domain = list(self.start)
        if not all(domain) or not self.shrink(domain, list(range(len(self.rows)))):
            return [set() for _ in domain]
        left = [{v for v in range(bits.bit_length()) if bits >> v & 1} for bits in domain]
        if not self._cycle():
            return left
        found: list[set[int]] = [set() for _ in domain]
        for i, values in enumerate(left):
            for v in sorted(values):
                if v not in found[i]:
                    for j, x in enumerate(self.solve([*domain[:i], 1 << v, *domain[i + 1 :]], self.of_cell[i]) or ()):
                        found[j].add(x)
        return found


def feasible_counts(tuples: DataFrame, terms: DataFrame, requires: DataFrame | None = None, floor: int = FLOOR) -> DataFrame:
    """(tuple_id, component, n_values, least, most) of the suppressed tuples (tuple_id, n, c, suppressed): the counts still possible, exactly."""
    folded = checkpointed(fold(terms, tuples, requires))  # read in every round of the components
    cells = tuples.where("suppressed").select("tuple_id", "n", "c").join(cell_components(folded), "tuple_id", "left").withColumn("component", F.coalesce("component", "tuple_id"))
    of_cell = folded.select("tuple_id", F.struct("row_id", "coef", "sense", "rhs").alias("r")).groupBy("tuple_id").agg(F.collect_list("r").alias("rows"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tuple_id")
        rows: dict[str, tuple[list, str, int]] = {}
        for i, found in enumerate(pdf["rows"]):
            for r in found if found is not None else ():
                rows.setdefault(r["row_id"], ([], r["sense"], int(r["rhs"])))[0].append((i, int(r["coef"])))
        sets = Component([_start_ranges(int(c), int(n), floor) for c, n in zip(pdf["c"], pdf["n"], strict=True)], list(rows.values())).feasible()
        out = [(t, g, len(s), min(s), max(s)) if s else (t, g, 0, None, None) for t, g, s in zip(pdf["tuple_id"], pdf["component"], sets, strict=True)]
        return pd.DataFrame(out, columns=["tuple_id", "component", "n_values", "least", "most"]).astype({"least": "Int64", "most": "Int64"})

    joined = cells.join(of_cell, "tuple_id", "left")
    return joined.groupBy("component").applyInPandas(run, "tuple_id string, component string, n_values long, least long, most long")
