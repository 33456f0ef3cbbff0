"""Budgets with reservations: a call reserves what it may cost, under its own cap and its parent's, and settles what it did cost.

Whether a reservation is granted depends on all before it under the same parent, so the events of one parent are folded in order. In
batch they stream through a task in sorted order, so that its memory holds the open reservations and not the events; over a stream the
same fold keeps its state for each parent from one batch to the next.

Events are (parent, child, ord, kind, id, usd, child_cap, parent_cap). `reserve` grants `id` if what is spent, reserved and asked for fits both
caps, and refuses an id that is still open; `settle` ends a reservation with what it cost, and counts as spent without one; `expire` ends one
at no cost. Null or negative amounts count as nothing; other kinds change nothing. `ord` orders a parent's events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SLACK = 1e-12
COLUMNS = ["parent", "child", "ord", "kind", "id", "usd", "child_cap", "parent_cap"]
RESULT = "ord long, kind string, granted boolean, spent double, reserved double, parent_spent double, parent_reserved double"


class Fold:
    """What one parent and its children have spent and reserved."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.sums: dict[str, list[float]] = state.get("sums", {})  # child, or "" for the parent: spent, reserved
        self.open: dict[str, list] = state.get("open", {})  # id: child, usd

    def state(self) -> dict:
        return {"sums": self.sums, "open": self.open}

    def apply(self, child: str, kind: str, key: str, usd: float | None, child_cap: float, parent_cap: float) -> tuple:
        """(granted, spent, reserved, parent_spent, parent_reserved) after an event."""
        usd = usd if usd is not None and usd > 0 else 0.0
        granted = None
        if kind == "reserve":
            fits = all(sum(self.sums.get(who, (0.0, 0.0))) + usd <= cap + SLACK for who, cap in (("c:" + child, child_cap), ("p", parent_cap)))
            granted = fits and key not in self.open
            if granted:
                self.open[key] = [child, usd]
                self._add(child, 0.0, usd)
        elif kind in ("settle", "expire"):
            owner, held = self.open.pop(key, (child, 0.0))
            self._add(owner, usd if kind == "settle" else 0.0, -held)
        own, whole = self.sums.get("c:" + child, [0.0, 0.0]), self.sums.get("p", [0.0, 0.0])
        return granted, own[0], own[1], whole[0], whole[1]

    def _add(self, child: str, spent: float, reserved: float) -> None:
        for who in ("c:" + child, "p"):
            s = self.sums.setdefault(who, [0.0, 0.0])
            s[0], s[1] = s[0] + spent, max(0.0, s[1] + reserved)


def _schema(events: DataFrame) -> str:
    return f"parent {events.schema['parent'].dataType.simpleString()}, child string, {RESULT}"


def reservations(events: DataFrame) -> DataFrame:
    """(parent, child, ord, kind, granted, spent, reserved, parent_spent, parent_reserved) after each event; `granted` is null but for reservations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, fold = None, None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if fold is None or r["parent"] != parent:
                    parent, fold = r["parent"], Fold()
                found.append((r["parent"], r["child"], r["ord"], r["kind"], *fold.apply(*(r[c] for c in COLUMNS[1:2] + COLUMNS[3:]))))
            types = [b.schema.field("parent").type, pa.string(), pa.int64(), pa.string(), pa.bool_(), *[pa.float64()] * 4]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = _schema(events)
    names = [x.split()[0] for x in schema.split(", ")]
    return events.select(*COLUMNS).repartition("parent").sortWithinPartitions("parent", "ord").mapInArrow(run, schema)


def streamed_reservations(events: DataFrame) -> DataFrame:
    """The same over unbounded input: a parent's events may come in any batches, as long as batches come in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = Fold(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(parts)).sort_values("ord")
        found = [(key[0], r.child, r.ord, r.kind, *fold.apply(r.child, r.kind, r.id, r.usd, r.child_cap, r.parent_cap)) for r in rows.itertuples()]
        state.update((json.dumps(fold.state()),))
        yield pd.DataFrame(found, columns=names)

    schema = _schema(events)
    names = [x.split()[0] for x in schema.split(", ")]
    return events.select(*COLUMNS).groupBy("parent").applyInPandasWithState(run, schema, "fold string", "append", "NoTimeout")
