"""Counters and timers of an engine, and the rows that each operator of a finished plan gave."""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Spent:
    ms: float = 0.0


@dataclass
class Metrics:
    counters: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    calls: dict[str, int] = field(default_factory=dict)

    def reset(self) -> None:
        for kept in (self.counters, self.seconds, self.calls):
            kept.clear()

    def inc(self, name: str, amount: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + amount

    def counter(self, name: str) -> int:
        return self.counters.get(name, 0)

    @contextmanager
    def timer(self, name: str) -> Iterator[Spent]:
        """Times what is inside, also if it fails."""
        spent, began = Spent(), time.perf_counter()
        try:
            yield spent
        finally:
            took = time.perf_counter() - began
            spent.ms = 1e3 * took
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            self.calls[name] = self.calls.get(name, 0) + 1

    def time_ms(self, name: str) -> float:
        return 1e3 * self.seconds.get(name, 0.0)

    def average_ms(self, name: str) -> float:
        """Of a call; 0 without any."""
        return self.time_ms(name) / self.calls[name] if self.calls.get(name) else 0.0

    def report(self) -> dict:
        timers = {n: {"ms": self.time_ms(n), "calls": self.calls[n], "average_ms": self.average_ms(n)} for n in sorted(self.seconds)}
        return {"counters": dict(sorted(self.counters.items())), "timers": timers}

    def to_json(self) -> str:
        return json.dumps(self.report())

    def to_csv(self) -> str:
        out = io.StringIO()
        rows = csv.writer(out, lineterminator="\n")
        rows.writerow(["name", "count", "ms", "average_ms"])
        rows.writerows([n, v, "", ""] for n, v in sorted(self.counters.items()))
        rows.writerows([n, self.calls[n], round(self.time_ms(n), 3), round(self.average_ms(n), 3)] for n in sorted(self.seconds))
        return out.getvalue()


def plan_rows(df: DataFrame) -> list[tuple[str, int]]:
    """(operator, rows) of a plan that has run, from the root down; operators that count no rows are left out."""

    def walk(node) -> Iterator[tuple[str, int]]:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
            return
        if kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
            return
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            yield node.nodeName().strip(), int(rows.get().value())
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))
