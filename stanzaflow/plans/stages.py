"""Stage graph (O-X01..X07): registry, selection, dependency closure, topological order, and a runner in one session."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise


@dataclass(frozen=True)
class Stage:
    """``run`` gets the session and the results of the stages it needs."""

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    stages: dict[str, Stage] = field(default_factory=dict)

    def add(self, stage: Stage) -> Stage:
        if stage.name in self.stages:
            raise ValueError(f"stage {stage.name} exists")
        self.stages[stage.name] = stage
        return stage

    def get(self, name: str) -> Stage:
        if name not in self.stages:
            raise KeyError(f"no stage {name}; there are {', '.join(self.stages)}")
        return self.stages[name]

    def between(self, first: str | None, last: str | None) -> list[str]:
        """Stages from first to last in order of registration (O-X02)."""
        names = list(self.stages)
        a = names.index(self.get(first).name) if first else 0
        b = names.index(self.get(last).name) if last else len(names) - 1
        return names[a : b + 1]

    def closure(self, wanted: Iterable[str]) -> set[str]:
        """The stages and all they need (O-X03)."""
        out, todo = set(), list(wanted)
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                todo += self.get(n).needs
        return out

    def order(self, wanted: Iterable[str]) -> list[str]:
        """Needs before what needs them; among the ready ones the first registered (O-X04). A cycle is an error."""
        names = self.closure(wanted)
        rank = {n: i for i, n in enumerate(self.stages)}
        sorter = TopologicalSorter({n: self.get(n).needs for n in names})
        try:
            sorter.prepare()
        except CycleError as e:
            raise ValueError(f"stages need each other: {' -> '.join(e.args[1])}") from e
        out: list[str] = []
        ready: list[str] = []
        while sorter.is_active():
            ready = sorted([*ready, *sorter.get_ready()], key=rank.__getitem__)
            out.append(ready.pop(0))
            sorter.done(out[-1])
        return out

    def run(self, spark: SparkSession, wanted: Iterable[str], dry: bool = False) -> tuple[list[str], dict[str, DataFrame]]:
        """Runs in order and stops at the first failure (O-X05): each stage is carried out and written to the shared folder before the next one begins."""
        plan = self.order(wanted)
        results: dict[str, DataFrame] = {}
        if not dry:
            for n in plan:
                s = self.get(n)
                try:
                    results[n] = materialise(s.run(spark, {k: results[k] for k in s.needs}))
                except Exception as e:
                    raise RuntimeError(f"stage {n} failed; done before it: {', '.join(results) or 'none'}") from e
        return plan, results
