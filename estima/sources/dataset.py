"""A data set as a handle: a DataFrame, a weight column, value labels and the steps that led to it. Steps return a new one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    root: DataFrame | None = None
    weight: str | None = None
    labels: dict[str, dict] = field(default_factory=dict)
    history: tuple[str, ...] = ()
    before: tuple[DataFrame, ...] = ()

    MAX_UNDO = 20

    def apply(self, note: str, step: Callable[[DataFrame], DataFrame]) -> Dataset:
        return replace(self, df=step(self.df), root=self.root or self.df, history=(*self.history, note), before=(*self.before, self.df)[-self.MAX_UNDO :])

    def undo(self) -> Dataset:
        return replace(self, df=self.before[-1], before=self.before[:-1], history=self.history[:-1]) if self.before else self

    def reset(self) -> Dataset:
        return replace(self, df=self.root or self.df, history=(), before=())

    def with_weight(self, column: str) -> Dataset:
        if column not in self.df.columns:
            raise ValueError(f"no column {column}")
        return replace(self, weight=column)

    def with_labels(self, column: str, labels: dict) -> Dataset:
        return replace(self, labels={**self.labels, column: dict(labels)})
