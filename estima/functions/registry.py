"""User functions by name: statistics, column functions and table functions that sessions can register."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.scalars: dict[str, tuple[Callable, str]] = {}
        self.aggregates: dict[str, tuple[Callable, str]] = {}
        self.tables: dict[str, tuple[type, str]] = {}

    def scalar(self, name: str, returns: str) -> Callable:
        """A function of pandas Series to a Series."""
        return lambda f: self.scalars.setdefault(name, (f, returns)) and f

    def aggregate(self, name: str, returns: str) -> Callable:
        """A function of pandas Series to one value."""
        return lambda f: self.aggregates.setdefault(name, (f, returns)) and f

    def table(self, name: str, returns: str) -> Callable:
        """A class with eval(), for a table function."""
        return lambda c: self.tables.setdefault(name, (c, returns)) and c

    def install(self, spark: SparkSession) -> list[str]:
        for name, (f, returns) in self.scalars.items():
            one = f.__code__.co_argcount == 1
            spark.udf.register(name, F.pandas_udf((lambda x, f=f: f(x)) if one else (lambda x, y, f=f: f(x, y)), returns, F.PandasUDFType.SCALAR))
        for name, (c, returns) in self.tables.items():
            spark.udtf.register(name, F.udtf(c, returnType=returns))
        return [*self.scalars, *self.tables]

    def group(self, df: DataFrame, by: str, name: str, column: str) -> DataFrame:
        """(by, value): a registered aggregate of each group's column."""
        import pandas as pd

        f, returns = self.aggregates[name]
        kind = dict(df.dtypes)[by]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [rows["k"].iloc[0]], "value": [f(rows["v"])]})

        return df.select(F.col(by).alias("k"), F.col(column).alias("v")).groupBy("k").applyInPandas(run, f"k {kind}, value {returns}").withColumnRenamed("k", by)

    def scan(self, folder: str) -> list[str]:
        """Loads the Python files of a folder, each of which defines register(registry)."""
        out = []
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            module.register(self)
            out.append(path.stem)
        return out
