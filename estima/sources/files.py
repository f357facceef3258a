"""Readers and writers. Formats that Spark reads are read by Spark; the rest go through pandas on the driver, within a
size that is checked, or raise where their library is missing."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("UTF-8", "windows-31j", "Shift_JIS", "ISO-8859-1")
SPARK_ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16")
#: Files that pandas reads on the driver may be no larger.
MAX_DRIVER_BYTES = 512 << 20
FORMATS = (".csv", ".tsv", ".txt", ".json", ".parquet", ".feather", ".arrow", ".xlsx", ".xls", ".h5", ".hdf5", ".dta", ".sav", ".sas7bdat", ".xpt")


def sniff(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The delimiter of a text file: that which parts its first lines alike, most often."""
    head = [r["value"] for r in spark.read.text(path).limit(lines).collect() if r["value"].strip()]
    best = (0, ",")
    for d in (",", "\t", ";", "|", " "):
        counts = {len(re.findall(re.escape(d) + ("+" if d == " " else ""), h.strip())) for h in head}
        if len(counts) == 1 and (n := counts.pop()) > best[0]:
            best = (n, d)
    return best[1]


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """With a header and inferred types. Without an encoding, the first of ENCODINGS in which no line has a character that
    can't be read; the test is one aggregate over the file."""
    for name in [encoding] if encoding else ENCODINGS:
        if name not in SPARK_ENCODINGS:  # the session then takes any character set that Java knows
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        text = spark.read.option("encoding", name).option("header", "false").option("sep", "\x01").csv(path)
        bad = text.agg(F.max(F.concat_ws("", *[F.col(c) for c in text.columns]).contains("�").cast("int"))).first()[0] if text.columns else 0
        if encoding or not bad:
            return spark.read.option("encoding", name).csv(path, header=True, inferSchema=True, sep=sep)
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


def _by_pandas(spark: SparkSession, path: str, read) -> DataFrame:
    local = path.removeprefix("file://")
    if os.path.getsize(local) > MAX_DRIVER_BYTES:
        raise ValueError(f"{path} is too large for a format that one process reads; convert it to Parquet")
    try:
        frame = read(local)
    except ImportError as error:
        raise ImportError(f"{os.path.splitext(local)[1]} files need an optional library: {error}") from error
    frame.columns = [str(c) for c in frame.columns]
    return spark.createDataFrame(frame)


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the path's extension; ValueError names the formats if it is none of them."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return read_csv(spark, path)
    if kind == ".tsv":
        return read_csv(spark, path, "\t")
    if kind == ".txt":
        return read_csv(spark, path, sniff(spark, path))
    if kind == ".json":
        return spark.read.option("multiLine", True).json(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".feather", ".arrow"):
        import pyarrow.feather

        if os.path.getsize(path.removeprefix("file://")) > MAX_DRIVER_BYTES:
            raise ValueError(f"{path} is too large for the driver; convert it to Parquet")
        return spark.createDataFrame(pyarrow.feather.read_table(path.removeprefix("file://")))
    import pandas as pd

    readers = {".xlsx": pd.read_excel, ".xls": pd.read_excel, ".h5": pd.read_hdf, ".hdf5": pd.read_hdf, ".dta": pd.read_stata, ".sav": pd.read_spss, ".sas7bdat": pd.read_sas, ".xpt": pd.read_sas}
    if kind in readers:
        return _by_pandas(spark, path, readers[kind])
    raise ValueError(f"can't read {kind or path}; formats: {', '.join(FORMATS)}")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_excel(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("too many rows for a sheet")
    rows.to_excel(path, index=False)


def _cells(df: DataFrame, most: int) -> tuple[list[list[str]], bool]:
    """(the first rows as texts, whether there are more)."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    rows = df.limit(most + 1).collect()
    return [[show(v) for v in r] for r in rows[:most]], len(rows) > most


def to_markdown(df: DataFrame, most: int = 200) -> str:
    """A table of the first rows; a last line says so if there are more."""
    cells, more = _cells(df, most)
    line = lambda row: "| " + " | ".join(x.replace("|", "\\|") for x in row) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in cells]] + [f"\nThe first {most} rows; there are more."] * more)


def to_latex(df: DataFrame, most: int = 200) -> str:
    """A table of the first rows; a last line says so if there are more."""
    cells, more = _cells(df, most)
    safe = lambda x: re.sub(r"([&%$#_{}])", r"\\\1", x)
    body = [" & ".join(safe(x) for x in row) + r" \\" for row in [df.columns, *cells]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"] + [f"The first {most} rows; there are more."] * more)


def save_project(path: str, tables: dict[str, DataFrame], history: Sequence[str] = (), labels: dict | None = None, weight: str | None = None) -> None:
    """Each table as Parquet and the rest as one JSON text; nothing is pickled."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = json.dumps({"tables": list(tables), "history": list(history), "labels": labels or {}, "weight": weight})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/project")


def load_project(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/project").collect()))
    return {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}, meta


def normal_noise(spark: SparkSession, n: int, seed: int = 42, partitions: int = 8) -> DataFrame:
    """(id, value): hashed by id, so that the values don't depend on the partitions."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return spark.range(0, n, 1, partitions).select("id", (F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))).alias("value"))


def synthetic(spark: SparkSession, n: int, kind: str = "regression", features: int = 3, seed: int = 42) -> DataFrame:
    """regression: y = 1 + sum j x_j + noise; classification: y drawn by a logit of the same; causal: treatment t by a
    logit of x and y = 2 t + the same."""
    def z(k: int):
        u = lambda m: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k), F.lit(m)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))

    df = spark.range(n).withColumns({f"x{j}": z(j) for j in range(1, features + 1)})
    line = sum(((j * F.col(f"x{j}")) for j in range(1, features + 1)), F.lit(1.0))
    chance = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(-1)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    if kind == "regression":
        return df.withColumn("y", line + z(0))
    if kind == "classification":
        return df.withColumn("y", (chance < 1 / (1 + F.exp(-line))).cast("int"))
    if kind == "causal":
        df = df.withColumn("t", (chance < 1 / (1 + F.exp(-0.5 * F.col("x1")))).cast("int"))
        return df.withColumn("y", 2 * F.col("t") + line + z(0))
    raise ValueError("kind must be regression, classification or causal")
