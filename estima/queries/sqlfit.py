"""SQL text for least squares of any number of regressors: the centred cross-products, swept column by column."""

from __future__ import annotations

from collections.abc import Sequence


def _cell(i: int, j: int) -> str:
    return f"a_{min(i, j)}_{max(i, j)}"


def inverse(i: int, j: int) -> str:
    """The column of a swept fit that holds the inverse of the centred cross-products of regressors i and j (from 1)."""
    return f"(-{_cell(i, j)})"


def swept(name: str, rows: str, x: Sequence[str], y: str = "y", by: str = "", weight: str = "") -> str:
    """CTEs, the last called name: n, means m1.., my, coefficients b0, b1.., rss, tss and the inverse, a row for each by."""
    k, cols = len(x), [*x, y]
    pairs = [(i, j) for i in range(1, k + 2) for j in range(i, k + 2)]
    kept = [*([by] if by else []), "n", *[f"m{i}" for i in range(1, k + 1)], "my", "tss"]
    mean = (lambda c: f"sum({weight} * {c}) / sum({weight})") if weight else (lambda c: f"avg({c})")
    means = ", ".join(f"{mean(c)} AS m{i}" for i, c in enumerate(cols, 1))
    part = f"{by}, " if by else ""
    group, join = (f" GROUP BY {by}", f" JOIN {name}_m USING ({by})") if by else ("", f", {name}_m")
    times = f"{weight} * " if weight else ""
    sums = ", ".join(f"sum({times}({cols[i - 1]} - m{i}) * ({cols[j - 1]} - m{j})) AS {_cell(i, j)}" for i, j in pairs)
    same = ", ".join(f"max(m{i}) AS {'my' if i == k + 1 else f'm{i}'}" for i in range(1, k + 2))
    out = [f"{name}_r AS (SELECT * FROM {rows})", f"{name}_m AS (SELECT {part}{means} FROM {name}_r{group})"]
    out.append(f"{name}_0 AS (SELECT *, {_cell(k + 1, k + 1)} AS tss FROM (SELECT {part}CAST(count(*) AS DOUBLE) AS n, {same}, {sums} FROM {name}_r{join}{group}))")
    for p in range(1, k + 1):
        d = _cell(p, p)
        new = [f"-1 / {d} AS {d}" if i == j == p else f"{_cell(i, j)} / {d} AS {_cell(i, j)}" if p in (i, j) else f"{_cell(i, j)} - {_cell(i, p)} * {_cell(j, p)} / {d} AS {_cell(i, j)}" for i, j in pairs]
        out.append(f"{name}_{p} AS (SELECT {', '.join([*kept, *new])} FROM {name}_{p - 1})")
    b = [f"{_cell(i, k + 1)}" for i in range(1, k + 1)]
    const = " - ".join(["my", *[f"{c} * m{i}" for i, c in enumerate(b, 1)]])
    out.append(f"{name} AS (SELECT *, {const} AS b0, {', '.join(f'{c} AS b{i}' for i, c in enumerate(b, 1))}, {_cell(k + 1, k + 1)} AS rss FROM {name}_{k})")
    return ",\n".join(out)


def residual(x: Sequence[str], y: str = "y") -> str:
    return " - ".join([y, "b0", *[f"b{i} * {c}" for i, c in enumerate(x, 1)]])


def shares(x: Sequence[str]) -> list[str]:
    """By coefficient, the intercept first: how much a unit of a row's residual moves it."""
    z = [f"({c} - m{i})" for i, c in enumerate(x, 1)]
    own = ["(" + " + ".join(f"{inverse(i, j)} * {c}" for j, c in enumerate(z, 1)) + ")" for i in range(1, len(x) + 1)]
    return ["(1 / n - " + " - ".join(f"m{i} * {c}" for i, c in enumerate(own, 1)) + ")", *own]


def leverage(x: Sequence[str]) -> str:
    own = shares(x)[1:]
    return "(1 / n + " + " + ".join(f"({c} - m{i}) * {o}" for i, (c, o) in enumerate(zip(x, own), 1)) + ")"
