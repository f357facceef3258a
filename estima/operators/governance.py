"""Credibility of models: an index, thresholds, objections, history, what-if, narratives and reports."""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.result import frame
from .linear import Fit, ols
from .prep import override

#: Shares of fit, steadiness and invariance in the index, and the least index by how strict one is.
SHARES = (0.4, 0.3, 0.3)
THRESHOLDS = {"strict": 0.8, "normal": 0.5, "exploratory": 0.0}


def credibility(r2: Column, mean: Column, std: Column, invariant: Column) -> Column:
    """struct(fit, topology, geometry, score) of metrics; missing r2 and invariance count as 0.5."""
    fit = F.greatest(F.lit(0.0), F.coalesce(r2, F.lit(0.5)))
    topology = F.coalesce(F.greatest(F.lit(0.0), 1 - 2 * std / (F.abs(mean) + 1e-9)), F.lit(0.5))
    geometry = F.coalesce(invariant, F.lit(0.5))
    score = SHARES[0] * fit + SHARES[1] * topology + SHARES[2] * geometry
    return F.struct(fit.alias("fit"), topology.alias("topology"), geometry.alias("geometry"), score.alias("score"))


@dataclass
class Verdict:
    score: float
    threshold: float
    accepted: bool
    messages: list[str]
    suggestions: list[str]
    objections: list[str]
    next_action: str


class Rejected(ValueError):
    def __init__(self, verdict: Verdict):
        super().__init__(f"credibility {verdict.score:.2f} is below {verdict.threshold:.2f}: {'; '.join(verdict.messages)}")
        self.verdict = verdict


def score(metrics: dict[str, float]) -> float:
    r2 = metrics.get("r2")
    fit = max(0.0, 0.5 if r2 is None or math.isnan(r2) else r2)
    mean, std = metrics.get("mean_structure"), metrics.get("std_structure")
    topology = 0.5 if mean is None or std is None else max(0.0, 1 - 2 * std / (abs(mean) + 1e-9))
    return SHARES[0] * fit + SHARES[1] * topology + SHARES[2] * metrics.get("invariant_ratio", 0.5)


def translate(metrics: dict[str, float]) -> list[str]:
    out = []
    r2 = metrics.get("r2")
    if r2 is not None and r2 < 0.3:
        out.append("the model explains little of the outcome")
    elif r2 is not None and r2 < 0.6:
        out.append("the model explains part of the outcome")
    mean, std = metrics.get("mean_structure"), metrics.get("std_structure")
    if mean and std is not None and std / abs(mean) > 0.1:
        out.append("the structure is unsteady over draws")
    if metrics.get("jump"):
        out.append("the structure jumps")
    if metrics.get("invariant_ratio", 1.0) < 0.8:
        out.append("the result depends on how the data are turned")
    return out


def messages_column(r2: Column) -> Column:
    return F.when(r2 < 0.3, "the model explains little of the outcome").when(r2 < 0.6, "the model explains part of the outcome").otherwise("")


def critique(metrics: dict[str, float], mode: str = "normal", raise_: bool = False) -> Verdict:
    value, least = score(metrics), THRESHOLDS[mode]
    texts = translate(metrics)
    suggestions, objections = [], []
    if metrics.get("r2", 1.0) < 0.3:
        suggestions += ["add columns that bear on the outcome", "look for a transformation of skewed columns"]
        objections.append("fit")
    if "the structure is unsteady over draws" in texts or metrics.get("jump"):
        suggestions.append("standardise the columns and look for outliers")
        objections.append("stability")
    if metrics.get("invariant_ratio", 1.0) < 0.8:
        suggestions.append("check the units of the columns")
        objections.append("invariance")
    ok = value >= least and not (metrics.get("jump") and mode == "strict")
    verdict = Verdict(value, least, ok, texts, suggestions, objections, "accept" if ok else suggestions[0] if suggestions else "gather more data")
    if raise_ and not ok:
        raise Rejected(verdict)
    return verdict


def ols_metrics(fit: Fit) -> dict[str, float]:
    return {"r2": fit.metrics()["r2"], "mean_structure": 5.0, "std_structure": 0.1, "invariant_ratio": 1.0}


def fit_and_judge(df: DataFrame, y: str, x: Sequence[str], mode: str = "normal") -> tuple[Fit, Verdict]:
    fit = ols(df, y, x)
    return fit, critique(ols_metrics(fit), mode, raise_=True)


def quickstart(df: DataFrame, y: str, mode: str = "exploratory") -> tuple[Fit, Verdict]:
    """All other numeric columns as regressors."""
    from .prep import numeric_columns

    return fit_and_judge(df, y, [c for c in numeric_columns(df) if c != y], mode)


def stagnation(history: DataFrame, order: str, value: str, last: int = 3, width: float = 0.01) -> DataFrame:
    """history with its change and whether the last values lie within width. A history is short: one window."""
    w = Window.orderBy(order)
    span = w.rowsBetween(1 - last, 0)
    out = history.withColumn("change", F.col(value) - F.lag(value).over(w))
    return out.withColumn("stagnant", (F.count(value).over(span) >= last) & (F.max(value).over(span) - F.min(value).over(span) < width))


def counter_intuitive(metrics: dict[str, float], manifold: Sequence[float] = ()) -> list[str]:
    """Findings that deserve a second look: a fine fit without structure, a steady structure without fit, a sign that
    turns along a manifold."""
    out = []
    s, r2 = score(metrics), metrics.get("r2", 0.5)
    if r2 > 0.8 and metrics.get("invariant_ratio", 1.0) < 0.5:
        out.append("a good fit that does not survive a change of frame")
    if r2 < 0.2 and s > 0.6:
        out.append("a steady structure behind a poor fit")
    if any(a * b < 0 for a, b in zip(manifold, manifold[1:])):
        out.append("the effect changes its sign along the manifold")
    return out


def gradients(manifold: DataFrame, at: str, value: str) -> DataFrame:
    """The slope towards the next point of a manifold, in its order."""
    w = Window.orderBy(at)
    return manifold.withColumn("slope", (F.lead(value).over(w) - F.col(value)) / (F.lead(at).over(w) - F.col(at)))


def refinement(manifold: DataFrame, at: str, value: str) -> float | None:
    """Between the two points that differ most."""
    w = Window.orderBy(at)
    r = manifold.withColumn("gap", F.abs(F.lead(value).over(w) - F.col(value))).withColumn("mid", (F.lead(at).over(w) + F.col(at)) / 2).where("gap IS NOT NULL").orderBy(F.desc("gap")).first()
    return r["mid"] if r else None


def what_if(df: DataFrame, prediction: Column, changes: dict[str, object | Callable[[Column], Column]], keep: Sequence[str] = ()) -> DataFrame:
    """baseline, scenario, delta and pct_change (0 where a baseline is about 0) per row."""
    own = df.withColumn("__baseline", prediction)
    out = override(own, changes).withColumn("scenario", prediction)
    return out.select(*keep, F.col("__baseline").alias("baseline"), "scenario", (F.col("scenario") - F.col("__baseline")).alias("delta"), F.when(F.abs("__baseline") < 1e-9, 0.0).otherwise(100 * (F.col("scenario") - F.col("__baseline")) / F.abs("__baseline")).alias("pct_change"))


# --- narratives ------------------------------------------------------------------------------------------------------------


class Adapter:
    """Turns a result into what a narrative needs; derive from it for other models."""

    def question(self) -> str:
        return "What bears on the outcome?"

    def findings(self) -> list[str]:
        raise NotImplementedError

    def cautions(self) -> list[str]:
        return []


class FitAdapter(Adapter):
    def __init__(self, fit: Fit, outcome: str):
        self.fit, self.outcome = fit, outcome

    def question(self) -> str:
        return f"What bears on {self.outcome}?"

    def findings(self) -> list[str]:
        out = []
        for t, b, s in zip(self.fit.terms, self.fit.beta, self.fit.se):
            if t != "intercept":
                sure = abs(b) > 1.96 * s
                out.append(f"one more of {t} goes with {b:+.4g} of {self.outcome}" + ("" if sure else ", within chance"))
        return out

    def cautions(self) -> list[str]:
        m = self.fit.metrics()
        return [f"the model explains {100 * m['r2']:.1f} % of the variance over {m['n']} rows"]


class EffectAdapter(Adapter):
    def __init__(self, effects: DataFrame, design: str):
        self.rows, self.design = effects.collect(), design

    def question(self) -> str:
        return f"What is the effect by {self.design}?"

    def findings(self) -> list[str]:
        return [f"{r['estimand']} is {r['estimate']:.4g}, between {r['ci_lower']:.4g} and {r['ci_upper']:.4g}" for r in self.rows]

    def cautions(self) -> list[str]:
        return ["the effect is causal only under the design's assumptions"]


def narrative(adapter: Adapter) -> str:
    part = lambda title, lines: title + "\n" + "\n".join(f"- {x}" for x in lines)
    return "\n\n".join([part("Question", [adapter.question()]), part("Findings", adapter.findings()), part("Cautions", adapter.cautions() or ["none noted"])])


def answer(question: str, report: dict[str, object]) -> str:
    """By keywords: why, improve, reliable, next; else the summary."""
    q = question.lower()
    pick = {"why": "messages", "improve": "suggestions", "better": "suggestions", "reliable": "score", "trust": "score", "next": "next_action"}
    for word, key in pick.items():
        if word in q and key in report:
            v = report[key]
            return "; ".join(map(str, v)) if isinstance(v, list) else str(v)
    return str(report.get("summary", "no answer in this report"))


@dataclass
class StepLog:
    steps: list[tuple[str, str]] = field(default_factory=list)

    def add(self, step: str, note: str = "") -> None:
        self.steps.append((step, note))

    def frame(self, spark) -> DataFrame:
        return frame(spark, [(i, s, n) for i, (s, n) in enumerate(self.steps)], "position int, step string, note string")


def script(model: str, **parameters) -> str:
    """A snippet that repeats a call of this library."""
    calls = {"ols": "linear.ols", "iv": "causal.iv", "psm": "causal.psm", "bayes": "bayes.BayesianLinear"}
    if model not in calls:
        raise ValueError(f"no script for {model}")
    module, name = calls[model].split(".")
    args = ", ".join(f"{k}={v!r}" for k, v in parameters.items())
    return f"from estima.operators import {module}\n\nresult = {module}.{name}(df, {args})\n"


def strategy(columns: dict[str, str], instrument: str | None = None, time: str | None = None, x_levels: int | None = None) -> str:
    """iv with an instrument, did for a two-valued treatment over time, else rdd."""
    if instrument and instrument in columns:
        return "iv"
    return "did" if time and x_levels == 2 else "rdd"


def report(title: str, sections: dict[str, DataFrame | str], most: int = 1000) -> str:
    """An HTML page of texts and tables, of each the first rows; a line below says so if there are more."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, content in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(content, str):
            parts.append(f"<p>{html.escape(content)}</p>")
            continue
        cells = lambda row, tag: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in row)
        rows = content.limit(most + 1).collect()
        parts.append("<table><tr>" + cells(content.columns, "th") + "</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows[:most]) + "</table>" + f"<p>The first {most} rows; there are more.</p>" * (len(rows) > most))
    return "".join(parts) + "</body></html>"


def refusal_report(verdict: Verdict) -> str:
    return f"<html><body><h1>Rejected</h1><p>Credibility {verdict.score:.2f}, needed {verdict.threshold:.2f}.</p><ul>{''.join(f'<li>{html.escape(m)}</li>' for m in verdict.messages)}</ul><p>Next: {html.escape(verdict.next_action)}</p></body></html>"
