"""Bayesian estimation: likelihoods are reduced to sufficient statistics by Spark, chains run one a task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.result import coefficients, frame
from ..plans.gram import Gram, complete, gram
from .linear import INTERCEPT
from .optimise import fista, minimise, numeric_gradient, numeric_hessian, prox_l1

LogDensity = Callable[[np.ndarray], tuple[float, np.ndarray]]
SAMPLES = "chain int, draw int, param string, value double"


def hmc_chain(f: LogDensity, start: np.ndarray, draws: int = 1000, warmup: int = 500, steps: int = 10, target: float = 0.8, seed: int = 1, randomise: bool = False, thin: int = 1) -> tuple[np.ndarray, float, int]:
    """(samples, acceptance, divergences): leapfrog steps, dual averaging of the step size, a diagonal mass from the
    first half of the warm-up; randomise draws the number of steps for each trajectory."""
    random = np.random.RandomState(seed)
    x = np.asarray(start, float).copy()
    lp, g = f(x)
    mass, k = np.ones(len(x)), len(x)
    eps, log_bar, h_bar, mu, count = 0.1, 0.0, 0.0, math.log(1.0), 0
    out, accepted, diverged, seen = [], 0.0, 0, []
    for it in range(warmup + draws * thin):
        p = random.randn(k) * np.sqrt(mass)
        y, gy, ly, q = x.copy(), g.copy(), lp, p.copy()
        for _ in range(random.randint(1, 2 * steps) if randomise else steps):
            q = q + 0.5 * eps * gy
            y = y + eps * q / mass
            ly, gy = f(y)
            if not math.isfinite(ly):
                break
            q = q + 0.5 * eps * gy
        gap = (ly - 0.5 * (q * q / mass).sum()) - (lp - 0.5 * (p * p / mass).sum()) if math.isfinite(ly) else -math.inf
        a = min(1.0, math.exp(min(0.0, gap))) if gap > -700 else 0.0
        diverged += it >= warmup and gap < -1000
        if random.rand() < a:
            x, lp, g = y, ly, gy
        if it < warmup:
            count += 1
            h_bar = (1 - 1 / (count + 10)) * h_bar + (target - a) / (count + 10)
            log_eps = mu - math.sqrt(count) / 0.05 * h_bar
            w = count**-0.75
            log_bar = w * log_eps + (1 - w) * log_bar
            eps = math.exp(min(3.0, max(-12.0, log_eps)))
            seen.append(x)
            if it == warmup // 2 and len(seen) > 20:
                mass = 1 / np.maximum(np.var(seen[len(seen) // 2 :], axis=0), 1e-10)
                mu, h_bar, count = math.log(10 * eps), 0.0, 0
            if it == warmup - 1:
                eps = math.exp(log_bar)
        else:
            accepted += a
            if (it - warmup) % thin == 0:
                out.append(x)
    return np.array(out), accepted / max(1, draws * thin), diverged


def metropolis_chain(f: Callable[[np.ndarray], float], start: np.ndarray, draws: int = 2000, warmup: int = 1000, scale: float = 1.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """Random walk whose proposal follows the running covariance of the warm-up."""
    random = np.random.RandomState(seed)
    x = np.asarray(start, float).copy()
    k, lp = len(x), f(x)
    mean, cov, root = x.copy(), np.eye(k), np.eye(k) * scale
    out, hits = [], 0
    for it in range(warmup + draws):
        y = x + 2.38 / math.sqrt(k) * root @ random.randn(k)
        ly = f(y)
        if math.log(random.rand() + 1e-300) < ly - lp:
            x, lp = y, ly
            hits += it >= warmup
        if it < warmup:
            w = 1 / (it + 2)
            d = x - mean
            mean = mean + w * d
            cov = (1 - w) * cov + w * np.outer(d, x - mean)
            if it > 100 and it % 50 == 0:
                root = np.linalg.cholesky(cov + 1e-9 * np.eye(k))
        else:
            out.append(x)
    return np.array(out), hits / draws


def sample(spark: SparkSession, f: LogDensity, start: Sequence[float], names: Sequence[str], chains: int = 4, draws: int = 500, warmup: int = 500, seed: int = 1, **more) -> DataFrame:
    """(chain, draw, param, value): a chain a task; f goes to the executors as it is."""
    names, start = list(names), np.asarray(start, float)

    def run(frames):
        for rows in frames:
            for c in rows["id"]:
                x, _, _ = hmc_chain(f, start + 0.1 * np.random.RandomState(seed + 1000 * int(c)).randn(len(start)), draws, warmup, seed=seed + int(c), **more)
                yield pd.DataFrame({"chain": np.int32(c), "draw": np.repeat(np.arange(len(x), dtype="i4"), len(names)), "param": names * len(x), "value": x.ravel()})

    return spark.range(chains).repartition(chains).mapInPandas(run, SAMPLES)


def effective_size(x: np.ndarray) -> float:
    """Geyer's initial monotone sequence for one chain."""
    n = len(x)
    d = x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    acov = np.fft.irfft(np.abs(np.fft.rfft(d, size)) ** 2, size)[:n] / n
    if acov[0] <= 0:
        return float(n)
    rho, total, last = acov / acov[0], 0.0, math.inf
    for k in range(0, n - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair < 0:
            break
        last = min(last, pair)
        total += last
    return float(min(n, n / max(2 * total - 1, 1e-12)))


def summarise(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """(param, mean, sd, lower, median, upper, r_hat) from the samples."""
    q = F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit(0.5), F.lit((1 + level) / 2)))
    all_ = samples.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return all_.join(r_hat(samples), "param").select("param", "mean", "sd", F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "r_hat")


def r_hat(samples: DataFrame) -> DataFrame:
    """(param, r_hat) by the means and variances of the chains."""
    c = samples.groupBy("param", "chain").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    g = c.groupBy("param").agg(F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return g.select("param", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.coalesce("b", F.lit(0.0))) / F.col("w")).alias("r_hat"))


def variational(f: LogDensity, k: int, steps: int = 3000, rate: float = 0.01, draws: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sd) of a normal with independent parts, by reparameterised gradients and Adam; the last half is averaged."""
    random = np.random.RandomState(seed)
    theta, m, v = np.concatenate([np.zeros(k), np.full(k, -1.0)]), np.zeros(2 * k), np.zeros(2 * k)
    kept = np.zeros(2 * k)
    for step in range(1, steps + 1):
        g = np.zeros(2 * k)
        sd = np.exp(theta[k:])
        for _ in range(draws):
            e = random.randn(k)
            d = f(theta[:k] + sd * e)[1]
            g += np.concatenate([d, d * e * sd + 1]) / draws
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            kept += theta / (steps - steps // 2)
    return kept[:k], np.exp(kept[k:])


# --- priors and modes --------------------------------------------------------------------------------------------------


def log_prior(kind: str, scale: float = 1.0) -> LogDensity:
    if kind == "flat":
        return lambda x: (0.0, np.zeros_like(x))
    if kind == "gaussian":
        return lambda x: (-0.5 * float((x / scale) @ (x / scale)), -x / scale**2)
    if kind == "laplace":
        return lambda x: (-float(np.abs(x).sum()) / scale, -np.sign(x) / scale)
    if kind == "horseshoe":
        f = lambda x: float(np.log(np.log1p(2 * scale**2 / (x * x + 1e-12))).sum())
        return lambda x: (f(x), numeric_gradient(f, x))
    raise ValueError("prior must be flat, gaussian, laplace or horseshoe")


def map_estimate(log_likelihood: LogDensity, prior: LogDensity, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mode, covariance of the Laplace approximation, log evidence by it)."""
    loss = lambda x: -(log_likelihood(x)[0] + prior(x)[0])
    x, value, _ = minimise(loss, start, lambda x: -(log_likelihood(x)[1] + prior(x)[1]))
    h = numeric_hessian(loss, x)
    cov = np.linalg.inv(h)
    return x, cov, -value + 0.5 * len(x) * math.log(2 * math.pi) + 0.5 * float(np.linalg.slogdet(cov)[1])


def laplace_mode(g: Gram, y: str, x: Sequence[str], sigma2: float, scale: float) -> np.ndarray:
    """The mode of a linear model under Laplace priors: the lasso, by accelerated proximal gradient."""
    i, j = g.at(x), g.at([y])[0]
    a, b = g.centred[np.ix_(i, i)], g.centred[i, j]
    step = 1 / max(np.linalg.eigvalsh(a).max(), 1e-300)
    return fista(lambda w: a @ w - b, lambda z, t: prox_l1(z, t * sigma2 / scale), np.zeros(len(x)), step)


def linear_density(g: Gram, y: str, x: Sequence[str], prior_sd: float = 10.0, sigma_scale: float = 2.5) -> LogDensity:
    """Of (intercept, slopes, log sigma) with normal and half-Cauchy priors. The likelihood needs the Gram alone."""
    names = ["1", *x]
    xx, xy, yy, n = g.raw(names), g.raw(names, [y])[:, 0], g.raw([y])[0, 0], g.n

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        b, s = theta[:-1], math.exp(min(50.0, max(-50.0, theta[-1])))
        rss = yy - 2 * b @ xy + b @ xx @ b
        lp = -n * theta[-1] - 0.5 * rss / s**2 - 0.5 * (b @ b) / prior_sd**2 - math.log1p((s / sigma_scale) ** 2) + theta[-1]
        db = (xy - xx @ b) / s**2 - b / prior_sd**2
        ds = -n + rss / s**2 - 2 * (s / sigma_scale) ** 2 / (1 + (s / sigma_scale) ** 2) + 1
        return float(lp), np.append(db, ds)

    return f


class BayesianLinear:
    """Linear regression: one aggregate, then everything is on the driver or in chains that get the Gram."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], prior_sd: float = 10.0, sigma_scale: float = 2.5):
        self.spark, self.x = df.sparkSession, list(x)
        self.gram = gram(complete(df, {"__y": y, **{c: c for c in x}}), ["__y", *x])
        self.names = [INTERCEPT, *self.x, "log_sigma"]
        # Chains move in standardised columns, where a unit step is sensible in all directions.
        sd = np.sqrt(np.diag(self.gram.centred) / self.gram.n)
        self.scale, mean = sd, self.gram.mean
        unit = Gram(self.gram.names, self.gram.n, self.gram.w, np.zeros(len(sd)), self.gram.centred / np.outer(sd, sd))
        self.mean = mean
        self.density = linear_density(unit, "__y", self.x, prior_sd, sigma_scale)

    def _back(self, theta: np.ndarray) -> np.ndarray:
        theta = np.atleast_2d(theta)
        slope = theta[:, 1:-1] * self.scale[0] / self.scale[1:]
        const = self.mean[0] + theta[:, 0] * self.scale[0] - slope @ self.mean[1:]
        return np.column_stack([const, slope, theta[:, -1] + math.log(self.scale[0])])

    def fit_map(self) -> DataFrame:
        theta, cov, _ = map_estimate(self.density, log_prior("flat"), np.zeros(len(self.names)))
        jac = np.array([(self._back(theta + d) - self._back(theta - d))[0] / 2e-5 for d in np.eye(len(theta)) * 1e-5]).T
        return coefficients(self.spark, self.names, self._back(theta)[0], np.sqrt(np.diag(jac @ cov @ jac.T)))

    def sample(self, chains: int = 4, draws: int = 500, warmup: int = 500, seed: int = 1) -> DataFrame:
        f, names, k = self.density, self.names, len(self.names)
        start, spark = map_estimate(f, log_prior("flat"), np.zeros(k))[0], self.spark
        mean, scale = self.mean, self.scale

        def run(frames):
            for rows in frames:
                for c in rows["id"]:
                    t, _, _ = hmc_chain(f, start, draws, warmup, seed=seed + int(c))
                    slope = t[:, 1:-1] * scale[0] / scale[1:]
                    x = np.column_stack([mean[0] + t[:, 0] * scale[0] - slope @ mean[1:], slope, t[:, -1] + math.log(scale[0])])
                    yield pd.DataFrame({"chain": np.int32(c), "draw": np.repeat(np.arange(len(x), dtype="i4"), len(names)), "param": names * len(x), "value": x.ravel()})

        return spark.range(chains).repartition(chains).mapInPandas(run, SAMPLES)

    def fit_vi(self, seed: int = 1) -> DataFrame:
        mean, sd = variational(self.density, len(self.names), seed=seed)
        jac = np.array([(self._back(mean + d) - self._back(mean - d))[0] / 2e-5 for d in np.eye(len(mean)) * 1e-5]).T
        return frame(self.spark, list(zip(self.names, self._back(mean)[0], np.sqrt(np.diag(jac @ np.diag(sd**2) @ jac.T)))), "param string, mean double, sd double")


def logistic_density(df: DataFrame, y: str, x: Sequence[str], prior_sd: float = 10.0, most: int = 200_000, digits: int | None = None) -> LogDensity:
    """Of the slopes, without intercept. Rows are first reduced to distinct covariate patterns with their counts (digits
    rounds them); at most so many patterns come to the driver."""
    own = complete(df, {"__y": y, **{c: c for c in x}})
    if digits is not None:
        own = own.withColumns({c: F.round(f"`{c}`", digits) for c in x})
    p = own.groupBy(*[F.col(f"`{c}`") for c in x]).agg(F.count("*").alias("__n"), F.sum("__y").alias("__k")).limit(most + 1).toPandas()
    if len(p) > most:
        raise ValueError("too many distinct covariate patterns; round them with digits")
    m, n, k = p[list(x)].to_numpy(), p["__n"].to_numpy(float), p["__k"].to_numpy(float)

    def f(b: np.ndarray) -> tuple[float, np.ndarray]:
        eta = m @ b
        lp = float((k * eta - n * np.logaddexp(0, eta)).sum()) - 0.5 * float(b @ b) / prior_sd**2
        return lp, m.T @ (k - n / (1 + np.exp(-np.clip(eta, -500, 500)))) - b / prior_sd**2

    return f


def bayesian_logistic(df: DataFrame, y: str, x: Sequence[str], chains: int = 2, draws: int = 300, warmup: int = 300, seed: int = 1, digits: int | None = None) -> DataFrame:
    f = logistic_density(df, y, x, digits=digits)
    start = map_estimate(f, log_prior("flat"), np.zeros(len(x)))[0]
    return sample(df.sparkSession, f, start, list(x), chains, draws, warmup, seed)
