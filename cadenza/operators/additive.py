"""Additive mixed models of many formulas at once: rows are read once, for all models together.

Rows are stored once, in buckets by subject. One pass over them makes, for each key, the sums of products of the columns of all terms
of all models; a model's normal equations are a part of these. Subjects' sums are made as their rows pass and never leave the task. Rows that lack a value take part in the models that don't
use it: sums are kept apart by which columns are missing. Subjects' random intercepts are the transform of generalised
least squares, which follows from the sums: with a share theta of its means taken from each of a subject's n rows, the
products lose (2 theta - theta^2) / n times the outer product of its sums.

Curves are natural cubic splines whose penalty is the integral of the squared second derivative; every curve, surface and random
group has a penalty of its own, found by coordinate search for the least generalised cross-validation score. The numbers
are those of this estimator, not of a REML fit.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.distributions import beta_share
from cadenza.operators.filters import guarded_corr
from cadenza.operators.joins import dimension
from cadenza.sources.scratch import bucketed, scratch_path

#: Penalties that are tried, as shares of the rows; knots of a curve; points of an effect.
PENALTIES = (0.0, 1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0)
KNOTS, POINTS = 6, 200
#: Levels that a factor may have.
LEVELS = 64


@dataclass(frozen=True)
class Model:
    """A formula: an intercept, random intercepts of the subject, and these."""

    name: str
    metrics: tuple[str, ...] = ()
    smooths: tuple[str, ...] = ()
    linear: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()
    tensors: tuple[tuple[str, str], ...] = ()
    groups: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.smooths, *self.linear, *self.factors, *(c for t in self.tensors for c in t), *self.groups]))


def listed(models: list[tuple[str, list[str], bool, bool, bool]], base: Model, aperiodic: tuple[str, ...] = ("fooof_offset", "fooof_exponent"), straight: tuple[str, ...] = ("sin_phase", "cos_phase")) -> list[Model]:
    """Rows of a registry (name, metrics, aperiodic, cap, tensor) as formulas on ``base``."""
    out = []
    for name, metrics, with_aperiodic, cap, tensor in models:
        curved = () if tensor else tuple(m for m in metrics if m not in straight)
        out.append(
            Model(
                name, tuple(metrics), base.smooths + curved + (aperiodic if with_aperiodic else ()), base.linear + tuple(m for m in metrics if m in straight and not tensor),
                base.factors + (("cap_size",) if cap else ()), base.tensors + ((tuple(metrics),) if tensor else ()), base.groups,
            )
        )
    return out


def combinations_of(metrics: list[str], sizes: list[int], base: Model, tensors: list[tuple[str, str]] | None = None) -> list[Model]:
    """``base`` and a model of each choice of so many metrics: curves, or a surface for a pair listed in ``tensors``."""
    from itertools import combinations

    out = [Model("m00_baseline", (), base.smooths, base.linear, base.factors, base.tensors, base.groups)]
    for size in sizes:
        for some in combinations(metrics, size):
            pair = size == 2 and any(set(p) == set(some) for p in tensors or [])
            name = f"m_{size}metric_" + "_x_".join(m.removesuffix("_z") for m in some)
            out.append(Model(name, some, base.smooths + (() if pair else some), base.linear, base.factors, base.tensors + ((some,) if pair else ()), base.groups))
    return out


def spline(x: np.ndarray, knots: list[float]) -> np.ndarray:
    """(rows, knots - 1): x itself and the natural cubic bends; x alone for fewer than three knots."""
    if len(knots) < 3:
        return x[:, None]
    last = knots[-1]
    cube = [np.maximum(x - k, 0.0) ** 3 for k in knots]
    bends = [(c - cube[-1]) / (last - k) for c, k in zip(cube[:-1], knots[:-1])]
    return np.stack([x, *(b - bends[-1] for b in bends[:-1])], 1)


def curvature(knots: list[float]) -> np.ndarray:
    """The integrals of the products of the basis functions' second derivatives."""
    k = len(knots) - 1 if len(knots) >= 3 else 1
    out = np.zeros((k, k))
    for a, b in zip(knots, knots[1:]) if k > 1 else ():
        at = np.array([a, (a + b) / 2, b])  # they are straight between knots, so Simpson's rule is exact
        hinge = [6 * (np.maximum(at - c, 0) - np.maximum(at - knots[-1], 0)) / (knots[-1] - c) for c in knots[:-1]]
        second = np.stack([np.zeros(3), *(h - hinge[-1] for h in hinge[:-1])])
        out += (second * np.array([1, 4, 1]) * (b - a) / 6) @ second.T
    return out


@dataclass
class Design:
    """The columns of all terms of all models. ``missing``: inputs that some row lacks; ``at``: the places of each block's columns,
    the intercept being 0."""

    curves: dict[str, list[float]]
    straight: list[str]
    levels: dict[str, list]
    tensors: list[tuple[str, str]]
    missing: set[str] = field(default_factory=set)
    at: dict[str, list[int]] = field(default_factory=dict)
    width: int = 1

    def __post_init__(self) -> None:
        place = lambda name, n: self.at.setdefault(name, list(range(self.width, self.width + n)))
        sizes = [*((f"s({c})", max(1, len(k) - 1)) for c, k in self.curves.items()), *((c, 1) for c in self.straight), *((c, len(v)) for c, v in self.levels.items())]
        sizes += [(f"te({a},{b})", max(1, len(self.curves[a]) - 1) * max(1, len(self.curves[b]) - 1)) for a, b in self.tensors]
        for name, n in sizes:
            place(name, n)
            self.width += n

    def inputs(self) -> list[str]:
        return [*dict.fromkeys([*self.curves, *self.straight]), *(c for c in self.levels)]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """Missing values count as 0 here; their columns belong to models that don't use these rows."""
        out = np.zeros((len(rows), self.width))
        out[:, 0] = 1
        made = {}
        for c, knots in self.curves.items():
            x = rows[c].to_numpy(float)
            made[c] = spline(np.where(np.isnan(x), 0.0, x), knots)
            out[:, self.at[f"s({c})"]] = made[c]
        for c in self.straight:
            x = rows[c].to_numpy(float)
            out[:, self.at[c][0]] = np.where(np.isnan(x), 0.0, x)
        for c, values in self.levels.items():
            for j, v in zip(self.at[c], values):
                out[:, j] = (rows[c] == v).to_numpy()
        for a, b in self.tensors:
            out[:, self.at[f"te({a},{b})"]] = (made[a][:, :, None] * made[b][:, None, :]).reshape(len(rows), -1)
        return out

    def blocks(self, m: Model) -> list[tuple[str, list[int], np.ndarray | None]]:
        """(term, columns, penalty matrix or none) of a model."""
        out = [(f"s({c})", self.at[f"s({c})"], curvature(self.curves[c]) if len(self.curves[c]) >= 3 else None) for c in m.smooths]
        for a, b in m.tensors:
            mains = [c for c in (a, b) if c not in m.smooths]
            own = self.at[f"te({a},{b})"]
            columns = [j for c in mains for j in self.at[f"s({c})"]] + own
            soft = [False if j == self.at[f"s({c})"][0] else True for c in mains for j in self.at[f"s({c})"]] + [True] * len(own)
            out.append((f"te({a},{b})", columns, np.diag(np.array(soft, float))))
        out += [(c, self.at[c], None) for c in m.linear]
        out += [(c, self.at[c][1:], None) for c in m.factors if len(self.at[c]) > 1]
        return out + [(c, self.at[c], np.eye(len(self.at[c]))) for c in m.groups if len(self.at[c]) > 1]


def arranged(df: DataFrame, keys: list[str], columns: list[str], subject: str, outcome: str) -> DataFrame:
    """The columns, _subject and _y, stored in buckets by subject: sums of a subject's rows are made where they lie, whatever is
    fitted. Values that aren't numbers are missing. If ``df`` is dealt by subject already, no row moves."""
    real = {c for c, t in df.dtypes if t in ("float", "double")}
    rows = df.select(*keys, F.col(subject).alias("_subject"), F.col(outcome).cast("double").alias("_y"), *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in columns])
    return bucketed(_together(rows), "model-rows", "_subject")


def _together(rows: DataFrame) -> DataFrame:
    """The rows of a subject follow each other in one task; rows that are dealt by subject stay where they are."""
    return rows.withColumn("_rows", F.count("*").over(Window.partitionBy("_subject")))


def _design(rows: DataFrame, models: list[Model], knots: int) -> Design:
    first = lambda kind: list(dict.fromkeys(c for m in models for c in kind(m)))
    tensors = first(lambda m: m.tensors)
    curves = list(dict.fromkeys([*first(lambda m: m.smooths), *(c for t in tensors for c in t)]))
    shares = F.array(*[F.lit(i / (knots - 1)) for i in range(knots)])
    inputs = first(lambda m: m.columns())
    found = rows.agg(F.count("*").alias("_all"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(inputs)], *[F.percentile_approx(c, shares, F.lit(10_000)).alias(f"_c{i}") for i, c in enumerate(curves)]).first()
    levels = {}
    for f in first(lambda m: (*m.factors, *m.groups)):
        levels[f] = [r[0] for r in rows.select(f).where(F.col(f).isNotNull()).distinct().orderBy(f).limit(LEVELS + 1).collect()]
        if len(levels[f]) > LEVELS:
            raise ValueError(f"{f} has more than {LEVELS} levels")
    missing = {c for i, c in enumerate(inputs) if found[f"_n{i}"] < found["_all"]}
    return Design({c: sorted(set(map(float, found[f"_c{i}"] or [0.0]))) for i, c in enumerate(curves)}, first(lambda m: m.linear), levels, tensors, missing)


def _ratios(rows: DataFrame, keys: list[str], missing: Column, needs: list[int], intercepts: bool) -> DataFrame:
    """(keys, _r0, _k0, _r1, _k1, ...), stored: of the rows that have each need's columns the ratio of the subjects' variance to that within them by
    the moments of a one-way layout, and the number of subjects."""
    own = rows.groupBy(*keys, "_subject", missing.alias("_gone")).agg(F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    each = own.withColumn("_need", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(need).cast("long").alias("mask")) for i, need in enumerate(needs)])))
    each = each.where(F.col("_gone").bitwiseAND(F.col("_need.mask")) == 0).groupBy(*keys, "_subject", F.col("_need.i").alias("_need")).agg(*[F.sum(c).alias(c) for c in ("n", "sy", "yy")])
    moments = {"k": F.count("*"), "nn": F.sum(F.col("n") * F.col("n").cast("double")), "b": F.sum(F.col("sy") * F.col("sy") / F.col("n"))} | {c: F.sum(c) for c in ("n", "sy", "yy")}
    between = each.groupBy(*keys, "_need").agg(*[v.alias(c) for c, v in moments.items()])
    inner = (F.col("yy") - F.col("b")) / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    share = ((F.col("b") - F.col("sy") * F.col("sy") / F.col("n")) / (F.col("k") - 1) - inner) / n0 / F.nullif(inner, F.lit(0.0))
    usable = F.lit(intercepts) & (F.col("k") > 1) & (F.col("n") > F.col("k"))
    between = between.withColumn("_r", F.when(usable, F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).otherwise(0.0))
    of = lambda c, i: F.max(F.when(F.col("_need") == i, F.col(c)))
    wide = between.groupBy(*keys).agg(*[x for i in range(len(needs)) for x in (of("_r", i).alias(f"_r{i}"), of("k", i).alias(f"_k{i}"))])
    path = scratch_path(rows.sparkSession, "model-ratios")
    wide.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _sums(rows: DataFrame, keys: list[str], design: Design, needs: list[int]) -> DataFrame:
    """Rows of two kinds, stored: (keys, whole true, part: a bit for each missing column, n, v: products of outcome and columns, then least and
    greatest curve values), and (keys, whole false, part: a need, v: what the subjects' shares take from its products). Of products the upper
    halves. ``rows`` hold the needs' ratios; a subject's sums are held only while its rows pass."""
    inputs, width = design.inputs(), design.width + 1
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keys) + ", whole boolean, part long, n long, v array<double>"
    half = np.triu_indices(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[tuple, list] = {}
        taken: dict[tuple, np.ndarray] = {}
        held: dict[tuple, tuple] = {}
        last = None

        def take(key: tuple, k: int, n: np.ndarray, s: np.ndarray, ratio: float) -> None:
            if ratio > 0:
                taken[key, k] = taken.get((key, k), 0.0) + (s * (ratio / (1 + n * ratio))[:, None]).T @ s

        def close(some: dict[tuple, tuple]) -> None:
            for (key, k), (n, s, ratio) in some.items():
                take(key, k, np.array([n]), s[None], ratio)

        for batch in batches:
            x = np.column_stack([batch["_y"].to_numpy(float), design.matrix(batch)])
            gone = np.zeros(len(batch), np.int64)
            for bit, c in enumerate(inputs):
                gone |= batch[c].isna().to_numpy().astype(np.int64) << bit
            ranges = np.stack([batch[c].to_numpy(float) for c in design.curves], 1) if design.curves else np.zeros((len(batch), 0))
            named = batch[[*keys, "_subject"]].assign(_gone=gone)
            for key, at in named.groupby([*keys, "_gone"], sort=False, dropna=False).indices.items():
                own, edge = x[at], ranges[at]
                with np.errstate(all="ignore"):
                    low, high = np.fmin.reduce(edge, 0), np.fmax.reduce(edge, 0)
                n, v, lows, highs = whole.get(key, (0, 0.0, np.full(edge.shape[1], np.nan), np.full(edge.shape[1], np.nan)))
                whole[key] = n + len(at), v + own.T @ own, np.fmin(low, lows), np.fmax(high, highs)
            group = named.groupby([*keys, "_subject"], sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            heads = order[starts]
            sorted_x, sorted_gone = x[order], gone[order]
            subjects = batch["_subject"].to_numpy()
            first, final, of = subjects[0], subjects[-1], subjects[heads]
            key_of = list(named.iloc[heads][keys].itertuples(index=False, name=None))
            codes = named.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()[heads]
            if held and first != last:
                close(held)
                held = {}
            begun, passed = np.flatnonzero(of == first), np.flatnonzero(of == final)
            new: dict[tuple, tuple] = {}
            for k, need in enumerate(needs):
                some = (sorted_gone & need) == 0
                n = np.add.reduceat(some.astype(float), starts)
                s = np.add.reduceat(sorted_x if some.all() else sorted_x * some[:, None], starts, axis=0)
                ratio = batch[f"_r{k}"].fillna(0.0).to_numpy(float)[heads]
                if held:
                    for g in begun:
                        more = held.pop((key_of[g], k), None)
                        if more:
                            n[g], s[g] = n[g] + more[0], s[g] + more[1]
                new |= {(key_of[g], k): (n[g], s[g].copy(), ratio[g]) for g in passed}
                rest = of != final
                for code in np.unique(codes[rest]):
                    at = np.flatnonzero(rest & (codes == code))
                    take(key_of[at[0]], k, n[at], s[at], ratio[at[0]])
            if final == first:
                new |= held
            else:
                close(held)
            held, last = new, final
        close(held)
        made = [[*key[:-1], True, key[-1], n, np.concatenate((v[half], a, b))] for key, (n, v, a, b) in whole.items()]
        made += [[*key, False, k, 0, v[half]] for (key, k), v in taken.items()]
        yield pd.DataFrame(made, columns=[*keys, "whole", "part", "n", "v"])

    path = scratch_path(rows.sparkSession, "model-sums")
    rows.mapInPandas(run, kinds).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _merged(parts: DataFrame, keys: list[str], merge: Callable[[list[np.ndarray]], np.ndarray], salts: int = 16) -> DataFrame:
    """(keys, n, v) of rows (keys, n, v), in two steps, so that no task holds the parts of all tasks."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in parts.select(*keys, "n", "v").dtypes)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        one = own.iloc[0]
        return pd.DataFrame([[*(one[c] for c in keys), own["n"].sum(), merge(list(own["v"]))]], columns=[*keys, "n", "v"])

    salted = parts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    first = salted.groupBy(*keys, "_salt").applyInPandas(lambda own: run(own[[*keys, "n", "v"]]), kinds)
    return first.groupBy(*keys).applyInPandas(run, kinds)


FIT = (
    "model string, metrics array<string>, n_metrics int, n long, n_subjects long, edf double, deviance double, dev_expl double, r_sq double, aic double, bic double, f double, p double,"
    " theta_ratio double, terms array<struct<term:string,edf:double,f:double,p:double,penalty:double>>, columns array<int>, coef array<double>,"
    " effects array<struct<term:string,x:array<double>,fit:array<double>,se:array<double>>>"
)


def _search(n: float, yy: float, xy: np.ndarray, xx: np.ndarray, penalties: list[np.ndarray | None]) -> tuple:
    """(shares, inverse, coefficients, edf, rss, hat) with the least n rss / (n - edf)^2: one penalty at a time, until none gains."""
    jitter = 1e-11 * np.trace(xx) / len(xx) * np.eye(len(xx))

    def at(shares: list[float]) -> tuple:
        s = np.linalg.inv(xx + jitter + n * sum(w * p for w, p in zip(shares, penalties) if p is not None and w))
        b, hat = s @ xy, s @ xx
        edf, rss = float(np.trace(hat)), max(float(yy - 2 * b @ xy + b @ xx @ b), 1e-300)
        return n * rss / max(n - edf, 1.0) ** 2, list(shares), s, b, edf, rss, hat

    best = at([1e-2 if p is not None else 0.0 for p in penalties])
    for _ in range(6):
        before = best[0]
        for k, p in enumerate(penalties):
            for w in PENALTIES if p is not None else ():
                if w != best[1][k]:
                    tried = at([w if i == k else v for i, v in enumerate(best[1])])
                    if tried[0] < best[0] * (1 - 1e-9):
                        best = tried
        if best[0] >= before * (1 - 1e-6):
            break
    return best[1:]


def _fitted(m: Model, design: Design, n: int, people: int, ratio: float, raw: np.ndarray, moved: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict | None:
    """A model from the products (outcome first) of its rows, ``raw`` as they are and ``moved`` by the subjects' shares."""
    blocks = design.blocks(m)
    spread = np.sqrt(np.maximum(np.diag(raw)[1:] / n - (raw[1, 1:] / n) ** 2, 0))
    usable = lambda j: spread[j] > 1e-9 * max(1.0, abs(raw[1, j + 1] / n))
    used, parts = [0], []
    for term, columns, penalty in blocks:
        keep = [i for i, j in enumerate(columns) if usable(j)]
        at = list(range(len(used), len(used) + len(keep)))
        if keep:
            used += [columns[i] for i in keep]
            scale = 1 / spread[[columns[i] for i in keep]]
            own = penalty[np.ix_(keep, keep)] * np.outer(scale, scale) if penalty is not None else None
            if own is not None and np.trace(own) > 0:
                own = own / np.trace(own) * np.count_nonzero(np.diag(own) > 0)
            parts.append((term, at, own if own is not None and np.trace(own) > 0 else None))
    if n <= len(used):
        return None
    scale = np.r_[1.0, 1 / spread[used[1:]]]
    pick = np.array(used) + 1
    xx, xy, yy = moved[np.ix_(pick, pick)] * np.outer(scale, scale), moved[0, pick] * scale, float(moved[0, 0])
    whole = []
    for _, at, own in parts:
        if own is not None:
            padded = np.zeros_like(xx)
            padded[np.ix_(at, at)] = own
            own = padded
        whole.append(own)
    shares, s, b, edf, rss, hat = _search(float(n), yy, xy, xx, whole)
    null = yy - xy[0] ** 2 / xx[0, 0]
    left = max(n - edf, 1.0)
    sigma = rss / left
    loglik = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1)
    terms, effects = [], []
    for (term, at, own), share in zip(parts, shares):
        d = max(float(np.trace(hat[np.ix_(at, at)])), 1e-9)
        f = max(float(b[at] @ np.linalg.pinv(s[np.ix_(at, at)], rcond=1e-9, hermitian=True) @ b[at] / sigma / d), 0.0)
        terms.append({"term": term, "edf": d, "f": f, "p": float(beta_share(left / 2, d / 2, left / (left + d * f))), "penalty": share if own is not None else None})
        if term.startswith("s("):
            column = term[2:-1]
            k = list(design.curves).index(column)
            x = np.linspace(low[k], high[k], POINTS)
            columns = [used[i] for i in at]
            basis = spline(x, design.curves[column])[:, [design.at[term].index(j) for j in columns]]
            apart = (basis - raw[1, np.array(columns) + 1] / n) * scale[at]
            se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", apart, s[np.ix_(at, at)], apart), 0) * sigma)
            effects.append({"term": column, "x": x.tolist(), "fit": (apart @ b[at]).tolist(), "se": se.tolist()})
    df1 = max(edf - 1, 1e-9)
    f = max((null - rss) / df1 / sigma, 0.0)
    return {
        "model": m.name, "metrics": list(m.metrics), "n_metrics": len(m.metrics), "n": n, "n_subjects": people, "edf": edf, "deviance": rss, "dev_expl": 1 - rss / null if null > 0 else None,
        "r_sq": 1 - sigma * (n - 1) / null if null > 0 else None, "aic": 2 * (edf + 1) - 2 * loglik, "bic": math.log(n) * (edf + 1) - 2 * loglik, "f": f,
        "p": float(beta_share(left / 2, df1 / 2, left / (left + df1 * f))), "theta_ratio": ratio, "terms": terms, "columns": used, "coef": (b * scale).tolist(), "effects": effects,
    }


def additive_mixed_fits(df: DataFrame, keys: list[str], models: list[Model], subject: str, outcome: str, knots: int = KNOTS, intercepts: bool = True) -> DataFrame:
    """A row of FIT for each of the keys and models: what the reference's screens list, each term's edf, F, p and penalty,
    and of each curve its partial effect on POINTS places of its range with the standard error at each.

    A model takes the rows that have its own columns, outcome and subject; with too few it has no row. ``coef`` are those of
    ``columns`` of the design, the intercept first. Knots are quantiles of the whole table. Without ``intercepts`` subjects have
    no random ones. deviance, AIC and BIC are those of the transformed rows: they compare models of one key and outcome."""
    columns = list(dict.fromkeys(c for m in models for c in m.columns()))
    return arranged_fits(arranged(df, keys, columns, subject, outcome), keys, models, knots, intercepts)


def arranged_fits(rows: DataFrame, keys: list[str], models: list[Model], knots: int = KNOTS, intercepts: bool = True) -> DataFrame:
    """``additive_mixed_fits`` of rows that are ``arranged``, for these and maybe other keys and models too."""
    design = _design(rows, models, knots)
    inputs, width = design.inputs(), design.width + 1
    if len(inputs) > 62:
        raise ValueError("more than 62 columns")
    need = {m.name: sum(1 << inputs.index(c) for c in m.columns() if c in design.missing) for m in models}
    needs = sorted(set(need.values()))
    of = {name: needs.index(n) for name, n in need.items()}
    own_keys = keys or ["_one"]
    used = rows.where(F.col("_y").isNotNull() & F.col("_subject").isNotNull())
    used = used.select(*([] if keys else [F.lit(0).alias("_one")]), *keys, "_subject", "_y", *[F.col(c) if c in design.levels else F.col(c).cast("double").alias(c) for c in inputs])
    gone = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(inputs) if c in design.missing]
    ratios = _ratios(used, own_keys, functools.reduce(lambda a, b: a + b, gone, F.lit(0).cast("long")), needs, intercepts)
    sums = _sums(_together(used.join(dimension(ratios.select(*own_keys, *[f"_r{k}" for k in range(len(needs))])), own_keys)), own_keys, design, needs)
    kinds = ", ".join(f"`{c}` {t}" for c, t in sums.dtypes[: len(own_keys)])
    half = np.triu_indices(width)
    size, curves = len(half[0]), len(design.curves)
    added = lambda some: np.concatenate((np.sum([v[:size] for v in some], 0), np.fmin.reduce([v[size : size + curves] for v in some]), np.fmax.reduce([v[size + curves :] for v in some])))
    whole = _merged(sums.where("whole").select(*own_keys, "part", "n", "v"), [*own_keys, "part"], added).groupBy(*own_keys).agg(F.collect_list("part").alias("missing"), *[F.collect_list(c).alias(c) for c in ("n", "v")])
    lost = _merged(sums.where(~F.col("whole")).select(*own_keys, "part", "n", "v"), [*own_keys, "part"], lambda some: np.sum(some, 0)).groupBy(*own_keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "v"))).alias("taken"))
    ready = whole.join(ratios, own_keys).join(lost, own_keys, "left").withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))))
    # Models of one key are solved apart.
    ready = ready.repartition(*own_keys, "_model")

    def full(v: np.ndarray) -> np.ndarray:
        out = np.zeros((width, width))
        out[half] = v
        return out + np.triu(out, 1).T

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.to_dict("records"):
                m = models[r["_model"]]
                k = of[m.name]
                some = [(n, np.asarray(v)) for gone, n, v in zip(r["missing"], r["n"], r["v"]) if gone & need[m.name] == 0]
                if not some:
                    continue
                taken = dict(r["taken"]) if r["taken"] is not None else {}
                raw = full(np.sum([v[:size] for _, v in some], 0))
                with np.errstate(all="ignore"):
                    low, high = np.fmin.reduce([v[size : size + curves] for _, v in some]), np.fmax.reduce([v[size + curves :] for _, v in some])
                moved = raw - full(np.asarray(taken[k])) if k in taken else raw
                fit = _fitted(m, design, int(sum(n for n, _ in some)), int(r[f"_k{k}"]), float(r[f"_r{k}"]), raw, moved, low, high)
                if fit:
                    made.append({c: r[c] for c in own_keys} | fit)
            yield pd.DataFrame(made, columns=[*own_keys, *(c.split()[0] for c in _top_level(FIT))])

    path = scratch_path(rows.sparkSession, "model-fits")
    ready.mapInPandas(solve, f"{kinds}, {FIT}").select(*keys, *(c.split()[0] for c in _top_level(FIT))).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _top_level(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def term_rows(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, term, edf, f, p, penalty): a row for each term of each fit."""
    return fits.select(*keys, "model", F.inline("terms"))


def smooth_effects(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, term, x, effect, se, low, high): the partial effect of each curve at each point, and 1.96 errors around it."""
    rows = fits.select(*keys, "model", F.inline("effects")).select(*keys, "model", "term", F.inline(F.arrays_zip("x", "fit", "se")))
    return rows.select(*keys, "model", "term", "x", F.col("fit").alias("effect"), "se", (F.col("fit") - 1.96 * F.col("se")).alias("low"), (F.col("fit") + 1.96 * F.col("se")).alias("high"))


def effect_concordance(channel: DataFrame, source: DataFrame, concepts: DataFrame, keys: list[str]) -> DataFrame:
    """(concept, keys, r, same_direction): the correlation of two models' effects on the channel's points, the source's
    interpolated there and held beyond its ends. ``concepts``: concept, channel_model, channel_term, source_model,
    source_term; those without terms are left out. ``keys``: of the source's fits."""
    effect = lambda fits, k, by: fits.select(*by, F.col("model").alias(f"{k}_model"), F.inline("effects")).select(*by, f"{k}_model", F.col("term").alias(f"{k}_term"), F.col("x").alias(f"{k}_x"), F.col("fit").alias(f"{k}_fit"))
    rows = dimension(concepts.where("channel_term IS NOT NULL AND source_term IS NOT NULL"))
    both = effect(source, "source", keys).join(rows, ["source_model", "source_term"]).join(dimension(effect(channel, "channel", [])), ["channel_model", "channel_term"])

    @F.pandas_udf("array<double>")
    def moved(x: pd.Series, own: pd.Series, fit: pd.Series) -> pd.Series:
        return pd.Series([np.interp(a, b, c) for a, b, c in zip(x, own, fit)])

    points = both.withColumn("_s", moved("channel_x", "source_x", "source_fit")).select("concept", *keys, F.inline(F.arrays_zip(F.col("channel_fit").alias("_c"), F.col("_s").alias("_v"))))
    return points.groupBy("concept", *keys).agg(guarded_corr("_c", "_v").alias("r")).withColumn("same_direction", F.col("r") > 0)


def quality_by_concept(channel: DataFrame, source: DataFrame, concepts: DataFrame, key: str) -> DataFrame:
    """(concept, channel_model, source_model, best: the source's key of least AIC, both AICs, delta_aic = channel - source,
    delta_dev_expl = source - channel) of ``concepts`` (concept, channel_model, source_model); one without a source fit stays."""
    c = channel.select(F.col("model").alias("channel_model"), F.col("aic").alias("channel_aic"), F.col("dev_expl").alias("channel_dev_expl"))
    least = source.groupBy(F.col("model").alias("source_model")).agg(F.min(F.struct("aic", key, "dev_expl")).alias("_b"))
    s = least.select("source_model", F.col(f"_b.{key}").alias("best"), F.col("_b.aic").alias("source_aic"), F.col("_b.dev_expl").alias("source_dev_expl"))
    both = dimension(concepts.select("concept", "channel_model", "source_model")).join(c, "channel_model").join(s, "source_model", "left")
    return both.withColumns({"delta_aic": F.col("channel_aic") - F.col("source_aic"), "delta_dev_expl": F.col("source_dev_expl") - F.col("channel_dev_expl")})
