"""Jobs over sampled signals: one row is one (subject, trial, unit) array; numpy kernels run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import kernels

IDS = ["subject", "trial", "unit"]


def explode_samples(signals: DataFrame, fs: float, t0_ms: float = 0.0) -> DataFrame:
    """One row a sample: i, t_ms, x."""
    rows = signals.select(*[c for c in signals.columns if c != "samples"], F.posexplode("samples").alias("i", "x"))
    return rows.withColumn("i", F.col("i").cast("long")).withColumn("t_ms", t0_ms + F.col("i") * (1000.0 / fs))


def collect_samples(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The arrays again, in the order of i."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return samples.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias("samples"))


def welch_psd(signals: DataFrame, fs: float, window_sec: float, overlap: float, nfft: int | None = None, f_min: float = 0.0, f_max: float = float("inf"), detrend: bool = False) -> DataFrame:
    """Replaces samples by f and p, the one-sided Welch densities in [f_min, f_max]. Signals under 8 samples have
    null ones."""

    @F.pandas_udf("struct<f:array<double>,p:array<double>>")
    def run(samples: pd.Series) -> pd.DataFrame:
        def make(block: np.ndarray) -> list[tuple]:
            if block.shape[1] < 8:
                return [None] * len(block)
            f, p = kernels.welch(block, fs, window_sec, overlap, nfft, detrend)
            keep = (f >= f_min) & (f <= f_max)
            return [(f[keep], row[keep]) for row in p]

        made = kernels.by_length(samples.tolist(), make)
        return pd.DataFrame({"f": [m and m[0] for m in made], "p": [m and m[1] for m in made]})

    return signals.withColumn("_s", run("samples")).select(*[c for c in signals.columns if c != "samples"], "_s.f", "_s.p")


def psd_long(psd: DataFrame) -> DataFrame:
    """One row a bin."""
    return psd.select(*[c for c in psd.columns if c not in ("f", "p")], F.explode(F.arrays_zip("f", "p")).alias("_z")).select("*", "_z.f", "_z.p").drop("_z")


def windowed_psd(signals: DataFrame, fs: float, windows: dict[str, tuple[int, int]], window_sec: float) -> DataFrame:
    """Adds ``window``: densities of sample ranges [start, end) that share one segment length, so that bins align.

    A range with fewer than 8 samples is an error; a signal that doesn't reach it has null densities."""
    shortest = min(b - a for a, b in windows.values())
    if shortest < 8:
        raise ValueError("a window has fewer than 8 samples")
    seconds = min(window_sec, shortest / fs)
    cut = F.array(*[F.struct(F.lit(n).alias("window"), F.when(F.size("samples") >= b, F.slice("samples", a + 1, b - a)).alias("part")) for n, (a, b) in windows.items()])
    rows = signals.withColumn("_w", F.explode(cut)).withColumns({"window": F.col("_w.window"), "samples": F.col("_w.part")}).drop("_w")
    return welch_psd(rows, fs, seconds, 0.5)


def spectrogram_ga(signals: DataFrame, fs: float, win: int, overlap: int, t0_ms: float = 0.0) -> DataFrame:
    """(subject, trial, f, t_ms, p, db): squared moduli averaged over units."""

    @F.pandas_udf("array<struct<f:double,frame:int,p:double>>")
    def run(samples: pd.Series) -> pd.Series:
        def make(block: np.ndarray) -> list[list[dict]]:
            if block.shape[1] < win:
                return [[] for _ in block]
            power = kernels.stft_power(block, win, win - overlap)
            f = np.arange(power.shape[2]) * fs / win
            return [[{"f": float(f[k]), "frame": t, "p": float(v)} for t, line in enumerate(row) for k, v in enumerate(line)] for row in power]

        return pd.Series(kernels.by_length(samples.tolist(), make))

    rows = signals.select("subject", "trial", F.explode(run("samples")).alias("_c")).select("subject", "trial", "_c.*")
    mean = rows.groupBy("subject", "trial", "f", "frame").agg(F.avg("p").alias("p"))
    at = t0_ms + (F.col("frame") * (win - overlap) + win / 2) * (1000.0 / fs)
    return mean.select("subject", "trial", "f", at.alias("t_ms"), "p", (10 * F.log10(F.col("p") + 1e-12)).alias("db"))


def _on_arrays(signals: DataFrame, make, column: str = "samples") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series(kernels.by_length(samples.tolist(), make))

    return signals.withColumn(column, run("samples"))


def bandpass(signals: DataFrame, fs: float, low: float | None, high: float | None, taps: int | None = None) -> DataFrame:
    """Zero-phase windowed-sinc filter; without ``low`` a low-pass, without ``high`` a high-pass."""
    h = kernels.sinc_taps(fs, low, high, taps)
    return _on_arrays(signals, lambda x: kernels.zero_phase(x, h))


def notch(signals: DataFrame, fs: float, at: float, width: float = 1.0, taps: int | None = None) -> DataFrame:
    h = kernels.sinc_taps(fs, at - width, at + width, taps or int(3.3 * fs / width), stop=True)
    return _on_arrays(signals, lambda x: kernels.zero_phase(x, h))


def resample(signals: DataFrame, fs: float, target: float) -> DataFrame:
    return signals if fs == target else _on_arrays(signals, lambda x: kernels.resample(x, fs, target))


def rereference(samples: DataFrame, keys: list[str], channels: list[str] | None = None, unit: str = "unit") -> DataFrame:
    """Subtracts at each sample the mean over all units, or over the reference ones."""
    w = Window.partitionBy(*keys, "i")
    used = F.col("x") if channels is None else F.when(F.col(unit).isin(channels), F.col("x"))
    return samples.withColumn("x", F.col("x") - F.avg(used).over(w))


def baseline_correct(signals: DataFrame, first: int, last: int) -> DataFrame:
    """Subtracts from each array the mean of its samples first..last."""
    part = F.slice("samples", first + 1, last - first + 1)
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    return signals.withColumn("_m", mean).withColumn("samples", F.transform("samples", lambda x: x - F.col("_m"))).drop("_m")


def hilbert_phase(signals: DataFrame, fs: float, low: float, high: float, at: int, taps: int | None = None) -> DataFrame:
    """Replaces samples by the phase of the band's analytic signal at one sample."""
    h = kernels.sinc_taps(fs, low, high, taps)

    @F.pandas_udf("double")
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series(kernels.by_length(samples.tolist(), lambda x: np.angle(kernels.analytic(kernels.zero_phase(x, h))[:, at]).tolist()))

    return signals.withColumn("phase", run("samples")).drop("samples")


def hilbert_phases(signals: DataFrame, fs: float, low: float, high: float, taps: int | None = None) -> DataFrame:
    """The phase at every sample, as an array."""
    h = kernels.sinc_taps(fs, low, high, taps)
    return _on_arrays(signals, lambda x: np.angle(kernels.analytic(kernels.zero_phase(x, h)))).withColumnRenamed("samples", "phases")


#: Cells of a matrix of channels that every task may hold.
MATRIX_CELLS = 1_000_000


def _matrix(weights: DataFrame) -> tuple[list[str], list[str], np.ndarray] | None:
    """(outputs, inputs, matrix) of weights (unit_in, unit_out, w), or none of more than MATRIX_CELLS rows."""
    rows = weights.limit(MATRIX_CELLS + 1).collect()
    if len(rows) > MATRIX_CELLS:
        return None
    outputs, inputs = (sorted({r[c] for r in rows}) for c in ("unit_out", "unit_in"))
    if len(outputs) * len(inputs) > MATRIX_CELLS:
        return None
    made = np.zeros((len(outputs), len(inputs)))
    row, column = ({u: i for i, u in enumerate(names)} for names in (outputs, inputs))
    for r in rows:
        made[row[r["unit_out"]], column[r["unit_in"]]] += r["w"]
    return outputs, inputs, made


def _by_matrix(signals: DataFrame, keys: list[str], outputs: list[str], inputs: list[str], matrix: np.ndarray, base: bool) -> DataFrame:
    """(keys, unit, samples): the matrix times the packed channels of each of the keys; with ``base`` each channel minus
    its row of the product, channels without a row as they are."""
    place = {u: k for k, u in enumerate(inputs)}
    packed = signals.groupBy(*keys).agg(F.collect_list(F.struct("unit", "samples")).alias("_c"))
    packed = packed.select(*keys, F.transform("_c", lambda c: c["unit"]).alias("_units"), F.transform("_c", lambda c: c["samples"]).alias("_samples"))
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                units = batch.column(k)[i].as_py()
                waves = [np.nan_to_num(np.array(w, float)) for w in batch.column(k + 1)[i].as_py()]
                size = max(map(len, waves), default=0)
                x, lengths = np.zeros((len(inputs), size)), np.zeros(len(inputs), int)
                for u, w in zip(units, waves):
                    if u in place:
                        x[place[u], : len(w)] = w
                        lengths[place[u]] = len(w)
                product = matrix @ x
                if base:
                    of = {u: product[r] for r, u in enumerate(outputs)}
                    names, made = units, [w - of[u][: len(w)] if u in of else w for u, w in zip(units, waves)]
                else:
                    long = [int(max(lengths[matrix[r] != 0], default=0)) for r in range(len(outputs))]
                    names, made = zip(*[(u, product[r, : long[r]]) for r, u in enumerate(outputs) if long[r]]) if any(long) else ((), ())
                at = pa.array([i] * len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:k]), pa.array(names, pa.string()), pa.array(list(made), pa.list_(pa.float64()))], names=[*keys, "unit", "samples"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes[:k])
    return packed.mapInArrow(run, f"{kinds}, unit string, samples array<double>")


def _long(signals: DataFrame, keys: list[str]) -> DataFrame:
    return signals.select(*keys, "unit", F.posexplode("samples").alias("i", "x"))


def _arrays(samples: DataFrame, keys: list[str]) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("i", "x")))
    return samples.groupBy(*keys, "unit").agg(F.transform(points, lambda p: p["x"]).alias("samples"))


def apply_matrix(signals: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, samples): arrays of weights (unit_in, unit_out, w) times the channels (keys, unit, samples) of each of the keys.

    What is shuffled is one array a channel, and a channel that is missing or shorter, or a missing sample, counts as 0. Weights
    of more than MATRIX_CELLS are joined, with a row for each sample."""
    made = _matrix(weights)
    if made is None:
        return _arrays(apply_linear(_long(signals, keys), weights, keys), keys)
    return _by_matrix(signals, keys, *made, base=False)


def remove_parts(signals: DataFrame, unmix: DataFrame, mix: DataFrame, drop: list[str], keys: list[str]) -> DataFrame:
    """Arrays minus the part of the dropped components, mixing (unit_in component) of unmixing (unit_out component): both are
    one matrix between channels."""
    one, two = _matrix(unmix.where(F.col("unit_out").isin(drop))), _matrix(mix.where(F.col("unit_in").isin(drop)))
    if one is None or two is None or len(one[1]) * len(two[0]) > MATRIX_CELLS:
        return _arrays(remove_components(_long(signals, keys), unmix, mix, drop, keys), keys)
    names, inputs, w = one
    outputs, parts, a = two
    through = np.array([[a[r, parts.index(c)] if c in parts else 0.0 for c in names] for r in range(len(outputs))]).reshape(len(outputs), len(names))
    return _by_matrix(signals, keys, outputs, inputs, through @ w, base=True)


def apply_linear(samples: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, i, x): x of unit_out is the sum of w * x over unit_in, at every sample."""
    rows = samples.withColumnRenamed("unit", "unit_in").join(F.broadcast(weights) if weights.count() <= 100_000 else weights, "unit_in")
    return rows.groupBy(*keys, F.col("unit_out").alias("unit"), "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def remove_components(samples: DataFrame, unmix: DataFrame, mix: DataFrame, drop: list[str], keys: list[str]) -> DataFrame:
    """x minus the part of the dropped components: mixing (unit_in component) of unmixing (unit_out component)."""
    parts = apply_linear(samples, unmix.where(F.col("unit_out").isin(drop)), keys)
    back = apply_linear(parts, mix, keys).withColumnRenamed("x", "_part")
    return samples.join(back, [*keys, "unit", "i"], "left").withColumn("x", F.col("x") - F.coalesce("_part", F.lit(0.0))).drop("_part")


def roi_time_course(samples: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, i, x): mean of sign * x over the members (unit, roi, sign) of each region."""
    rows = samples.join(F.broadcast(members) if members.count() <= 100_000 else members, "unit")
    return rows.groupBy(*keys, F.col("roi").alias("unit"), "i").agg(F.avg(F.col("sign") * F.col("x")).alias("x"))


def suggest_components(probabilities: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reasons): components with a class at or over its limit; probabilities: keys, class, p; limits: class, limit."""
    hits = probabilities.join(F.broadcast(limits), "class").where(F.col("p") >= F.col("limit"))
    named = F.array_sort(F.collect_list(F.concat("class", F.lit("="), F.format_number("p", 3))))
    return hits.groupBy(*keys).agg(F.concat_ws(" + ", named).alias("reasons"))


def fit_aperiodic(psd: DataFrame, low: float = 2.0, high: float = 40.0, band: tuple[float, float] = (8.0, 12.0), knee: bool = False) -> DataFrame:
    """psd (ids, f, p arrays) to ids and a struct of fits; see kernels.fit_aperiodic."""

    @F.pandas_udf("struct<offset:double,exponent:double,knee:double,r2:double,error:double,alpha_cf:double,alpha_pw:double,alpha_bw:double,fail_reason:string>")
    def run(f: pd.Series, p: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("offset", "exponent", "knee", "r2", "error", "alpha_cf", "alpha_pw", "alpha_bw"))
        made = [kernels.fit_aperiodic(np.asarray(a, float), np.asarray(b, float), low, high, band, knee) if a is not None else empty | {"fail_reason": "no spectrum"} for a, b in zip(f, p)]
        out = pd.DataFrame(made, columns=[*empty, "fail_reason"])
        return out.astype({c: float for c in empty}).astype({"fail_reason": object})

    return psd.withColumn("fit", run("f", "p")).drop("f", "p")


@F.udtf(returnType="cf double, pw double, bw double")
class SpectralPeaks:
    """A row for each peak of a spectrum above its aperiodic part, from the highest down: centre, height in log power, width."""

    def eval(self, f: list, p: list, low: float, high: float, most: int) -> Iterator[tuple[float, float, float]]:
        if f is not None and p is not None:
            yield from kernels.fit_spectrum(np.asarray(f, float), np.asarray(p, float), low, high, peaks=most)[1]


def spectral_peaks(psd: DataFrame, low: float = 2.0, high: float = 40.0, most: int = 6) -> DataFrame:
    """psd (ids, f, p arrays) to (ids, cf, pw, bw): all its peaks, up to ``most`` a spectrum; one without peaks has no row."""
    found = SpectralPeaks(F.col("f").outer(), F.col("p").outer(), F.lit(low), F.lit(high), F.lit(most))
    return psd.lateralJoin(found).drop("f", "p")


def aperiodic_line(psd_long: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, offset, exponent, r2) of the ordinary log-log line, in one aggregation."""
    rows = psd_long.where(F.col("f").between(low, high) & (F.col("p") > 0) & (F.col("f") > 0)).select(*keys, F.log10("f").alias("x"), F.log10("p").alias("y"))
    return rows.groupBy(*keys).agg(F.regr_intercept("y", "x").alias("offset"), (-F.regr_slope("y", "x")).alias("exponent"), F.regr_r2("y", "x").alias("r2"))


def build_epochs(recordings: DataFrame, events: DataFrame, mapping: DataFrame, fs: float, before_sec: float, after_sec: float, baseline_sec: tuple[float, float]) -> DataFrame:
    """Events labelled, epochs cut around them and baseline-corrected; epoch_index counts a subject's epochs."""
    from cadenza.operators.joins import epochs, label_events

    before, after = round(before_sec * fs), round(after_sec * fs)
    cut = epochs(recordings, label_events(events, mapping), before, after)
    corrected = baseline_correct(cut, before + round(baseline_sec[0] * fs), before + round(baseline_sec[1] * fs))
    return corrected.withColumn("epoch_index", F.dense_rank().over(Window.partitionBy("subject", "unit").orderBy("at")))
