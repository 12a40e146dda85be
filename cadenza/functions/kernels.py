"""Numeric kernels on batches of sample arrays, for use inside tasks; Spark deals out the rows.

Each takes a 2-D block of equally long rows; ``by_length`` groups a batch accordingly."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np


def by_length(rows: Sequence[Sequence[float] | None], make: Callable[[np.ndarray], Sequence]) -> list:
    """``make`` of each block of equally long rows, in the order of ``rows``; null rows give null."""
    out: list = [None] * len(rows)
    places: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        if r is not None and len(r):
            places.setdefault(len(r), []).append(i)
    for where in places.values():
        block = np.array([np.asarray(rows[i], float) for i in where])
        for i, made in zip(where, make(block)):
            out[i] = made
    return out


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)


def welch_sizes(n: int, fs: float, window_sec: float, overlap: float, nfft: int | None = None) -> tuple[int, int, int]:
    """(window, overlap, transform length) in samples: the window has 8 samples at least and n at most."""
    win = min(n, max(8, int(np.floor(window_sec * fs + 0.5))))
    return win, int(np.floor(win * overlap + 0.5)), max(nfft or 1 << int(np.ceil(np.log2(win))), win)


def welch(x: np.ndarray, fs: float, window_sec: float, overlap: float, nfft: int | None = None, detrend: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided densities [rows, bins]): mean over Hamming segments. Rows with a missing sample
    have missing densities."""
    win, over, size = welch_sizes(x.shape[1], fs, window_sec, overlap, nfft)
    w = hamming(win)
    starts = range(0, x.shape[1] - win + 1, max(1, win - over))
    total = 0.0
    for s in starts:
        part = x[:, s : s + win]
        if detrend:
            part = part - part.mean(axis=1, keepdims=True)
        total = total + np.abs(np.fft.rfft(part * w, size, axis=1)) ** 2
    p = total / len(starts) / (fs * (w * w).sum())
    p[:, 1 : (size + 1) // 2] *= 2
    return np.arange(p.shape[1]) * fs / size, p


def sinc_taps(fs: float, low: float | None, high: float | None, taps: int | None = None, stop: bool = False) -> np.ndarray:
    """A windowed-sinc filter of odd length: low-pass (low is None), high-pass (high is None), band-pass, or
    band-stop."""
    edge = min(v for v in (low, high) if v)
    n = taps or int(2 * np.ceil(1.65 * fs / max(0.5, min(edge, 2.0))) + 1)
    n += 1 - n % 2
    t = np.arange(n) - n // 2
    pass_below = lambda f: 2 * f / fs * np.sinc(2 * f / fs * t) if f else np.zeros(n)
    h = (pass_below(high) if high else np.where(t == 0, 1.0, 0.0)) - pass_below(low)
    h = h * hamming(n)
    unit = np.where(t == 0, 1.0, 0.0)
    if stop:
        h = unit - h
    if low is None and not stop:
        h = h / h.sum()
    return h


def zero_phase(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolution without delay; the ends are mirrored."""
    half = len(taps) // 2
    pad = min(half, x.shape[1] - 1)
    wide = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1)
    size = 1 << int(np.ceil(np.log2(wide.shape[1] + len(taps))))
    full = np.fft.irfft(np.fft.rfft(wide, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)
    return full[:, half + pad : half + pad + x.shape[1]]


def rational_rate(fs: float, target: float) -> tuple[int, int]:
    """(up, down) with target = fs * up / down."""
    share = Fraction(target).limit_denominator(10**6) / Fraction(fs).limit_denominator(10**6)
    share = share.limit_denominator(10_000)
    return share.numerator, share.denominator


def polyphase_taps(up: int, down: int, half: int = 10) -> np.ndarray:
    """A low-pass for the rate fs * up, below the lower of both Nyquist frequencies: ``half`` of its zeros on either side, under a Kaiser window."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(t / wide) / wide * np.kaiser(len(t), 5.0)
    return h / h.sum() * up


def resample(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """A polyphase filter bank of a rational rate: what zeros between samples, the filter and every ``down``-th value
    would give, each output from the branch of taps that meets samples. The ends are mirrored."""
    up, down = rational_rate(fs, target)
    if up == down:
        return x
    h = polyphase_taps(up, down)
    half, n = len(h) // 2, x.shape[1]
    size = -(-len(h) // up)
    bank = np.zeros((up, size))
    for phase in range(up):
        branch = h[phase::up]
        bank[phase, : len(branch)] = branch
    pad = min(size, n - 1)
    wide = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1) if pad else x
    wide = np.pad(wide, ((0, 0), (size - pad, size - pad)))
    at = np.arange(-(-n * up // down)) * down + half
    first, phase = at // up + size, at % up
    out = np.empty((len(x), len(at)))
    for p in np.unique(phase):
        some = np.flatnonzero(phase == p)
        out[:, some] = wide[:, first[some][:, None] - np.arange(size)] @ bank[p]
    return out


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def stft_power(x: np.ndarray, win: int, step: int) -> np.ndarray:
    """[rows, frames, bins]: squared moduli of Hamming segments."""
    starts = np.arange(0, x.shape[1] - win + 1, step)
    parts = x[:, starts[:, None] + np.arange(win)] * hamming(win)
    return np.abs(np.fft.rfft(parts, axis=2)) ** 2


def _half_height(x: np.ndarray, y: np.ndarray, i: int) -> tuple[float, float]:
    """Where y falls to half of y[i] on either side, between bins; a side that never does mirrors the other."""
    sides = []
    for step in (-1, 1):
        k = i
        while 0 <= k + step < len(x) and y[k + step] > y[i] / 2:
            k += step
        n = k + step
        if 0 <= n < len(x):
            share = (y[k] - y[i] / 2) / (y[k] - y[n])
            sides.append(abs(x[k] + share * (x[n] - x[k]) - x[i]))
        else:
            sides.append(None)
    left, right = (s if s is not None else o if o is not None else abs(x[-1] - x[0]) / 2 for s, o in (sides, sides[::-1]))
    return float(x[i] - left), float(x[i] + right)


def fit_aperiodic(f: np.ndarray, p: np.ndarray, low: float = 2.0, high: float = 40.0, band: tuple[float, float] = (8.0, 12.0), knee: bool = False, peaks: int = 4, threshold: float = 2.0, rounds: int = 5) -> dict[str, float | str | None]:
    """Offset, exponent (and knee) of a 1/f spectrum with Gaussian peaks, and the strongest peak in ``band``. A spectrum that
    can't be fitted has null numbers and a reason."""
    fit, found = fit_spectrum(f, p, low, high, knee, peaks, threshold, rounds)
    own = max((q for q in found if band[0] <= q[0] <= band[1]), key=lambda q: q[1], default=(None,) * 3)
    return fit | dict(zip(("alpha_cf", "alpha_pw", "alpha_bw"), own))


def fit_spectrum(f: np.ndarray, p: np.ndarray, low: float, high: float, knee: bool = False, peaks: int = 4, threshold: float = 2.0, rounds: int = 5) -> tuple[dict[str, float | str | None], list[tuple[float, float, float]]]:
    """The fit, and its peaks (centre, height, width) from the highest down.

    A robust line in log-log axes, Gaussians taken off the flattened spectrum from the highest down, and the line
    again on what is left."""
    names = ("offset", "exponent", "knee", "r2", "error")
    empty = dict.fromkeys(names)
    keep = (f >= low) & (f <= high) & (f > 0)
    if keep.sum() < 5:
        return empty | {"fail_reason": "too few bins"}, []
    if not np.all(np.isfinite(p[keep])) or np.any(p[keep] <= 0):
        return empty | {"fail_reason": "powers aren't positive"}, []
    x, y = f[keep], np.log10(p[keep])

    def line(values: np.ndarray, share: float) -> tuple[float, float, float]:
        best = None
        for k in (0.0, *np.geomspace(0.5, 200, 25)) if knee else (0.0,):
            g = np.log10(k + x**2) if k else np.log10(x)
            a = np.stack((np.ones_like(g), -g), 1)
            inside = np.ones(len(g), bool)
            for _ in range(3):
                b = np.linalg.lstsq(a[inside], values[inside], rcond=None)[0]
                left = values - a @ b
                inside = left <= np.quantile(left, share)
            e = float(((values - a @ b)[inside] ** 2).sum())
            if best is None or e < best[0] - 1e-12:
                best = e, (float(b[0]), float(b[1]) * (2 if k else 1), float(k))
        return best[1]

    shape = lambda o, e, k: o - (np.log10(k + x ** (2 if k else 1)) * (e / 2 if k else e))
    found: list[tuple[float, float, float]] = []
    bumps = np.zeros_like(y)
    for turn in range(rounds):
        o, e, k = line(y - bumps, 0.9 if turn else 0.6)
        flat, found, bumps = y - shape(o, e, k), [], np.zeros_like(y)
        rest = flat.copy()
        for _ in range(peaks):
            i = int(rest.argmax())
            if rest[i] <= max(threshold * rest.std(), 0.05):
                break
            low_side, high_side = _half_height(x, rest, i)
            width = max((high_side - low_side) / 2.355, float(x[1] - x[0]) / 2)
            bump = rest[i] * np.exp(-((x - x[i]) ** 2) / (2 * width * width))
            found.append((float(x[i]), float(rest[i]), 2 * float(width)))
            bumps, rest = bumps + bump, rest - bump
    fitted = shape(o, e, k) + bumps
    error = float(np.abs(y - fitted).mean())
    r2 = float(np.corrcoef(y, fitted)[0, 1] ** 2) if y.std() > 0 and fitted.std() > 0 else None
    return dict(zip(names, (o, e, k if knee else None, r2, error))) | {"fail_reason": None}, found
