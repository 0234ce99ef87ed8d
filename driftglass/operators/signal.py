"""Signal kernels over one channel's stretch of samples, as grouped maps.

Samples are rows ``(keys, chunk, i, x)``: a channel is cut into chunks with a halo on both sides (``chunked``), so a
task holds one chunk whatever the length of the recording; results are kept for the chunk's own samples only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(samples: DataFrame, at: str, chunk: int, halo: int) -> DataFrame:
    """Adds ``chunk`` and ``own``: each sample goes to its own chunk and, near an edge, to the neighbour's halo."""
    own = F.expr(f"{at} div {chunk}")
    inside = F.pmod(F.col(at), F.lit(chunk))
    near = F.array(own, F.when((inside < halo) & (own > 0), own - 1), F.when(inside >= chunk - halo, own + 1))
    spread = samples.withColumn("_own", own).withColumn("chunk", F.explode(F.filter(near, lambda c: c.isNotNull())))
    return spread.withColumn("own", F.col("chunk") == F.col("_own")).drop("_own")


def per_chunk(samples: DataFrame, keys: list[str], at: str, value: str, kernel: Callable[[np.ndarray], np.ndarray], chunk: int = 1 << 20, halo: int = 1 << 12) -> DataFrame:
    """(keys, at, y): ``kernel`` maps a chunk's values, in order, to as many; the halo's results are dropped."""
    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{at} {kinds[at]}", "y double"])

    def apply(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(at)
        y = kernel(rows[value].to_numpy(zero_copy_only=False).astype(float))
        own = rows["own"]
        out = rows.select([*keys, at]).append_column("y", pa.array(y, pa.float64(), from_pandas=True))
        return out.filter(own)

    picked = chunked(samples.select(*keys, at, value), at, chunk, halo)
    return picked.groupBy(*keys, "chunk").applyInArrow(apply, schema)


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a low-, high- or band-pass by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low and high:
        width, mid = warp(high) - warp(low), np.sqrt(warp(high) * warp(low))
        half = poles * width / 2
        poles, zeros = np.concatenate((half + np.sqrt(half**2 - mid**2), half - np.sqrt(half**2 - mid**2))), [1.0] * order + [-1.0] * order
        centre = np.exp(1j * 2 * np.arctan(mid / (2 * rate)))
    elif low:
        poles, zeros, centre = warp(low) / poles, [1.0] * order, -1.0
    else:
        poles, zeros, centre = poles * warp(high), [-1.0] * order, 1.0
    z = (2 * rate + poles) / (2 * rate - poles)
    pairs = sorted(z[z.imag > 1e-12], key=lambda p: abs(p))
    single = sorted(z[np.abs(z.imag) <= 1e-12].real)
    sections = [np.poly([p, p.conjugate()]).real for p in pairs] + [np.poly(single[i : i + 2]) for i in range(0, len(single), 2)]
    zeros = sorted(zeros)
    out = []
    for i, a in enumerate(sections):
        take = [zeros.pop(0), zeros.pop(-1)] if len(a) == 3 and len(zeros) > 1 else [zeros.pop(0)]
        b = np.poly(take).real
        b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
        gain = abs(np.polyval(b, centre) / np.polyval(a, centre))
        out.append(np.concatenate((b / gain, a)))
    return np.array(out)


#: Samples that a filter's recursion advances at once.
_STEP = 64


def _run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Second-order sections in a row, each started at rest on the first value's level. A block's outputs are linear in
    its inputs and in the two values of state before it, so only the states go from block to block."""
    for b0, b1, b2, _, a1, a2 in sos:
        n, first = len(x), x[0]
        level = first * (b0 + b1 + b2) / (1 + a1 + a2) if abs(1 + a1 + a2) > 1e-12 else 0.0
        # direct form II transposed: y = b0 v + s1, s1' = b1 v - a1 y + s2, s2' = b2 v - a2 y
        ahead, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = np.empty((_STEP + 1, 2, 2))
        powers[0] = np.eye(2)
        for k in range(_STEP):
            powers[k + 1] = ahead @ powers[k]
        impulse = np.concatenate(([b0], (powers[: _STEP - 1] @ feed)[:, 0]))
        lag = np.arange(_STEP)[:, None] - np.arange(_STEP)[None, :]
        inside = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        gather = powers[_STEP - 1 :: -1] @ feed  # what each input of a block leaves in the state after it
        blocks = np.pad(x, (0, -n % _STEP)).reshape(-1, _STEP)
        pushed, state = blocks @ gather, np.empty((len(blocks), 2))
        now, jump = np.array([level - b0 * first, b2 * first - a2 * level]), powers[_STEP]
        for k in range(len(blocks)):
            state[k] = now
            now = jump @ now + pushed[k]
        x = (blocks @ inside.T + state @ powers[:_STEP, 0, :].T).ravel()[:n]
    return x


def zero_phase(sos: np.ndarray, most_gain: float = 10.0) -> Callable[[np.ndarray], np.ndarray]:
    """A kernel that filters forward and backward; stretches of missing values split it, and a result far larger than
    its input is refused."""

    def kernel(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for lo, hi in finite_runs(x):
            y = _run_sections(sos, _run_sections(sos, x[lo:hi])[::-1])[::-1]
            if len(y) and np.abs(y).max() > most_gain * max(np.abs(x[lo:hi]).max(), 1e-12):
                raise ValueError("the filter is unstable on these values")
            out[lo:hi] = y
        return out

    return kernel


def finite_runs(x: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.isfinite(x).astype(int), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def settling(sos: np.ndarray, rate: float, share: float = 0.01, most_s: float = 60.0) -> float:
    """Seconds until the impulse response stays below a share of its peak."""
    x = np.zeros(int(most_s * rate))
    x[0] = 1.0
    y = np.abs(_run_sections(sos, np.concatenate(([0.0], x)))[1:])
    return float((np.flatnonzero(y >= share * y.max())[-1] + 1) / rate)


def tops_of(x: np.ndarray) -> np.ndarray:
    """Indices of samples above the one before and not below the one after."""
    return np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1


def prominences(x: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """How far each top stands out: to the higher of the two lowest values between it and the next higher value (or the
    end) on either side. One pass each way over the tops and the lows between them, with a stack of higher ones."""
    if not len(tops):
        return np.zeros(0)

    def lowest(x: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """The lowest value between each top and the next higher value to its left."""
        at = np.concatenate(([0], tops))
        lows, heights = np.minimum.reduceat(x, at)[: len(at) - 1].tolist(), x[at].tolist()
        stack, out = [(heights[0], np.inf)], []
        for k, height in enumerate(heights[1:]):
            low = lows[k]
            while stack and stack[-1][0] <= height:
                low = min(low, stack.pop()[1])
            out.append(min(low, height))
            stack.append((height, low))
        return np.array(out)

    left, right = lowest(x, tops), lowest(x[::-1], len(x) - 1 - tops[::-1])[::-1]
    return x[tops] - np.maximum(left, right)


def half_widths(x: np.ndarray, tops: np.ndarray, prominence: np.ndarray) -> np.ndarray:
    """Samples between the places, interpolated, where each top falls to half its prominence."""
    out = []
    for p, height in zip(tops.tolist(), (x[tops] - prominence / 2).tolist(), strict=True):
        i = p
        while i > 0 and x[i] > height:
            i -= 1
        left = i + (height - x[i]) / (x[i + 1] - x[i]) if x[i] < height else i
        i = p
        while i < len(x) - 1 and x[i] > height:
            i += 1
        right = i - (height - x[i]) / (x[i - 1] - x[i]) if x[i] < height else i
        out.append(right - left)
    return np.array(out, float)


def spaced(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of some places, in order, stay: the highest first, each taking out those closer than ``distance``."""
    stays, done = np.ones(len(at), bool), np.zeros(len(at), bool)
    for k in np.lexsort((at, -height)).tolist():
        if not stays[k]:
            continue
        done[k] = True
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(at) and abs(at[j] - at[k]) < distance:
                stays[j] &= done[j]
                j += step
    return stays


def peaks(x: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Indices of local maxima with at least this prominence, the highest first where two are closer than ``distance``."""
    tops = tops_of(x)
    tops = tops[prominences(x, tops) >= prominence]
    return tops[spaced(tops, x[tops], distance)]


def find_peaks(samples: DataFrame, keys: list[str], at: str, value: str, prominence_sigmas: float, distance: int, chunk: int = 1 << 16, halo: int = 1 << 10) -> DataFrame:
    """(keys, at, height): peaks by prominence in robust sigmas of their chunk, never made up in gaps."""
    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{at} {kinds[at]}", "height double"])

    def apply(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(at)
        x = rows[value].to_numpy(zero_copy_only=False).astype(float)
        good = x[np.isfinite(x)]
        sigma = 1.4826 * np.median(np.abs(good - np.median(good))) if len(good) else np.nan
        found = [lo + peaks(x[lo:hi], prominence_sigmas * sigma, distance) for lo, hi in finite_runs(x) if hi - lo > 2] if sigma > 0 else []
        index = np.concatenate(found).astype(int) if found else np.zeros(0, int)
        picked = rows.take(pa.array(index, pa.int64()))
        return picked.select([*keys, at]).append_column("height", pa.array(x[index])).filter(picked["own"])

    picked = chunked(samples.select(*keys, at, value), at, chunk, halo)
    return picked.groupBy(*keys, "chunk").applyInArrow(apply, schema)


def spectrum_features(x: np.ndarray, rate: float, line: float = 60.0) -> dict[str, float]:
    """Spectral entropy, 95 % edge and the share of power near the line frequency."""
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    p = power / max(power.sum(), 1e-300)
    entropy = float(-(p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(p)))
    edge = float(freq[np.searchsorted(np.cumsum(p), 0.95)])
    return {"entropy": entropy, "edge": edge, "line": float(p[np.abs(freq - line) <= 1].sum())}


def autocorr_rate(x: np.ndarray, rate: float, low: float, high: float) -> tuple[float, float]:
    """(rate per second, height) of the autocorrelation's peak, refined by a parabola."""
    y = x - x.mean()
    n = 1 << (2 * len(y) - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(y, n)) ** 2, n)[: len(y)]
    r = r / max(r[0], 1e-300)
    lo, hi = int(rate / high), min(int(rate / low) + 1, len(r) - 2)
    if hi <= lo:
        return float("nan"), float("nan")
    k = lo + int(np.argmax(r[lo:hi]))
    a, b, c = r[k - 1], r[k], r[k + 1]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return rate / (k + shift), float(b - 0.25 * (a - c) * shift)
