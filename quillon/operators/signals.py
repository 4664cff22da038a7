"""Per-entity signal kernels that SQL can't express: NumPy over one entity's ordered samples (applyInPandas).

A group is one recording of one entity, bounded by the recording's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def band_powers(x: np.ndarray, rate: float, segment: int = 64) -> dict[str, float]:
    """Welch periodogram (Hann, half overlap) summed over bands."""
    n = min(segment, len(x))
    if n < 8:
        return dict.fromkeys(BANDS, float("nan"))
    win = np.hanning(n)
    parts = [np.abs(np.fft.rfft((x[i : i + n] - x[i : i + n].mean()) * win)) ** 2 for i in range(0, len(x) - n + 1, max(1, n // 2))]
    power, freq = np.mean(parts, axis=0) / (rate * (win**2).sum()), np.fft.rfftfreq(n, 1 / rate)
    return {k: float(power[(freq >= a) & (freq < b)].sum()) for k, (a, b) in BANDS.items()}


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of the share of matches of m samples that still match with one more; in rows, so memory is linear."""
    n, tol = len(x), r * x.std(ddof=1) if len(x) > 1 else 0.0
    if n <= m + 1 or not tol:
        return float("nan")
    a = b = 0
    short = np.lib.stride_tricks.sliding_window_view(x, m)[: n - m]
    for i in range(n - m - 1):
        near = np.abs(short[i + 1 :] - short[i]).max(1) <= tol
        b += int(near.sum())
        a += int((near & (np.abs(x[i + 1 + m :] - x[i + m]) <= tol)).sum())
    return float(-np.log(a / b)) if a and b else float("nan")


def detrended_fluctuation(x: np.ndarray, scales: tuple[int, ...] = (4, 8, 16)) -> float:
    """Slope of log fluctuation over log scale."""
    y, out = np.cumsum(x - x.mean()), []
    for s in scales:
        k = len(y) // s
        if k < 2:
            continue
        seg, t = y[: k * s].reshape(k, s), np.arange(s)
        fit = np.polyfit(t, seg.T, 1)
        out.append((np.log(s), 0.5 * np.log(np.mean((seg - (fit[0][:, None] * t + fit[1][:, None])) ** 2))))
    return float(np.polyfit(*np.array(out).T, 1)[0]) if len(out) > 1 else float("nan")


def recordings(df: DataFrame, entity: str, order: list[str], value: str, rate: float) -> DataFrame:
    """One row an entity: band powers, sample entropy and the fluctuation exponent of its series."""
    kind = dict(df.dtypes)[entity]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        return pd.DataFrame([{entity: pdf[entity].iloc[0], "n": len(x), **band_powers(x, rate), "sample_entropy": sample_entropy(x), "dfa": detrended_fluctuation(x)}])

    return df.select(entity, *order, value).groupBy(entity).applyInPandas(one, f"{entity} {kind}, n long, " + ", ".join(f"{b} double" for b in BANDS) + ", sample_entropy double, dfa double")
