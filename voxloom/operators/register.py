"""Pairwise registration of neighbouring tiles from their projections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPECTED_ERROR = 2.0  # of an edge whose shift was replaced
LEAST_ERROR = 1e-6


def phase_correlation(reference: np.ndarray, moving: np.ndarray, upsample_factor: int = 1) -> tuple[float, float, float]:
    """Shift (rows, columns) that moves ``moving`` onto ``reference``, and sqrt(|1 - peak ** 2|).

    Whole pixels; with an upsample_factor u, the correlation is also evaluated at steps of 1 / u around the whole shift.
    """
    if reference.shape != moving.shape:
        raise ValueError("images differ in shape")
    cross = np.fft.fft2(reference) * np.conj(np.fft.fft2(moving))
    size = np.abs(cross)
    phase = np.where(size > 1e-12 * max(size.max(), 1e-300), cross / np.maximum(size, 1e-300), 0)
    peak = np.abs(np.fft.ifft2(phase))
    at = np.unravel_index(peak.argmax(), peak.shape)
    top = float(peak[at])
    shift = [int(k) - (n if k > n // 2 else 0) for k, n in zip(at, peak.shape, strict=True)]
    if upsample_factor > 1:
        near = np.arange(-upsample_factor, upsample_factor + 1) / upsample_factor
        waves = [np.exp(2j * np.pi * np.outer(s + near, np.fft.fftfreq(n))) for s, n in zip(shift, peak.shape, strict=True)]
        fine = np.abs(waves[0] @ phase @ waves[1].T) / phase.size
        at = np.unravel_index(fine.argmax(), fine.shape)
        top = float(fine[at])
        shift = [s + float(near[k]) for s, k in zip(shift, at, strict=True)]
    return shift[0], shift[1], float(np.sqrt(abs(1 - top**2)))


def reliability(reference: np.ndarray, moving: np.ndarray, shift: tuple[int, int], legacy_sign: bool = False) -> float:
    """2 p99(reference) / p99(reference + shifted moving): lower is better, 1 for a perfect match."""
    sign = -1 if legacy_sign else 1
    both = reference + np.roll(moving, (sign * shift[0], sign * shift[1]), (0, 1))
    return float(2 * np.percentile(reference, 99) / max(np.percentile(both, 99), 1e-12))


def nrmse(reference: np.ndarray, moving: np.ndarray, shift: tuple[int, int]) -> float:
    """Root mean square difference after the shift, over the reference's mean."""
    moved = np.roll(moving, shift, (0, 1))
    return float(np.sqrt(np.mean((reference.astype(float) - moved) ** 2)) / max(reference.mean(), 1e-12))


def shift_quality(pixels: DataFrame, shift: tuple[int, int], by: list[str] | None = None) -> DataFrame:
    """``by, reliability, nrmse`` of a shift between images ``(by, p, q, reference, moving)``; absent pixels are zero.

    A task holds a pair of planes at a time.
    """
    by = by or []
    schema = pixels.select(*by).schema.add("reliability", "double").add("nrmse", "double")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shape = (int(group.p.max()) + 1, int(group.q.max()) + 1)
        a, b = (_image(group.rename(columns={c: "v"}), shape) for c in ("reference", "moving"))
        return group[by].iloc[:1].assign(reliability=reliability(a, b, shift), nrmse=nrmse(a, b, shift))

    return pixels.groupBy(*by).applyInPandas(run, schema)


def default_kernel(reference: np.ndarray, moving: np.ndarray) -> tuple[int, int, float]:
    """Shift by phase correlation; error: reliability over the root of the mean, times 10."""
    dy, dx, _ = phase_correlation(reference, moving)
    return dy, dx, reliability(reference, moving, (dy, dx)) / np.sqrt(max(reference.mean(), 1e-12)) * 10


def fine_kernel(upsample_factor: int) -> Callable:
    """The default kernel with shifts of parts of a pixel; the error is that of the nearest whole shift."""

    def kernel(reference: np.ndarray, moving: np.ndarray) -> tuple[float, float, float]:
        dy, dx, _ = phase_correlation(reference, moving, upsample_factor)
        return dy, dx, reliability(reference, moving, (round(dy), round(dx))) / np.sqrt(max(reference.mean(), 1e-12)) * 10

    return kernel


def masked_kernel(percentile: float, kernel: Callable = default_kernel) -> Callable:
    """A kernel that sees both images with pixels above their percentile set to the median of the rest."""
    def masked(a: np.ndarray) -> np.ndarray:
        bright = a > np.percentile(a, percentile)
        return np.where(bright, np.median(a[~bright]) if (~bright).any() else 0, a)

    return lambda a, b: kernel(masked(a), masked(b))


def _image(p: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[p.p, p.q] = p.v
    return out


def plane_shifts(projections: DataFrame, edges: DataFrame, kernel: Callable = default_kernel) -> DataFrame:
    """``a, b, side, plane, s0, s1, e``: a shift for each edge and plane.

    projections: ``(row, col, side, plane, p, q, v)`` in coordinates of the strip.  The strip of a tile that faces its
    neighbour meets the neighbour's opposite strip; a task holds two planes.
    """
    facing = {"east": "west", "south": "north"}
    opposite = F.create_map(*[F.lit(x) for kv in facing.items() for x in kv])
    first = edges.select("a", "b", "side", "row", "col", F.col("side").alias("strip"), F.lit(0).alias("which"))
    second = edges.select("a", "b", "side", F.col("n_row").alias("row"), F.col("n_col").alias("col"), opposite[F.col("side")].alias("strip"), F.lit(1).alias("which"))
    rows = first.unionByName(second).join(projections.withColumnRenamed("side", "strip"), ["row", "col", "strip"])

    def pair(p: pd.DataFrame) -> pd.DataFrame:
        shape = (int(p.p.max()) + 1, int(p.q.max()) + 1)
        x, y = _image(p[p.which == 0], shape), _image(p[p.which == 1], shape)
        s0, s1, e = kernel(x, y) if (p.which == 0).any() and (p.which == 1).any() else (0, 0, EXPECTED_ERROR)
        k = p.iloc[0]
        return pd.DataFrame({"a": [k.a], "b": [k.b], "side": [k.side], "plane": [k.plane], "s0": [float(s0)], "s1": [float(s1)], "e": [float(e)]})

    return rows.groupBy("a", "b", "side", "plane").applyInPandas(pair, "a int, b int, side string, plane string, s0 double, s1 double, e double")


def pair_shifts(planes: DataFrame) -> DataFrame:
    """``a, b, side, d_h, d_v, d_d, r_h, r_v, r_d``: of the two planes that see an axis, the one with the smaller error.

    D: zx if strictly better, else zy; H: zx, else yx; V: yx, else zy.
    """
    def of(plane: str, c: str) -> Column:
        value = F.max(F.when(F.col("plane") == plane, F.col(c)))
        return F.when(value == 0, F.lit(LEAST_ERROR)).otherwise(value) if c == "e" else value

    names = {f"{p}_{c}": of(p, c) for p in ("zy", "zx", "yx") for c in ("s0", "s1", "e")}
    got = planes.groupBy("a", "b", "side").agg(*[v.alias(k) for k, v in names.items()])
    pick = lambda x, y, c, d: (F.when(F.col(f"{x}_e") < F.col(f"{y}_e"), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{d}")), F.least(f"{x}_e", f"{y}_e"))
    (d_d, r_d), (d_h, r_h), (d_v, r_v) = pick("zx", "zy", "s0", "s0"), pick("zx", "yx", "s1", "s1"), pick("yx", "zy", "s0", "s1")
    return got.select("a", "b", "side", d_h.alias("d_h"), d_v.alias("d_v"), d_d.alias("d_d"), r_h.alias("r_h"), r_v.alias("r_v"), r_d.alias("r_d"))


def strip_offsets(shifts: DataFrame, size: int, overlap_h: int, overlap_v: int) -> DataFrame:
    """Shifts between strips as relative positions of the tiles: the strip's begin is added along the edge's axis."""
    along = lambda side, gap, c: F.when(F.col("side") == side, F.col(c) + gap).otherwise(F.col(c)).alias(c)
    return shifts.select("a", "b", "side", along("east", size - overlap_h, "d_h"), along("south", size - overlap_v, "d_v"), "d_d", "r_h", "r_v", "r_d")


def regularize(shifts: DataFrame, reg_h: float, reg_v: float, reg_d: float, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """Shifts further than a bound from the expected one are replaced by it, with error 2.

    expected: for each side (h, v); depth is expected to be 0.
    """
    want = {k: F.coalesce(*[F.when(F.col("side") == s, F.lit(float(x[i]))) for s, x in expected.items()]) for i, k in enumerate("hv")} | {"d": F.lit(0.0)}
    out = shifts
    for k, reg in (("h", reg_h), ("v", reg_v), ("d", reg_d)):
        off = F.abs(F.col(f"d_{k}") - want[k]) > reg
        out = out.withColumns({f"d_{k}": F.when(off, want[k]).otherwise(F.col(f"d_{k}")), f"r_{k}": F.when(off, F.lit(EXPECTED_ERROR)).otherwise(F.col(f"r_{k}"))})
    return out


def channel_shifts(reference: DataFrame, moving: DataFrame, kernel: Callable = default_kernel) -> DataFrame:
    """``row, col, d_h, d_v, d_d``: shift of each tile between two channels, from projections of the whole tiles."""
    both = reference.withColumn("which", F.lit(0)).unionByName(moving.withColumn("which", F.lit(1)))

    def pair(p: pd.DataFrame) -> pd.DataFrame:
        shape = (int(p.p.max()) + 1, int(p.q.max()) + 1)
        s0, s1, e = kernel(_image(p[p.which == 0], shape), _image(p[p.which == 1], shape))
        k = p.iloc[0]
        return pd.DataFrame({"row": [k.row], "col": [k.col], "plane": [k.plane], "s0": [float(s0)], "s1": [float(s1)], "e": [float(e)]})

    planes = both.groupBy("row", "col", "plane").applyInPandas(pair, "row int, col int, plane string, s0 double, s1 double, e double")
    got = pair_shifts(planes.select(F.col("row").alias("a"), F.col("col").alias("b"), F.lit("").alias("side"), "plane", "s0", "s1", "e"))
    return got.select(F.col("a").alias("row"), F.col("b").alias("col"), "d_h", "d_v", "d_d")


def update_registration(registration: DataFrame, shifts: DataFrame) -> DataFrame:
    """Positions with each tile's shift added; tiles without one stay."""
    got = registration.join(shifts.select("row", "col", *[F.col(f"d_{k}").alias(f"_{k}") for k in "hvd"]), ["row", "col"], "left")
    added = {f"{p}{k}": F.col(f"{p}{k}") + F.coalesce(F.col(f"_{k.lower()}"), F.lit(0.0)) for p in ("d", "ABS_") for k in "HVD"}
    return got.withColumns(added).select(registration.columns)
