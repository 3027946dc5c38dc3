"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def snake_row(n: Column, ncol: Column | int) -> Column:
    """Row of the n-th tile (from 1) in serpentine order."""
    return (F.ceil(n / ncol) - 1).cast("int")


def snake_col(n: Column, ncol: Column | int) -> Column:
    """Column of the n-th tile: even rows run forwards, odd rows backwards."""
    at = F.pmod(n - 1, F.lit(ncol) if isinstance(ncol, int) else ncol)
    return F.when(F.pmod(snake_row(n, ncol), F.lit(2)) == 0, at).otherwise(ncol - 1 - at).cast("int")


def box(**limits: tuple[int | None, int | None]) -> Column:
    """begin <= axis < end for each axis given; None leaves a side open. A plain conjunction, so scans take it over."""
    out = F.lit(True)
    for axis, (begin, end) in limits.items():
        if begin is not None:
            out &= F.col(axis) >= begin
        if end is not None:
            out &= F.col(axis) < end
    return out


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df with the columns of a table of one row, which an ungrouped aggregate has by its nature."""
    return df.crossJoin(F.broadcast(scalars))


def contrast(v: Column, low: Column, high: Column, top: int) -> Column:
    """log(v + 200), stretched from [low, high] (of the logarithm) to 0 .. top and cut."""
    x = (F.log(v + 200) - low) / (high - low)
    return F.when(high <= low, F.lit(0)).otherwise(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * top)).cast("int")


def hsv(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue in 0 .. 1 of hue, saturation and value in 0 .. 1."""
    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return [part(n) for n in (5, 3, 1)]
