"""Small string helpers: labels of methods, numbers for table cells, float-safe comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(col: Column) -> Column:
    """``degree_sum`` as ``Degree Sum``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def near(col: Column, x: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether a double is x but for rounding."""
    return F.abs(col - F.lit(float(x))) <= F.lit(atol + rtol * abs(x))


def scientific(x: float, digits: int = 2) -> str:
    """LaTeX in scientific notation below 0.001, else fixed."""
    if x == 0 or x is None or not math.isfinite(x):
        return "0" if x == 0 else "--"
    power = math.floor(math.log10(abs(x)))
    return f"{x:.{digits + 1}f}" if power >= -3 else rf"${x / 10**power:.{digits}f} \times 10^{{{power}}}$"


def mean_std(mean: float | None, std: float | None, digits: int = 3) -> str:
    if mean is None:
        return "--"
    return f"{mean:.{digits}f}" if std is None or math.isnan(std) else rf"${mean:.{digits}f} \pm {std:.{digits}f}$"


def seconds(x: float) -> str:
    """Milliseconds below a second."""
    return f"{x:.2f}s" if x >= 1 else f"{1000 * x:.0f}ms"


def escaped(text: str) -> str:
    """Text with LaTeX's special characters escaped."""
    return "".join("\\" + c if c in "_&%#$" else c for c in text)
