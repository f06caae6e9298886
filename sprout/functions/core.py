"""Scalar column helpers shared by every operator.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, n: int) -> Column:
    """Round half to even at ``n`` places: scale, ``rint``, unscale.

    This is how numpy rounds arrays; Spark ``round`` is half-up and ``bround``
    with a scale disagrees with other engines at near-ties, so the scaled form is
    the only one used in compared output.
    """
    s = 10 ** n
    return F.rint(_c(x) * s) / s


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """``np.clip`` that keeps NULL as NULL (``greatest``/``least`` skip NULLs)."""
    c = _c(x)
    out = c
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    return F.when(c.isNotNull(), out)


def trunc_int(x) -> Column:
    """Python ``int(x)``: truncation toward zero."""
    return _c(x).cast("bigint")


def weekday0(d) -> Column:
    """Day of week with Monday = 0 (pandas ``dt.dayofweek``)."""
    return F.weekday(_c(d))


def md5_key(salt: str, *parts) -> Column:
    """md5 hex of ``salt || p1 || ':' || p2 ...`` over the string form of the parts."""
    items = [F.lit(salt)]
    for i, p in enumerate(parts):
        if i:
            items.append(F.lit(":"))
        items.append(_c(p).cast("string"))
    return F.md5(F.concat(*items))


def h16(salt: str, *parts) -> Column:
    """Deterministic surrogate in 0..65535: first four hex digits of md5 as an int."""
    return F.conv(F.substring(md5_key(salt, *parts), 1, 4), 16, 10).cast("int")


def grade(score) -> Column:
    """Letter grade: >=90 A, >=80 B, >=70 C, >=60 D, else F."""
    s = _c(score)
    return (F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C")
            .when(s >= 60, "D").otherwise("F"))
