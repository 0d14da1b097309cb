"""Columns, and the same as functions of SQL."""

from pyspark.sql import SparkSession

from .text import SPACE

_RATIO = "(case when {1} > 0 then {0} / {1} else 0.0D end)"


def register(spark: SparkSession) -> None:
    """Makes prf_strict, prf_adapted (m, c, s, n; each a struct of p, r, f1), clean_span (text, s, e; a struct of s, e) and span_iou (s, e, s2, e2) functions of SQL, without Python in them."""
    kinds = {"prf_strict": ("m", "(m + c + s)"), "prf_adapted": ("(m + 0.5D * c)", "(m + c + 0.25D * s)")}
    for name, (top, bottom) in kinds.items():
        p, r = _RATIO.format(top, bottom), _RATIO.format(top, "(m + c + n)")
        f1 = _RATIO.format(f"(2 * {p} * {r})", f"({p} + {r})")
        spark.sql(f"create or replace temporary function {name}(m bigint, c bigint, s bigint, n bigint) returns struct<p: double, r: double, f1: double> return named_struct('p', cast({p} as double), 'r', cast({r} as double), 'f1', cast({f1} as double))")
    low, blank = "least(greatest(s, 0), length(text))", f"[{SPACE}]+"
    high = f"greatest(least(e, length(text)), {low})"
    part = f"substring(text, {low} + 1, {high} - {low})"
    left = f"least({low} + length({part}) - length(regexp_replace({part}, r'^{blank}', '')), {high})"
    right = f"greatest({high} - length({part}) + length(regexp_replace({part}, r'{blank}\\z', '')), {left})"
    spark.sql(f"create or replace temporary function clean_span(text string, s int, e int) returns struct<s: int, e: int> return named_struct('s', {left}, 'e', {right})")
    both, union = "greatest(least(e, e2) - greatest(s, s2), 0)", "(greatest(e, e2) - least(s, s2))"
    spark.sql(f"create or replace temporary function span_iou(s int, e int, s2 int, e2 int) returns double return cast({_RATIO.format(both, union)} as double)")
