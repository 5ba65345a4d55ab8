"""Column expressions over spans of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The spans share more than a point. Null when a bound is null."""
    return (a_start < b_end) & (a_end > b_start)


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the common part, 0 where there is none."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def contained(i_start: Column, i_end: Column, o_start: Column, o_end: Column) -> Column:
    """The inner span lies within the outer one, edges included."""
    return (i_start >= o_start) & (i_end <= o_end)


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common part over covered part; 0 without a common part, 1 where nothing is covered."""
    common = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    covered = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(common < 0, 0.0).when(covered <= 0, 1.0).otherwise(common / covered)
