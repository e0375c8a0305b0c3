"""Period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# The month words a header may use, and the words labels are built from.
PERIOD_MONTHS = "JAN|FEV|FEB|MAR|ABR|APR|MAI|MAY|JUN|JUL|AGO|AUG|SET|SEP|OUT|OCT|NOV|DEZ|DEC"
LABEL_MONTHS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")

PERIOD_PATTERN = r"^((19|20)\d{2}|(" + PERIOD_MONTHS + r")\s*\d{2,4})$"


def is_period(normalized) -> Column:
    """Whether a normalized label is a year or a month with a year."""
    return _col(normalized).rlike(PERIOD_PATTERN)


def period_label(date) -> Column:
    """Month word and two-digit year; a day of 13 or more was really a year."""
    d = _col(date)
    names = F.array(*[F.lit(m) for m in LABEL_MONTHS])
    day = F.dayofmonth(d)
    year = F.when(day >= 13, day).otherwise(F.year(d) % 100)
    return F.concat(F.element_at(names, F.month(d)), F.lit("/"), F.lpad(year.cast("string"), 2, "0"))
