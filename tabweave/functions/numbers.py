"""Number, flag and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# What counts as true, as active, and as inactive.
TRUE_WORDS = ("1", "true", "sim", "yes", "y")
ACTIVE_WORDS = ("1", "sim", "s", "yes", "true", "ativo")
INACTIVE_WORDS = ("", "0", "nao", "n", "no", "false", "inativo")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(value, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain_number_text(c) -> Column:
    """Locale text to a plain decimal literal: percent sign dropped, and when both
    separators occur the dot groups thousands."""
    text = F.trim(F.replace(F.trim(_col(c).cast("string")), F.lit("%"), F.lit("")))
    text = F.regexp_replace(text, "^(-?),", "$10,")
    grouped = F.when(text.contains(",") & text.contains("."), F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    return F.replace(grouped, F.lit(","), F.lit("."))


def parse_number(c) -> Column:
    """Locale number as double; null when the text is not a finite number."""
    return let(_plain_number_text(c), lambda t: F.when(t.rlike(_NUMBER), t.try_cast("double")))


def parse_decimal(c) -> Column:
    """Locale number as decimal(38,18); inner blanks are ignored."""
    text = _plain_number_text(F.replace(_col(c).cast("string"), F.lit(" "), F.lit("")))
    return let(text, lambda t: F.when(t.rlike(_NUMBER), t.try_cast("decimal(38,18)")))


def lenient_number(c) -> Column:
    """Number for range functions: text that is not a number counts as 0."""
    text = F.replace(F.trim(_col(c).cast("string")), F.lit(","), F.lit("."))
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(0.0))


def truthy(c, default: bool = False) -> Column:
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text.isin(*TRUE_WORDS))


def active_flag(c) -> Column:
    """1, 0, or null when the value is neither."""
    from .text import norm_label

    text = F.lower(norm_label(c, plus=False))
    return F.when(text.isin(*ACTIVE_WORDS), F.lit(1)).when(text.isin(*INACTIVE_WORDS), F.lit(0))


def int_or_null(c) -> Column:
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def _swap_separators(text) -> Column:
    return F.translate(text, ",.", ".,")


def format_decimals(number_format) -> Column:
    """Decimals asked for by a number format: the digits after the first dot of
    its first section, quoted text ignored."""
    primary = F.split_part(F.coalesce(_col(number_format), F.lit("0.0")), F.lit(";"), F.lit(1))
    primary = F.regexp_replace(primary, '"[^"]*"', "")
    return F.length(F.regexp_extract(primary, r"\.([0#]+)", 1))


def display_number(value, number_format) -> Column:
    """Number shown with the decimals, percent scaling and grouping of its format,
    decimal comma and dot for thousands.  Text that is no number is kept."""
    raw = F.coalesce(_col(value).cast("string"), F.lit(""))
    fmt = F.coalesce(_col(number_format), F.lit(""))
    percent = fmt.contains("%")
    decimals = format_decimals(F.when(fmt == "", F.lit("0.0")).otherwise(fmt))

    def shown(number):
        # format_number rounds the exact binary value half-even
        text = F.call_function("format_number", F.when(percent, number * 100).otherwise(number), decimals)
        text = _swap_separators(F.when(fmt.contains(","), text).otherwise(F.replace(text, F.lit(","), F.lit(""))))
        return F.when(number.isNull(), raw).otherwise(F.concat(text, F.when(percent, "%").otherwise("")))

    return let(parse_number(raw), shown)


def display_table(raw, num, thousands) -> Column:
    """Table text: integral numbers lose the fraction (and group when asked),
    others use a decimal comma."""
    n = _col(num)
    flag = thousands if isinstance(thousands, Column) else F.lit(bool(thousands))
    whole = n == F.floor(n)
    as_int = F.when(flag, F.translate(F.format_string("%,d", n.cast("bigint")), ",", ".")).otherwise(
        n.cast("bigint").cast("string")
    )
    return (
        F.when(n.isNull(), F.coalesce(_col(raw), F.lit("")))
        .when(whole, as_int)
        .otherwise(F.replace(n.cast("string"), F.lit("."), F.lit(",")))
    )


def legacy_scale(c) -> Column:
    """Shares in [-1, 1] become percents; everything is rounded to one decimal."""
    n = _col(c)
    return F.when(F.abs(n) <= 1, F.round(n * 100, 1)).otherwise(F.round(n, 1))


def value_text(num) -> Column:
    """Twelve significant digits without trailing zeros; null becomes '0'."""
    n = _col(num)
    digits = F.format_string("%.11e", n)
    exponent = F.regexp_extract(digits, r"e([+-]\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(digits, r"^([^e]*)e", 1), r"\.?0+$", "")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    # rounding to 12 significant digits first, then printing the shortest decimal
    fixed = F.regexp_replace(digits.try_cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1")
    fixed = F.regexp_replace(fixed, r"\.$", "")
    return (
        F.when(n.isNull(), F.lit("0"))
        .when(n == 0, F.lit("0"))
        .when((exponent >= -4) & (exponent < 12), fixed)
        .otherwise(scientific)
    )


def is_meaningful_format(c) -> Column:
    return ~F.lower(F.trim(F.coalesce(_col(c), F.lit("")))).isin("", "general", "@")
