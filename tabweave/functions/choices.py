"""Controlled vocabularies, criteria strings, ranges and typed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import lenient_number, parse_decimal
from .text import _col, norm_label

# Allowed choices and the spellings that mean one of them.
READ_MODES = ("auto", "tabela_excel", "dinamico", "exato")
ORIENTATIONS = ("auto", "manter", "transpor")
VALUE_FORMATS = ("auto", "percentual", "numero", "milhares")
CHOICE_ALIASES = {
    "automatico": "auto",
    "tabela": "tabela_excel",
    "exact": "exato",
    "keep": "manter",
    "transpose": "transpor",
    "percent": "percentual",
}
VALUE_FORMAT_CODES = {"percentual": "0%", "numero": "0.0", "milhares": "thousands_pt_br"}

# Operators of a criteria string, longest first.
CRITERIA_OPERATORS = (">=", "<=", "!=", "<>", ">", "<", "=")

# Texts that look like numbers or dates but are labels.
FORCED_TEXT_FORMS = (
    r"\d{1,2}[/-]\d{2,4}",
    r"\d{1,2}-\d{1,2}",
    r"\d+Q\d{2,4}",
    r"Q\d{1,2}\s*\d{2,4}",
    r"[A-Za-zÀ-ÿ]{3}/\d{2,4}",
    r"\d{2,}",
)
FORCED_TEXT_PATTERN = r"(?i)^('.*|0\d+|" + "|".join(FORCED_TEXT_FORMS) + r")$"


def normalize_choice(c, allowed: tuple[str, ...], default: str = "auto") -> Column:
    """Struct of the choice a free spelling means and whether it is allowed."""
    key = F.replace(F.lower(norm_label(c, plus=False)), F.lit(" "), F.lit("_"))
    chosen = key
    for spelling, meaning in CHOICE_ALIASES.items():
        chosen = F.when(key == spelling, meaning).otherwise(chosen)
    chosen = F.when(key == "", default).otherwise(chosen)
    return F.struct(chosen.alias("value"), chosen.isin(*allowed).alias("valid"))


def criteria(value, rule: str) -> Column:
    """Predicate of a criteria string such as '>=10' or 'Total'."""
    rule = rule.strip().strip('"')
    for operator in CRITERIA_OPERATORS:
        if rule.startswith(operator):
            left = lenient_number(value)
            right = lenient_number(F.lit(rule[len(operator):].strip()))
            return {
                ">=": left >= right, "<=": left <= right, "!=": left != right, "<>": left != right,
                ">": left > right, "<": left < right, "=": left == right,
            }[operator]
    return norm_label(value, plus=False) == norm_label(F.lit(rule), plus=False)


def typed_cell(c, force_text=False) -> Column:
    """Struct (value, type, force_text, source_raw) inferred from a raw cell."""
    raw = F.coalesce(_col(c).cast("string"), F.lit(""))
    trimmed = F.trim(raw)
    forced = F.lit(force_text) if isinstance(force_text, bool) else force_text
    is_text = forced | (trimmed == "") | trimmed.rlike(FORCED_TEXT_PATTERN) | parse_decimal(trimmed).isNull()
    return F.struct(
        raw.alias("value"),
        F.when(is_text, "text").otherwise("number").alias("type"),
        is_text.alias("force_text"),
        F.when(is_text, "").otherwise(raw).alias("source_raw"),
    )


def expand_ranges(c) -> Column:
    """Sorted distinct numbers of a list such as '3, 5, 8-10'.  Null when a part
    is malformed or not above zero."""
    parts = F.filter(F.split(F.trim(F.coalesce(_col(c), F.lit(""))), r"[,;\s]+"), lambda p: p != "")
    number = lambda p, g: F.regexp_extract(p, r"^(\d+)(?:[-:](\d+))?$", g).try_cast("int")
    spans = F.transform(
        parts,
        lambda p: F.struct(number(p, 1).alias("a"), F.coalesce(number(p, 2), number(p, 1)).alias("b")),
    )
    bad = F.exists(spans, lambda s: s["a"].isNull() | (s["a"] <= 0) | (s["b"] <= 0))
    values = F.flatten(
        F.transform(
            F.filter(spans, lambda s: s["a"].isNotNull()),
            lambda s: F.sequence(F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"])),
        )
    )
    return F.when(~F.coalesce(bad, F.lit(False)), F.array_sort(F.array_distinct(values)))
