"""Similarity of labels and label sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, tokens

#: A label counts as found when its best score reaches this.
COVERED = 0.68

# Domain rules.  Each one scores a pair of normalized labels when
# the pair, read as one text, contains every phrase of ``every`` and one of ``some``.
PHRASE_RULES = (
    {"every": ("AUTO CONSUMO", "USO PROPRIO"), "some": ("NAO", "COMPRO"), "score": 0.9},
    {"every": ("NAO TEM AUTO CONSUMO", "NAO COMPRO"), "some": (), "score": 0.95},
)
# Bands that make two labels equal when both carry one of them.
BAND_RULES = ("ATE 25", "26 50", "51 75", "MAIS DE 75")
BAND_SCORE = 0.96


def domain_score(left, right) -> Column:
    """Score of the first domain rule that fits a normalized pair, else 0."""
    left, right = _col(left), _col(right)
    pair = F.concat_ws(" ", left, right)
    out = F.lit(0.0)
    for band in reversed(BAND_RULES):
        out = F.when(left.contains(band) & right.contains(band), BAND_SCORE).otherwise(out)
    for rule in reversed(PHRASE_RULES):
        fits = F.lit(True)
        for phrase in rule["every"]:
            fits = fits & pair.contains(phrase)
        if rule["some"]:
            some = F.lit(False)
            for phrase in rule["some"]:
                some = some | pair.contains(phrase)
            fits = fits & some
        out = F.when(fits, rule["score"]).otherwise(out)
    return out


def rule_words() -> list[str]:
    """Words without which no domain rule can fit: one of each phrase rule, and the
    bands.  A word never straddles two labels, so one label must carry it."""
    return [*dict.fromkeys(rule["every"][0].split()[-1] for rule in PHRASE_RULES), *BAND_RULES]


def may_fit_rule(text) -> Column:
    out = F.lit(False)
    for word in rule_words():
        out = out | _col(text).contains(word)
    return out


def overlap(left_tokens, right_tokens) -> Column:
    """Shared words over the larger word count; 0 when a side has none."""
    a, b = _col(left_tokens), _col(right_tokens)
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger).otherwise(0.0)


def bound(value, then) -> Column:
    """``then`` of a value computed once.  Within functions of arrays a value that is only written out is computed again for each element and each
    time it is named."""
    return F.get(F.transform(F.array(_col(value)), then), F.lit(0))


def _legacy_form(normalized) -> Column:
    """What the legacy comparison reads of a normalized text."""
    return bound(normalized, lambda t: F.struct(t.alias("text"), F.replace(t, F.lit(" "), F.lit("")).alias("compact"), tokens(t).alias("words")))


def _legacy_score(left, right) -> Column:
    """The legacy score of two forms.  Texts are edited only where their lengths let that count for more than their words."""
    lc, rc = left["compact"], right["compact"]
    compact = (F.length(lc) > 2) & (F.length(rc) > 2) & (lc.contains(rc) | rc.contains(lc))
    edit = lambda distance: (F.lit(1.0) - distance / F.greatest(F.length(lc), F.length(rc), F.lit(1))) * 0.75
    either = bound(overlap(left["words"], right["words"]), lambda shared: F.when(
        shared >= edit(F.abs(F.length(lc) - F.length(rc))), shared).otherwise(F.greatest(shared, edit(F.levenshtein(lc, rc)))))
    return F.when((left["text"] == "") | (right["text"] == ""), 0.0).when(lc == rc, 1.0).when(compact, 0.92).otherwise(either)


def _best_legacy(label, forms) -> Column:
    """Best legacy score of a normalized label against forms; nothing scores more than an equal one."""
    return bound(_legacy_form(label), lambda own: F.when(F.exists(forms, lambda f: (f["compact"] == own["compact"]) & (own["text"] != "")), 1.0).otherwise(
        F.coalesce(F.array_max(F.transform(forms, lambda f: _legacy_score(own, f))), F.lit(0.0))))


def soft_score(left, right, mode: str = "current", rules: bool = True) -> Column:
    """Similarity in [0, 1] of two *normalized* texts.

    ``current``: domain rule, equal 1, containment 0.9, else word overlap.
    ``legacy``:  also compares without blanks (containment 0.92) and takes three
                 quarters of the edit similarity when that is larger.
    ``review``:  no domain rule; overlap is measured against the left side only.
    """
    left, right = _col(left), _col(right)
    blank = (left == "") | (right == "")
    inside = left.contains(right) | right.contains(left)
    lt, rt = tokens(left), tokens(right)
    if mode == "review":
        share = F.size(F.array_intersect(lt, rt)) / F.greatest(F.size(lt), F.lit(1))
        return F.when(blank, 0.0).when(left == right, 1.0).when(inside, 0.9).otherwise(share)
    if mode == "legacy":
        return bound(_legacy_form(left), lambda a: bound(_legacy_form(right), lambda b: _legacy_score(a, b)))
    base = F.when(left == right, 1.0).when(inside, 0.9).otherwise(overlap(lt, rt))
    if not rules:
        return F.when(blank, 0.0).otherwise(base)
    domain = domain_score(left, right)
    ruled = F.when(domain > 0, domain).otherwise(base)
    return F.when(blank, 0.0).when(may_fit_rule(left) | may_fit_rule(right), ruled).otherwise(base)


def best_score(label, choices, mode: str = "current") -> Column:
    """Best score of one normalized label against an array of them."""
    if mode == "legacy":
        return bound(F.transform(_col(choices), _legacy_form), lambda forms: _best_legacy(label, forms))
    return bound(label, lambda v: F.coalesce(F.array_max(F.transform(_col(choices), lambda c: soft_score(v, c, mode))), F.lit(0.0)))


def coverage(labels, choices, mode: str = "current") -> Column:
    """Share of the non-blank labels found in the choices; the legacy mode takes
    the mean best score instead.  Both sides are arrays of normalized labels."""
    required = F.filter(_col(labels), lambda v: v != "")
    if mode == "legacy":
        found = lambda asked: bound(F.transform(_col(choices), _legacy_form), lambda forms: F.aggregate(
            asked, F.lit(0.0), lambda acc, v: acc + _best_legacy(v, forms)))
    else:
        found = lambda asked: bound(choices, lambda known: F.size(
            F.filter(asked, lambda v: F.exists(known, lambda c: soft_score(v, c, mode) >= COVERED))).cast("double"))
    return bound(required, lambda asked: F.when(F.size(asked) > 0, found(asked) / F.size(asked)).otherwise(0.0))


def jaccard(left, right) -> Column:
    """Overlap of two label sets (normalized arrays); 0 when a side is empty."""
    a = F.array_distinct(F.filter(_col(left), lambda v: v != ""))
    b = F.array_distinct(F.filter(_col(right), lambda v: v != ""))
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)
