"""String expressions: label normalization, ids, paths, slugs and joins."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks over all code points: the
    arguments of translate() that fold one to one and drop marks, and the forms of
    several letters as a map."""
    source, target, longer, dropped = [], [], {}, []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        whole = unicodedata.normalize("NFKD", char)
        plain = "".join(c for c in whole if not unicodedata.combining(c))
        if not plain:
            dropped.append(char)
            continue
        plain = "".join(c if c.isascii() else c.upper() if c.upper().isascii() else " " for c in plain)
        if whole == char or plain == char or not any(c.isalnum() for c in plain):
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            longer[char] = plain
    # translate() drops what has no counterpart
    return "".join(source + dropped), "".join(target), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _fold_tables()
# the long forms one after the other, filled up to one width with a character that is taken out again
_FOLD_WIDTH = max(map(len, _FOLD_LONGER.values()))
_FOLD_CHARS, _FOLD_FORMS = "".join(_FOLD_LONGER), "".join(v.ljust(_FOLD_WIDTH, "\x00") for v in _FOLD_LONGER.values())


def fold_accents(c) -> Column:
    """Drop diacritics and compatibility forms; plain ASCII text is untouched.

    Only texts with a form of several letters are taken apart by character, and only
    their characters beyond ASCII are looked up."""
    text = _col(c)
    folded = F.translate(text, _FOLD_FROM, _FOLD_TO)

    def one(v):
        at = F.instr(F.lit(_FOLD_CHARS), v)
        form = F.replace(F.substring(F.lit(_FOLD_FORMS), (at - 1) * _FOLD_WIDTH + 1, F.lit(_FOLD_WIDTH)), F.lit("\x00"), F.lit(""))
        return F.when((v > "\x7f") & (at > 0), form).otherwise(v)

    has_long = F.length(F.translate(text, _FOLD_CHARS, "")) < F.length(text)
    longer = F.array_join(F.transform(F.split(folded, ""), one), "")
    return F.when(F.octet_length(text) == F.length(text), text).when(has_long, longer).otherwise(folded)


def norm_label(c, plus: bool = True) -> Column:
    """Comparison key of a label.  ``plus`` keeps a plus sign as the word PLUS,
    which matching wants and fingerprints do not.  Null becomes ''."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    if plus:
        text = F.replace(text, F.lit("+"), F.lit(" PLUS "))
    return F.trim(F.regexp_replace(F.upper(fold_accents(text)), "[^A-Z0-9]+", " "))


def tokens(normalized) -> Column:
    """Distinct words of an already normalized text; empty array for ''."""
    return F.array_distinct(F.filter(F.split(_col(normalized), " "), lambda t: t != ""))


def cell_text(raw, num=None) -> Column:
    """Text of a cell: integral numbers lose their fraction, text is trimmed."""
    text = F.coalesce(F.trim(_col(raw).cast("string")), F.lit(""))
    if num is None:
        return text
    n = _col(num)
    whole = n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 9e15)
    return F.when(whole, n.cast("bigint").cast("string")).otherwise(text)


def id_digits(c) -> Column:
    """Digits of a file stem after removing a float tail and a page suffix."""
    text = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    text = F.when(text.rlike(r"^\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"(?i)(^|[\s_-])(slide|s)0*\d+$", ""))
    return F.regexp_replace(text, r"\D", "")


def padded_id(c) -> Column:
    """Digits of an id, left-padded with zeros to ten; '' when there are none."""
    text = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    text = F.when(text.rlike(r"^\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
    digits = F.regexp_replace(text, r"\D", "")
    return F.when((digits != "") & (F.length(digits) < 10), F.lpad(digits, 10, "0")).otherwise(digits)


def _positive(digits) -> Column:
    n = digits.try_cast("int")
    return F.when(n > 0, n)


def block_hint_path(path) -> Column:
    """Block number from the first folder of a path, else from the file name's
    suffix; null when neither carries one."""
    p = F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    folder = F.lower(F.regexp_replace(F.when(p.contains("/"), F.split_part(p, F.lit("/"), F.lit(1))), r"[\s_-]+", ""))
    from_folder = _positive(F.nullif(F.regexp_extract(folder, r"^(?:slide|s)?0*(\d+)$", 1), F.lit("")))
    stem = F.trim(file_stem(p))
    from_name = _positive(F.nullif(F.regexp_extract(stem, r"(?i)(?:^|[\s_-])(?:slide|s)0*(\d+)$", 1), F.lit("")))
    return F.coalesce(from_folder, from_name)


def block_hint_text(text) -> Column:
    """Block number written anywhere in a text as 'slide' plus up to 3 digits."""
    return F.nullif(F.regexp_extract(_col(text), r"(?i)slide[_\s-]*([0-9]{1,3})", 1), F.lit("")).try_cast("int")


def base_name(path) -> Column:
    return F.regexp_extract(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"[^/]*$", 0)


def file_stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def object_ids(c) -> Column:
    """All object numbers written as 'obj' plus at least four digits."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?i)obj[_\s]*([0-9]{4,})"), 1))


def context_variants(c) -> Column:
    """A text followed by its parts at ' - ', ' | ' and ':' (each only where it occurs)."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    pieces = [F.array(text)]
    for separator in (" - ", " | ", ":"):
        parts = F.transform(F.split(text, "\\Q" + separator + "\\E"), lambda p: F.trim(p))
        pieces.append(F.when(text.contains(separator), parts).otherwise(F.array().cast("array<string>")))
    return F.filter(F.concat(*pieces), lambda p: p != "")


def join_unique(texts, separator: str = " | ") -> Column:
    """Join texts in order, keeping the first of each normalized key."""
    items = F.transform(
        F.filter(_col(texts), lambda t: t.isNotNull() & (F.trim(t) != "")),
        lambda t: F.struct(norm_label(t, plus=False).alias("k"), F.trim(t).alias("t")),
    )
    keys = F.transform(items, lambda s: s["k"])
    first = F.filter(items, lambda s, i: F.array_position(keys, s["k"]) == i + 1)
    return F.array_join(F.transform(first, lambda s: s["t"]), separator)


def short_text(c, limit: int) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("...")))


def slugify(c, default: str = "projeto") -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens."""
    text = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    slug = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def safe_file_name(c, default: str = "arquivo") -> Column:
    name = F.regexp_replace(F.regexp_replace(base_name(_col(c)), r"[^A-Za-z0-9._ -]+", "_"), r"^[. ]+|[. ]+$", "")
    return F.when(name == "", F.lit(default)).otherwise(name)


def search_text(*columns) -> Column:
    return F.lower(F.concat_ws(" ", *[_col(c).cast("string") for c in columns]))


def series_key(c) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+", "")


def column_number(letters) -> Column:
    """A, B, ..., Z, AA to 1, 2, ..., 26, 27."""
    chars = F.filter(F.split(F.upper(_col(letters)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def column_letters(number) -> Column:
    """1 to A; up to three letters, the widest a sheet has."""
    n = _col(number).cast("bigint")
    letter = lambda v: F.char(v + 65)
    one = F.when(n <= 26, letter(n - 1))
    m = n - 27
    two = F.when(n <= 702, F.concat(letter(F.floor(m / 26)), letter(F.pmod(m, F.lit(26)))))
    t = n - 703
    three = F.concat(letter(F.floor(t / 676)), letter(F.pmod(F.floor(t / 26), F.lit(26))), letter(F.pmod(t, F.lit(26))))
    return F.when(n >= 1, F.coalesce(one, two, three))


def a1_row(ref) -> Column:
    return F.nullif(F.regexp_extract(F.upper(_col(ref)), r"^([A-Z]+)(\d+)", 2), F.lit("")).try_cast("bigint")


def a1_col(ref) -> Column:
    letters = F.nullif(F.regexp_extract(F.upper(_col(ref)), r"^([A-Z]+)(\d+)", 1), F.lit(""))
    return column_number(letters)


def detect_title(title, nearby) -> Column:
    """A given title, else the best segment of the nearby text: mostly upper
    case first, then two to twelve words, then a length close to 32."""
    segments = F.transform(
        F.split(F.coalesce(_col(nearby), F.lit("")), r"\s+\|\s+"),
        lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ .:-]+|[ .:-]+$", ""),
    )
    kept = F.filter(
        segments,
        lambda s: F.length(s).between(4, 100) & ~s.rlike("[<>]") & ~F.lower(s).contains("nome_"),
    )

    def scored(s, i):
        letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
        upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
        return F.struct(
            (-F.when((letters > 0) & (upper >= letters * 0.85), 4).otherwise(0)).alias("case"),
            (-F.when(F.size(F.split(s, " ")).between(2, 12), 2).otherwise(0)).alias("words"),
            F.abs(F.length(s) - 32).alias("gap"),
            i.alias("ix"),
            s.alias("text"),
        )

    best = F.array_min(F.transform(kept, scored))
    given = F.nullif(F.trim(F.coalesce(_col(title), F.lit(""))), F.lit(""))
    return F.coalesce(given, best["text"], F.lit(""))


def title_confidence(title, nearby, detected) -> Column:
    given = F.coalesce(_col(title), F.lit("")) != ""
    near = F.coalesce(_col(nearby), F.lit(""))
    return (
        F.when(given & (near != "") & near.contains(_col(title)), "alta")
        .when(given, "media")
        .when(_col(detected) != "", "baixa")
        .otherwise("ausente")
    )
