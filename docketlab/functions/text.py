"""Normalisers, keys and formatters as Column functions; all run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "missing", raw and canonical side.
MISSING = ("NOT STATED", "NEEDS REVIEW", "UNKNOWN", "NOT PROVIDED", "N A", "NA")
NOT_STATED, NEEDS_REVIEW = "Not Stated", "Needs review"


#: Letters one by one: a regular expression looks these up in one table, ranges go through a chain of predicates.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def replaced(col: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(col, pattern, by)


def trimmed(col: Column) -> Column:
    return replaced(replaced(col, "[ \\t\\n\\r\\f]+", " "), "^ | $", "")


def normalize(col: Column) -> Column:
    """Comparison form of a quote: lower case, straight quotes, letters, digits and $ # . / ' - only."""
    out = F.lower(F.coalesce(col, F.lit("")))
    for quote in "“”‘’":
        out = F.replace(out, F.lit(quote), F.lit("'"))
    return F.trim(replaced(out, f"[^{LOWER}{DIGITS}$#./'-]+"))


def upper_words(col: Column) -> Column:
    return F.trim(replaced(F.upper(F.coalesce(col, F.lit(""))), f"[^{UPPER}{DIGITS}]+"))


def alnum_key(col: Column) -> Column:
    return replaced(F.upper(F.coalesce(col, F.lit(""))), "[^A-Z0-9]+", "")


def compact(col: Column) -> Column:
    """NUL to space, runs of blanks to one, at most two line ends in a row, outer white space off."""
    one = replaced(replaced(F.coalesce(col, F.lit("")), "\\x00"), "[ \\t]+")
    return replaced(replaced(one, "\\n{3,}", "\n\n"), "^[ \\n]+|[ \\n]+$", "")


def is_missing(col: Column) -> Column:
    key = upper_words(col)
    return (key == "") | key.isin(*MISSING)


def stated(col: Column) -> Column:
    """The value, or null where it is missing; restored to text at the sinks only."""
    return F.when(~is_missing(col), col)


def digest(prefix: str, text: Column, size: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, size))


def anchor_key(page: Column, kind: Column, number: Column, quote: Column) -> Column:
    return F.concat_ws("|", page.cast("string"), normalize(kind), normalize(number), normalize(quote))


def evidence_id(packet: Column, page: Column, kind: Column, number: Column, quote: Column) -> Column:
    return digest("ev_", F.concat_ws("|", packet, anchor_key(page, kind, number, quote)))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ..., 11th, 12th, 13th."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    end = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def money_key(col: Column) -> Column:
    """First signed decimal to two places; other text in comparison form."""
    found = F.regexp_extract(replaced(F.coalesce(col, F.lit("")), "[$,\\s]", ""), "-?\\d+(?:\\.\\d{1,2})?", 0)
    return F.when(found != "", found.try_cast("decimal(38,2)").cast("string")).otherwise(normalize(col))


def date_key(col: Column) -> Column:
    """ISO date of m/d/y text (two-digit years are 20yy) or of ISO text; other text in comparison form."""
    pattern = "\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})\\b"
    month, day, year = (F.regexp_extract(col, pattern, k) for k in (1, 2, 3))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    numeric = F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    iso = F.regexp_extract(col, "\\d{4}-\\d{2}-\\d{2}", 0)
    return F.when(iso != "", iso).when(year != "", numeric).otherwise(normalize(col))


def sequence_key(col: Column) -> Column:
    digits = replaced(F.coalesce(col, F.lit("")), "[^0-9]", "")
    return F.when((digits != "") & (F.length(digits) <= 30), digits.try_cast("decimal(30,0)"))


def address_key(col: Column) -> Column:
    """Street, road and avenue by their short forms, then letters and digits only."""
    text = F.upper(F.coalesce(col, F.lit("")))
    for word, short in (("STREET", "ST"), ("ROAD", "RD"), ("AVENUE", "AVE")):
        text = replaced(text, f"\\b{word}\\b", short)
    return alnum_key(text)


def legal_key(col: Column) -> Column:
    return alnum_key(replaced(F.upper(F.coalesce(col, F.lit(""))), "\\bTHE\\b", " "))


def slug(col: Column, default: str = "client", longest: int = 80) -> Column:
    out = F.substring(replaced(replaced(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.when(out == "", default).otherwise(out)


def csv_cell(col: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(cols: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cols])


def first_match(text: Column, classes: list[tuple[str, str]], default: str) -> Column:
    """Name of the first class whose pattern occurs in text."""
    out = F
    for name, pattern in classes:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def signal_score(text: Column, patterns: list[str]) -> Column:
    score = F.lit(0)
    for p in patterns:
        score = score + text.rlike(p).cast("int")
    return score


def bounded(value: str | None, default: float, low: float, high: float) -> float:
    """A configured number within its limits; what is no number is the default."""
    try:
        return min(max(float(value), low), high)
    except (TypeError, ValueError):
        return default
