"""Numbers as they are written in Norwegian accounts and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no amount (fixed values).
NULL_TOKENS = ["", "-", "–", "—", "N/A", "n/a", "null"]
#: Words that say in what unit amounts are given (fixed values).
THOUSANDS = ["i hele tusen", "i 1 000", "i 1000", "tusen nok", "nok 1000", "nok 1 000", "tkr", "t.kr"]
MILLIONS = ["i millioner", "i mill", "mnok", "mill. nok"]


def norwegian_number(raw: Column, scale: Column | float = 1.0, once=lambda value, of: of(value)) -> Column:
    """A number with spaces between thousands and a decimal comma, negative by one sign (before or behind) or brackets,
    times ``scale``. Dots divide thousands if a comma is right of all of them; a comma left of a dot is no number. Without a comma
    a dot is the decimal point. Null if it is none; an explicit zero stays zero. Inside of a lambda, where Spark works out a value each
    time that it is named, ``once`` is ``urls.bound``."""
    scale = F.lit(scale) if not isinstance(scale, Column) else scale

    def read(text: Column) -> Column:
        bracket = text.rlike(r"^\(.*\)$")
        negative = bracket | text.rlike("^[-−]") | text.rlike("-$")
        bare = F.when(bracket, F.regexp_replace(text, r"^\(|\)$", "")).when(text.rlike("^[-−]"), F.substr(text, F.lit(2))).when(text.rlike("-$"), F.regexp_replace(text, "-$", "")).otherwise(text)
        plain = lambda b: F.when(b.rlike(r",[^.]*$") & b.rlike(r"\."), F.replace(F.replace(b, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(~b.rlike(r"\."), F.replace(b, F.lit(","), F.lit("."))).otherwise(b)
        number = lambda p: F.when(p.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), p.try_cast("double"))
        value = once(once(F.replace(bare, F.lit(" "), F.lit("")), plain), number)
        return F.when(text.isin(NULL_TOKENS), None).otherwise(F.when(negative, -value).otherwise(value) * scale)

    return once(F.trim(F.replace(raw, F.lit("\u00a0"), F.lit(" "))), read)


def scale_factor(text: Column) -> Column:
    """1000 or 1000000 if the text names that unit, thousands first; else 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda marks: F.greatest(*[F.contains(low, F.lit(m)).cast("int") for m in marks]) == 1
    return F.when(some(THOUSANDS), 1000.0).when(some(MILLIONS), 1_000_000.0).otherwise(1.0)


def ocr_count(raw: Column) -> Column:
    """A count of people from scanned text: O read as 0, spaces and marks around it left out, dots between thousands unless one
    or two digits follow the last; null outside of 0 to 100000."""
    text = F.regexp_replace(F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit("O"), F.lit("0")), "^[.,-]+|[.,-]+$", "")
    whole = F.replace(text, F.lit("."), F.lit(""))
    plain = F.when(F.contains(text, F.lit(",")), F.replace(whole, F.lit(","), F.lit("."))).when(text.rlike(r"\.[0-9]{1,2}$"), text).otherwise(whole)
    value = F.when(plain.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), plain.try_cast("double"))
    return F.when(value.between(0, 100_000), F.bround(value, 2))


def currency(amount: Column) -> Column:
    """Millions (M) and thousands (k) with one decimal, smaller amounts whole, also where they round to a thousand; a loss that rounds to nothing keeps
    its sign; N/A for null."""
    mark = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    size = F.abs(amount)
    # Both round halves to even, but bround goes through decimals, which have no negative zero.
    small = F.format_string("%.0f NOK", F.rint(amount))
    return F.when(amount.isNull(), "N/A").when(size >= 1e6, mark(F.bround(amount / 1e6, 1), "M NOK")).when(size >= 1e3, mark(F.bround(amount / 1e3, 1), "k NOK")).otherwise(small)


def phone(raw: Column) -> Column:
    """The last eight digits, after the country's prefix."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    return F.right(F.when(F.startswith(digits, F.lit("47")) & (F.length(digits) > 8), F.substr(digits, F.lit(3))).otherwise(digits), F.lit(8))
