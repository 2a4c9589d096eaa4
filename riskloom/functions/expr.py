"""Column expressions: blanks, keys, hashes, versions, and decimals of bounded precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKEN = "<NULL>"
#: Operand types whose products stay exact within 38 digits: (23,6) * (14,12) is (38,18). AMOUNT is for sums that are not multiplied.
MONEY, RETURN, QUANTITY, PRICE, WEIGHT = "decimal(23,6)", "decimal(14,12)", "decimal(38,16)", "decimal(20,8)", "decimal(12,10)"
AMOUNT = "decimal(32,6)"
#: Pairs of operand types of a product, from the most exact on: digits give way to size.
_PRODUCTS = (("decimal(20,8)", "decimal(17,8)"), ("decimal(28,8)", "decimal(17,4)"), ("decimal(34,2)", "decimal(20,4)"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_blank(c: Column | str) -> Column:
    """Trimmed; null where nothing is left."""
    t = F.trim(_col(c))
    return F.when(t != "", t)


def is_blank(c: Column | str) -> Column:
    return _col(c).isNull() | (F.trim(_col(c)) == "")


def try_cast(c: Column | str, to: str) -> Column:
    """A typed value; null where the trimmed text can't be cast."""
    return null_if_blank(c).try_cast(to)


def castable(raw: str, typed: str) -> Column:
    """False only where a value was given and the cast lost it."""
    return ~(~is_blank(raw) & F.col(typed).isNull())


def canonical(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(NULL_TOKEN))


def record_hash(fields: Sequence[Column | str]) -> Column:
    """SHA-256 of the fields' canonical texts, joined by bars, in the given order."""
    return F.sha2(F.concat_ws("|", *[canonical(f) for f in fields]), 256)


def business_key(fields: Sequence[Column | str], sep: str = "|") -> Column:
    """The parts joined; null if any part is blank."""
    parts = [_col(f).cast("string") for f in fields]
    blank = parts[0].isNull() | (F.trim(parts[0]) == "")
    for p in parts[1:]:
        blank = blank | p.isNull() | (F.trim(p) == "")
    return F.when(~blank, F.concat_ws(sep, *parts))


def surrogate_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256)


def semver(c: Column | str) -> Column:
    """(major, minor, patch), which compares in version order; null unless three whole numbers are given."""
    text = _col(c)
    parts = F.split(text, r"\.")
    return F.when(text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.struct(*[parts[i].cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def product(a: Column, b: Column, to: str = QUANTITY) -> Column:
    """a * b of two decimals, exact where their narrow forms hold them and with fewer digits where only wider ones do.

    Nothing throws: a product that ``to`` can't hold is null, which the rules on required results report.
    """
    return F.coalesce(*[(a.try_cast(x) * b.try_cast(y)).try_cast(to) for x, y in _PRODUCTS])


def ratio(a: Column, b: Column, scale: int = 12) -> Column:
    """a / b rounded half up to ``scale`` digits; null where b is zero or a result is too large."""
    return F.round(a.try_cast(PRICE) / F.nullif(b.try_cast(PRICE), F.lit(0).cast(PRICE)), scale)


def share(a: Column, b: Column) -> Column:
    """a / b with eighteen digits, rounded half up; 0 where b isn't positive. Amounts from 1e14 on have fifteen digits."""
    narrow = "decimal(20,6)"
    exact = a.try_cast(narrow) / F.nullif(b.try_cast(narrow), F.lit(0).cast(narrow))
    wide = a.try_cast(MONEY) / F.nullif(b.try_cast(MONEY), F.lit(0).cast(MONEY))
    return F.when(b > 0, F.coalesce(exact.try_cast("decimal(38,18)"), wide.try_cast("decimal(38,18)"))).otherwise(F.lit(0).cast("decimal(38,18)"))


def shown(c: Column, scale: int = 4) -> Column:
    """A decimal rounded to ``scale`` digits, as a double, for results that leave the engine."""
    return c.cast(f"decimal(38,{scale})").cast("double")


def in_force(start: Column | str, end: Column | str, on: Column) -> Column:
    """Effective range, both ends included, open at the end if null."""
    return (_col(start) <= on) & (_col(end).isNull() | (_col(end) >= on))
