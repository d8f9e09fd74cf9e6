"""Check digits and number shapes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of GB 11643 and GB 32100.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def luhn(c: Column | str) -> Column:
    """MTH6: 13 to 19 digits whose Luhn sum fits."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", F.when(c.rlike(r"^\d{13,19}$"), c).otherwise("1"))


def id_number(c: Column | str, as_of: Column | None = None, *, strict_standard: bool = False) -> Column:
    """MTH5: 17 digits and a check character over a real birth date from 1900 to as_of. Without strict_standard the
    check character 2 (remainder 10) is not accepted, as the tools this replaces do."""
    c = F.upper(F.col(c) if isinstance(c, str) else c)
    shape = c.rlike(r"^\d{17}[\dX]$")
    total = sum((F.coalesce(F.substring(c, k + 1, 1).try_cast("int"), F.lit(0)) * w for k, w in enumerate(ID_WEIGHTS)), F.lit(0))
    checks = ID_CHECKS if strict_standard else ID_CHECKS[:10] + "?"
    born = F.try_to_date(F.when(shape, F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 11, 2), F.substring(c, 13, 2))), "yyyy-MM-dd")
    real = born.isNotNull() & (F.year(born) >= 1900) & (born <= (F.current_date() if as_of is None else as_of))
    return F.coalesce(shape & (F.lit(checks).substr(total % 11 + 1, F.lit(1)) == F.substring(c, 18, 1)) & real, F.lit(False))


def credit_code(c: Column | str) -> Column:
    """MTH4: 18 characters of the GB 32100 alphabet with their check character; null for another shape."""
    c = F.upper(F.col(c) if isinstance(c, str) else c)
    shape = c.rlike(f"^[{CREDIT_ALPHABET}]{{18}}$")
    total = sum((F.call_function("instr", F.lit(CREDIT_ALPHABET), F.substring(c, k + 1, 1)) - 1) * (3**k % 31) for k in range(17))
    return F.when(shape, F.lit(CREDIT_ALPHABET).substr(F.pmod(31 - total % 31, F.lit(31)) + 1, F.lit(1)) == F.substring(c, 18, 1))


def old_tax_number(c: Column | str) -> Column:
    """MTH7: fifteen digits; null for another length."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) == 15, c.rlike(r"^\d{15}$"))


def ipv4(c: Column | str) -> Column:
    """MTH11: four numbers of at most 255."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
