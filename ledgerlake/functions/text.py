"""Column expressions that normalise untidy text and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks at the ends of a key.
BLANKS = " \t\r\n\x0b\x0c "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def key_text(c: Column | str) -> Column:
    """A key compared ignoring case and outer blanks."""
    return F.upper(trim_blanks(c))


def same_name(c: Column | str) -> Column:
    """Text whose equality means "differs only in letter case and blanks"."""
    return F.lower(F.btrim(F.regexp_replace(col(c), r"[\s ]+", " ")))


def number_text(c: Column | str) -> Column:
    """Digits of an untidy number without leading zeros; NULL when there are none."""
    digits = F.regexp_extract(col(c), r"(\d+)", 1)
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(digits != "", bare)


def ten_digits(c: Column | str) -> Column:
    """A company number as ten digits; longer numbers stay whole, text without digits is NULL."""
    bare = number_text(c)
    return F.when(F.length(bare) >= 10, bare).otherwise(F.lpad(bare, 10, "0"))


def iso_day(c: Column | str) -> Column:
    """``YYYY-MM-DD`` from ``YYYY-MM-DD``, ``YYYYMMDD`` or a timestamp text; NULL otherwise."""
    digits = F.regexp_replace(F.regexp_extract(trim_blanks(c), r"^(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    day = F.try_to_date(digits, "yyyyMMdd")
    return F.date_format(day, "yyyy-MM-dd")


_HEX64 = "^[0-9A-F]{64}$"


def pack_key(c: Column | str) -> Column:
    """A key in half the bytes: upper-case SHA-256 hex as its 32 bytes, any other text as UTF-8.

    Equal keys have equal packed forms and different keys different ones; hex digits do not
    compress in shuffles, so hash keys move in this form.
    """
    c = col(c)
    whole = F.concat(F.lit(bytearray(b"\x01")), F.unhex(c))
    return F.when(c.rlike(_HEX64), whole).when(c.isNotNull(), F.concat(F.lit(bytearray(b"\x00")), F.encode(c, "UTF-8")))


def unpack_key(c: Column | str) -> Column:
    """The key as it was before ``pack_key``."""
    c = col(c)
    rest = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(bytearray(b"\x01")), F.hex(rest)).when(c.isNotNull(), F.decode(rest, "UTF-8"))
