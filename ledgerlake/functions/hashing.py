"""Key hashes of the vault: upper-case SHA-256 hex, parts joined by ``||``, NULL parts ``^^``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import col

SEPARATOR = "||"
NULL_PART = "^^"


def ts_text(c: Column | str) -> Column:
    """Timestamp text with six fractional digits (a plain cast trims trailing zeros)."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sha(c: Column | str) -> Column:
    return F.upper(F.sha2(col(c).cast("string"), 256))


def key_hash(*parts: Column | str, nullable: tuple[int, ...] = ()) -> Column:
    """Hash of the parts in order; NULL when a part outside ``nullable`` is NULL."""
    texts = [F.coalesce(col(p).cast("string"), F.lit(NULL_PART)) if i in nullable else col(p).cast("string") for i, p in enumerate(parts)]
    return sha(reduce(lambda a, b: F.concat(a, F.lit(SEPARATOR), b), texts))


def hashdiff(*parts: Column | str) -> Column:
    """Hash of a payload; NULL parts count as ``^^``, so it is never NULL."""
    return key_hash(*parts, nullable=tuple(range(len(parts))))
