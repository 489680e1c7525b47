"""Column functions that pipelines of the catalogue use; all stay in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.transforms import Expr, col


def words(text: Expr, sep: str = " ") -> Column:
    """Pieces between separators, empty ones left out."""
    return F.filter(F.split(col(text), f"[{sep}]"), lambda w: w != "")


def dot(a: Expr, b: Expr) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Expr, b: Expr) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def logistic(x: Expr) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def unit_hash(*cols: Expr, salt: int = 0) -> Column:
    """A number from 0 to below 1 that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *map(col, cols)), 11) / float(1 << 53)


def zero_if_nan(x: Expr) -> Column:
    return F.nanvl(col(x), F.lit(0.0))


def version_text(ts: Expr) -> Column:
    return F.date_format(col(ts), "yyMMdd_HHmmss.SSSSSS")


def version_time(text: Expr) -> Column:
    """The time that version_text wrote."""
    return F.to_timestamp(col(text), "yyMMdd_HHmmss.SSSSSS")


def sha512(x: Expr) -> Column:
    return F.sha2(col(x).cast("binary"), 512)


def encrypted(x: Expr, key: Expr) -> Column:
    """AES in GCM with a random start, as bytes; the key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(col(x).cast("binary"), col(key).cast("binary"))


def decrypted(x: Expr, key: Expr) -> Column:
    return F.aes_decrypt(col(x), col(key).cast("binary")).cast("string")


def filled(amount: float, limits: list[float]) -> list[float]:
    """Shares of an amount for holders with limits: all get the same, those whose limit is less get their limit."""
    out, left = [0.0] * len(limits), amount
    order = sorted(range(len(limits)), key=lambda i: limits[i])
    for k, i in enumerate(order):
        out[i] = min(limits[i], left / (len(order) - k))
        left -= out[i]
    return out


def stable_id(text: Expr) -> Column:
    """A 128-bit identity of a text, as hex digits."""
    return F.md5(col(text).cast("binary"))


def scan(text: Expr, pattern: str, *groups: int) -> Column:
    return F.array(*[F.regexp_extract(col(text), pattern, g) for g in groups])
