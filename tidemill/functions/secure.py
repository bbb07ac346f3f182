"""Authenticated encryption and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKILL_BYTES = 50 * 1024 * 1024


def encrypt(c: Column, secret: Column) -> Column:
    """AES-GCM under the secret's SHA-256, as Base64 of nonce, text and tag; null and empty text pass through."""
    return F.when(F.length(c) > 0, F.base64(F.aes_encrypt(c, F.unhex(F.sha2(secret, 256)), F.lit("GCM")))).otherwise(c)


def looks_encrypted(c: Column) -> Column:
    return (F.length(c) >= 20) & c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


def decrypt(c: Column, secret: Column) -> Column:
    """Text that isn't Base64 of 20 characters at least is returned as it is; what fails to decrypt raises."""
    raw = F.unbase64(F.when(looks_encrypted(c), c))
    return F.when(F.length(raw) > 12, F.aes_decrypt(raw, F.unhex(F.sha2(secret, 256)), F.lit("GCM")).cast("string")).otherwise(c)


def digest_ok(content: Column, declared: Column) -> Column:
    """Whether a declared SHA-256 fits, whatever its case; a blank one isn't checked."""
    blank = declared.isNull() | (F.trim(declared) == "")
    return blank | (F.sha2(content, 256) == F.lower(F.trim(declared)))


def size_ok(content: Column, most: int = SKILL_BYTES) -> Column:
    return F.coalesce(F.octet_length(content).between(1, most), F.lit(False))
