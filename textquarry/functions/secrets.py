"""Sealing of values: AES-256 in GCM mode, a fresh 12-byte vector before and the tag after what is sealed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seal(value: Column, key: Column) -> Column:
    """``key``: 32 bytes."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    """The text, or null where key or seal are wrong."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")
