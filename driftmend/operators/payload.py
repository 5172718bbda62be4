"""Encrypt, decrypt and compare payload columns (AES-CBC, zero initial vector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.functions.columns import padded_length

_ZERO = "00" * 16


def encrypted(content: Column, key: Column) -> Column:
    """Ciphertext without the initial vector."""
    vector = F.unhex(F.lit(_ZERO))
    return F.substring(F.aes_encrypt(content, key, F.lit("CBC"), F.lit("PKCS"), vector), 17, 2147483647)


def decrypted(cipher: Column, key: Column) -> Column:
    """Plaintext, or null if the key or the ciphertext is wrong."""
    return F.try_aes_decrypt(F.concat(F.unhex(F.lit(_ZERO)), cipher), key, F.lit("CBC"), F.lit("PKCS"))


def payload_round_trip(table: DataFrame, name: str, content: str, key: bytes) -> DataFrame:
    """(name, plain_length, cipher_length, length_ok, restored): every payload encrypted, decrypted and compared by hash."""
    k, plain = F.unhex(F.lit(key.hex())), F.coalesce(F.col(content).cast("binary"), F.unhex(F.lit("")))
    both = table.select(name, plain.alias("plain")).withColumn("cipher", encrypted(F.col("plain"), k))
    n = F.octet_length("plain")
    same = F.sha2(F.col("plain"), 256).eqNullSafe(F.sha2(decrypted(F.col("cipher"), k), 256))
    return both.select(name, n.cast("long").alias("plain_length"), F.octet_length("cipher").cast("long").alias("cipher_length"), (F.octet_length("cipher") == padded_length(n)).alias("length_ok"), same.alias("restored"))
