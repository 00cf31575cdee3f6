"""Hashes and repeatable random draws, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

ADLER_MODULUS = 65521


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def adler32(value) -> Column:
    """Adler-32 checksum of the UTF-8 bytes of a string."""

    def of_hex(text: Column) -> Column:
        n = F.length(text) / 2
        bytes_ = F.when(n < 1, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), n.cast("int")),
                lambda i: F.conv(F.substring(text, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"),
            )
        )
        start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))

        def step(acc, byte):
            a = (acc["a"] + byte) % ADLER_MODULUS
            return F.struct(a.alias("a"), ((acc["b"] + a) % ADLER_MODULUS).alias("b"))

        return F.aggregate(bytes_, start, step, lambda acc: acc["b"] * 65536 + acc["a"])

    return let(F.hex(F.encode(_col(value), "UTF-8")), of_hex)


def _seeded(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed, *keys) -> Column:
    """Uniform draw in [0, 1) that depends only on the seed and the key columns."""
    return F.conv(F.substring(_seeded(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffle_rank(seed, *keys) -> Column:
    """60-bit pseudo-random sort key: ordering by it is a seeded, repeatable shuffle."""
    return F.conv(F.substring(_seeded(seed, *keys), 1, 15), 16, 10).cast("bigint")


def content_id(value) -> Column:
    return F.sha2(_col(value), 256)
