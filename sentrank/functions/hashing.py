"""Stable hashes: combo keys, [0,1] hashes and seeded draws per event.

All randomness in the package is a function of (event id, seed, purpose), so it
does not depend on partitioning or on retries of a lost task.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW32 = (1 << 32) - 1


def combo_key(agent: Column, rule_id: Column, bucket: Column) -> Column:
    """``agent||rule||bucket`` with missing parts spelled ``nan``."""
    return F.concat_ws(
        "||", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in (agent, rule_id, bucket)]
    )


@F.pandas_udf(T.DoubleType())
def hash01(keys: pd.Series) -> pd.Series:
    """Low half of the 8-byte BLAKE2b digest, scaled to [0,1]. Use on distinct keys."""
    def low32(text: str) -> int:
        digest = hashlib.blake2b(text.encode("utf-8"), digest_size=8).digest()
        return int.from_bytes(digest[4:], "big")

    return keys.map(low32, na_action="ignore").astype("float64") / _LOW32


def hash01_md5(key: Column) -> Column:
    """The same idea on MD5, entirely inside the JVM and checkable in other engines."""
    return F.conv(F.right(F.md5(key), F.lit(8)), 16, 10).cast("double") / F.lit(float(_LOW32))


def draw_key(event_id: Column, seed: int, purpose: str) -> Column:
    """A uniform 32-digit hex key per event."""
    return F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), F.coalesce(event_id, F.lit("nan"))))


def row_key(df: DataFrame, key: str, seed: int, purpose: str) -> Column:
    """``draw_key`` of a row's id, or of the whole row where it has none."""
    return draw_key(F.coalesce(F.col(f"`{key}`").cast("string"), F.to_json(F.struct("*"))), seed, purpose)


def draw_int(event_id: Column, seed: int, purpose: str, low: int, n: int | Column) -> Column:
    """A uniform whole number in ``[low, low + n)`` per event."""
    word = F.conv(F.left(draw_key(event_id, seed, purpose), F.lit(8)), 16, 10).cast("long")
    width = n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long")
    return F.lit(low).cast("long") + word % width
