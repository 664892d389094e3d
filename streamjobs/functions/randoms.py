"""Reproducible random columns.

Each value is a function of a seed and the row's key only, so a retried task or
another partitioning gives the same rows (``rand`` depends on both).
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits, the most that a double holds exactly.
_DIGITS = 13


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    digits = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10)
    return digits.cast("double") / F.lit(float(16 ** _DIGITS))


def hash_int(low: int | Column, high: int | Column, seed: int | str, *keys: Column) -> Column:
    """Uniform whole number, both ends included."""
    lo = F.lit(low) if isinstance(low, int) else low
    hi = F.lit(high) if isinstance(high, int) else high
    return (F.floor(hash_uniform(seed, *keys) * (hi - lo + 1)) + lo).cast("long")


def hash_normal(mean: float, sd: float, seed: int | str, *keys: Column) -> Column:
    """Gaussian by the Box-Muller formula."""
    u = F.lit(1.0) - hash_uniform(f"{seed}a", *keys)
    v = hash_uniform(f"{seed}b", *keys)
    return F.lit(mean) + F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def poisson_law(mean: float) -> list[float]:
    """Probabilities of at most 0, 1, 2, ... events, up to one that is 1 but for rounding."""
    cumulative, total, k = [], 0.0, 0
    while k <= mean or total < 1.0 - 1e-12:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        cumulative.append(total)
        k += 1
    return cumulative


def hash_poisson(mean: float, seed: int | str, *keys: Column) -> Column:
    """Poisson count, by looking the uniform value up in the cumulative law."""
    u = hash_uniform(seed, *keys)
    return F.size(F.filter(F.lit(poisson_law(mean)), lambda c: c <= u)).cast("long")


# Letters per SHA-256 digest, and bits per letter: five hexadecimal digits.
_LETTERS, _LETTER_BITS = 12, 20


def hash_text(length: Column, alphabet: str, seed: int | str, *keys: Column) -> Column:
    """Random text of ``length`` characters of ``alphabet``; each digest gives twelve of them.

    The digests and letters of a text are made in one go per row: as expressions, every letter
    cost some ten calls of its own.
    """
    letters, per_digest, bits = np.array(list(alphabet)), _LETTERS, _LETTER_BITS

    def text(key: str, n: int | None) -> str:
        if n is None or n <= 0 or not len(letters):
            return ""
        head = f"{key}|".encode()
        digests = [sha256(head + b"%d" % block).digest() for block in range((n - 1) // per_digest + 1)]
        # five bytes are the ten hexadecimal digits of two letters
        used = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)[:, :per_digest * bits // 8]
        five = used.reshape(-1, 5).astype(np.int64).T
        first, second = five[0] << 12 | five[1] << 4 | five[2] >> 4, (five[2] & 15) << 16 | five[3] << 8 | five[4]
        places = np.stack([first, second], 1).ravel()[:n] * len(letters) >> bits
        return "".join(letters[places].view(f"U{n}").tolist())

    def texts(key: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(map(text, key.to_pylist(), n.to_pylist()), pa.string())

    key = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.arrow_udf(texts, "string")(key, length.cast("int"))
