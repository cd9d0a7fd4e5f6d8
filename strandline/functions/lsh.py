"""MinHash signatures and bands of feature sets, from integer hashes that any SQL engine can compute."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 4294967311


def coefficients(n: int) -> list[tuple[int, int]]:
    """The factors and terms of n hashes."""
    if n <= 0:
        raise ValueError("there must be a hash")
    return [((i * 2654435761 + 1013904223) % 2147483629 + 1, (i * 40503 * 65537 + 12345) % PRIME) for i in range(1, n + 1)]


def bands(n: int, threshold: float) -> tuple[int, int]:
    """(bands, hashes in a band) of n hashes for a Jaccard threshold: the fewest b with b ln b >= -n ln threshold."""
    if not 0 < threshold < 1 or n <= 0:
        raise ValueError("the threshold must lie between 0 and 1, and there must be a hash")
    b = 1
    while b * math.log(b) < -n * math.log(threshold):
        b += 1
    b = min(b, n)
    return b, n // b


def inclusion_probability(similarity: float, n: int, threshold: float) -> float:
    b, r = bands(n, threshold)
    return 1 - (1 - similarity**r) ** b


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and not once for each of its uses inside a lambda."""
    return F.transform(F.array(value), body)[0]


def base_hash(feature: Column) -> Column:
    """The first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long")


def signature(features: Column, n: int) -> Column:
    """The least hash of all features for each of n hash functions; null for no features."""
    bases = F.transform(F.array_distinct(features), base_hash)
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in coefficients(n)])
    return F.when(F.size(features) > 0, let(bases, lambda known: F.transform(pairs, lambda c: F.array_min(F.transform(known, lambda x: (c["a"] * x + c["b"]) % PRIME)))))


def least_hashes(bases: pa.ListArray, n: int) -> pa.ListArray:
    """signature() of base hashes for a whole batch: null for none. Factors and bases are so small that no product overflows."""
    sizes = bases.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    some, values = sizes > 0, bases.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    starts = np.cumsum(sizes[some]) - sizes[some]
    out = np.empty((len(starts), n), np.int64)
    if len(starts):
        for j, (a, b) in enumerate(coefficients(n)):
            x = values * np.uint64(a) + np.uint64(b)
            x -= x // np.uint64(PRIME) * np.uint64(PRIME)
            out[:, j] = np.minimum.reduceat(x, starts)
    return _lists(some, pa.array(out.ravel()), n)


def signature_in_batches(features: Column, n: int) -> Column:
    """The same as signature(), with the hashes of a batch of rows computed at once: a lambda takes ten times as long for them."""
    hashed = F.arrow_udf(lambda bases: least_hashes(bases, n), "array<bigint>")
    return hashed(F.array_compact(F.transform(F.array_distinct(features), base_hash)))


def _lists(some: np.ndarray, rows: pa.Array, width: int) -> pa.ListArray:
    """Lists of one width for the rows that have one, null for the others."""
    offsets = np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), rows, mask=pa.array(~some))


def sketches(sigs: pa.ListArray, n: int, threshold: float) -> pa.StructArray:
    """For each signature its bands as (key, first), equal if and only if their names in buckets() are, in 16 bytes: 64 bits of all places and the band's number, and
    the first place; and the prints: the lowest byte of each place, seven in a long."""
    some = sigs.is_valid().to_numpy(zero_copy_only=False)
    all_ = sigs.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    b, r = bands(n, threshold)
    each = all_[:, : b * r].reshape(-1, b, r)
    key = np.tile(np.arange(1, b + 1, dtype=np.uint64), (len(each), 1))
    for j in range(r):
        key = (key ^ each[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    both = pa.StructArray.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(each[:, :, 0].ravel())], ["key", "first"])
    width = -(-n // 7)
    low = np.zeros((len(all_), width, 8), np.uint8)
    low[:, :, :7] = np.pad(all_.astype(np.uint8), ((0, 0), (0, 7 * width - n))).reshape(-1, width, 7)
    return pa.StructArray.from_arrays([_lists(some, both, b), _lists(some, pa.array(low.reshape(-1, 8).view("<i8").ravel()), width)], ["bands", "prints"])


def sketch(sig: Column, n: int, threshold: float) -> Column:
    return F.arrow_udf(lambda sigs: sketches(sigs, n, threshold), "struct<bands:array<struct<key:bigint,first:bigint>>,prints:array<bigint>>")(sig)


def agreeing(a: Column, b: Column, n: int) -> Column:
    """How many bytes of two prints are equal: at least as many as their signatures' equal places."""
    low, high = 0x007F7F7F7F7F7F7F, 0x0080808080808080
    # Adding carries into a byte's highest bit if any lower one is set, and never into the next byte.
    other = lambda d: F.bit_count((d.bitwiseAND(low) + F.lit(low)).bitwiseOR(d).bitwiseAND(high))
    return F.lit(n) - F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda s, d: s + other(d))


def buckets(sig: Column, n: int, threshold: float) -> Column:
    """A name for each band: its number and the MD5 of its hashes."""
    b, r = bands(n, threshold)
    name = lambda s, i: F.concat_ws(":", i.cast("string"), F.md5(F.array_join(F.transform(F.slice(s, i * r + 1, r), lambda x: x.cast("string")), ",")))
    return let(sig, lambda s: F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: name(s, i)))


def similarity(a: Column, b: Column) -> Column:
    """The share of equal places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))


def encoded(sig: Column) -> Column:
    """A signature as Base64 text in one line."""
    return F.regexp_replace(F.base64(F.encode(F.array_join(F.transform(sig, lambda x: x.cast("string")), ","), "utf-8")), r"\s", "")


def decoded(text: Column) -> Column:
    return F.transform(F.split(F.decode(F.unbase64(text), "utf-8"), ","), lambda x: x.cast("long"))
