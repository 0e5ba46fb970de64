"""Fixed-width byte streams for tables of anchor sets and feature vectors.

Headers and rules are column expressions on one row per set; the payload is packed
and unpacked over Arrow batches in time linear in its bits. Rows that break a rule go to a
second frame with a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulo.functions.formulas import let
from cumulo.functions.lattice import (
    CONSTELLATION_HEADER_BYTES, FEATURE_HEADER_BYTES, MAX_BITS, MAX_FEATURE_BITS, MAX_SET_SIZE, MIN_BITS,
)

# Fixed values of the two stream formats: magic (ASCII as hex), version, domain, mode ids.
SET_MAGIC = "50434F4E"
FEATURE_MAGIC = "50464C54"
VERSION = 1
DOMAIN = 1
MODES = {"free": 1, "strict_subset": 2, "fps": 3}
MAX_UINT32 = 4294967295


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def _number(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def pack_numbers(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of ``width`` bits, highest bit first, zero bits up to whole bytes."""
    places = np.arange(width - 1, -1, -1, dtype=np.uint64)
    bits = (np.asarray(values, np.uint64)[:, None] >> places) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_numbers(body: bytes, width: int, count: int) -> tuple[np.ndarray, bool]:
    """``count`` numbers of ``width`` bits, and whether only zero bits follow."""
    bits = np.unpackbits(np.frombuffer(body, np.uint8))
    used = count * width
    places = np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)
    return bits[:used].reshape(count, width).astype(np.uint64) @ places, not bits[used:].any()


@F.pandas_udf(T.BinaryType())
def _packed(values: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([pack_numbers(v, w) for v, w in zip(values, width)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("values", T.ArrayType(T.LongType())), T.StructField("clean", T.BooleanType())]))
def _unpacked(body: pd.Series, width: pd.Series, count: pd.Series) -> pd.DataFrame:
    found = [unpack_numbers(b, w, n) for b, w, n in zip(body, width, count)]
    return pd.DataFrame({"values": [v.astype(np.int64) for v, _ in found], "clean": [c for _, c in found]}, columns=["values", "clean"])


def _lattice(value: Column, bits: int) -> Column:
    return F.rint((value + F.lit(1.0)) * F.lit(0.5) * F.lit(float(2**bits - 1))).cast("bigint")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def canonical_sets(sets: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """One row per set with its order-free key: sorted lattice triples and a digest.

    ``sets`` holds lattice indices ``ix, iy, iz``.
    """
    triples = F.array_sort(F.collect_list(F.struct("ix", "iy", "iz")))
    text = F.array_join(F.transform(
        "triples", lambda t: F.concat_ws(",", t["ix"].cast("string"), t["iy"].cast("string"), t["iz"].cast("string"))
    ), ";")
    return sets.groupBy(*keys).agg(triples.alias("triples")).withColumn("set_key", F.sha2(text, 256))


def distinct_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of sets per canonical key, with the smallest set id of each."""
    keyed = canonical_sets(sets, keys)
    return keyed.groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*keys)).alias("first"))


def encode_sets(sets: DataFrame, *, bits: int, mode: Column, output_points: Column,
                keys: Sequence[str] = ("cloud_id",)) -> tuple[DataFrame, DataFrame]:
    """Pack unordered coordinate sets; returns (streams, rejected with ``reason``).

    ``mode`` and ``output_points`` are constant within a set.
    """
    if not MIN_BITS <= bits <= MAX_BITS:
        raise ValueError(f"bits must be in {MIN_BITS}..{MAX_BITS}")
    axes = [F.col(a) for a in ("x", "y", "z")]
    finite = _finite(axes[0]) & _finite(axes[1]) & _finite(axes[2])
    inside = axes[0].between(-1, 1) & axes[1].between(-1, 1) & axes[2].between(-1, 1)
    safe = [F.when(finite & inside, a).otherwise(F.lit(0.0)) for a in axes]
    rows = sets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*[_lattice(v, bits).alias(n) for v, n in zip(safe, ("ix", "iy", "iz"))]))).alias("_t"),
        F.bool_and(finite).alias("_finite"), F.bool_and(finite & inside).alias("_inside"),
        F.any_value(mode).alias("mode"), F.any_value(output_points).alias("output_points"), F.count(F.lit(1)).alias("k"),
    )
    known = F.create_map(*[part for name, number in MODES.items() for part in (F.lit(name), F.lit(number))])
    judged = rows.withColumn("reason", F.when(~F.col("_finite"), "coordinates are not finite")
        .when(~F.col("_inside"), "coordinates outside the domain")
        .when(F.col("k") > MAX_SET_SIZE, "set is too large")
        .when(F.get(F.map_values(F.map_filter(known, lambda name, _: name == F.col("mode"))), F.lit(0)).isNull(), "unknown mode")
        .when((F.col("output_points") < F.col("k")) | (F.col("output_points") > MAX_UINT32), "output point count does not fit"))
    header = F.concat(
        F.lit(SET_MAGIC), _hex(F.lit(VERSION), 2), _hex(known[F.col("mode")], 2), _hex(F.lit(bits), 2), _hex(F.lit(DOMAIN), 2),
        _hex(F.col("k"), 4), _hex(F.col("output_points"), 8),
    )
    flat = F.flatten(F.transform("_t", lambda t: F.array(t["ix"], t["iy"], t["iz"])))
    good = judged.filter("reason IS NULL").withColumn("_body", _packed(flat, F.lit(bits)))
    streams = good.select(*keys, F.concat(F.unhex(header), F.col("_body")).alias("stream"))
    return streams, judged.filter("reason IS NOT NULL").select(*keys, "k", "reason")


def _payload(df: DataFrame, header_bytes: int, count: Column) -> DataFrame:
    """Adds ``_values`` (unsigned integers) and ``_clean`` (no bit is set after the last one)."""
    body = F.substring(F.col("stream"), F.lit(header_bytes + 1), F.length("stream"))
    read = df.withColumn("_read", _unpacked(body, F.col("bits"), count.cast("int")))
    return read.withColumn("_values", F.col("_read.values")).withColumn("_clean", F.col("_read.clean"))


def decode_sets(streams: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> tuple[DataFrame, DataFrame]:
    """Unpack set streams; returns (one row per anchor, rejected with ``reason``)."""
    text = streams.select(*keys, "stream", F.hex(F.substring("stream", 1, CONSTELLATION_HEADER_BYTES)).alias("_hex"), F.length("stream").alias("stream_bytes"))

    def field(start: int, digits: int) -> Column:
        return _number(F.substring("_hex", start, digits))

    parsed = text.withColumns({
        "_magic": F.substring("_hex", 1, 8), "_version": field(9, 2), "_mode": field(11, 2), "bits": field(13, 2).cast("int"),
        "_domain": field(15, 2), "k": field(17, 4).cast("int"), "output_points": field(21, 8),
    })
    expected = F.lit(CONSTELLATION_HEADER_BYTES) + F.ceil(F.lit(3.0) * F.col("k") * F.col("bits") / F.lit(8.0))
    names = F.create_map(*[part for name, number in MODES.items() for part in (F.lit(number).cast("bigint"), F.lit(name))])
    mode = F.get(F.map_values(F.map_filter(names, lambda number, _: number == F.col("_mode"))), F.lit(0))
    judged = parsed.withColumn("mode", mode).withColumn("reason", F.when(F.col("stream_bytes") < CONSTELLATION_HEADER_BYTES, "truncated header")
        .when(F.col("_magic") != SET_MAGIC, "wrong magic")
        .when(F.col("_version") != VERSION, "unsupported version")
        .when(F.col("mode").isNull(), "unknown mode")
        .when(F.col("_domain") != DOMAIN, "unsupported domain")
        .when(~F.col("bits").between(MIN_BITS, MAX_BITS) | (F.col("k") < 1), "size or bit width out of range")
        .when(F.col("stream_bytes") != expected, "stream length differs from header")
        .when(F.col("output_points") < F.col("k"), "output point count below set size"))
    ready = _payload(judged.filter("reason IS NULL"), CONSTELLATION_HEADER_BYTES, F.col("k") * 3)
    padded = ~F.col("_clean")
    bad = judged.filter("reason IS NOT NULL").select(*keys, "reason").unionByName(
        ready.filter(padded).select(*keys, F.lit("non-zero padding bits").alias("reason"))
    )
    levels = F.pow(F.lit(2.0), F.col("bits")) - F.lit(1.0)
    good = ready.filter(~padded).select(
        *keys, "mode", "bits", "k", "output_points", "stream_bytes", (F.lit(3) * F.col("k") * F.col("bits")).alias("payload_bits"),
        levels.alias("_levels"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.slice("_values", i * 3 + 1, 3))).alias("slot", "_t"),
    )
    index = {f"i{a}": F.get("_t", F.lit(i)).cast("int") for i, a in enumerate(("x", "y", "z"))}
    good = good.withColumns(index).withColumns({
        a: F.col(f"i{a}").cast("double") * (F.lit(2.0) / F.col("_levels")) - F.lit(1.0) for a in ("x", "y", "z")
    })
    return good.drop("_levels", "_t"), bad


def encode_features(vectors: DataFrame, *, bits: int, output_points: Column) -> tuple[DataFrame, DataFrame]:
    """Pack ordered vectors ``features`` (array of double in [-1, 1]) with their key columns."""
    if not MIN_BITS <= bits <= MAX_FEATURE_BITS:
        raise ValueError(f"bits must be in {MIN_BITS}..{MAX_FEATURE_BITS}")
    keys = [c for c in vectors.columns if c != "features"]
    size = F.size("features")
    judged = vectors.withColumn("output_points", output_points).withColumn("reason", F.when(size < 1, "vector is empty")
        .when(size > MAX_SET_SIZE, "vector is too long")
        .when(~F.forall("features", _finite), "features are not finite")
        .when(~F.forall("features", lambda v: v.between(-1, 1)), "features outside the domain")
        .when(~F.col("output_points").between(1, MAX_UINT32), "output point count does not fit"))
    header = F.concat(
        F.lit(FEATURE_MAGIC), _hex(F.lit(VERSION), 2), _hex(F.lit(bits), 2), _hex(size, 4), _hex(F.col("output_points"), 8)
    )
    good = judged.filter("reason IS NULL").withColumn("_body", _packed(F.transform("features", lambda v: _lattice(v, bits)), F.lit(bits)))
    return (
        good.select(*keys, F.concat(F.unhex(header), F.col("_body")).alias("stream")),
        judged.filter("reason IS NOT NULL").select(*keys, "reason"),
    )


def decode_features(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unpack feature streams; returns (vectors, rejected with ``reason``)."""
    keys = [c for c in streams.columns if c != "stream"]
    text = streams.select(*keys, "stream", F.hex(F.substring("stream", 1, FEATURE_HEADER_BYTES)).alias("_hex"), F.length("stream").alias("stream_bytes"))

    def field(start: int, digits: int) -> Column:
        return _number(F.substring("_hex", start, digits))

    parsed = text.withColumns({
        "_magic": F.substring("_hex", 1, 8), "_version": field(9, 2), "bits": field(11, 2).cast("int"),
        "length": field(13, 4).cast("int"), "output_points": field(17, 8),
    })
    expected = F.lit(FEATURE_HEADER_BYTES) + F.ceil(F.col("length") * F.col("bits") / F.lit(8.0))
    judged = parsed.withColumn("reason", F.when(F.col("stream_bytes") < FEATURE_HEADER_BYTES, "truncated header")
        .when(F.col("_magic") != FEATURE_MAGIC, "wrong magic")
        .when(F.col("_version") != VERSION, "unsupported version")
        .when(~F.col("bits").between(MIN_BITS, MAX_FEATURE_BITS) | (F.col("length") < 1), "size or bit width out of range")
        .when(F.col("stream_bytes") != expected, "stream length differs from header")
        .when(F.col("output_points") < 1, "output point count must be positive"))
    ready = _payload(judged.filter("reason IS NULL"), FEATURE_HEADER_BYTES, F.col("length"))
    padded = ~F.col("_clean")
    bad = judged.filter("reason IS NOT NULL").select(*keys, "reason").unionByName(
        ready.filter(padded).select(*keys, F.lit("non-zero padding bits").alias("reason"))
    )
    unit = F.lit(2.0) / (F.pow(F.lit(2.0), F.col("bits")) - F.lit(1.0))
    scaled = let(F.struct(F.col("_values").alias("v"), unit.alias("u")), lambda p: F.transform(p["v"], lambda v: v.cast("double") * p["u"] - F.lit(1.0)))
    good = ready.filter(~padded).select(
        *keys, "bits", "length", "output_points", "stream_bytes", (F.col("length") * F.col("bits")).alias("payload_bits"),
        scaled.alias("features"),
    )
    return good, bad


def round_trip_report(sets: DataFrame, decoded: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Whether each decoded set equals the sent lattice set, order aside."""
    sent = canonical_sets(sets, keys).select(*keys, F.col("set_key").alias("_sent"))
    got = canonical_sets(decoded, keys).select(*keys, F.col("set_key").alias("_got"))
    return sent.join(got, list(keys), "left").select(
        *keys, F.coalesce(F.col("_sent") == F.col("_got"), F.lit(False)).alias("exact")
    )
