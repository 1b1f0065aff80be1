"""Column jobs over TLS and HTTP/2 fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.schema import (CIPHER_NAMES, CURVE_NAMES, GREASE_BITS, GREASE_MASK,
                            POST_QUANTUM_CURVES, PSEUDO_ORDER_CODES, SIGNATURE_NAMES,
                            VERSION_NAMES)


def _lookup(table: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def is_grease(value: Column) -> Column:
    return value.bitwiseAND(F.lit(GREASE_MASK)) == F.lit(GREASE_BITS)


def without_grease(seq: str) -> Column:
    return F.filter(F.col(seq), lambda v: ~is_grease(v))


def has_grease(seq: str) -> Column:
    return F.coalesce(F.exists(F.col(seq), is_grease), F.lit(False))


def grease_position(seq: str) -> Column:
    """Zero-based place of the first GREASE value, null without one."""
    at = F.array_position(F.transform(F.col(seq), is_grease), True)
    return (F.nullif(at, F.lit(0)) - 1).cast("int")


def ja4_fields(df: DataFrame, source: str = "ja4") -> DataFrame:
    """Nine parts of a JA4 string; all null when it does not have three sections."""
    parts = F.split(F.col(source), "_")
    ok = F.size(parts) == 3
    a = F.when(ok, F.get(parts, 0))
    long = F.length(a) >= 10

    def count(start: int) -> Column:
        digits = F.substring(a, start, 2)
        return F.when(long & digits.rlike("^[0-9]+$"), digits.try_cast("int"))

    return df.select(
        "*", a.alias("ja4_a"), F.when(ok, F.get(parts, 1)).alias("ja4_b"),
        F.when(ok, F.get(parts, 2)).alias("ja4_c"),
        F.when(long, F.substring(a, 1, 1)).alias("ja4_protocol"),
        F.when(long, F.substring(a, 2, 2)).alias("ja4_version"),
        F.when(long, F.substring(a, 4, 1)).alias("ja4_sni"),
        count(5).alias("ja4_cipher_count"), count(7).alias("ja4_ext_count"),
        F.when(long, F.substring(a, 9, 2)).alias("ja4_alpn_code"))


def h2_fingerprint_fields(df: DataFrame, source: str = "h2_fp") -> DataFrame:
    """Settings 1-6, window update, priority string and depth, pseudo-header order."""
    parts = F.split(F.col(source), r"\|")
    ok = F.size(parts) >= 2
    settings = F.when(ok, F.get(parts, 0))
    window = F.get(parts, 1)
    priority = F.when(ok, F.get(parts, 2))

    def setting(number: int) -> Column:
        # the leading greedy part makes the last pair of a repeated key win
        found = F.regexp_extract(settings, rf"^(?:.*;)?\s*{number}\s*:\s*(-?\d+)\s*(?:;.*)?$", 1)
        return found.try_cast("bigint")

    return df.select(
        "*", settings.alias("ak_settings_str"),
        F.when(ok & window.rlike("^[0-9]+$"), window.try_cast("bigint")).alias("ak_window_update"),
        priority.alias("ak_priority_str"), F.when(ok, F.get(parts, 3)).alias("ak_pseudo_order"),
        F.when(priority != "", F.size(F.split(priority, ","))).alias("ak_stream_count"),
        *[setting(i).alias(n) for i, n in enumerate(
            ("ak_header_table", "ak_enable_push", "ak_max_concurrent", "ak_init_window",
             "ak_max_frame", "ak_max_header_list"), start=1)])


def sequence_columns(seq: str, name: str, names: Mapping[int, str]) -> list[Column]:
    table = _lookup(names)
    labels = F.transform(without_grease(seq),
                         lambda v: F.coalesce(F.try_element_at(table, v), v.cast("string")))
    return [F.size(without_grease(seq)).alias(f"{name}_count"),
            has_grease(seq).alias(f"{name}_has_grease"),
            grease_position(seq).alias(f"{name}_grease_pos"),
            F.array_join(F.col(seq).cast("array<string>"), ",").alias(f"{name}_seq_str"),
            F.array_join(labels, "_").alias(f"{name}_no_grease_str")]


def sequence_features(df: DataFrame) -> DataFrame:
    """Count, GREASE flag and place, raw and named strings per offered list."""
    post_quantum = F.exists("curves", lambda v: v.isin(POST_QUANTUM_CURVES))
    return df.select("*", *sequence_columns("ciphers", "cipher", CIPHER_NAMES),
                     *sequence_columns("curves", "curve", CURVE_NAMES),
                     *sequence_columns("sigs", "sig", SIGNATURE_NAMES),
                     F.coalesce(post_quantum, F.lit(False)).alias("has_pq_crypto"))


def alpn_features(df: DataFrame) -> DataFrame:
    alpn, first, n = F.col("alpn"), F.get("alpn", 0), F.size("alpn")
    place = F.array_position(alpn, "h2")
    choice = (F.when((n == 1) & (first == "h2"), "h2_only").when(first == "h2", "h2_first")
              .when((n == 1) & (first == "http/1.1"), "http11_only")
              .when(first == "http/1.1", "http11_first")
              .when(n == 0, "none").otherwise("other"))
    return df.select(
        "*", F.array_join(alpn, ",").alias("alpn_offered_str"), first.alias("alpn_first"),
        n.alias("alpn_count"), F.array_contains(alpn, "h2").alias("alpn_has_h2"),
        F.array_contains(alpn, "http/1.1").alias("alpn_has_http11"),
        (F.nullif(place, F.lit(0)) - 1).cast("int").alias("alpn_h2_position"),
        choice.alias("alpn_preference"))


def tls_version_features(df: DataFrame) -> DataFrame:
    table = _lookup(VERSION_NAMES)
    real = without_grease("versions")
    names = F.transform(real, lambda v: F.coalesce(
        F.try_element_at(table, v), F.concat(F.lit("0x"), F.lpad(F.hex(v), 4, "0"))))
    profile = F.array_join(F.transform(names, lambda n: F.replace(n, F.lit(" "), F.lit(""))), "+")
    at13, at12 = F.array_position(real, 772), F.array_position(real, 771)
    return df.select(
        "*", F.array_join(F.col("versions").cast("array<string>"), ",").alias("supported_ver_str"),
        F.array_join(names, ",").alias("supported_ver_names"), F.size(real).alias("supported_ver_count"),
        has_grease("versions").alias("supported_ver_has_grease"),
        grease_position("versions").alias("supported_ver_grease_pos"),
        (at13 > 0).alias("supported_ver_has_tls13"), (at12 > 0).alias("supported_ver_has_tls12"),
        F.array_contains(real, 770).alias("supported_ver_has_tls11"),
        F.when(profile == "", "none").otherwise(profile).alias("supported_ver_profile"),
        F.when((at13 > 0) & (at12 > 0), at13 < at12).alias("supported_ver_13_before_12"))


def stream_weight(stream: int, source: str = "ak_priority_str") -> Column:
    """Priority weight given to one HTTP/2 stream, null when it is not listed."""
    found = F.regexp_extract(F.col(source), rf"(?:^|,)0*{int(stream)}:\d+:\d+:(\d+)", 1)
    return found.try_cast("double")


def pseudo_order_code(order: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(PSEUDO_ORDER_CODES), order), F.lit(-1))


def tls_signals(df: DataFrame) -> DataFrame:
    """Thirteen 0/1 signals and two stream weights over the parsed columns."""
    def bit(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    signals = {
        "has_kyber768": F.col("curve_no_grease_str").contains("Kyber768"),
        "has_mlkem768": F.col("curve_no_grease_str").contains("MLKEM"),
        "is_firefox_ja4": F.col("ja4_a").startswith("t13d2812"),
        "is_h2": F.col("negotiated_proto") == "h2",
        "has_pq": F.col("has_pq_crypto"),
        "win_is_firefox": F.col("ak_window_update") > 1_000_000_000,
        "is_ext16": F.col("ja4_ext_count") == 16,
        "is_ext17": F.col("ja4_ext_count") == 17,
        "is_ext12": F.col("ja4_ext_count") == 12,
        "is_cipher28": F.col("ja4_cipher_count") == 28,
        "grease_cipher": F.col("cipher_has_grease"),
        "grease_curve": F.col("curve_has_grease"),
        "grease_ver": F.col("supported_ver_has_grease"),
    }
    return df.select("*", *[bit(c).alias(n) for n, c in signals.items()],
                     stream_weight(3).alias("s3_weight"), stream_weight(5).alias("s5_weight"))


def fingerprint_features(df: DataFrame) -> DataFrame:
    """All fingerprint jobs over a request frame."""
    out = h2_fingerprint_fields(ja4_fields(df))
    return tls_signals(tls_version_features(alpn_features(sequence_features(out))))
