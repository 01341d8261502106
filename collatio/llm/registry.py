"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, delta_lloyd, kneser_ney, language_id, license_scan, line_frequency, merkle_manifest, mixing, mpeg_audio, secret_links, simhash, token_counts, warc_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
        "op3_pfair_mixing": mixing.op3_pfair_mixing,
        "op4_simhash": simhash.op4_simhash,
        "op5_mpeg_audio": mpeg_audio.op5_mpeg_audio,
        "op6_secret_links": secret_links.op6_secret_links,
        "op7_language_id": language_id.op7_language_id,
        "op8_warc_store": warc_store.op8_warc_store,
        "op9_kneser_ney": kneser_ney.op9_kneser_ney,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
        "op12_delta_lloyd": delta_lloyd.op12_delta_lloyd,
        "op13_line_frequency": line_frequency.op13_line_frequency,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": decontaminate.OP2_SQL,
        "op3_pfair_mixing": mixing.op3_sql(),
        "op6_secret_links": secret_links.op6_sql(),
        "op8_warc_store": warc_store.OP8_SQL,
        "op11_merkle_manifest": merkle_manifest.op11_sql(),
        "op12_delta_lloyd": delta_lloyd.op12_sql(),
        "op13_line_frequency": line_frequency.OP13_SQL,
    }
