"""Queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from cargolens.llm import decontaminate, fm_dedup, hard_negatives, jaccard_join, license_scan, media, mixing, piece_codec, quality_crf, suffix_dedup, token_counts, warc, whitening


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op2_jaccard_join": jaccard_join.digest_query,
        "op3_quality_crf": quality_crf.digest_query,
        "op4_suffix_dedup": suffix_dedup.digest_query,
        "op5_media_columns": media.digest_query,
        "op6_source_mixing": mixing.query,
        "op7_fm_dedup": fm_dedup.digest_query,
        "op8_token_counts": token_counts.digest_query,
        "op9_decontaminate": decontaminate.digest_query,
        "op10_arc_to_warc": warc.digest_query,
        "op11_whitening": whitening.digest_query,
        "op12_piece_codec": piece_codec.digest_query,
        "op13_hard_negatives": hard_negatives.digest_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_decontaminate": decontaminate.ORACLE_SQL, "op10_arc_to_warc": warc.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
