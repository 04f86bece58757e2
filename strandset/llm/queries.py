"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from . import byte_bpe, decontaminate, jaccard_join, licenses, line_dedup, media, quality, sharding, suffix_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality": quality.op7_quality,
    "op8_hilbert_shards": sharding.op8_hilbert_shards,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_media": media.op10_media,
}


def sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.sql(), "op2_decontamination": decontaminate.sql(), "op6_license_scan": licenses.sql()}
