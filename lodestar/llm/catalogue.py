"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestar.llm import decontamination, language_id, license_scan, line_dedup, multiset_hash, packing, quality, simhash, suffix_dedup, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_document_fingerprint": multiset_hash.op7_document_fingerprint,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {
    "op2_license_scan": license_scan.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op9_warc": warc.ORACLE,
}
