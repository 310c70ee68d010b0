"""The registered query of each operator, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import ann, bpe, decontaminate, language_id, license_scan, line_dedup, near_dedup, quality, spelling, token_files, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_quality": quality.op4_quality,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_bpe": bpe.op6_bpe,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_ann": ann.op8_ann,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_spelling": spelling.op11_spelling,
        "op12_whitening": whitening.op12_whitening,
        "op13_token_files": token_files.op13_token_files,
        # The columns of op10_license_scan that SQL can say, held against SQL.
        "license_base_phrases": license_scan.license_base_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op7_url_filter": url_filter.ORACLE, "op8_ann": ann.ORACLE, "op11_spelling": spelling.ORACLE, "license_base_phrases": license_scan.BASE_ORACLE}
