"""The queries of this package, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from rootspan.llm import ann, byte_bpe, decontaminate, language, licenses, lines, near_dup, quality, secrets, token_files

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_token_output": token_files.query,
    "op3_quality": quality.query,
    "op4_nearest": ann.query,
    "op5_near_dup": near_dup.query,
    "op6_license_scan": licenses.query,
    "op7_language_id": language.query,
    "op8_secret_scan": secrets.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_line_dedup": lines.query,
}
SQL = {
    "op10_line_dedup": lines.SQL,
}
