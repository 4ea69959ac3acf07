"""Queries of this subpackage, one for each operator, with oracle SQL where SQL can express it."""

from keyloom.llm import byte_bpe, chat_format, decontaminate, html_extract, jaccard_join, license_scan, quality_model, quality_rules, secret_scan, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_quality_model": quality_model.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_license_scan": license_scan.query,
    "op5_chat_format": chat_format.query,
    "op6_html_extract": html_extract.query,
    "op7_secret_scan": secret_scan.query,
    "op8_warc": warc.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_quality_rules": quality_rules.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op5_chat_format": chat_format.ORACLE_SQL,
    "op7_secret_scan": secret_scan.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
}
