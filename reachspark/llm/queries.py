"""Registered queries of this subpackage, with their SQL where SQL can state them."""

from __future__ import annotations

from . import audit, chat, decontaminate, licenses, mixing, neighbours, quality, simhash, spelling, substring, suffixes, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_chat": chat.op5_chat,
    "op6_quality": quality.op6_quality,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_licenses": licenses.op9_licenses,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

# Classifiers (1, 6) and XXH64 fingerprints (8) can't be stated in SQL.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_chat": chat.OP5_SQL,
    "op7_substring_dedup": substring.OP7_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op10_neighbours": neighbours.OP10_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_suffix_dedup": suffixes.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
