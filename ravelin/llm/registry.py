"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from ravelin.llm import bpe, decontaminate, language, matroska, pii, secrets, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_language": language.op1,
    "op2_simhash": simhash.op2,
    "op3_toxicity": toxicity.op3,
    "op4_matroska": matroska.op4,
    "op5_bpe": bpe.op5,
    "op6_pii": pii.op6,
    "op7_token_counts": token_counts.op7,
    "op8_secrets": secrets.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_warc": warc.op10,
}

ORACLE_SQL = {
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}
