"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, bpe, chat, decontaminate, jaccard, langid, lm, marked, phrases, quality, secrets, sharding, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_bpe": bpe.op4_bpe,
    "op5_chat": chat.op5_chat,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "sharding_contents": sharding.sharding_contents,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op8_proximity": decontaminate.op8_proximity,
    "op9_language_id": langid.op9_language_id,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_collocations": phrases.op12_collocations,
    "op13_sentencepiece": marked.op13_sentencepiece,
}

SQL = {**quality.SQL, **jaccard.SQL, **chat.SQL, **warc.SQL, **sharding.SQL, **decontaminate.SQL, **audit.SQL, **phrases.SQL}
