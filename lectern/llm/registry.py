"""The queries of this subpackage, by name."""

from lectern.llm import bpe, chat_format, decontaminate, filter_audit, hard_negatives, minhash_dedup, pii, quality_rules, secrets, simhash_dedup, suffix_dedup, superkmer_dedup, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_superkmer_dedup": superkmer_dedup.op5_superkmer_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_bpe": bpe.op10_bpe,
    "op11_simhash_dedup": simhash_dedup.op11_simhash_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
