"""The numbered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from . import (
    decontamination, filter_audit, fingerprints, hmm, html_extraction, line_dedup, mixing, quality_classifier, quality_rules, secrets, simhash,
    token_counts, vector_codes,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_hmm_scores": hmm.op8_hmm_scores,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_secrets": secrets.op10_secrets,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op10_secrets": secrets.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_fingerprints": fingerprints.SQL,
}
