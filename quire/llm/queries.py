"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm import (
    q_decontaminate, q_embeddings, q_html_text, q_minhash, q_packing, q_periodic_runs, q_quality, q_substrings,
    q_token_files, q_toxicity, q_url_filter, q_warc, q_whitening)

QUERIES = {
    "op1_url_filter": q_url_filter.op1_url_filter,
    "op2_decontaminate": q_decontaminate.op2_decontaminate,
    "op3_toxicity": q_toxicity.op3_toxicity,
    "op4_minhash": q_minhash.op4_minhash,
    "op5_token_files": q_token_files.op5_token_files,
    "op6_embeddings": q_embeddings.op6_embeddings,
    "op7_html_text": q_html_text.op7_html_text,
    "op8_substrings": q_substrings.op8_substrings,
    "op9_packing": q_packing.op9_packing,
    "op10_warc": q_warc.op10_warc,
    "op11_periodic_runs": q_periodic_runs.op11_periodic_runs,
    "op12_whitening": q_whitening.op12_whitening,
    "op13_quality": q_quality.op13_quality,
}

ORACLE = {
    "op1_url_filter": q_url_filter.ORACLE,
    "op2_decontaminate": q_decontaminate.ORACLE,
    "op4_minhash": q_minhash.ORACLE,
    "op6_embeddings": q_embeddings.ORACLE,
    "op8_substrings": q_substrings.ORACLE,
    "op10_warc": q_warc.ORACLE,
    "op11_periodic_runs": q_periodic_runs.ORACLE,
}
