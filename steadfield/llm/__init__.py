"""Training-data operators: deduplication, tokenisation, extraction, scoring, mixing and vector search.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. QUERIES and ORACLE hold the query of each operator
and its SQL, where SQL can express it.
"""

from . import bag_minhash, byte_bpe, exact_dedup, hnsw, html_wrappers, language, line_dedup, mixing, quality, resampling, spelling, suffix_dedup, token_files

QUERIES = {
    "op1_hnsw": hnsw.query,
    "op2_bag_minhash": bag_minhash.query,
    "op3_line_dedup": line_dedup.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_token_files": token_files.query,
    "op6_html_wrappers": html_wrappers.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_mixing": mixing.query,
    "op10_quality": quality.query,
    "op9_exact_dedup": exact_dedup.query,
    "op11_anagram_variants": spelling.query,
    "op12_output_codes": language.query,
    "op13_importance_resampling": resampling.query,
}

ORACLE = {
    "op3_line_dedup": line_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_anagram_variants": spelling.SQL,
    "op13_importance_resampling": resampling.SQL,
}
