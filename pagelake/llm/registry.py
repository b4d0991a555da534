"""The queries of this subpackage by name, and their DuckDB counterparts where SQL expresses them."""

import corpus_pipeline

from . import decontaminate, hard_negatives, hnsw, jaccard_join, lexical_rank, licences, mixing, packing, pii, quality, secrets, suffixes, toxicity

QUERIES = {
    "op1_hnsw_neighbours": hnsw.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_pii_pseudonyms": pii.op3,
    "op4_licence_scan": licences.op4,
    "op5_ngram_jaccard_join": jaccard_join.op5,
    "op6_quality_line_field": quality.op6,
    "op7_suffix_merge_dedup": suffixes.op7,
    "op8_secret_scan": secrets.op8,
    "op9_toxicity_string_kernel": toxicity.op9,
    "op10_source_mixing": mixing.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_bag_ranking": lexical_rank.op12,
    "op13_window_packing": packing.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op8_secret_scan": secrets.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_bag_ranking": lexical_rank.OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
