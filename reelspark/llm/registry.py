"""The queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

import corpus_pipeline
from reelspark.llm import queries as q

#: Query name: (function of the session and the tables' folder, DuckDB SQL or None).
ALL = {
    "op1_chat_formatting": (q.op1_chat_formatting, q.OP1_SQL),
    "op2_document_fingerprints": (q.op2_document_fingerprints, None),
    "op3_url_filters": (q.op3_url_filters, q.OP3_SQL),
    "op4_mix_sources": (q.op4_mix_sources, q.OP4_SQL),
    "op5_secret_scans": (q.op5_secret_scans, q.OP5_SQL),
    "op6_jaccard_join": (q.op6_jaccard_join, q.OP6_SQL),
    "op7_language_id": (q.op7_language_id, None),
    "op8_toxicity": (q.op8_toxicity, None),
    "op9_pii": (q.op9_pii, q.OP9_SQL),
    "op10_benchmark_decontamination": (q.op10_benchmark_decontamination, None),
    "op11_merkle_manifest": (q.op11_merkle_manifest, q.OP11_SQL),
    "op12_conversation_repair": (q.op12_conversation_repair, q.OP12_SQL),
    "op13_token_files": (q.op13_token_files, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
