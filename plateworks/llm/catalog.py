"""Queries of the numbered operators and of the pipeline, and their DuckDB counterparts."""

from __future__ import annotations

from . import audit, codes, decontaminate, langid, neardup, packing, pipeline, quality, simhash, sstable, topk, toxicity, warc, wordpiece

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_language": langid.op2_language,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": wordpiece.op5_token_counts,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_output": sstable.op10_token_output,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_codes": codes.op12_codes,
    "op13_simhash": simhash.op13_simhash,
    "pipeline": pipeline.run,
}

SQL = {"op1_topk": topk.OP1_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_codes": codes.OP12_SQL, "op6_warc": warc.OP6_SQL, "op8_near_duplicates": neardup.OP8_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
if pipeline.ORACLE_SQL:
    SQL["pipeline"] = pipeline.ORACLE_SQL
