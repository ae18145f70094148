"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from reviewmill.llm import conversations, decontaminate, html_text, mixing, neighbours, pii, quality, sharding, simhash, suffixes, topk, warc, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash": simhash.op1_simhash,
    "op2_main_text": html_text.op2_main_text,
    "op3_nearest_codes": topk.op3_nearest_codes,
    "op4_warc": warc.op4_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_personal_data": pii.op6_personal_data,
    "op7_repeated_strings": suffixes.op7_repeated_strings,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality": quality.op9_quality,
    "op10_reshard": sharding.op10_reshard,
    "op11_whitening": whitening.op11_whitening,
    "op12_repair": conversations.op12_repair,
    "op13_neighbours": neighbours.op13_neighbours,
}
ORACLE = {"op5_decontaminate": decontaminate.OP5_SQL, "op8_mix_sources": mixing.OP8_SQL, "op12_repair": conversations.OP12_SQL}
