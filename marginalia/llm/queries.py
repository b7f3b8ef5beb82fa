"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from marginalia.llm import ann, clustering, collocations, decontaminate, langid, line_dedup, lm, mixing, packing, quality, secrets, simhash, simple8b

QUERIES = {
    "op1_language_evidence": langid.op1_language_evidence,
    "op2_simple8b": simple8b.op2_simple8b,
    "op3_secret_formats": secrets.op3_secret_formats,
    "op4_bradley_terry": quality.op4_bradley_terry,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_multiprobe_ann": ann.op6_multiprobe_ann,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_context_mixing": lm.op10_context_mixing,
    "op11_weighted_fair_queueing": mixing.op11_weighted_fair_queueing,
    "op12_sharded_lloyd": clustering.op12_sharded_lloyd,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {
    "op5_decontamination": decontaminate.OP5_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_weighted_fair_queueing": mixing.OP11_SQL,
    "op12_sharded_lloyd": clustering.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
