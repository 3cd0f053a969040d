"""The training-data queries and, where SQL can express them, their equivalents."""

from tessera.llm import decontaminate, licenses, lines, ngram_join, packing, quality, rules, shards, suffix_dedup, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_interleaved_shards": shards.op2_interleaved_shards,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_pack_ffd": packing.op5_pack_ffd,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_quality_qda": quality.op7_quality_qda,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_interleaved_shards": shards.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
}
