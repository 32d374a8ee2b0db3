"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from langmix.llm import (classlm, decontaminate, exact, jaccard, mixing, neighbours, phrases, quality, repair, runs, sharding, suffixes,
                         toxicity)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_class_lm": classlm.op6_class_lm,
    "op7_phrase_dedup": phrases.op7_phrase_dedup,
    "op8_quality": quality.op8_quality,
    "op9_sorted_passes": neighbours.op9_sorted_passes,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op9_sorted_passes": neighbours.ORACLE,
    "op10_jaccard_join": jaccard.ORACLE,
    "op11_structure_repair": repair.ORACLE,
    "op12_exact_dedup": exact.ORACLE,
    "op13_periodic_runs": runs.ORACLE,
}
