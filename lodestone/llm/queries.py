"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm.collocations import op13_collocations
from lodestone.llm.collocations import oracle as collocations_oracle
from lodestone.llm.decontam import op2_decontamination
from lodestone.llm.exact_dedup import op12_exact_dedup
from lodestone.llm.exact_dedup import oracle as exact_oracle
from lodestone.llm.fill_middle import op11_fill_middle
from lodestone.llm.fill_middle import oracle as fill_middle_oracle
from lodestone.llm.html_text import op4_html_extraction
from lodestone.llm.line_dedup import op6_line_dedup
from lodestone.llm.mixing import op5_mixing
from lodestone.llm.mixing import oracle as mixing_oracle
from lodestone.llm.near_dedup import op1_minhash_near_dedup
from lodestone.llm.pii import op9_pii
from lodestone.llm.quality import op7_quality_rules
from lodestone.llm.sharding import op10_extendible_sharding
from lodestone.llm.sharding import oracle as sharding_oracle
from lodestone.llm.substrings import op8_substring_dedup
from lodestone.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_extendible_sharding": op10_extendible_sharding,
    "op11_fill_middle": op11_fill_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op5_mixing": mixing_oracle(), "op10_extendible_sharding": sharding_oracle(), "op11_fill_middle": fill_middle_oracle(), "op12_exact_dedup": exact_oracle(), "op13_collocations": collocations_oracle()}
