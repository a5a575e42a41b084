"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from ontoloom.llm.decontaminate import op2_decontamination
from ontoloom.llm.divergence import OP11_SQL, op11_source_divergence
from ontoloom.llm.html_model import op8_html_extraction
from ontoloom.llm.licences import OP5_SQL, op5_licence_scan
from ontoloom.llm.line_dedup import OP3_SQL, op3_line_dedup
from ontoloom.llm.merkle import OP13_SQL, op13_merkle_manifest
from ontoloom.llm.minhash import op9_minhash_near_dedup
from ontoloom.llm.packing import op7_best_fit_packing
from ontoloom.llm.quality import op6_quality_rules
from ontoloom.llm.sharding import op4_sampled_splitters
from ontoloom.llm.token_counts import op12_token_counts
from ontoloom.llm.token_file import op10_token_orc
from ontoloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_sampled_splitters": op4_sampled_splitters,
    "op5_licence_scan": op5_licence_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_token_orc": op10_token_orc,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_licence_scan": OP5_SQL, "op11_source_divergence": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
