"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .html import op2_html_extraction
from .importance import OP12_SQL, op12_target_resampling
from .language import op8_language_id
from .lines import op5_line_dedup
from .mixing import OP10_SQL, op10_mixing
from .near_duplicates import OP6_SQL, op6_minhash_near_dedup
from .periodic import OP13_SQL, op13_periodic_runs
from .quality import op9_quality_rules
from .secrets import op1_secret_scans
from .substrings import op3_substring_dedup
from .tokens import op11_token_output
from .toxicity import op4_toxicity

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_token_output": op11_token_output,
    "op12_target_resampling": op12_target_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op6_minhash_near_dedup": OP6_SQL,
    "op10_mixing": OP10_SQL,
    "op12_target_resampling": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
