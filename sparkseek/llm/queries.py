"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from sparkseek.llm.ann import op8_balanced_posting_lists
from sparkseek.llm.chat import OP6_SQL, op6_chat_formatting
from sparkseek.llm.decontam import OP5_SQL, op5_benchmark_decontamination
from sparkseek.llm.langid import op9_language_id
from sparkseek.llm.mixing import op4_mixing_to_target_weights
from sparkseek.llm.pii import op2_personal_data
from sparkseek.llm.secret_scan import OP1_SQL, op1_secret_scan
from sparkseek.llm.sharding import op3_sharding
from sparkseek.llm.simhash import op10_simhash_near_dedup
from sparkseek.llm.toxicity import op7_toxicity


def queries() -> dict:
    found = (
        op1_secret_scan, op2_personal_data, op3_sharding, op4_mixing_to_target_weights, op5_benchmark_decontamination,
        op6_chat_formatting, op7_toxicity, op8_balanced_posting_lists, op9_language_id, op10_simhash_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1_SQL, "op5_benchmark_decontamination": OP5_SQL, "op6_chat_formatting": OP6_SQL}
