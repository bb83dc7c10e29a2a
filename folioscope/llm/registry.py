"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscope.llm.op1_decontamination import op1_decontamination
from folioscope.llm.op2_secrets import op2_secrets
from folioscope.llm.op3_substrings import op3_substrings
from folioscope.llm.op4_near_dedup import op4_near_dedup
from folioscope.llm.op5_urls import op5_urls
from folioscope.llm.op6_packing import op6_packing
from folioscope.llm.op7_quality_rules import op7_quality_rules
from folioscope.llm.op8_suffixes import op8_suffixes
from folioscope.llm.op9_quality import op9_quality
from folioscope.llm.op10_pii import op10_pii
from folioscope.llm.op11_runs import op11_runs
from folioscope.llm.op12_fill_in_middle import ORACLE_SQL as OP12_SQL
from folioscope.llm.op12_fill_in_middle import op12_fill_in_middle
from folioscope.llm.op13_embedding_near_dedup import ORACLE_SQL as OP13_SQL
from folioscope.llm.op13_embedding_near_dedup import op13_embedding_near_dedup


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_decontamination, op2_secrets, op3_substrings, op4_near_dedup, op5_urls, op6_packing,
        op7_quality_rules, op8_suffixes, op9_quality, op10_pii, op11_runs,
        op12_fill_in_middle, op13_embedding_near_dedup)}


def oracles() -> dict[str, str]:
    return {"op12_fill_in_middle": OP12_SQL, "op13_embedding_near_dedup": OP13_SQL}
