"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from kindred.llm.bpe import op8_bpe
from kindred.llm.chat_format import OP5_SQL, op5_chat_format
from kindred.llm.decontaminate import op7_decontaminate
from kindred.llm.jaccard_join import op9_jaccard_join
from kindred.llm.quality import op2_quality
from kindred.llm.quality_rules import OP3_SQL, op3_quality_rules
from kindred.llm.sharding import op6_sharding
from kindred.llm.substring_dedup import op10_substring_dedup
from kindred.llm.token_files import op4_token_files
from kindred.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_quality_rules, op4_token_files, op5_chat_format, op6_sharding, op7_decontaminate, op8_bpe, op9_jaccard_join, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op5_chat_format": OP5_SQL}
