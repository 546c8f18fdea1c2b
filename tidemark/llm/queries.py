"""Registry of the corpus queries and of the SQL that checks them."""

from __future__ import annotations

from tidemark.llm.decontaminate import op9_decontaminate
from tidemark.llm.licenses import op7_licenses
from tidemark.llm.merkle import op11_merkle_manifest
from tidemark.llm.mixing import op4_mixing
from tidemark.llm.ngram_join import op3_ngram_join
from tidemark.llm.oracles import ORACLE_SQL  # noqa: F401
from tidemark.llm.pii import op5_pii
from tidemark.llm.preferences import op1_preferences
from tidemark.llm.quality_rules import op8_quality_rules
from tidemark.llm.repair import op13_conversation_repair
from tidemark.llm.suffix_dedup import op2_suffix_dedup
from tidemark.llm.token_files import op10_token_files
from tidemark.llm.warc import op12_warc_bundles
from tidemark.llm.window_dedup import op6_window_dedup

QUERIES = {
    "op1_preferences": op1_preferences,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_window_dedup": op6_window_dedup,
    "op7_licenses": op7_licenses,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc_bundles": op12_warc_bundles,
    "op13_conversation_repair": op13_conversation_repair,
}
