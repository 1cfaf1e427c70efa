"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tilework.llm import line_dedup
from tilework.llm.chat_format import op2_chat_format
from tilework.llm.html_extract import op10_html_extract
from tilework.llm.jaccard_join import op6_jaccard_join
from tilework.llm.mixing import op1_mixing
from tilework.llm.nearest import op7_nearest
from tilework.llm.periodic_runs import op13_periodic_runs
from tilework.llm.quality_rules import op5_quality_rules
from tilework.llm.sentencepieces import op3_sentencepieces
from tilework.llm.simhash import op11_simhash
from tilework.llm.suffix_dedup import op8_suffix_dedup
from tilework.llm.url_filter import op9_url_filter
from tilework.llm.whitening import op12_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_sentencepieces": op3_sentencepieces,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_nearest": op7_nearest,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op4_line_dedup": line_dedup.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
