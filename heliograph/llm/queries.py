"""The queries of the training-data operators and the SQL of those that SQL can express."""

from heliograph.llm.bpe import op10_bpe
from heliograph.llm import ball_kmeans, decontam, fm_dedup, lexical_search, preference, suffix_dedup
from heliograph.llm.language import op5_language
from heliograph.llm.pii import op3_pii
from heliograph.llm.quality import op7_quality
from heliograph.llm.simhash import op4_simhash
from heliograph.llm.token_rollup import op6_token_rollup
from heliograph.llm.token_store import op9_token_store

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_preference": preference.op2_preference,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_token_rollup": op6_token_rollup,
    "op7_quality": op7_quality,
    "op8_decontam": decontam.op8_decontam,
    "op9_token_store": op9_token_store,
    "op10_bpe": op10_bpe,
    "op11_ball_kmeans": ball_kmeans.op11_ball_kmeans,
    "op12_fm_dedup": fm_dedup.op12_fm_dedup,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op2_preference": preference.ORACLE_SQL,
    "op8_decontam": decontam.ORACLE_SQL,
    "op11_ball_kmeans": ball_kmeans.ORACLE_SQL,
    "op12_fm_dedup": fm_dedup.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
