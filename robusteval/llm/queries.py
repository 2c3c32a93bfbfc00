"""The registered queries of this subpackage; ``pipeline`` is registered beside them."""

from __future__ import annotations

from robusteval.llm import infilling, ranking
from robusteval.llm.bpe import op4_bpe
from robusteval.llm.duckbpe import op13_duckdb_bpe
from robusteval.llm.infilling import op11_lookaround_infilling
from robusteval.llm.langid import op10_naive_bayes_langid
from robusteval.llm.licenses import op5_license_scan
from robusteval.llm.mixing import op9_entropy_mix
from robusteval.llm.quality import op1_mcd_quality
from robusteval.llm.ranking import op12_tiered_search
from robusteval.llm.sharding import op7_jump_sharding
from robusteval.llm.simhash import op3_simhash
from robusteval.llm.toxicity import op2_lexicon_toxicity
from robusteval.llm.vectorjoin import op6_vector_range_join
from robusteval.llm.wavelet import op8_wavelet_tokens

QUERIES = {
    "op1_mcd_quality": op1_mcd_quality,
    "op2_lexicon_toxicity": op2_lexicon_toxicity,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_vector_range_join": op6_vector_range_join,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_entropy_mix": op9_entropy_mix,
    "op10_naive_bayes_langid": op10_naive_bayes_langid,
    "op11_lookaround_infilling": op11_lookaround_infilling,
    "op12_tiered_search": op12_tiered_search,
    "op13_duckdb_bpe": op13_duckdb_bpe,
}

#: The others can't be expressed in SQL: see tests/llm.
ORACLES: dict[str, str] = {"op11_lookaround_infilling": infilling.ORACLE_SQL, "op12_tiered_search": ranking.ORACLE_SQL}
