"""The registered queries of this subpackage and the SQL that some are held against."""

from loomgraph.llm.decontamination import op10_benchmark_decontamination
from loomgraph.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from loomgraph.llm.fingerprints import op3_document_fingerprints
from loomgraph.llm.html_text import op6_html_extraction
from loomgraph.llm.jaccard_join import op1_ngram_jaccard_join
from loomgraph.llm.language import op8_language_id
from loomgraph.llm.packing import op7_best_fit_packing
from loomgraph.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from loomgraph.llm.quality import op9_quality_classifier
from loomgraph.llm.sharding import op4_sharding
from loomgraph.llm.substring_dedup import OP13_SQL, op13_substring_dedup
from loomgraph.llm.token_counts import op2_token_counts
from loomgraph.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_substring_dedup": op13_substring_dedup,
}

#: The others learn, search or parse; tests hold them against brute force, held-out rows or planted cases.
ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
}
