"""The operators of this package as registered queries over whole tables, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markset.llm.collocations import OP12_SQL, op12_collocations
from markset.llm.decontaminate import OP11_SQL, op11_decontaminate
from markset.llm.disclosure import op1_pii
from markset.llm.jaccard import OP5_SQL, op5_jaccard_join
from markset.llm.language import op4_language_id
from markset.llm.line_quality import op7_quality_rules
from markset.llm.mixing import op9_mix_sources
from markset.llm.neighbours import op3_nearest_neighbours
from markset.llm.packing import op2_best_fit_packing
from markset.llm.periods import op13_periodic_runs
from markset.llm.ranking import op10_quality_classifier
from markset.llm.records import op8_binary_records
from markset.llm.transducer import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_best_fit_packing, op3_nearest_neighbours, op4_language_id, op5_jaccard_join, op6_token_counts, op7_quality_rules, op8_binary_records, op9_mix_sources,
                              op10_quality_classifier, op11_decontaminate, op12_collocations, op13_periodic_runs)
}

ORACLES: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op11_decontaminate": OP11_SQL, "op12_collocations": OP12_SQL}
