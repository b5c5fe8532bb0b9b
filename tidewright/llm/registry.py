"""The registered queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.alignment import op13_alignment
from tidewright.llm.decontamination import op6_decontamination
from tidewright.llm.language_id import op3_language_id
from tidewright.llm.licenses import op10_license_scan, op10_sql
from tidewright.llm.line_dedup import op5_line_dedup
from tidewright.llm.mixing import op12_mixing, op12_sql
from tidewright.llm.packing import op8_packing
from tidewright.llm.quality import op2_quality
from tidewright.llm.quality_rules import op4_quality_rules
from tidewright.llm.ranked_search import op11_ranked_search, op11_sql
from tidewright.llm.repeats import op7_suffix_dedup
from tidewright.llm.simhash import op1_simhash
from tidewright.llm.toxicity import op9_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_language_id": op3_language_id,
        "op4_quality_rules": op4_quality_rules,
        "op5_line_dedup": op5_line_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_license_scan": op10_license_scan,
        "op11_ranked_search": op11_ranked_search,
        "op12_mixing": op12_mixing,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": op10_sql(), "op11_ranked_search": op11_sql(), "op12_mixing": op12_sql()}
