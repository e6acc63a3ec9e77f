"""The registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm.attribution import op4_token_counts
from pagequarry.llm.bpe import op8_bpe
from pagequarry.llm.decontaminate import OP9_SQL, op9_decontaminate
from pagequarry.llm.license_scan import op10_license_scan
from pagequarry.llm.near_dedup import op1_near_dedup
from pagequarry.llm.phrases import OP11_SQL, op11_phrases
from pagequarry.llm.quality_rules import op2_quality_rules
from pagequarry.llm.secret_scan import op7_secret_scan
from pagequarry.llm.spelling import op13_spelling
from pagequarry.llm.substrings import OP12_SQL, op12_substrings
from pagequarry.llm.toxicity import op5_toxicity
from pagequarry.llm.url_filters import OP3_SQL, op3_url_filters
from pagequarry.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_bpe": op8_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_license_scan": op10_license_scan,
    "op11_phrases": op11_phrases,
    "op12_substrings": op12_substrings,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op3_url_filters": OP3_SQL, "op6_warc": OP6_SQL, "op9_decontaminate": OP9_SQL, "op11_phrases": OP11_SQL, "op12_substrings": OP12_SQL}
