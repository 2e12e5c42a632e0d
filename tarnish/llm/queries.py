"""The registered queries of the dealt operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnish.llm.op1_packing import op1_packing
from tarnish.llm.op2_mixing import op2_mixing
from tarnish.llm.op3_quality_classifier import op3_quality_classifier
from tarnish.llm.op4_lattice_dedup import op4_lattice_dedup
from tarnish.llm.op5_sentencepiece import op5_sentencepiece
from tarnish.llm.op6_page_differencing import op6_page_differencing
from tarnish.llm.op7_bagminhash import op7_bagminhash
from tarnish.llm.op8_suffix_dedup import op8_suffix_dedup
from tarnish.llm.op9_substring_dedup import op9_substring_dedup
from tarnish.llm.op10_quality_rules import op10_quality_rules
from tarnish.llm.op11_whitening import op11_whitening
from tarnish.llm.op12_imatch import op12_imatch
from tarnish.llm.op13_alignment import op13_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lattice_dedup": op4_lattice_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_page_differencing": op6_page_differencing,
    "op7_bagminhash": op7_bagminhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_imatch": op12_imatch,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {}
