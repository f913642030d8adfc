"""The queries of this package and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op10_bpe
from tidemark.llm.clustering import op12_clustering
from tidemark.llm.decontamination import op2_decontamination
from tidemark.llm.extraction import op5_extraction
from tidemark.llm.licenses import op8_licenses
from tidemark.llm.mixing import op13_mixing
from tidemark.llm.near_duplicates import op4_near_duplicates
from tidemark.llm.neighbours import op7_neighbours
from tidemark.llm.oracle import ORACLE as ORACLE
from tidemark.llm.quality import op3_quality
from tidemark.llm.secrets import op6_secrets
from tidemark.llm.spelling import op11_spelling
from tidemark.llm.substrings import op1_substrings
from tidemark.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substrings, op2_decontamination, op3_quality, op4_near_duplicates, op5_extraction, op6_secrets, op7_neighbours,
    op8_licenses, op9_toxicity, op10_bpe, op11_spelling, op12_clustering,
    op13_mixing)}
