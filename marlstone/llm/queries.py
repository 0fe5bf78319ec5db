"""Registered queries of the corpus operators, and DuckDB SQL where SQL can give their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11
from .conversation_trie import OP13_SQL, op13
from .decontamination import OP8_SQL, op8
from .fingerprints import op4
from .jaccard_join import OP7_SQL, op7
from .language import op10
from .mixing import OP9_SQL, op9
from .pieces import op12
from .quality import op3
from .secrets import op6
from .sharding import op5
from .token_files import op1
from .warc import OP2_SQL, op2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1,
    "op2_warc": op2,
    "op3_quality": op3,
    "op4_fingerprints": op4,
    "op5_sharding": op5,
    "op6_secrets": op6,
    "op7_jaccard_join": op7,
    "op8_decontamination": op8,
    "op9_mixing": op9,
    "op10_language_id": op10,
    "op11_collocations": op11,
    "op12_sentencepiece": op12,
    "op13_conversation_trie": op13,
}
ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
