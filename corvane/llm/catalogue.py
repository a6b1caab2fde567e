"""op1 to op10 over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .chat import format_conversations
from .common import documents
from .html_text import extract
from .neighbours import search_embeddings
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality_classifier import classify_documents
from .quality_rules import quality_rules
from .sharding import shard_documents
from .sql import SQL  # noqa: F401
from .token_files import token_files
from .word_bpe import encode_documents

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": lambda s, d: ngram_join(s, documents(s, d)),
    "op2_packing": lambda s, d: pack_documents(documents(s, d), BYTE_BPE),
    "op3_quality_rules": lambda s, d: quality_rules(documents(s, d)),
    "op4_quality_classifier": lambda s, d: classify_documents(documents(s, d), _table(s, d, "labels")),
    "op5_sharding": lambda s, d: shard_documents(documents(s, d)),
    "op6_token_ids": lambda s, d: token_files(s, documents(s, d), BYTE_BPE),
    "op7_bpe": lambda s, d: encode_documents(documents(s, d), WORD_BPE),
    "op8_chat": lambda s, d: format_conversations(s, _table(s, d, "conversations")),
    "op9_ann": lambda s, d: search_embeddings(_table(s, d, "embeddings")),
    "op10_html": lambda s, d: extract(_table(s, d, "pages")),
}
