"""The operators as queries over whole tables: name -> fn(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traitscope.llm.chat_format import chat_format
from traitscope.llm.common import read
from traitscope.llm.conversation_repair import conversation_repair
from traitscope.llm.exact_dedup import exact_dedup
from traitscope.llm.licenses import scan_licenses
from traitscope.llm.lm_scoring import score_texts
from traitscope.llm.packing import pack
from traitscope.llm.phrases import phrase_collocations
from traitscope.llm.quality_rules import quality_rules
from traitscope.llm.sentencepiece_codec import sentencepiece_code
from traitscope.llm.simhash import simhash_components
from traitscope.llm.substring_dedup import repeated_passages
from traitscope.llm.toxicity import toxicity
from traitscope.llm.warc import archive_pages

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_lm_scoring(spark, folder):
    return score_texts(read(spark, folder, "documents"))


@query
def op2_best_fit_packing(spark, folder):
    return pack(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op3_warc(spark, folder):
    return archive_pages(read(spark, folder, "pages"))


@query
def op4_substring_dedup(spark, folder):
    return repeated_passages(read(spark, folder, "documents"))


@query
def op5_quality_rules(spark, folder):
    return quality_rules(read(spark, folder, "documents"))


@query
def op6_license_scan(spark, folder):
    return scan_licenses(read(spark, folder, "documents"))


@query
def op7_sentencepiece(spark, folder):
    return sentencepiece_code(read(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op8_exact_dedup(spark, folder):
    return exact_dedup(read(spark, folder, "documents"))


@query
def op9_simhash(spark, folder):
    return simhash_components(read(spark, folder, "documents"))


@query
def op10_toxicity(spark, folder):
    return toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op11_conversation_repair(spark, folder):
    return conversation_repair(read(spark, folder, "conversations"))


@query
def op12_phrases(spark, folder):
    return phrase_collocations(read(spark, folder, "documents"))


@query
def op13_chat_format(spark, folder):
    return chat_format(read(spark, folder, "conversations"))
