"""The corpus pipeline: quality rules, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the docs of the next one. All stages but the last return the columns of documents, in
their order; extra columns go along. Nulls, empty texts, repeated rows and empty tables are treated
as each operator's module says: a null or empty text fails the quality rules.
"""

from __future__ import annotations

from traitscope.llm.common import prepare, read
from traitscope.llm.exact_dedup import drop_copies
from traitscope.llm.near_copies import drop_near_copies
from traitscope.llm.packing import pack
from traitscope.llm.quality_rules import keep_documents
from traitscope.llm.queries import vocabulary
from traitscope.llm.substring_dedup import remove_passages
from traitscope.session import materialise


def quality(spark, docs, sf_dir):
    """Documents that the adaptive quality rules keep."""
    prepare(spark)
    return keep_documents(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts the one with the largest doc_id."""
    prepare(spark)
    return drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of texts linked by close fingerprints or similar shingles the one with the smallest doc_id."""
    prepare(spark)
    return drop_near_copies(docs)


def passages(spark, docs, sf_dir):
    """Texts without the passages that an earlier document has; texts left empty go."""
    prepare(spark)
    return remove_passages(docs)


def packing(spark, docs, sf_dir):
    """Pieces of the texts' token ids, packed into sequences of 1024."""
    prepare(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("substring dedup", passages),
    ("best-fit packing", packing),
]

#: SQL has neither the fingerprints nor the packing; tests/llm tests the stages one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
