"""Explain large text corpora with a few readable yes/no predicates, on Spark."""

from .operators.embedders import BatchEmbedder, ColumnEmbedder, Embedder, HashedBowEmbedder, OneHotEmbedder
from .operators.proposers import PromptProposer, Proposer, TokenProposer
from .operators.scorers import (
    BatchScorer,
    Committer,
    FirstMatchCommitter,
    PromptCommitter,
    PromptScorer,
    Scorer,
    SimilarityJudge,
    TokenScorer,
)
from .plans.experiments import run_experiments
from .plans.explain import explain_clusters, explain_labels, explain_trend
from .plans.models import ClassificationModel, ClusteringModel, Explanation, Model, Reference, TimeSeriesModel
from .session import get_spark, materialise
from .sources.caches import EmbeddingCache, VerdictCache

__all__ = [
    "BatchEmbedder",
    "BatchScorer",
    "ClassificationModel",
    "ClusteringModel",
    "ColumnEmbedder",
    "Committer",
    "Embedder",
    "EmbeddingCache",
    "Explanation",
    "FirstMatchCommitter",
    "HashedBowEmbedder",
    "Model",
    "OneHotEmbedder",
    "PromptCommitter",
    "PromptProposer",
    "PromptScorer",
    "Proposer",
    "Reference",
    "Scorer",
    "SimilarityJudge",
    "TimeSeriesModel",
    "TokenProposer",
    "TokenScorer",
    "VerdictCache",
    "explain_clusters",
    "explain_labels",
    "explain_trend",
    "get_spark",
    "materialise",
    "run_experiments",
]
