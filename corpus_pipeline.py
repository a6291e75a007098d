"""From raw documents to token ids, in five stages.

1. quality rules: documents that fail them go;
2. near-duplicates: one document of each component stays;
3. personal data: found data and terms that disclose it are replaced;
4. mixing: each source's documents are repeated or left out to meet its target;
5. tokens: whole texts are encoded.

Each stage works on all that the one before kept; results are written as
Parquet in the shared folder in between, so a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portloom.llm import mixing, pieces, pii, quality, simhash
from portloom.llm.common import stored, table

#: The vocabulary file that the last stage encodes with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the least id."""
    return simhash.thinned(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sanitised."""
    return pii.cleaned(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, up to three."""
    return mixing.replicated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and round_trip of each document of the mix."""
    return pieces.encoded(docs, PIECE_MODEL, ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: SQL has no search over pieces and no fingerprints; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
