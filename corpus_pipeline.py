"""From raw documents to token files: five stages, one operator each.

Each stage gets the documents that the one before has written, and decides on its own input:

1. toxicity: documents predicted toxic go;
2. SimHash near-dedup: one document of each group stays;
3. benchmark decontamination: contaminated documents go;
4. mixing sources to target weights: each source's documents as often as its target says,
   each copy with its training time as ``position``;
5. token-ID output: documents become token files in the order of training, and the rows
   their index.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firstdue.llm import decontamination, mixing, simhash, tokens, toxicity
from firstdue.llm.queries import TOKENIZER
from firstdue.llm.registry import table
from firstdue.llm.store import stored
from firstdue.session import tune


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(tune(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(tune(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return mixing.mix_documents(docs, "position")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return tokens.token_corpus(docs, public_tokenizers.path(TOKENIZER), order="position")


STAGES = [
    ("toxicity", reject_toxic),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Nearest neighbours, fingerprints and token ids have no SQL.
ORACLE_SQL = None
