"""From raw documents to token ids, stage by stage.

Each stage works on all that the stage before it kept, and its decisions take effect: texts in no learned language go,
one document of each near-duplicate group stays, documents that contain a benchmark item go, personal data
becomes its kind in brackets, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontam, langid, pii, sentencepiece, simhash
from heddle.llm.common import Scope, Stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language accounts for go; the languages are learned from the stage's own input."""
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.

    Groups are those of the SimHash query; of what they leave, copies with words changed here and there go by longer fingerprints.
    """
    return simhash.drop_near_copies(simhash.keep_one(docs.select(*COLUMNS)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    docs = docs.select(*COLUMNS)
    out = pii.redact_documents(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): each text's token ids, their digest and the digest of what they decode to.

    The last stage: the documents' other columns end here.
    """
    import public_tokenizers

    return sentencepiece.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can express neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage wrote on its way, and the result before it, are removed once its own result is there.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with Scope() as scope:
            now = scope.keep(Stored(stage(spark, docs, sf_dir)))
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
