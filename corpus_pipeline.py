"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result is written as Parquet and read
again. All but the last return the columns of documents.

In every stage an empty table gives no rows, a very long text is taken whole, rows are judged one by one where doc_ids repeat, and
columns besides doc_id, text and n_chars are handed on as they are, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, jaccard, packing, quality, secrets
from tessella.llm.common import new_path, stored, table
from tessella.llm.tokens import default_vocabulary

#: SQL can't express the tokenizer, nor this hash-based scoring.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go.

    A null, empty or blank text has fewer than ten words and goes. A row with a null doc_id is judged like any other.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id.

    Rows without words or with a null doc_id all stay. Of rows equal in doc_id and text one stays; another text under the same
    doc_id is judged by itself.
    """
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two benchmark items or more go; of the others the spans that a benchmark item has are cut out.

    A null text stays null, and n_chars follows the text. Repeated rows all stay. Without a benchmark nothing changes.
    """
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    A null text stays null, and n_chars follows the text. Repeated rows all stay.
    """
    return secrets.redacted(docs, new_path(spark, "ledger"))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 1024 ids.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null doc_id stays null. Only the
    pieces' columns come out.
    """
    return packing.pack(docs, partial(packing._encode, default_vocabulary()))


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("harmonic_packing", harmonic_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
