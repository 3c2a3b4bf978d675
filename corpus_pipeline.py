"""A training corpus from raw documents: quality, near duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again as the next one's docs. All but the last return the columns of docs,
whatever columns there are beside doc_id, text and source.

In every stage, each row is judged by its own text. A null or empty text has no words, so the quality
rules drop it; in later stages it is linked with nothing, has no secrets, isn't taken by the mix and
has no tokens. A null id counts like any other, but comes last where the smallest id stays. Repeated
rows and rows that share an id are documents of their own; of copies one stays. A null source is a
source of its own. Texts of any length are read whole. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, mixing, quality, queries, secret_scan
from plumbline.llm.shared import materialise, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    out = unused(docs, "quality")
    return quality.with_quality(docs, out=out).where(F.col(out)["kept"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets (private keys always) replaced by their kind in brackets; n_chars follows the text."""
    return secret_scan.without_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None, always=("key",))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, as op1 returns them."""
    return queries.encoded(spark, docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither the join nor the tokens; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
