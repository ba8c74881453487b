"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``, and any others, whatever
their names. Null and empty texts have no language and go in the first stage;
of repeated rows one stays in the second; long texts are taken whole; ties go
to the least id. An empty table gives an empty one, an empty benchmark leaves
texts as they are, and without labelled languages nothing passes the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import decontaminate, langid, neardup, packing, secrets, spans
from kelpline.llm.store import materialise, table

#: SQL can't express the stages (models, hashing, packing): tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model accepts go."""
    own, c = _apart(docs)
    found = langid.identify(own, langid.learn(own, id_col=c["doc_id"], text_col=c["text"], lang_col=c["lang"]), text_col=c["text"])
    return found.where(~F.col("rejected")).select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    own, c = _apart(docs)
    return neardup.deduplicated(own, id_col=c["doc_id"], text_col=c["text"]).select(*own.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    own, c = _apart(docs)
    found = decontaminate.scan(own, table(spark, sf_dir, "benchmark"), text_col=c["text"])
    text = decontaminate.without_spans(F.col(c["text"]), F.col("spans"))
    return _with_text(found, own.columns, c, text).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [SECRET]."""
    own, c = _apart(docs)
    found = secrets.scan(own, secrets.learn(own, id_col=c["doc_id"], text_col=c["text"]), text_col=c["text"])
    return _with_text(found, own.columns, c, spans.redacted(F.col(c["text"]), F.col("spans"), "[SECRET]")).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, in sequences of 2048 tokens."""
    return packing.pack(docs)


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns by number, which clash with no operator's, and the number of each name."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return own, dict(zip(docs.columns, own.columns, strict=True))


def _with_text(found: DataFrame, columns: list[str], c: dict[str, str], text) -> DataFrame:
    """The columns of documents with the new text, and its length where it changed."""
    new = found.withColumn("new_text", text)
    chars = F.when(F.size("spans") > 0, F.length("new_text").cast("long")).otherwise(F.col(c["n_chars"]))
    return new.withColumns({c["n_chars"]: chars, c["text"]: F.col("new_text")}).select(*columns)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
