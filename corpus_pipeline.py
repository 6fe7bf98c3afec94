"""A corpus pipeline over documents: toxicity, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, mixing, simhash, toxicity
from pagewright.session import drop_table, write_table


def _free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted to ``labels``, does not flag as toxic.

    Null and empty texts are scored like any other; rows are kept or dropped one by one, so
    repeated rows stay repeated. Without labels of both kinds, or for no documents, nothing goes.
    """
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free_name(docs, "scores")
    return toxicity.with_scores(docs, chain, name).where(~F.col(f"{name}.toxic")).drop(name)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest id, null ids last.

    Rows are known by id and text together, so an id that stands with several texts, or no
    id, keeps no row that its component has not chosen. Only rows that are repeated in both
    are compared by text, so other texts are moved once.
    """
    k1, k2 = F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(F.lit(simhash.SEED), docs["doc_id"], docs["text"])
    found = write_table(simhash.fingerprints(docs, k1.alias("k1"), k2.alias("k2")), "fingerprints")
    roots = simhash.rooted(found)
    rows = found.groupBy("fp", "doc_id", "k1", "k2").agg(F.count("*").alias("rows")).join(roots.select("fp", "root"), "fp")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "rows")).alias("x"))
    kept = write_table(first.select("x.k1", "x.k2", "x.rows"), "kept")
    drop_table(found, roots)
    chosen = lambda of: docs.join(of, (k1 == of["k1"]) & (k2 == of["k2"]), "left_semi")
    return chosen(kept.where("rows = 1")).unionByName(chosen(kept.where("rows > 1")).dropDuplicates(["doc_id", "text"]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, its size times at most 3.

    Null is a source of its own; null and blank texts have no words and are taken no time.
    Repeated rows count each. Reruns take the same documents.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the byte-level BPE ids, digest of the decoded bytes, and whether they are the text's.

    A row for each row: null text counts as empty, null ids and repeated rows stay.
    """
    return bpe.encode_decode(docs)


STAGES = [("toxicity", toxic_out), ("simhash near-dedup", near_duplicates_out), ("mixing", mixed), ("byte-level BPE", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, "stage-" + name.replace(" ", "-"))
    return docs


#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None
