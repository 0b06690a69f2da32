"""A corpus pipeline over ``documents``: quality rules, near duplicates, personal data, mixing,
tokens.  Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns a DataFrame; all but the last return the columns that came in, the last the place in the mix too.

Null and empty texts fail the quality rules, so later stages don't see them when run in order; each
stage takes them all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._tables import freed, marked, written
from tessera.llm.jaccard import near_duplicates
from tessera.llm.mixing import mix_positions, mixed
from tessera.llm.pieces import encode_pieces
from tessera.llm.pii import redact_personal_data
from tessera.llm.queries import WEIGHTS
from tessera.llm.rules import keep, learn_rules

#: The mix, for the stage that orders and for the one that gives each row its place.
MIX = {"weights": WEIGHTS, "block_rows": 64, "seed": 17}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rules keep; the rules are learned from the labels of these rows."""
    return keep(docs, learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (five words, similarity of 0.8 or more) one row stays: of the least id, a null
    id being the last, then of the least hash of id and text.  Rows equal in id and text are one.
    Rows without words stay."""
    found = written(near_duplicates(docs, size=5, num=80, den=100).select("doc_id", "component_id", "component_key", "key"), "found")
    alone = F.when(F.col("component_key").isNull(), F.col("key"))
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = own.groupBy("component_key", alone.alias("alone")).agg(F.min("key").alias("key")).select("key", F.lit(True).alias("stays"))
    name = "key"
    while name in docs.columns:
        name += "_"
    # keys that go, or that repeat; only rows that may have one of them are dealt by key
    keys = found.groupBy("key").agg(F.count("*").alias("n")).join(first, "key", "left")
    open_ = written(keys.where("n > 1 or stays is null").select(F.col("key").alias(name), F.coalesce("stays", F.lit(False)).alias("__stays")), "open")
    freed(found)
    keyed = marked(docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))), name, open_, "__may")
    met = keyed.where("__may").join(open_, name, "left").where("__stays is null or __stays")
    # dealt by key for the join, rows are already where their repeats are
    return keyed.where("not __may").select(*docs.columns).union(met.dropDuplicates([name, "doc_id", "text"]).select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows."""
    out = redact_personal_data(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix: files follow it, and rows inside them."""
    return mixed(docs, **MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, n_chars, ids and whether they decode to the text.  Files are not read back in
    the order they were written in, so position (from 0, gapless), worked out anew from the
    ids and sources, is what says the place in the mix."""
    placed = mix_positions(docs.select("doc_id", "source", F.col("text").alias("body")), **MIX, keep=("body",))
    out = encode_pieces(placed, dropout=0.1, seed=29, text="body", keep=("position",))
    return out.select("doc_id", "position", "n_chars", "ids", (F.length("decoded") == F.col("n_chars")).alias("whole"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_copies), ("personal data", personal_data), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
