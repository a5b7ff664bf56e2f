"""A corpus pipeline over ``documents``: quality, near duplicates, repeated passages, mixing, packing.

Every row is a document of its own, also where its doc_id is null or repeats. A key ``row``, made once
before the first stage, follows the order of the ids, nulls last; decisions are mapped back by it. A null text is an empty one: the classifier judges it, it
is no one's copy, and the other stages keep it. An empty table gives an empty one at every stage. Columns beside ``COLUMNS`` are left out, whatever their
names. How long texts are borne the operators state.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.mixing import mixed
from segmentry.llm.near_dup import near_duplicates
from segmentry.llm.packing import pack_documents
from segmentry.llm.quality import quality_scores
from segmentry.llm.queries import RANKS
from segmentry.llm.substring_dedup import remove_repeats
from segmentry.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """``COLUMNS`` and ``row``, which is made here if a stage before hasn't."""
    if "row" in docs.columns:
        return docs
    ordered = docs.select(*COLUMNS).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*COLUMNS[1:]))
    return stored(ordered.withColumn("row", F.monotonically_increasing_id()), "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, each by its own text, also if others of its id are rejected."""
    docs = keyed(docs)
    verdicts = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col="row")
    return docs.join(verdicts.where("predicted = 1").select("row"), "row", "left_semi").select(*COLUMNS, "row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates: five words, similarity 0.8; one row where ids repeat."""
    docs = keyed(docs)
    kept = near_duplicates(docs, words=5, percent=80, id_col="row").where("kept").select("row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS, "row")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier row has; white space and texts without repeats stay as they are, a text of which nothing is left is gone.

    Rows that repeat an id, or have none, are documents of their own here too.
    """
    docs = keyed(docs)
    changed = remove_repeats(docs, window=50, seed=20, spaced=True, id_col="row").where("n_removed > 0").select("row", "kept_text")
    text = F.coalesce("kept_text", "text")
    out = docs.join(changed, "row", "left").where("kept_text is null or kept_text <> ''")
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, "row")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once, and those of smaller sources again up to the mixture's weights; the key repeats with its uses."""
    docs = keyed(docs)
    uses = mixed(docs, id_col="row").select("row")
    return docs.join(uses, "row").select(*COLUMNS, "row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, null and repeated ids too, with their places in sequences of 2,048 tokens."""
    return pack_documents(docs, RANKS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
