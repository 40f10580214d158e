"""A corpus from raw documents: toxic ones go, near and exact copies go, benchmark passages go, sources are mixed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.llm.deobfuscate import toxicity
from phasemill.llm.odd_sketch import near_duplicates
from phasemill.llm.pfair import mixed
from phasemill.llm.positional_index import contamination
from phasemill.llm.run_length_index import repeated_bytes
from phasemill.llm.shared import settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tuned(spark: SparkSession) -> None:
    """Texts are long, so fewer rows at a time go between Spark and Python; the session stays so, for stages run when their result is read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def _numbered(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text, _whole): written rows with a number each; _whole holds all columns, whatever their names."""
    rows = settled(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")), "rows")
    return rows.select("_row", F.col("_whole.doc_id").alias("doc_id"), F.col("_whole.text").alias("text"), "_whole")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model doesn't predict to be toxic, each by its own text.

    Null and empty texts are scored as texts without words, rows without doc_id or with a repeated
    one are judged one by one, repeated rows alike. Extra columns stay. No rows give no rows.
    """
    _tuned(spark)
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    return toxicity(whole, _table(spark, sf_dir, "labels"), carry=("_whole",)).filter("predicted = 0").select("_whole.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; rows without doc_id come after all others, rows of one doc_id in any order.

    Null, empty and blank texts are copies of nothing and stay. Of a row given twice one stays.
    Extra columns stay. No rows give no rows.
    """
    _tuned(spark)
    rows = _numbered(docs)
    filled = F.coalesce("doc_id", F.lit("0").cast(docs.schema["doc_id"].dataType))
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), filled.alias("doc_id"), "_row").alias("_key"), "text")
    gone = near_duplicates(keyed, key="_key").filter(~F.col("kept")).select(F.col("_key._row").alias("_gone"))
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_whole.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that an earlier place holds too; rows without doc_id come after all others, in order of a hash.

    A null text stays null, an empty one empty; n_chars is that of what is left. Of a row given
    twice neither is the earlier. Extra columns stay. No rows give no rows.
    """
    _tuned(spark)
    late = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), late).alias("_key"), "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("_rest"))
    found = repeated_bytes(keyed, key="_key", carry=("_rest",))
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*(made[c].alias(c) if c in made else F.col(f"_rest.`{c}`") for c in docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no more benchmark text than the rule allows, each by its own text.

    Null and empty texts hold none and stay, and so does every row where the benchmark is empty;
    rows without doc_id or with a repeated one are judged one by one, repeated rows alike. Extra
    columns stay. No rows give no rows.
    """
    _tuned(spark)
    rows = _numbered(docs)
    gone = contamination(rows, _table(spark, sf_dir, "benchmark"), key="_row").filter("contaminated").select(F.col("_row").alias("_gone"))
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_whole.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix: in order of slot, offset.

    Null is a source of its own, null and empty texts and repeated rows have places too. A column of
    documents with the name of one of the mix's (n_bytes, block, slot, offset, release, deadline) is
    called documents_<name>. No rows give no rows.
    """
    _tuned(spark)
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    placed = mixed(whole, carry=("_whole",))
    made = [c for c in placed.columns if c not in ("doc_id", "source", "_whole")]
    return placed.select(*(F.col(f"_whole.`{c}`").alias(f"documents_{c}" if c in made else c) for c in docs.columns), *made)


STAGES = [("toxicity", toxic), ("near_dedup", near), ("repeated_bytes", repeats), ("decontamination", benchmark), ("mixing", mix)]

#: The toxicity stage is a fitted model, so SQL has no rows for run(); tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each settled before the next."""
    docs = _table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = settled(docs, f"stage-{name}")
    return docs
