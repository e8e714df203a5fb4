"""A corpus pipeline over documents: stages that each apply one operator of fragspark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of documents. Documents that the classifier rejects go; of each group of near
duplicates (word 5-shingles, Jaccard similarity 0.8 or more) the smallest id stays;
repeated strings of more than 50 words, or of 400 bytes, go from the texts; documents are repeated or cut as the
mix takes them; and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragspark import ship
from fragspark.llm import op2_suffix_dedup, op3_mixing, op4_classifier, op6_jaccard_join, op10_packing
from fragspark.llm.entries import vocabulary_path
from fragspark.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier scores 0.5 or more, repeated ones each for itself; null and empty texts are scored like others. An empty table stays empty."""
    ship(spark)
    forest = op4_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op4_classifier.classify(docs, forest, carry=docs.columns).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id. Rows that share that id stay once for each text; rows without an id, with or without text, all stay."""
    ship(spark)
    found = op6_jaccard_join.jaccard_components(docs, width=5, percent=80)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(0)))
    kept = docs.join(stay, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    kept = kept.withColumn("once", once).where("once = 1").select("row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Passages of more words than these go; the shortest, of words of one byte with a blank between, has 2 * 51 - 1 bytes.
PASSAGE_WORDS = 50


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of more than 50 words, and those of 400 bytes or more, out of the texts. Every row stays; a null text stays null, and a text that goes whole is empty."""
    ship(spark)
    # the text travels once: what is left of it takes its place
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = op2_suffix_dedup.suffix_dedup(docs, length=2 * PASSAGE_WORDS + 1, carry=carry, words=PASSAGE_WORDS)
    left = {"text": F.col("kept_text"), "n_chars": F.coalesce(F.length("kept_text"), F.lit(0)).cast("bigint")}
    return found.select(*[left.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats a document as often as the mix takes all its words; what it takes beyond that is a row with the first words, a blank between. Texts without words are never taken."""
    ship(spark)
    key = ["_id", "_key"]
    taken = op3_mixing.mix(docs, with_key=True).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "size", "taken")
    taken = taken.groupBy(*key).agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), op3_mixing.row_key().alias("_place"))
    both = rows.join(taken, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_place") == F.col("_key"))).where("_taken > 0")
    # rows that are the same share what was taken of them
    nth = F.row_number().over(Window.partitionBy("_doc", "_place").orderBy(F.lit(0)))
    both = both.withColumn("_nth", nth).withColumn("_own", F.expr("_taken div _rows + if(_nth <= _taken % _rows, 1, 0)"))
    both = both.withColumn("_copy", F.explode(F.expr("sequence(1, _own div _size + if(_own % _size > 0, 1, 0))")))
    whole = F.expr("_copy <= _own div _size")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(op3_mixing.WORD), F.lit(0)), 1, F.expr("cast(_own % _size as int)")), " ")
    both = both.where("_own > 0").withColumn("_text", F.when(whole, F.col("row.text")).otherwise(first))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens; null and empty texts are packed as the end id alone, repeated rows and rows without an id each for itself."""
    ship(spark)
    return op10_packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
