"""Documents to training tokens: toxicity, near duplicates, repeated passages, mixing of sources, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navprep.llm import bpe, mixing, near_dup, substring, toxicity
from navprep.llm._store import sized, stored

#: SQL can express neither learned scores nor tokens.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels, scores below one half; those without an id or text are kept."""
    docs = _documents(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = docs.mapInArrow(toxicity.keeper(spark.sparkContext.broadcast(model)), docs.schema)
    return judged


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near duplicates: five-word shingles, similarity 0.8."""
    docs = _documents(docs)
    out = near_dup.near_duplicates(docs, k=5, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct()
    gone = stored(out, "pipeline-near")
    return docs.join(sized(gone), "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document of smaller id holds; texts that lose nothing stay as they are, a text that loses all becomes empty."""
    docs = _documents(docs)
    shape, ids, cuts = substring.repeats(docs.where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit(""))))
    copies = shape.where(F.col("copy") & (F.col("n_words") >= substring.WINDOW)).select("doc_id")
    copies = stored(copies, "pipeline-copies")
    whole = docs.join(sized(ids), "doc_id", "left_anti").join(sized(copies), "doc_id", "left_anti")
    emptied = docs.join(sized(copies), "doc_id", "left_semi").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long"))
    lost = F.col("n_removed") > 0
    new = cuts.withColumn("n_chars", F.when(lost, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")).withColumn("text", F.when(lost, F.col("kept_text")).otherwise(F.col("text")))
    return whole.select(*COLUMNS).unionByName(new.select(*COLUMNS)).unionByName(emptied.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for: no row, or up to three."""
    docs = _documents(docs)
    plan = mixing.mix(docs).where("doc_id is not null and copies <> 1").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    times = F.coalesce(F.col("copies"), F.lit(1)).cast("int")
    both = docs.join(sized(stored(plan, "pipeline-mix")), "doc_id", "left")
    return both.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each row."""
    import public_tokenizers

    # workers hold other stages' memory, too
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), pieces=60_000, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
