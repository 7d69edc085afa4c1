"""Corpus preparation: toxic and unidentifiable documents go, near copies merge, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import discard, materialize, ship
from panelweave.llm.jaccard import JaccardJoin, jaccard_components
from panelweave.llm.language import fit_language, language_column
from panelweave.llm.packing import Capacity, pack_documents
from panelweave.llm.pii import learn_contexts, redact_column
from panelweave.llm.toxicity import fit_toxicity, toxicity_column

#: A document at or above this toxicity goes; one whose language is less sure than this goes.
TOXIC, UNSURE = 0.3, 0.4
NEAR = JaccardJoin(words=5, percent=80)


def _new_name(docs: DataFrame, wish: str) -> str:
    """A column name that `docs` doesn't have."""
    have = {c.lower() for c in docs.columns}
    while wish in have:
        wish += "_"
    return wish


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity is below TOXIC, the score of a text without words being the model's bias.

    Null text counts as empty. Rows are judged each: null and repeated ids stay as they are. Without
    labels, or on an empty table, nothing goes.
    """
    ship(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _new_name(docs, "toxicity")
    return docs.withColumn(name, toxicity_column(model, F.col("text"), spark)).where(F.col(name) < TOXIC).drop(name)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found: und and probabilities below UNSURE go.

    Null or empty text is und; so is everything where no row has a label to learn from. Rows are
    judged each, whatever their ids; an empty table stays empty.
    """
    ship(spark)
    name = _new_name(docs, "language")
    found = docs.withColumn(name, language_column(fit_language(docs), F.col("text"), spark))
    return found.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= UNSURE)).drop(name)


def merge_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of links; documents without words all stay.

    A null id counts as the largest. Of rows that repeat a kept document's id and set of shingles one
    stays, that of the smallest hash of its text. An empty table stays empty.
    """
    ship(spark)
    last = F.lit((1 << 63) - 1)
    doc, text = _new_name(docs, "kept_id"), _new_name(docs, "text_hash")
    found = jaccard_components(docs, NEAR)
    heads = found.where("set_key = head_key AND doc_id <=> component_id").groupBy(F.coalesce("doc_id", last).alias(doc), "set_key").agg(F.min("text_hash").alias(text))
    wordless = found.where("set_key IS NULL").select(F.coalesce("doc_id", last).alias(doc), F.col("text_hash").alias(text)).distinct()
    named = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), last)).withColumn(text, F.xxhash64(F.col("text").cast("string")))
    kept = named.join(heads.select(doc, text).distinct(), [doc, text], "left_semi").dropDuplicates([doc, text])
    empty = named.join(wordless, [doc, text], "left_semi")
    return kept.unionByName(empty).select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind; n_chars follows the text where both are there.

    Null text stays null, as does a null n_chars; ids aren't looked at, an empty table stays empty.
    """
    ship(spark)
    clean = docs.withColumn("text", redact_column(learn_contexts(docs), F.col("text"), spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids: a row per piece. Null text: the end id alone; repeated and null ids are documents of their own.

    Workers that have served the stages before keep a smaller cache of words here.
    """
    import public_tokenizers

    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=Capacity(tokens=4096), cache=28 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", identify_languages),
    ("near_copies", merge_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained models have no SQL equivalent; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the pieces are a table by now
    return packed
