"""The corpus pipeline's stages: each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

All but the last return the columns of documents. Defined cases are those of the operators; what a stage adds to them
is said in its docstring. Columns of docs beyond the known ones are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm import best_fit_packing, decontamination, language_id, line_dedup, ngram_join
from resonant.llm.common import free_name, materialize, table
from resonant.llm.queries import tokenizer_paths

#: Bits by which eight bits a byte must beat the best language's code, for the text to be in no learned language. Short texts
#: can't show that much, so they stay.
EVIDENCE_BITS = 64.0


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that the best language predicts clearly worse than chance; others get the
    predicted language if they have none. Where no language can be learned, all documents with a letter stay as they are."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = tuple(free_name(docs, x) for x in ("lid_lang", "lid_score", "lid_bits"))
    found = language_id.predict(docs, model, keep=tuple(docs.columns), names=names)
    excess = (F.col(names[2]) - 8.0) * F.octet_length("text")
    kept = found.where((F.col(names[0]) != language_id.UNDETERMINED) & (excess < EVIDENCE_BITS))
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(*_all(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are boilerplate on the document's source; n_chars follows the text. No document goes."""
    cleaned = line_dedup.apply_to(docs, counts=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*_all(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates: of those with the smallest id any one, and one without an id only
    where no row has one. Repeated rows and rows that share an id are told apart by a key of their own. Documents without words
    are linked with nothing and stay."""
    name = free_name(docs, "row_key")
    tagged = materialize(docs.withColumn(name, F.monotonically_increasing_id()))
    keys = tagged.select(F.col(name).alias("key"), "doc_id")
    linked = ngram_join.link_components(tagged.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = linked.join(keys, F.col("row") == F.col("key"))
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    return tagged.join(first.select(F.col("first.key").alias("kept_key")), F.col(name) == F.col("kept_key"), "left_semi").select(*_all(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that contain a test item."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return best_fit_packing.pack(docs, *tokenizer_paths())
