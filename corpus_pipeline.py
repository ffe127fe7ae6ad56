"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again for the next one. All but the last keep the columns of documents.

- language: rows whose language can't be told (no text, or no letter in it) go; ambiguous ones stay.
- near_copies: of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles the one with the
  least doc_id stays; rows that repeat a doc_id and text count as one, and of texts that share a doc_id each is judged by
  itself; rows without a doc_id stay.
- passages: passages of 50 words and more that stand in a document of a smaller id are cut out; the document stays.
- pii: entities and the words that disclose them are generalised; every document stays.
- packing: documents become pieces of power-of-two lengths with their token ids.

Null and empty texts, ties, empty tables and further columns: see the operators; every stage accepts them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import jaccard_join, langid, packing, pii, substring_dedup
from tidewell.llm.common import Scratch, sweep, table, unused

#: A sequential, tokenizing last stage: SQL can't express it.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(langid.fold(F.col("doc_id"), 5) != 0))
    prefix = "stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    said = langid.predict(docs, model, prefix=prefix)
    return said.where(F.col(f"{prefix}lang_pred") != "und").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near-copies")
    mark, id_ = unused(docs, "mark", "id")
    classes = scratch.write(jaccard_join.jaccard_classes(docs), "classes").where("doc_id is not null").withColumnsRenamed({"doc_id": id_, "mark": mark})
    gone = classes.where(F.col("component_id") != F.col(id_)).select(id_, mark).distinct()
    twice = classes.groupBy(id_, mark).count().where("count > 1").select(id_, mark)
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).withColumn(id_, F.col("doc_id").cast("long"))
    kept = marked.join(gone, [id_, mark], "left_anti")
    once = kept.join(twice, [id_, mark], "left_anti")
    again = kept.join(twice, [id_, mark], "left_semi").dropDuplicates([id_, mark])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.removed(docs, substring_dedup.repeated(docs)))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitised(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        before = len(Scratch.live)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        sweep(before)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
