"""Source catalogue: nested JSON contexts to two flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import fixed

_ELEMENT = (
    "document_id string, source_element_key string, source_record_sha256 string, element_id string, id_occurrence_count int, "
    "id_uniqueness string, parent_element_id string, ancestor_element_ids array<string>, source_path string, document_order int, "
    "element_kind string, el_type string, widget_type string, architecture_kind string, editor_label string"
)
CONTEXT_SCHEMA = (
    "context_id string, documents array<struct<document_id: string, document_type: string, document_fingerprint: string, "
    f"elements: array<struct<{', '.join(p.replace(' ', ': ', 1) for p in _ELEMENT.split(', '))}>>>>, _corrupt_record string"
)


def read_source_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, elements, corrupt) of JSON-lines contexts; the schema is fixed, never inferred.

    A context, or one of its documents, may be spread over several records.
    """
    rows = spark.read.schema(CONTEXT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    documents = rows.filter("context_id IS NOT NULL").select("context_id", F.explode("documents").alias("d"))
    elements = documents.select("context_id", F.col("d.document_id").alias("parent_document_id"), F.explode("d.elements").alias("e"))
    corrupt = rows.filter("context_id IS NULL").select("_corrupt_record")
    return (
        documents.select("context_id", "d.document_id", "d.document_type", "d.document_fingerprint"),
        elements.select("context_id", "parent_document_id", "e.*"),
        corrupt,
    )


def context_bounds_summary(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Documents and elements per context against the published limits."""
    counted = documents.groupBy("context_id").agg(F.countDistinct("document_id").alias("n_documents"))
    sized = elements.groupBy("context_id").agg(F.count("*").alias("n_elements"))
    out = counted.join(sized, "context_id", "left").withColumn("n_elements", F.coalesce("n_elements", F.lit(0)))
    return out.withColumns({
        "too_many_documents": F.col("n_documents") > fixed.MAX_CONTEXT_DOCUMENTS,
        "too_many_elements": F.col("n_elements") > fixed.MAX_CONTEXT_ELEMENTS,
    })
