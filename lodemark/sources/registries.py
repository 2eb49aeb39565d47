"""Registries kept as whole JSON documents, as semi-structured values.

A file is one document: a record, a list of records, or an envelope
{"records": [...]}. Its canonical form has the keys of every object sorted at
every depth, no white space, and numbers in their shortest form, so two
documents that say the same have the same digest, whatever order a writer chose.
A document that is not JSON, or repeats a key, is refused with its name. Files
are read one a row, so a registry's size is bounded by its largest file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import SHOWN, DataError, allowed


def canonical(json: Column) -> Column:
    """The canonical form of JSON text; null for text that is none."""
    return F.to_json(F.try_parse_json(json))


def digest(json: Column) -> Column:
    """sha256 of the canonical form's bytes."""
    return F.sha2(canonical(json), 256)


def write_documents(documents: DataFrame, path: str) -> None:
    """One file for each row's JSON text (column document)."""
    documents.select("document").write.option("maxRecordsPerFile", 1).text(allowed(path))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).text(allowed(path), wholetext=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("_text"), F.try_parse_json("value").alias("_v"))


def _refuse(rows: DataFrame, why: str) -> None:
    bad = [r["file"] for r in rows.select("file").limit(SHOWN).collect()]
    if bad:
        raise DataError(f"{why}: {bad}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, record, sha256) of every record, in canonical form; lists and envelopes are taken apart."""
    docs = _documents(spark, path)
    _refuse(docs.filter(F.col("_v").isNull()), "not JSON")
    is_list = F.schema_of_variant("_v").startswith("ARRAY")
    inside = F.when(is_list, F.col("_v")).otherwise(F.coalesce(F.try_variant_get("_v", "$.records", "variant"), F.parse_json(F.concat(F.lit("["), F.to_json("_v"), F.lit("]")))))
    each = docs.select("file", inside.alias("_list")).lateralJoin(spark.tvf.variant_explode(F.col("_list").outer()))
    record = F.to_json("value")
    return each.select("file", "pos", record.alias("record"), F.sha2(record, 256).alias("sha256"))


def conflicts(records: DataFrame, key: str) -> DataFrame:
    """Ids that stand for records of different content, with how many there are; key is a path like $.id."""
    named = records.select(F.try_variant_get(F.parse_json("record"), key, "string").alias("id"), "sha256")
    return named.groupBy("id").agg(F.countDistinct("sha256").alias("contents")).filter("contents > 1")


def sealed(payload: Column) -> Column:
    """A document that carries its payload's digest."""
    return F.concat(F.lit('{"checksum":"'), digest(payload), F.lit('","payload":'), canonical(payload), F.lit("}"))


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """(file, payload) of sealed documents; one whose payload has another digest than it says refuses the read."""
    docs = _documents(spark, path)
    _refuse(docs.filter(F.col("_v").isNull()), "not JSON")
    got = docs.select("file", F.to_json(F.try_variant_get("_v", "$.payload", "variant")).alias("payload"), F.try_variant_get("_v", "$.checksum", "string").alias("_sum"))
    _refuse(got.filter(~F.col("_sum").eqNullSafe(F.sha2("payload", 256))), "checksums differ")
    return got.select("file", "payload")


def new_parameters(expanded: DataFrame, seen: DataFrame, json: str) -> DataFrame:
    """Rows of expanded whose parameters are new: the first of each canonical form (by column order), unless seen has it."""
    known = seen.select(canonical(F.col(json)).alias("_c")).distinct()
    first = expanded.withColumn("_c", canonical(F.col(json))).groupBy("_c").agg(F.min_by(F.struct(*expanded.columns), F.struct(*expanded.columns)).alias("_v"))
    return first.join(known, "_c", "left_anti").select("_v.*")
