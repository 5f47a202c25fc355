"""What files are made of, without anything a person wrote: shapes of JSON documents, columns of tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import names, paths

from . import quality

#: Fixed value: objects and arrays at this depth are only named.
DEPTH = 2


def shape(value: Column, depth: int = 0) -> Column:
    """A VARIANT's skeleton as JSON: of an object its keys, in order of name, with their shapes; of an array its
    length and its first element's shape; of all else the kind. Two levels deep."""
    items, fields = F.try_variant_get(value, F.lit("$"), "array<variant>"), F.try_variant_get(value, F.lit("$"), "map<string,variant>")
    kind = F.schema_of_variant(value)
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    plain = F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    if depth >= DEPTH:
        return F.when(items.isNotNull(), quoted(F.lit("array("), F.size(items).cast("string"), F.lit(")"))).when(fields.isNotNull(), quoted(F.lit("object"))).otherwise(quoted(plain))
    listed = F.concat(F.lit('{"_array":'), F.size(items).cast("string"), F.lit(',"of":'), F.get(F.transform(F.slice(items, 1, 1), lambda v: shape(v, depth + 1)), F.lit(0)), F.lit("}"))
    key = lambda e: F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2)
    told = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.struct(k.alias("key"), F.element_at(fields, k).alias("v")))
    keyed = F.concat(F.lit("{"), F.array_join(F.transform(told, lambda e: F.concat(key(e), F.lit(":"), shape(e["v"], depth + 1))), ","), F.lit("}"))
    return F.when(F.size(items) == 0, quoted(F.lit("array(0)"))).when(items.isNotNull(), listed).when(fields.isNotNull(), keyed).otherwise(quoted(plain))


def json_shapes(files: DataFrame) -> DataFrame:
    """files(path, content): per masked path and shape the files and their characters; shape is null for what
    is no JSON."""
    doc = F.try_parse_json("content")
    read = files.select(names.mask_path(F.col("path")).alias("path"), F.when(doc.isNotNull(), shape(doc)).alias("shape"), F.length("content").alias("chars"))
    return read.groupBy("path", "shape").agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"))


def merged_schemas(files: DataFrame) -> DataFrame:
    """files(path, content): per masked path one schema that all its JSON documents fit, with the files read
    and those that are no JSON. Schemas merge before the shuffle; a key of several kinds is VARIANT."""
    doc = F.try_parse_json("content")
    return files.groupBy(names.mask_path(F.col("path")).alias("path")).agg(F.schema_of_variant_agg(doc).alias("schema"), F.count(doc).alias("files"), F.count_if(doc.isNull()).alias("unreadable"))


def table_shapes(rows: DataFrame) -> DataFrame:
    """rows(path, line, r) of CSV files: per masked path and column names the files and their rows below them."""
    per = rows.groupBy("path").agg(F.min_by("r", F.when(F.col("line") == 0, 0)).alias("columns"), (F.count(F.lit(1)) - 1).alias("n"))
    return per.groupBy(names.mask_path(F.col("path")).alias("path"), "columns").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows"))


def report(entries: DataFrame, files: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(part, body): a report of what an export is made of, a JSON object a row, that holds nothing that a person
    wrote: totals, endings, folders, and shapes of the documents and tables that are given (files(path,
    content), rows(path, line, r))."""
    ext = paths.extension(F.col("path"))
    whole = entries.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.array_sort(F.collect_set("method")).alias("methods"))
    endings = entries.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    parts = {"archive": whole, "ending": endings, "folder": quality.structure(entries)}
    if files is not None:
        parts |= {"document": json_shapes(files), "schema": merged_schemas(files)}
    if rows is not None:
        parts["table"] = table_shapes(rows)
    return functools.reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("body")) for name, df in parts.items()))
