"""The star schema of coded paragraphs: building, checks, lookups, exports, nested documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Primary keys and references of the four tables.
KEYS = {"municipalities": ("id",), "coding_types": ("id",), "paragraphs": ("id",), "paragraph_codings": ("id",)}
UNIQUE = {"municipalities": ("name",), "coding_types": ("code",), "paragraph_codings": ("paragraph_id", "coding_type_id")}
INDEXES = (("paragraphs", "municipality_id"), ("paragraph_codings", "paragraph_id"), ("paragraph_codings", "coding_type_id"))
REFERENCES = (("paragraphs", "municipality_id", "municipalities"), ("paragraph_codings", "paragraph_id", "paragraphs"), ("paragraph_codings", "coding_type_id", "coding_types"))


def resolve(rows: DataFrame, names: DataFrame, name: str, id_as: str) -> DataFrame:
    """Names become ids by an inner join: rows without a match go.  names: (id, name)."""
    return rows.join(names.select(F.col("id").alias(id_as), F.col("name").alias(name)), name).drop(name)


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join with the first row of each key."""
    others = [c for c in right.columns if c not in keys]
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_m"))
    return left.join(first, keys, "left").select(*left.columns, *[F.col(f"_m.`{c}`").alias(c) for c in others])


def enrich(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Base rows with the updates' columns; updates without a base row are ignored."""
    return base.join(updates, key, "left")


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows that are there stay; new keys come in once."""
    return existing.unionByName(new.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def codes_of(paragraphs: DataFrame, codings: DataFrame, types: DataFrame) -> DataFrame:
    """Paragraphs with the sorted array of their codes, empty without any."""
    named = codings.join(types.select(F.col("id").alias("coding_type_id"), "code"), "coding_type_id").groupBy(F.col("paragraph_id").alias("id")).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return paragraphs.join(named, "id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def codings_of(paragraph_id: int, codings: DataFrame, types: DataFrame) -> DataFrame:
    """(coding_type_id, code) of one paragraph, in order of codes."""
    own = codings.filter(F.col("paragraph_id") == paragraph_id).select("coding_type_id")
    return own.join(types.select(F.col("id").alias("coding_type_id"), "code"), "coding_type_id").orderBy("code")


def having_all(rows: DataFrame, selected: list[str], codes: str = "codes") -> DataFrame:
    """Rows that have every selected code; a null array has none."""
    return rows.filter(F.coalesce(F.size(F.array_except(F.array(*[F.lit(c) for c in selected]).cast("array<string>"), F.col(codes))) == 0, F.lit(not selected)))


def code_id(types: DataFrame, code: str | int) -> int:
    """Id of a code by name or id; an unknown one is an error."""
    found = types.filter((F.col("id") == code) if isinstance(code, int) else (F.col("code") == code)).select("id").head()
    if found is None:
        raise KeyError(f"no such code: {code}")
    return found["id"]


def export_by_code(paragraphs: DataFrame, codings: DataFrame, municipalities: DataFrame, coding_id: int, columns: list[str]) -> DataFrame:
    """Paragraphs with one code, municipality names where known, sorted by both; columns from a white list."""
    allowed = {"id", "h5", "year", "category", "dan_number", "text", "municipality"}
    if set(columns) - allowed:
        raise ValueError(f"columns not allowed: {sorted(set(columns) - allowed)}")
    rows = paragraphs.join(codings.filter(F.col("coding_type_id") == coding_id).select(F.col("paragraph_id").alias("id")), "id")
    named = rows.join(municipalities.select(F.col("id").alias("municipality_id"), F.col("name").alias("municipality")), "municipality_id", "left")
    return named.orderBy(F.asc_nulls_first("municipality"), "id").select(*columns)


def info_map(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """One map from key to a struct of the other columns (for each ``by``)."""
    others = [c for c in rows.columns if c not in [key, *(by or [])]]
    return rows.groupBy(*(by or [])).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.struct(*others))))).alias("info"))


def nested(**parts: DataFrame) -> str:
    """Small result tables as one JSON document: lists of rows by name."""
    import json

    return json.dumps({k: [json.loads(r) for r in df.toJSON().collect()] for k, df in parts.items()}, ensure_ascii=False)


def nested_documents(paragraphs: DataFrame, by: str) -> DataFrame:
    """(by, document): each group's rows as one JSON list, in order of their columns; groups are written where they are made."""
    rows = paragraphs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in paragraphs.columns if c != by]))).alias("rows"))
    return rows.select(by, F.to_json("rows").alias("document"))


def edited(documents: DataFrame, key: str, field: str, changes: DataFrame, stamp: Column) -> DataFrame:
    """A new snapshot in which (key, value) changes replace a field; the old value is kept with a time stamp.

    A change of a key that no document has, and two changes of one key, end the job with an error.
    """
    once = changes.groupBy(key).agg(F.first("value").alias("_value"), F.count("*").alias("_n"))
    new = once.select(F.col(key).alias("_key"), F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("changed twice: "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("_value")).alias("_new"))
    hit = documents.withColumn("_there", F.lit(True)).join(new, F.col(key) == F.col("_key"), "full")
    known = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such document: "), F.col("_key").cast("string"))).cast("boolean"))
    changed = F.col("_key").isNotNull()
    out = hit.filter(known).withColumn("previous", F.when(changed, F.col(field))).withColumn("edited_at", F.when(changed, stamp))
    return out.withColumn(field, F.when(changed, F.col("_new")).otherwise(F.col(field))).drop("_new", "_key", "_there")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of broken keys, unique columns and references; all 0 in a sound store."""
    parts = []
    for name, keys in [*KEYS.items(), *UNIQUE.items()]:
        parts.append(tables[name].groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"unique {name}({', '.join(keys)})").alias("check"), "n"))
    for child, column, parent in REFERENCES:
        lost = tables[child].filter(F.col(column).isNotNull()).join(tables[parent].select(F.col("id").alias("_pid")), F.col(column) == F.col("_pid"), "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"{child}.{column} -> {parent}").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, kind, columns, target, n_values): the primary keys, unique columns, references and indexes that the store declares, and how many distinct values each holds."""
    rows = [(t, "primary key", k, None) for t, k in KEYS.items()] + [(t, "unique", k, None) for t, k in UNIQUE.items()]
    rows += [(t, "reference", (c,), f"{to}(id)") for t, c, to in REFERENCES] + [(t, "index", (c,), None) for t, c in INDEXES]
    parts = []
    for table in KEYS:  # a table's columns are counted in one pass
        own = [r for r in rows if r[0] == table]
        counts = tables[table].agg(*[F.count_distinct(*[F.col(c) for c in columns]).alias(f"n{i}") for i, columns in enumerate(dict.fromkeys(r[2] for r in own))])
        at = {columns: f"n{i}" for i, columns in enumerate(dict.fromkeys(r[2] for r in own))}
        named = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(kind).alias("kind"), F.lit(", ".join(c)).alias("columns"), F.lit(to).cast("string").alias("target"), F.col(at[c]).alias("n_values")) for t, kind, c, to in own])
        parts.append(counts.select(F.explode(named).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of all tables, in one job."""
    parts = [df.select(F.lit(t).alias("table")) for t, df in tables.items()]
    counted = reduce(DataFrame.unionByName, parts).groupBy("table").agg(F.count("*").alias("n"))
    names = parts[0].sparkSession.createDataFrame([(t,) for t in tables], "table string")
    return names.join(F.broadcast(counted), "table", "left").select("table", F.coalesce("n", F.lit(0)).alias("n_rows"))


def create(spark: SparkSession, database: str, tables: dict[str, DataFrame], location: str | None = None) -> None:
    """Drop and create the database and its four tables; codings are bucketed by paragraph, as joins want them."""
    drop(spark, database)
    spark.sql(f"CREATE DATABASE `{database}`" + (f" LOCATION '{location}'" if location else ""))
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name == "paragraph_codings":
            writer = writer.bucketBy(8, "paragraph_id").sortBy("paragraph_id")
        writer.saveAsTable(f"`{database}`.`{name}`")


def drop(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")


def read(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"`{database}`.`{name}`") for name in KEYS}


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, n_rows) of every column; each table is counted once, all in one job."""
    fields = spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields], "table string, column string, type string")
    return fields.join(F.broadcast(table_counts(tables)), "table")  # a row for each table


def build(coded: DataFrame, analysis: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four tables from (municipality, year, category, h5, dan, text, codes); ids follow the sort order of names and codes.

    No job runs here.  Names and codes are few, so they are numbered in one task each, from one grouping of the rows; a coding's id names
    its paragraph and its code.  Where all four tables are used, save ``coded`` first: paragraphs and codings each read it.
    """
    found = coded.groupBy("municipality").agg(F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"))
    numbered = lambda rows, name: rows.filter(F.col(name).isNotNull()).distinct().withColumn("id", F.row_number().over(Window.orderBy(name)))
    towns = numbered(found.select(F.col("municipality").alias("name")), "name")
    types = numbered(found.select(F.explode("codes").alias("code")), "code")
    keyed = towns.select(F.col("name").alias("municipality"), F.col("id").alias("municipality_id"))
    if analysis is not None:
        towns = enrich(towns, analysis, "name")
    # One bigint for a paragraph's place: document ordinal and line, so no global order is needed.
    placed = coded.withColumn("id", F.col("h5") * F.lit(1 << 24) + F.col("dan"))
    paragraphs = placed.join(keyed, "municipality")
    known = placed.filter(F.col("municipality").isNotNull())
    pairs = known.select(F.col("id").alias("paragraph_id"), F.explode("codes").alias("code")).join(types.withColumnRenamed("id", "coding_type_id"), "code")
    codings = pairs.select(F.concat_ws("-", "paragraph_id", "coding_type_id").alias("id"), "paragraph_id", "coding_type_id")
    return {"municipalities": towns, "coding_types": types, "paragraphs": paragraphs.select("id", "h5", "municipality_id", "year", "category", F.col("dan").alias("dan_number"), "text"), "paragraph_codings": codings}
