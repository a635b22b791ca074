"""Readers and writers of map tables, dialogues, traces and task sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import in_bbox, sized_broadcast

DUMP = "latitude double, longitude double, fsq_category_labels array<string>, name string"
POINTS = "array<struct<x:double,y:double>>"
REGION = {
    "pois": "poi_id long, category string, name string, Address string, address_osm string, category_osm string",
    "aois": "aoi_id long, aoi_name string, land_use string, coords string, Address string",
    "roads": "road_id long, road_name string",
}
DIALOGUE = "task string, id string, diag array<struct<role:string,content:string>>"


def read_poi_dump(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Points of a folder of Parquet files inside a closed box; files without one of the
    four columns are left out.  Box and columns are pushed to the scan.

    A column that a file lacks reads as null, so one scan tells which files have all four:
    those in which each has a value in some row (a file with an all-null column counts
    as lacking it).  The driver opens no file; the names of the good ones are joined by
    broadcast while they are few."""
    need = ("latitude", "longitude", "fsq_category_labels", "name")
    dump = spark.read.schema(DUMP).parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    good = dump.groupBy("_file").agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in need)).where(" AND ".join(need)).select("_file")
    return in_bbox(dump, "longitude", "latitude", bbox).join(sized_broadcast(good), "_file", "left_semi").drop("_file")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, coords) of the named LineString features."""
    # coordinates are nested to a depth that depends on the type, so they are read as text
    loose = spark.read.schema("features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>").json(path, multiLine=True)
    f = loose.select(F.explode("features").alias("f")).where("f.geometry.type = 'LineString' and coalesce(f.properties.name, '') <> ''")
    return f.select(F.col("f.properties.name").alias("name"), F.from_json("f.geometry.coordinates", "array<array<double>>").alias("coords"))


def split_map(df: DataFrame, classes: tuple[str, ...] = ("header", "junction", "road", "lane", "aoi", "poi")) -> dict[str, DataFrame]:
    """One table per class of a tagged collection (class, data)."""
    return {c: df.where(F.col("class") == c).select("data.*") for c in classes}


def latest_snapshot(names: DataFrame, fsq: bool) -> DataFrame:
    """(city, name): per city the name of the latest six-digit date."""
    pattern = r"^map_(.+?)_fsq_(\d{6})$" if fsq else r"^map_((?:(?!_fsq).)+?)_(\d{6})$"
    p = names.where(F.col("name").rlike(pattern)).select("name", F.regexp_extract("name", pattern, 1).alias("city"), F.regexp_extract("name", pattern, 2).alias("day"))
    return p.groupBy("city").agg(F.max(F.struct("day", "name")).alias("m")).select("city", F.col("m.name").alias("name"))


def parse_coords(text: Column) -> Column:
    """Points of a text such as "[(116.1, 39.9), ...]", never evaluated."""
    return F.transform(F.from_json(F.translate(text, "()", "[]"), "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_region_csv(spark: SparkSession, kind: str, path: str) -> DataFrame:
    df = spark.read.csv(path, schema=REGION[kind], header=True, quote='"', escape='"')
    return df.withColumn("coords", parse_coords(F.col("coords"))) if kind == "aois" else df


def write_region_csv(df: DataFrame, path: str) -> None:
    flat = df
    for field in df.schema:
        if field.dataType.typeName() == "array":
            pts = F.transform(field.name, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit(")")))
            flat = flat.withColumn(field.name, F.concat(F.lit("["), F.array_join(pts, ", "), F.lit("]")))
    flat.write.csv(path, header=True, quote='"', escape='"')


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIALOGUE).json(path)


def write_dialogues(df: DataFrame, path: str) -> None:
    """JSON lines, in one folder per task."""
    df.write.partitionBy("task").json(path)


def read_dir(spark: SparkSession, path: str, name_contains: str, schema: str, folders: bool = False) -> DataFrame:
    """JSON files whose name holds a text, labelled with their name; with folders=True
    the name is that of the folder and the file."""
    df = spark.read.schema(schema).json(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1) if folders else F.col("_metadata.file_name")
    return df.select("*", name.alias("file_name")).where(F.col("file_name").contains(name_contains))


def read_traces(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Generated traces, one JSON array per file below a folder per model (lines: one per
    line, so that many traces need few files), and the count of unreadable ones per
    model.  extra: what a step holds beyond event, span, place."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("file"))
    model = F.element_at(F.split("file", "/"), -2)
    parsed = raw.select(model.alias("model"), "file", F.from_json("value", "array<array<string>>").alias("trace"))
    bad = parsed.where("trace is null").groupBy("model").agg(F.count(F.lit(1)).alias("unreadable"))
    good = parsed.where("trace is not null").select("model", "file", F.posexplode("trace").alias("seq", "step"))
    return good.select("model", "file", F.col("seq").cast("long"), F.col("step")[0].alias("event"), F.col("step")[1].alias("span"), F.col("step")[2].try_cast("long").alias("poi_id"), F.slice("step", 4, F.greatest(F.size("step") - 3, F.lit(0))).alias("extra")), bad


def write_tasks(df: DataFrame, path: str) -> None:
    """Multiple-choice tasks, one folder per (category, task); options become A, B, ..."""
    letters = [F.try_element_at("options", F.lit(i + 1)).alias(x) for i, x in enumerate("ABCDEFGH")]
    df.select("category", "task", "question", *letters, "answer").write.partitionBy("category", "task").csv(path, header=True, quote='"', escape='"')


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet, by key."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def normalize_registered(df: DataFrame, entry: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns (messages, and chosen, rejected, kto_tag, images, tools where
    declared) of a data set as its register entry describes it."""
    columns, tags = entry.get("columns", {}), entry.get("tags", {})
    extra = [F.col(columns[c]).alias(c) for c in ("chosen", "rejected", "kto_tag", "images", "tools") if c in columns]
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    if entry.get("formatting", "alpaca") == "sharegpt":
        role, content = tags.get("role_tag", "from"), tags.get("content_tag", "value")
        names = {tags.get("user_tag", "human"): "user", tags.get("assistant_tag", "gpt"): "assistant", tags.get("system_tag", "system"): "system"}
        canonical = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        messages = F.transform(columns.get("messages", "conversations"), lambda m: F.struct(F.coalesce(F.try_element_at(canonical, m[role]), m[role]).alias("role"), m[content].alias("content")))
        if "system" in columns:
            messages = F.when(F.coalesce(F.col(columns["system"]), F.lit("")) != "", F.concat(one("system", F.col(columns["system"])), messages)).otherwise(messages)
    else:
        prompt, query, answer = (columns.get(k, d) for k, d in (("prompt", "instruction"), ("query", "input"), ("response", "output")))
        question = F.concat_ws("\n", F.nullif(F.col(prompt), F.lit("")), F.nullif(F.col(query), F.lit(""))) if query in df.columns else F.col(prompt)
        messages = F.concat(one("user", question), one("assistant", F.col(answer)))
        if columns.get("history") in df.columns:
            past = F.flatten(F.transform(F.coalesce(F.col(columns["history"]), F.array().cast("array<array<string>>")), lambda p: F.concat(one("user", p[0]), one("assistant", p[1]))))
            messages = F.concat(past, messages)
        if columns.get("system") in df.columns:
            messages = F.when(F.coalesce(F.col(columns["system"]), F.lit("")) != "", F.concat(one("system", F.col(columns["system"])), messages)).otherwise(messages)
    return df.select(*keep, messages.alias("messages"), *extra)
