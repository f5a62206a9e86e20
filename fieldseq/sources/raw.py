"""Raw event records as VARIANT values, and a quarantine for broken ones.

A fixed schema turns what does not fit into nulls. Here a record is parsed first and
checked field by field; what cannot be read stays as text beside the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.spec import RAW_EVENT

#: Fields no record may lack.
REQUIRED = ("id", "index", "type.name")


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, text): one row per line of JSON-lines files; blank lines are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.monotonically_increasing_id().alias("place"))
    return lines.filter(F.trim("value") != "").select("file", "place", F.col("value").alias("text"))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, text): one row per element of files that each hold one JSON array.

    A file that is no array is one record, its whole text, for the quarantine to hold.
    """
    files = (spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
             .select("value", F.col("_metadata.file_path").alias("file")))
    parsed = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    parts = F.transform(parsed, lambda v: F.to_json(v))
    return files.select("file", F.posexplode(F.coalesce(parts, F.array("value"))).alias("place", "text"))


def _leaves(schema: T.StructType, path: str = "") -> Iterator[tuple[str, T.DataType]]:
    for field in schema:
        name = f"{path}{field.name}"
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, f"{name}.")
        else:
            yield name, field.dataType


def _found(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get("raw", "$." + path, kind)


def _given(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _bad(value: Column, kind: T.DataType) -> Column:
    """Whether a VARIANT that is there cannot be read as the type, down to the last element."""
    if isinstance(kind, T.StructType):
        wrong = ~F.schema_of_variant(value).startswith("OBJECT")
        for field in kind:
            wrong = wrong | _bad(F.try_variant_get(value, f"$.{field.name}", "variant"), field.dataType)
        return _given(value) & wrong
    if isinstance(kind, T.ArrayType):
        parts = F.try_variant_get(value, "$", "array<variant>")
        return _given(value) & (parts.isNull() | F.exists(
            parts, lambda e: ~_given(e) | _bad(e, kind.elementType)))
    return _given(value) & F.try_variant_get(value, "$", kind.simpleString()).isNull()


def checked(records: DataFrame) -> DataFrame:
    """Add `raw`, the parsed VARIANT, and `problems`, an array of reasons, empty for sound records.

    Both are one-element arrays taken apart, so that a text is parsed and checked once.
    """
    parsed = records.withColumn("raw", F.explode(F.array(F.try_parse_json("text"))))
    whole = F.schema_of_variant("raw").startswith("OBJECT")
    missing = [F.when(~_given(_found(p)), F.lit(f"missing {p}")) for p in REQUIRED]
    wrong = [F.when(_bad(_found(p), kind), F.lit(f"bad {p}")) for p, kind in _leaves(RAW_EVENT)]
    wrong += [F.when(_given(_found(f.name)) & ~F.schema_of_variant(_found(f.name)).startswith("OBJECT"),
                     F.lit(f"bad {f.name}")) for f in RAW_EVENT if isinstance(f.dataType, T.StructType)]
    problems = (F.when(F.col("raw").isNull(), F.array(F.lit("not JSON")))
                .when(~whole, F.array(F.lit("not an object")))
                .otherwise(F.array_compact(F.array(*missing, *wrong))))
    return parsed.withColumn("problems", F.explode(F.array(problems)))


def quarantine(records: DataFrame) -> DataFrame:
    """Broken records of a checked table: all columns but `raw`, with the text as it came."""
    return records.filter(F.size("problems") > 0).drop("raw")


def _typed(schema: T.StructType, path: str = "") -> list[Column]:
    out = []
    for field in schema:
        name = f"{path}{field.name}"
        if isinstance(field.dataType, T.StructType):
            value = F.when(_given(_found(name)), F.struct(*_typed(field.dataType, f"{name}.")))
        else:
            value = _found(name, field.dataType.simpleString())
        out.append(value.alias(field.name))
    return out


def sound_events(records: DataFrame, *carried: str) -> DataFrame:
    """Sound records of a checked table in the columns `flatten_events` reads, and carried ones."""
    return records.filter(F.size("problems") == 0).select(*carried, *_typed(RAW_EVENT))


def nested(events: DataFrame) -> DataFrame:
    """(match_id, text): flat events as records of nested JSON."""
    def named(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("name")))
    end = F.when(F.col("end_x").isNotNull(), F.array("end_x", "end_y"))
    of_type = {t: F.col("type") == t for t in ("Pass", "Carry", "Shot")}
    goal = F.when(F.col("is_goal"), "Goal").otherwise("Saved")
    record = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("idx").alias("index"), "period", "minute", "second",
        named("type").alias("type"), named("play_pattern").alias("play_pattern"), "possession",
        named("possession_team").alias("possession_team"), named("team").alias("team"), named("player").alias("player"),
        F.array("x", "y").alias("location"), "under_pressure", "duration",
        F.when(of_type["Pass"], F.struct(end.alias("end_location"), F.col("is_cross").alias("cross"),
                                         named("technique").alias("technique"), named("pass_type").alias("type"))).alias("pass"),
        F.when(of_type["Carry"], F.struct(end.alias("end_location"))).alias("carry"),
        F.when(of_type["Shot"], F.struct(end.alias("end_location"), F.struct(goal.alias("name")).alias("outcome"),
                                         F.col("provider_xg").alias("statsbomb_xg"))).alias("shot"))
    return events.select("match_id", F.to_json(record).alias("text"))
