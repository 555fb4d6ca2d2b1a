"""Readers with explicit schemas for the inputs the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, text string, date string"
BUSINESS = (
    "business_id string, name string, address string, city string, state string, postal_code string, "
    "latitude double, longitude double, stars double, review_count int, is_open int, "
    "attributes map<string,string>, categories string, hours map<string,string>"
)
PAIR = "user_id string, business_id string"
PREDICTION = "user_id string, business_id string, stars double"
PROFILE = "profile_type string, profile_id string, profile_content array<int>"
ITEM_MODEL = "b1 string, b2 string, sim double"
USER_MODEL = "u1 string, u2 string, sim double"


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON objects, one a line."""
    return spark.read.schema(schema).json(path)


def reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_lines(spark, path, REVIEW)


def businesses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_lines(spark, path, BUSINESS)


def pairs(spark: SparkSession, path: str | list[str], schema: str = PAIR) -> DataFrame:
    """CSV pairs below a header. Rows that repeat the header are dropped, as
    files made by concatenation hold them."""
    table = spark.read.schema(schema).csv(path, header=True)
    same = F.lit(True)
    for name in table.columns:
        same = same & (F.col(name) == name)
    return table.where(~F.coalesce(same, F.lit(False)))


def word_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One word a line: column ``word``."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless numeric CSV: (id, vec), the first field being the id."""
    fields = F.split("value", ",")
    vec = F.transform(F.slice(fields, F.lit(2), F.size(fields) - 1), lambda x: x.cast("double"))
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim(fields[0]).cast("long").alias("id"), vec.alias("vec"))


def round_paths(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder by name, hidden ones left out: one file a round.
    Works for any file system that Spark can reach."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
    found = [s.getPath() for s in listed if s.isFile()]
    return [str(p) for p in sorted(found, key=lambda p: p.getName()) if not p.getName().startswith((".", "_"))]


def number_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of numbers, as (key, value)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))


def profiles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, term) of the profiles of one type, of a model that ``reports.profiles`` writes."""
    table = json_lines(spark, path, PROFILE).where(F.col("profile_type") == kind)
    return table.select(F.col("profile_id").alias("id"), F.explode("profile_content").alias("term"))


def pair_model(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, sim) of a similarity model of items or of users, by the names its rows have."""
    table = json_lines(spark, path, "b1 string, b2 string, u1 string, u2 string, sim double")
    return table.select(F.coalesce("b1", "u1").alias("a"), F.coalesce("b2", "u2").alias("b"), "sim")
