"""Rows out of JSON: repositories that orders name, reports in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fields of an element, each in all its spellings.
_FIELDS = (
    "full_name", "fullName", "owner", "name", "id", "url", "html_url", "clone_url", "cloneUrl", "default_branch", "defaultBranch", "language",
    "stars", "stargazers_count", "is_private", "private",
)


def _field(*names: str) -> Column:
    """The first of the fields of an element that is there and not empty, as text."""
    return F.coalesce(*[F.when(F.col(f"_{n}") != "", F.col(f"_{n}")) for n in names])


def order_repos(orders: DataFrame, column: str = "selected_repos") -> DataFrame:
    """orders (order_id, JSON array) -> order_id, full_name, owner, name, external_id, url, clone_url, default_branch, language, stars, is_private.

    A name counts once an order, ignoring case, and its first element wins. Elements that are no
    objects or have no full name are skipped, as is a text that is no array; both spellings of a field
    count. Owner and name fall back to the parts of the full name. Numbers in quotes count as stars.
    """
    rows = orders.select("order_id", F.posexplode(F.from_json(column, "array<string>")).alias("at", "element"))
    rows = rows.select("order_id", "at", F.json_tuple("element", *_FIELDS).alias(*[f"_{n}" for n in _FIELDS]))
    full = F.trim(_field("full_name", "fullName"))
    rows = rows.withColumn("full_name", full).where("full_name <> ''")
    split = F.instr("full_name", "/") > 0
    login = F.get_json_object("_owner", "$.login")
    owner = F.when(F.col("_owner").startswith("{"), F.when(login != "", login)).otherwise(_field("owner"))
    made = rows.select(
        "order_id",
        "at",
        "full_name",
        F.coalesce(owner, F.when(split, F.substring_index("full_name", "/", 1)), F.lit("")).alias("owner"),
        F.coalesce(_field("name"), F.when(split, F.regexp_extract("full_name", "(?s)^[^/]*/(.*)$", 1)), F.col("full_name")).alias("name"),
        _field("id").alias("external_id"),
        _field("url", "html_url").alias("url"),
        _field("clone_url", "cloneUrl").alias("clone_url"),
        _field("default_branch", "defaultBranch").alias("default_branch"),
        _field("language").alias("language"),
        _field("stars", "stargazers_count").try_cast("long").alias("stars"),
        _field("is_private", "private").try_cast("boolean").alias("is_private"),
    )
    whole = F.struct(*[c for c in made.columns if c not in ("order_id", "at")])
    return made.groupBy("order_id", F.lower("full_name").alias("_key")).agg(F.min_by(whole, "at").alias("_row")).select("order_id", "_row.*")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row a file of JSON, with the columns of ``schema`` and file; files that are no JSON are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("file", F.input_file_name()).where("_bad IS NULL").drop("_bad")
