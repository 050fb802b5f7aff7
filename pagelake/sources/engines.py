"""The engine catalog: a small dimension table of search engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "name STRING, engine STRING, shortcut STRING, categories STRING, disabled BOOLEAN, base_urls ARRAY<STRING>, description STRING"

# The configured engines (name, engine, shortcut, categories, disabled).
YACY_URLS = [
    "https://yacy.searchlab.eu",
    "https://search.lomig.me",
    "https://yacy.ecosys.eu",
    "https://search.webproject.link",
]
ENGINES = [
    ("bing", "bing", "bi", "general", False),
    ("duckduckgo", "duckduckgo", "ddg", "general", False),
    ("google", "google", "go", "general", False),
    ("startpage", "startpage", "sp", "general", False),
    ("wikipedia", "wikipedia", "wp", "general", False),
    ("wikidata", "wikidata", "wd", "general", False),
    ("github", "github", "gh", "it", False),
    ("reddit", "reddit", "re", "general", False),
    ("youtube", "youtube_noapi", "yt", "videos", False),
    ("vimeo", "vimeo", "vi", "videos", False),
    ("stackexchange", "stackexchange", "sx", "it", False),
    ("ahmia", "ahmia", "ah", "general", False),
    ("yacy", "yacy", "ya", "general", False),
    ("yacy images", "yacy", "yai", "images", True),
]


def engine_catalog(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Engines with `enabled` and their categories as an array."""
    if rows is None:
        rows = [(*row, YACY_URLS if row[1] == "yacy" else None, None) for row in ENGINES]
    return shape_catalog(spark.createDataFrame(rows, CATALOG_SCHEMA))


def shape_catalog(rows: DataFrame) -> DataFrame:
    categories = F.transform(F.split("categories", ","), lambda word: F.trim(word))
    return rows.withColumns({"categories": categories, "enabled": ~F.coalesce("disabled", F.lit(False))})


def engines_by_category(catalog: DataFrame) -> DataFrame:
    """(category, name) of the enabled engines."""
    return catalog.where("enabled").select(F.explode("categories").alias("category"), "name")


def engine_listing(catalog: DataFrame) -> DataFrame:
    """One line per engine: `name: description`."""
    return catalog.select("name", F.concat(F.col("name"), F.lit(": "), F.coalesce("description", F.lit("No description"))).alias("line"))
