"""Small fixed dimensions: shortcuts of a query, categories and engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shortcut, name, description, engine, category.
BANGS = [
    ("!ol", "OpenLibrary", "Search books on OpenLibrary", "openlibrary", "books"),
    ("!aa", "Anna's Archive", "Search books on Anna's Archive", "annas archive", "books"),
    ("!arxiv", "arXiv", "Search scientific papers on arXiv", "arxiv", "science"),
    ("!gos", "Google Scholar", "Search academic papers on Google Scholar", "google scholar", "science"),
    ("!re", "Reddit", "Search Reddit discussions", "reddit", "social_media"),
    ("!ddn", "DuckDuckGo News", "Search news articles on DuckDuckGo", "duckduckgo news", "news"),
    ("!psn", "Presearch News", "Search news articles on Presearch", "presearch news", "news"),
    ("!books", "Books", "Search all book sources (OpenLibrary, Anna's Archive)", None, "books"),
    ("!science", "Science", "Search all scientific databases (arXiv, Google Scholar)", None, "science"),
    ("!social", "Social Media", "Search social media platforms (Reddit)", None, "social_media"),
    ("!news", "News", "Search all news sources (DuckDuckGo News, Presearch News)", None, "news"),
]
#: Category, description, examples.
CATEGORIES = [
    ("books", "Search books and literature", ["!ol python programming", "!aa machine learning"]),
    ("science", "Search scientific papers and academic content", ["!arxiv quantum computing", "!gos climate change"]),
    ("social_media", "Search social media discussions", ["!re web development"]),
    ("news", "Search news articles and current events", ["!ddn technology news", "!psn climate updates"]),
]
#: Engine, seconds that it may take, largest page.
ENGINE_LIMITS = [
    ("openlibrary", 5.0, None), ("annas archive", 5.0, None), ("arxiv", 10.0, None), ("google scholar", 10.0, 50), ("reddit", 10.0, None),
    ("duckduckgo news", 10.0, None), ("presearch news", 10.0, None),
]
#: Engines without pages, allowed ranges of time, and the largest page.
NO_PAGES = ["reddit"]
TIME_RANGES = ["day", "month", "year"]
PER_PAGE = (1, 100)


def bangs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANGS, "bang string, name string, description string, engine string, category string")


def engines(spark: SparkSession) -> DataFrame:
    """One row for each engine, with whether it can be paged, how many seconds it may take and its largest page."""
    rows = bangs(spark).filter("engine is not null")
    limits = spark.createDataFrame(ENGINE_LIMITS, "engine string, timeout double, max_page int")
    rows = rows.select("category", "engine", "bang", "description", (~F.col("engine").isin(NO_PAGES)).alias("paged"))
    return rows.join(F.broadcast(limits), "engine")


def find(catalog: DataFrame, **equal: str) -> DataFrame:
    """The rows of a catalog with the given values."""
    for column, value in equal.items():
        catalog = catalog.filter(F.col(column) == value)
    return catalog


def categories(spark: SparkSession) -> DataFrame:
    """One row for each category, with its engines and shortcuts in order of name."""
    known = spark.createDataFrame(CATEGORIES, "category string, description string, examples array<string>")
    grouped = engines(spark).groupBy("category").agg(F.sort_array(F.collect_list("engine")).alias("engines"), F.sort_array(F.collect_list("bang")).alias("bangs"))
    return known.join(F.broadcast(grouped), "category")
