"""Routed and paged search: shortcuts, validation, pages of results, and what a response says about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.catalogs import CATEGORIES, NO_PAGES, PER_PAGE, TIME_RANGES, bangs


def parse_bang(query: Column) -> tuple[Column, Column]:
    """The shortcut at the beginning of a query, or null, and the rest of the query."""
    parts = F.split(query, " ", -1)
    bang = F.when(F.element_at(parts, 1).startswith("!"), F.element_at(parts, 1))
    rest = F.when(bang.isNotNull(), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")).otherwise(query)
    return bang, rest


def without_engine(engines: Column, engine: str) -> Column:
    """A request's engines without one; null if none is left."""
    rest = F.array_remove(engines, engine)
    return F.when(F.size(rest) > 0, rest)


def route(requests: DataFrame, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """Requests with the query, engines and category that their shortcut gives them.

    An engine's shortcut replaces engines and category, a category's only the category.  Columns: request_id, bang,
    query, category, engines, error (``unknown_bang`` or null).  ``transform`` may rewrite the query.  A null query has no shortcut and stays null.
    """
    bang, rest = parse_bang(F.col("query_text"))
    rest = transform(rest) if transform else rest
    given = F.when(F.size("engines") > 0, F.col("engines")).when(F.col("engine") != "", F.array("engine"))
    asked = requests.select("request_id", bang.alias("bang"), rest.alias("query"), F.col("category").alias("asked"), given.alias("given"))
    dim = bangs(requests.sparkSession).select("bang", F.col("engine").alias("bang_engine"), F.col("category").alias("bang_category"))
    joined = asked.join(F.broadcast(dim), "bang", "left")  # 11 rows
    return joined.select(
        "request_id", "bang", "query",
        F.coalesce("bang_category", "asked").alias("category"),
        F.when(F.col("bang_engine").isNotNull(), F.array("bang_engine")).otherwise(F.col("given")).alias("engines"),
        F.when(F.col("bang").isNotNull() & F.col("bang_category").isNull(), "unknown_bang").alias("error"),
    )


def validate(requests: DataFrame) -> DataFrame:
    """Requests with the reasons for which each is rejected; ``is_valid`` where there are none."""
    allowed = [c for c, _, _ in CATEGORIES]
    rules = {
        "query": F.col("query_text").isNull(),
        "category": F.col("category").isNotNull() & ~F.col("category").isin(allowed),
        "time_range": F.col("time_range").isNotNull() & ~F.col("time_range").isin(TIME_RANGES),
        "page": F.coalesce(F.col("page") < 1, F.lit(True)),
        "per_page": F.coalesce(~F.col("per_page").between(*PER_PAGE), F.lit(True)),
    }
    reasons = F.array_join(F.array_compact(F.array(*(F.when(failed, F.lit(name)) for name, failed in rules.items()))), ",")
    return requests.select("request_id", reasons.alias("reasons"), (reasons == "").alias("is_valid"))


def status(requests: DataFrame) -> DataFrame:
    """The HTTP status that each request gets before any engine is asked: 422 rejected, 400 unknown shortcut, else 200."""
    checked = validate(requests).join(route(requests).select("request_id", "error"), "request_id")
    code = F.when(~F.col("is_valid"), 422).when(F.col("error") == "unknown_bang", 400).otherwise(200)
    return checked.select("request_id", code.alias("status"))


def status_of_error(kind: Column) -> Column:
    """The HTTP status of an engine's error; ``http:NNN`` passes its own."""
    http = F.regexp_extract(kind, r"^http:(\d{3})$", 1)
    return F.when(kind == "bang", 400).when(kind == "timeout", 504).when(http != "", http.try_cast("int")).when(kind == "connection", 503).otherwise(500)


def unpaged(engines: Column) -> Column:
    """Whether any of the engines has no pages."""
    return F.coalesce(F.exists(engines, lambda e: F.lower(e).isin(NO_PAGES)), F.lit(False))


def parameters(requests: DataFrame) -> DataFrame:
    """What is asked of the engines for each valid request: q, per_page, pageno (null where engines have no pages), categories, time_range, engines."""
    routed = route(requests).filter("error is null").join(validate(requests).filter("is_valid").select("request_id"), "request_id")
    asked = routed.join(requests.select("request_id", "page", "per_page", "time_range"), "request_id")
    return asked.select(
        "request_id", F.col("query").alias("q"), "per_page", F.when(~unpaged(F.col("engines")), F.col("page")).alias("pageno"),
        F.col("category").alias("categories"), "time_range", F.array_join("engines", ",").alias("engines"),
    )


def normalise(results: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Results, each once, with empty strings and zeros for what is missing.

    A missing category becomes that which its request, if given, was routed to, else ``general``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = results.select(
        "result_id", "request_id", text("title"), text("url"), text("content"), F.lower(F.coalesce("engine", F.lit(""))).alias("engine"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("category") != "", F.col("category")).alias("category"),
    ).dropDuplicates(["result_id"])
    if requests is not None:
        routed = route(requests).select("request_id", F.col("category").alias("routed"))
        rows = rows.join(routed, "request_id", "left").withColumn("category", F.coalesce("category", "routed")).drop("routed")
    return rows.select("result_id", *(c for c in rows.columns if c not in ("result_id", "category")), F.coalesce("category", F.lit("general")).alias("category"))


def request_body(requests: DataFrame) -> DataFrame:
    """``request_id`` and what a client sends of each request with a query: a JSON object without a filter that isn't set."""
    filters = F.when(F.col("category") != "", F.col("category")).alias("category"), F.when(F.size("engines") > 0, F.col("engines")).alias("engines")
    body = F.struct(F.col("query_text").alias("query"), "page", "per_page", *filters)
    return requests.filter("query_text is not null").select("request_id", F.to_json(body).alias("body"))


def two_decimals(score: Column) -> Column:
    """A score that isn't negative as a reader sees it, with two decimals, halves rounded up."""
    hundredths = F.floor(score * 100 + 0.5).cast("bigint")
    return F.concat((hundredths / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def _answering(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The results of the engines that each valid request asks, with the request's engines, page and per_page."""
    asked = route(requests).filter("error is null").join(validate(requests).filter("is_valid").select("request_id"), "request_id")
    asked = asked.join(requests.select("request_id", "page", "per_page"), "request_id").select("request_id", "engines", "page", "per_page")
    found = normalise(results).select("request_id", "result_id", "engine", "score")
    return found.join(asked, "request_id").filter(F.col("engines").isNull() | F.array_contains("engines", F.col("engine")))


def pages(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The page of its results that each valid request asks for: request_id, rank, result_id, score.

    Results are those of the request's engines, if it names any, by falling score, then by id; an engine without pages
    always gives its first page.
    """
    joined = _answering(requests, results).withColumn("page", F.when(unpaged(F.col("engines")), 1).otherwise(F.col("page")))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("score").desc(), "result_id"))
    ranked = joined.withColumn("rank", rank)
    on = F.col("rank").between((F.col("page") - 1) * F.col("per_page") + 1, F.col("page") * F.col("per_page"))
    return ranked.filter(on).select("request_id", "rank", "result_id", "score")


def responses(requests: DataFrame, results: DataFrame) -> DataFrame:
    """What the response to each valid request says: number_of_results (of the engines asked), page, per_page, has_next, has_previous."""
    shown = pages(requests, results).groupBy("request_id").agg(F.count("*").alias("shown"))
    total = _answering(requests, results).groupBy("request_id").agg(F.count("*").alias("total"))
    asked = route(requests).filter("error is null").join(validate(requests).filter("is_valid").select("request_id"), "request_id")
    asked = asked.join(requests.select("request_id", "page", "per_page"), "request_id").join(shown, "request_id", "left").join(total, "request_id", "left")
    shown_n = F.coalesce("shown", F.lit(0))
    return asked.select(
        "request_id", "query", "category",
        F.coalesce(F.nullif("total", F.lit(0)), shown_n).alias("number_of_results"), "page", "per_page",
        (~unpaged(F.col("engines")) & (shown_n == F.col("per_page"))).alias("has_next"), (F.col("page") > 1).alias("has_previous"),
    )


def page_bar(requests: DataFrame, results: DataFrame, size: int = 10) -> DataFrame:
    """The page numbers and the range of results that a reader sees: total_pages, first, last, visible."""
    meta = responses(requests, results).select("request_id", "page", F.col("number_of_results").alias("n"))
    last_page = F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int")
    begin = F.when(F.col("page") <= 2, 1).otherwise(F.col("page") - 1)
    return meta.select(
        "request_id", last_page.alias("total_pages"), ((F.col("page") - 1) * size + 1).cast("bigint").alias("first"),
        F.least(F.col("page") * size, F.col("n")).cast("bigint").alias("last"),
        F.array_join(F.sequence(begin, begin + 2), ",").alias("visible"),
    )


def gaps(requests: DataFrame, key: str, time: str, least: float) -> DataFrame:
    """Seconds since the key's request before, and the wait that a spacing of ``least`` seconds would ask for."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time, *[c for c in requests.columns if c not in (key, time)]))
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return requests.withColumn("gap", F.round(seconds, 6)).withColumn("wait", F.round(F.greatest(least - F.coalesce(seconds, F.lit(least)), F.lit(0.0)), 6))


def backoff(attempts: DataFrame, delay: float, factor: float) -> DataFrame:
    """The waits of each row's ``attempts`` retries, and their sum."""
    waits = F.transform(F.sequence(F.lit(0), F.col("attempts") - 1), lambda k: F.lit(delay) * F.pow(F.lit(factor), k))
    return attempts.withColumn("waits", F.when(F.col("attempts") > 0, waits).otherwise(F.array().cast("array<double>")))
