"""Model exchange: requests, answers and insights per post."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.constants import (
    ERROR_EMPTY,
    ERROR_NO_HANGUL,
    ERROR_NO_ITEMS,
    ERROR_NOT_CONFIGURED,
    ERROR_NOT_JSON,
    KO_FILLERS,
)
from feedloom.functions.html import contains_hangul
from feedloom.functions.json_cols import (
    insight_items,
    items_given,
    model_content,
    strip_code_fence,
)
from feedloom.functions.lines import normalize_bullets
from feedloom.functions.text import is_blank, no_strings

#: Posts of a digest that are sent to the model.
TRANSLATED = 10


def model_requests(posts: DataFrame) -> DataFrame:
    """One JSON payload per digest; `posts` is the translation slice, ten posts at most."""
    item = F.struct(
        "index", "title", normalize_bullets(F.col("english_summary")).alias("englishSummary")
    )
    return posts.groupBy("digest_id").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("payload")
    )


def parse_insights(responses: DataFrame) -> DataFrame:
    """Insights per digest and index; of two items with one index the later wins.

    An index that no post of the translation slice can have is left out.
    """
    clean = responses.filter(F.col("status").between(200, 299)).select(
        "digest_id", strip_code_fence(model_content(F.col("body"))).alias("content")
    )
    items = clean.select("digest_id", F.explode(insight_items(F.col("content"))).alias("i"))
    last = Window.partitionBy("digest_id", "index").orderBy(F.col("pos").desc())
    return (
        items.select("digest_id", "i.pos", "i.index", "i.bullets")
        .withColumn("_n", F.row_number().over(last))
        .filter(F.expr("_n = 1") & F.col("index").between(0, TRANSLATED - 1))
        .select(
            "digest_id",
            "index",
            normalize_bullets(F.col("bullets"), KO_FILLERS).alias("korean_summary"),
        )
    )


def attach_insights(posts: DataFrame, insights: DataFrame) -> DataFrame:
    """Posts of the translation slice with the insights of their index, else an empty list."""
    return posts.join(insights, ["digest_id", "index"], "left").withColumn(
        "korean_summary", F.coalesce("korean_summary", no_strings())
    )


def diagnostics(runs: DataFrame, responses: DataFrame, posts: DataFrame) -> DataFrame:
    """Outcome of the model exchange per digest; a run without a response was not configured."""
    ko = F.exists(F.coalesce("korean_summary", no_strings()), contains_hangul)
    counted = posts.groupBy("digest_id").agg(F.count_if(ko).alias("translated_posts"))
    answers = responses.select(
        "digest_id", "status", model_content(F.col("body")).alias("content")
    ).withColumn("_given", items_given(strip_code_fence(F.col("content"))))
    joined = runs.select("digest_id").join(answers, "digest_id", "left").join(
        counted, "digest_id", "left"
    )
    configured = F.col("status").isNotNull()
    n = F.coalesce("translated_posts", F.lit(0))
    error = (
        F.when(~configured, F.lit(ERROR_NOT_CONFIGURED))
        .when(
            ~F.col("status").between(200, 299),
            F.concat(F.lit("HTTP "), F.col("status").cast("string")),
        )
        .when(is_blank(F.col("content")), F.lit(ERROR_EMPTY))
        .when(F.col("_given").isNull(), F.lit(ERROR_NOT_JSON))
        .when(~F.col("_given"), F.lit(ERROR_NO_ITEMS))
        .when(n == 0, F.lit(ERROR_NO_HANGUL))
    )
    return joined.select(
        "digest_id",
        configured.alias("configured"),
        configured.alias("attempted"),
        error.isNull().alias("succeeded"),
        F.when(error.isNull(), n).otherwise(0).cast("bigint").alias("translated_posts"),
        error.alias("error"),
    )
