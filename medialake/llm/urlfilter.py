"""URL filters (native): rules by host and path, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

The labelled table is a bounded parameter (``LABELLED``, below 200 rows); the feature space is
fixed (``FEATURES``), so the model's size does not grow with the corpus.  Scoring is one pass
without a shuffle.

Defined results: a URL that is NULL or has no ``://`` has empty host and path, no rule, and the
model's verdict on the empty string (with these labels: allow); NULLs in other columns and
repeated rows pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_UPPER

FEATURES = 1 << 14
NGRAMS = (3, 4, 5)

#: (allow, host and its subdomains, path prefix); the longest rule that fits wins.
RULES = (
    (True, "org", "/"), (False, "example.org", "/es/"), (False, "example.org", "/en/1"),
    (True, "com", "/fr/"), (False, "com", "/de/"),
)

# The labelled URLs: hosts and paths of our own invention, (unwanted, url).
LABELLED = tuple(
    [(1, f"http://{h}.test/{p}") for h, p in (
        ("casino-royal", "en/12"), ("my-casino", "win/77"), ("online-casino", "de/41?bonus=1"),
        ("big-win", "fr/8"), ("win-jackpot", "en/300"), ("free-win", "es/52"), ("sport-bets", "en/5"),
        ("best-bets", "de/610"), ("free-bets-now", "en/4"), ("bets24", "fr/19"),
        ("free-spins", "en/31"), ("free-money", "es/9"), ("cheap-pills-shop", "en/27"),
        ("diet-pills", "fr/45"), ("cheap-meds", "de/6"), ("pills-online", "es/83"),
        ("cheap-watches", "en/70"), ("spam-mail", "en/2"), ("link-farm", "de/15"),
        ("spam-links", "fr/64"), ("content-farm", "en/91"), ("spamfarm", "es/33"),
        ("ads-server", "en/18"), ("ads-click", "de/57"), ("track-pixel", "en/3"),
        ("ad-track", "fr/22"), ("click-track", "es/40"), ("best-ads", "en/66"),
        ("adult-video", "en/14"), ("adult-chat", "de/29"), ("x-adult", "fr/81"),
        ("xxx-adult", "es/11"), ("hot-adult-cams", "en/50"), ("porn-x", "en/75"),
        ("blog.casino-tips", "en/39"), ("m.sport-bets", "de/72"), ("www.cheap-pills", "en/6"),
        ("www.ads-net", "fr/90"), ("m.adult-pics", "es/28"), ("blog.spam-seo", "en/54"))]
    + [(0, f"https://{h}.test/{p}") for h, p in (
        ("riverside", "en/12"), ("gardening", "de/41"), ("thenation", "en/300"),
        ("historyof", "fr/8"), ("theatre", "en/27.html"), ("anderson", "de/6"),
        ("northern", "es/52"), ("weather", "en/5"), ("station", "fr/19/"),
        ("morning", "en/4?page=2&ref=x"), ("library", "de/610"), ("university", "es/9"),
        ("kitchen", "en/31"), ("mountain", "fr/45"), ("museum", "en/70#top"),
        ("science", "es/83"), ("teaching", "en/2"), ("nature", "de/15"),
        ("thornton", "fr/64"), ("heather", "en/91"), ("edition", "es/33"),
        ("notion", "en/18"), ("blog.painting", "de/57"), ("blog.ocean", "en/3"),
        ("blog.thestar", "fr/22?utm_source=feed"), ("m.cooking", "es/40"),
        ("m.railway", "en/66"), ("m.another", "en/14"), ("www.bridge", "de/29"),
        ("www.rather", "fr/81"), ("www.townhall", "es/11"), ("www.forest", "en/50"),
        ("www.thisone", "en/75"), ("school", "en/39.html"), ("tenth", "de/72/"),
        ("orchestra", "en/6"), ("lantern", "fr/90"), ("harbour", "es/28"),
        ("meeting", "en/54"), ("thing", "de/333"))])


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple] = RULES) -> Column:
    """struct(rule, allow) of the longest rule that fits, or NULL."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(allow).alias("allow")))
            for allow, h, p in by_length]
    return F.coalesce(*fits)


def char_ngrams(col: Column, mark: str) -> Column:
    """Marked character n-grams of ``<col>``; the angle brackets stand for its ends."""
    text = F.concat(F.lit("<"), col, F.lit(">"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(text, i, F.lit(n))))

    grams = [of_length(n) for n in NGRAMS]
    return F.concat(*grams)


def _features(df: DataFrame) -> DataFrame:
    """Drops nothing; expects columns _host and _path."""
    grams = F.concat(char_ngrams(F.col("_host"), "h"), char_ngrams(
        F.regexp_replace("_path", "[0-9]+", "0"), "p"))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True) \
        .transform(df.withColumn("_grams", grams))


def train(spark: SparkSession, labelled: Sequence[tuple[int, str]] = LABELLED):
    """The model, fitted on one partition so that reruns give the same weights."""
    rows = spark.createDataFrame(list(labelled), "label int, url string").coalesce(1)
    rows = rows.select(F.col("label").cast("double").alias("label"), host_of(F.col("url")).alias("_host"),
                       path_of(F.col("url")).alias("_path"))
    return LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_prediction",
                              probabilityCol="_probability", rawPredictionCol="_raw",
                              regParam=0.01, maxIter=40).fit(_features(rows))


def judge(pages: DataFrame, *, url: str = "url", rules: Sequence[tuple] = RULES, model=None) -> DataFrame:
    """``pages`` plus _host, _path, rule, verdict and model_verdict."""
    model = train(pages.sparkSession) if model is None else model
    parts = pages.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    scored = model.transform(_features(parts))
    by_model = F.when(F.col("_prediction") == 1.0, "block").otherwise("allow")
    return (scored.withColumn("_fit", fitting_rule(F.col("_host"), F.col("_path"), rules))
            .withColumn("model_verdict", by_model)
            .withColumn("rule", F.col("_fit.rule"))
            .withColumn("verdict", F.when(F.col("_fit").isNull(), F.col("model_verdict"))
                        .when(F.col("_fit.allow"), "allow").otherwise("block"))
            .drop("_fit", "_grams", "_features", "_raw", "_probability", "_prediction"))


def verdict_table(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict",
        "model_verdict")
