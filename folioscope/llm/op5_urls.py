"""URL filters: host and path rules, and a linear model for what no rule fits.

The model is a logistic regression on hashed character n-grams of host and path,
trained by Spark's own library on a small labelled URL table (`LABELLED`, or another
one that is passed). It has one weight per hash bucket, a fixed number. Hashing, scaling
and scoring run in the JVM as DataFrame transformations; no Python runs on the executors.

A null URL, or one without `://`, has an empty host and path, so no rule and the
model's verdict on an empty string. Repeated rows and null page IDs are judged like
others; only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import prepare, table

# Fixed values: (rule as host/path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))

BUCKETS = 1 << 16

# The labelled table: common words, alone and in pairs, dealt in turn to the same frames, so
# that only names tell the labels apart. Each label has 80 words, so as many of each frame.
FRAMES = ("https://www.{}.example.org/en/12", "http://blog.{}.example.net/fr/2045",
          "https://m.{}.org/de/310/", "http://{}.net/es/77.html", "https://{}.example.com/en/31950")
WORDS = {
    0: """library garden school museum railway weather history science village college theatre
        gallery archive travel harbour river mountain forest bird flower kitchen recipe cooking
        bakery botany nature society association institute foundation council clinic hospital
        dental physics maths biology chemistry geology astronomy journal review gazette herald
        chronicle poetry novel books reading music choir orchestra painting pottery knitting
        carpentry cycling hiking sailing swimming football cricket chess farming orchard vineyard
        dairy heritage castle bridge lighthouse teacher student children family community
        volunteer software engineering photography""".split(),
    1: """casino poker slots roulette bingo lottery jackpot betting gambling bonus spins viagra
        cialis pills pharma steroids xanax diet slimming enlargement porn xxx sex sexy nude cams
        escort hookup dating adult erotic singles loans payday cash debt forex bitcoin profit
        rich millionaire earn money free prize winner win gift voucher coupon cheap discount
        deals replica fake rolex warez crack keygen serial torrent pirated hacked cheats click
        traffic seo backlinks followers spam bulkmail popup adware malware phishing verify login
        account suspended ads""".split(),
}


def _names(words: list[str]) -> list[str]:
    """Each word alone, and before two others, with and without a hyphen."""
    n = len(words)
    return (words + [f"{w}-{words[(i + 17) % n]}" for i, w in enumerate(words)]
            + [f"{w}{words[(i + 31) % n]}" for i, w in enumerate(words)])


LABELLED = tuple((FRAMES[i % len(FRAMES)].format(name), label)
                 for label, words in WORDS.items() for i, name in enumerate(_names(words)))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")
                  ).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return (F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def grams(text: Column, least: int = 3, most: int = 4) -> Column:
    """The character n-grams of a text with marked ends; a run of digits counts as one 0."""
    text = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
    return F.flatten(F.array(*(_of_length(text, n) for n in range(least, most + 1))))


def _of_length(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(
        starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def labelled_urls(spark: SparkSession, rows=LABELLED) -> DataFrame:
    return (spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in rows)))
        .alias("row")).select("row.*"))


def with_grams(urls: DataFrame) -> DataFrame:
    return urls.withColumn("_grams", grams(F.concat("host", "path")))


def train(labelled: DataFrame, ridge: float = 0.0002) -> PipelineModel:
    """Hash the n-grams, scale the counts, and fit a logistic regression on them."""
    host, path = parts(F.col("url"))
    rows = with_grams(labelled.select("label", host.alias("host"), path.alias("path")))
    return Pipeline(stages=[
        HashingTF(numFeatures=BUCKETS, inputCol="_grams", outputCol="_counts"),
        Normalizer(inputCol="_counts", outputCol="_scaled"),
        LogisticRegression(featuresCol="_scaled", regParam=ridge, maxIter=60,
                           standardization=False, probabilityCol="_probability"),
    ]).fit(rows.coalesce(1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or above it and whose path begins the URL's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        top, _, below = text.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: PipelineModel, rules=RULES,
          block_from: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of being blocked."""
    host, path = parts(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = model.transform(with_grams(
        pages.select("page_id", host.alias("host"), path.alias("path"))))
    score = vector_to_array("_probability")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(score >= block_from, "block")
                                    .otherwise("allow")).alias("verdict"), score.alias("score"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, train(labelled_urls(spark)))
