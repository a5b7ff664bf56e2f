"""URL verdicts: rules first, then a ratio of two character models.

Rules name a host and a path. URLs that a rule decides also teach: those allowed are
the accepted class, those blocked the rejected one. For each class a variable-order
Markov model of the URL's characters is smoothed by Witten-Bell interpolation. The
log-ratio of a character after its context is written as a sum of differences
between orders. A known context gives the ratio of the classes' escape weights wherever it stands, and a
known run the difference to that, so a URL's score is a plain sum over its character
runs, new ones too, divided by its length. The cut is calibrated on a fold of the rule-decided URLs that the models haven't
seen. All of it is DataFrame operations.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.shared import stored

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Stands before a text.
_START = "\u0002"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _runs(text: Column, order: int) -> Column:
    """All runs of 1 to order + 1 characters that end at each character, the text between marks. The array of characters is made once and read by place, so time is linear."""
    chars = F.concat(F.array(*[F.lit(_START)] * order), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("\u0003")))

    def ending(cs: Column, i: Column) -> Column:
        return F.array(*(F.concat(*(F.get(cs, i - j) for j in range(k, -1, -1))) for k in range(order + 1)))

    return F.transform(F.array(chars), lambda cs: F.flatten(F.transform(F.sequence(F.lit(order), F.size(cs) - 1), lambda i: ending(cs, i))))[0]


def _model(runs: DataFrame, order: int) -> tuple[DataFrame, float, float]:
    """``runs``: columns run and accepted. (columns run and delta: what it adds to a sum as a run and as the context of what follows; what each
    character adds, also an unseen one; what the start of a text adds)."""
    counts = runs.groupBy("run").agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    counts = stored(counts.withColumn("k", F.length("run") - 1), "runs")
    marks = counts.where("k = 0").agg(F.count("*").alias("v"), F.sum("a").alias("na"), F.sum("r").alias("nr")).first()
    v, na, nr = marks.v or 1, marks.na or 0, marks.nr or 0
    level = counts.where("k = 0").select("run", ((F.col("a") + 1) / F.lit(float(na + v))).alias("pa"), ((F.col("r") + 1) / F.lit(float(nr + v))).alias("pr"))
    unseen = math.log((nr + v) / (na + v))
    out = level.select("run", (F.log("pa") - F.log("pr") - F.lit(unseen)).alias("delta"))
    for k in range(1, order + 1):
        # substr(1, k) is the context, substr(2) the run one order lower.
        at = counts.where(F.col("k") == k).withColumn("context", F.substring("run", 1, k)).withColumn("lower", F.expr("substring(run, 2)"))
        contexts = at.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum((F.col("a") > 0).cast("int")).alias("ta"), F.sum((F.col("r") > 0).cast("int")).alias("tr")
        )
        below = level.select(F.col("run").alias("lower"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        # A class without the context keeps the lower order's probability.
        p = lambda n, t, total, q: (F.col(n) + F.greatest(t, F.lit(1)) * F.col(q)) / (F.col(total) + F.greatest(t, F.lit(1)))
        weight = lambda t, total: F.log(F.greatest(t, F.lit(1)) / (F.col(total) + F.greatest(t, F.lit(1))))
        contexts = contexts.withColumn("escape", weight("ta", "na") - weight("tr", "nr"))
        joined = at.join(contexts, "context").join(below, "lower")
        level = stored(joined.select("run", "context", "escape", p("a", "ta", "na", "qa").alias("pa"), p("r", "tr", "nr", "qr").alias("pr"), "qa", "qr"), "level")
        out = out.unionByName(level.select("run", (F.log("pa") - F.log("pr") - F.log("qa") + F.log("qr") - F.col("escape")).alias("delta")))
        out = out.unionByName(level.groupBy("context").agg(F.first("escape").alias("delta")).withColumnRenamed("context", "run"))
    model = stored(out.groupBy("run").agg(F.sum("delta").alias("delta")), "model")
    # The marks before a text are contexts of its first character, but no runs of it.
    start = model.where(F.col("run").isin([_START * k for k in range(1, order + 1)])).agg(F.sum("delta")).first()[0] or 0.0
    return model, unseen, start


def _scores(urls: DataFrame, model: DataFrame, unseen: float, start: float, order: int, salts: int = 16) -> DataFrame:
    """id and the length-normalised log-ratio. Common runs are dealt by a salt of the id; the model is repeated for each salt."""
    runs = urls.select("id", F.explode(_runs(F.col("text"), order)).alias("run")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    table = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    sums = runs.join(table, ["run", "salt"]).groupBy("id").agg(F.sum("delta").alias("sum"))
    return urls.join(sums, "id", "left").select("id", F.round((F.coalesce("sum", F.lit(0.0)) + F.lit(start)) / (F.length("text") + 1) + F.lit(unseen), 9).alias("score"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (null where a rule decides).

    A url that is null or has no ``://`` has an empty host and path, and the models judge its
    text (null: empty). Equal urls get equal verdicts. Where the rules decide nothing in
    one class the models are even and all else is allowed. Other columns are not
    looked at.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("id"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumn("rule", rule).withColumn("ruled", verdict)

    # Distinct urls; without a scheme, as that says nothing of the page.
    urls = judged.groupBy("id").agg(F.min("ruled").alias("ruled"), F.count("*").alias("pages"))
    fold = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 5 == 0
    urls = stored(urls.withColumn("text", F.regexp_replace("id", r"^(?s:.*?)://", "")).withColumn("fold", fold), "urls")
    # A url's few bytes become a hundred runs and more, so they are spread before that.
    spread = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    taught = spread.where("ruled is not null and not fold").select(F.explode(_runs(F.col("text"), order)).alias("run"), (F.col("ruled") == "allow").alias("accepted"))
    scores = stored(_scores(spread.where("ruled is null or fold").select("id", "text"), *_model(taught, order), order), "scores")

    # Balanced accuracy of the cut "score >= bin" over at most 4,001 bins of calibration scores.
    tried = scores.join(urls.where("ruled is not null").select("id", "ruled"), "id")
    bins = tried.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100))).alias("bin")).agg(
        F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.sum((F.col("ruled") == "block").cast("long")).alias("bad")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost, caught = F.coalesce(F.sum("good").over(below), F.lit(0)), F.coalesce(F.sum("bad").over(below), F.lit(0))
    rated = bins.select("bin", (F.sum("bad").over(total) * (F.sum("good").over(total) - lost) + F.sum("good").over(total) * caught).alias("rate"), F.abs("bin").alias("far"))
    best = rated.where("rate > 0").orderBy(F.desc("rate"), "far", "bin").first()
    cut = best.bin / 100 if best else -1e9

    out = judged.join(scores, "id", "left")
    said = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select(F.col("page").alias(id_col), "host", "path", "rule", said.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
