"""URL filter: rules first, then the ratio of two character language models.

Both models have variable order: the probability of a character after three others is
smoothed with that after two, one and none. They learn from the urls that rules accept and
reject. A url that no rule fits is judged by its log-likelihood difference per character,
against the cut that separates accepted from rejected urls best in the fold left out of
the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seasonframe.llm.common import stored

Rule = tuple[str, str]

#: The models' alphabet: letters, one sign for all digits, five marks, anything else, the ends.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_:?^$"
ORDER = 3
SMOOTHING = 5.0
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both empty for NULL and where there is no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Verdict and pattern of the longest rule that fits ``host`` and ``path``, else NULL."""
    verdict = pattern = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        verdict, pattern = F.when(fits, kind).otherwise(verdict), F.when(fits, text).otherwise(pattern)
    return verdict, pattern


def _grams(urls: DataFrame) -> DataFrame:
    """One row for each character of a url, with the ``ORDER`` characters before it."""
    text = F.translate(F.lower(F.concat("host", "path")), "123456789", "000000000")
    text = F.concat(F.lit("^" * ORDER), F.regexp_replace(text, r"[^a-z0./\-_:]", "?"), F.lit("$"))
    gram = F.transform(F.sequence(F.lit(1), F.length("s") - ORDER), lambda i: F.substring(F.col("s"), i, F.lit(ORDER + 1)))
    return urls.withColumn("s", text).select("page_id", "given", F.explode(gram).alias("gram"))


def log_ratios(grams: DataFrame) -> DataFrame:
    """``gram, ratio`` for each gram of any url: log of its last character's probability in the
    model of accepted urls over that in the model of rejected ones.

    No table here can have more rows than the alphabet has words of ``ORDER + 1`` letters.
    """
    learn = F.pmod("page_id", F.lit(FOLDS)) != 0
    counted = stored(
        grams.groupBy("gram").agg(
            F.sum(((F.col("given") == "allow") & learn).cast("long")).alias("na"),
            F.sum(((F.col("given") == "block") & learn).cast("long")).alias("nb"),
        ).na.fill(0), "grams",
    )
    out = counted.select("gram")
    total = counted.agg(F.sum("na").alias("a"), F.sum("nb").alias("b"))
    pa = pb = F.lit(1.0 / len(ALPHABET))
    for k in range(1, ORDER + 2):
        end, before = F.substring("gram", ORDER + 2 - k, k), F.substring("gram", ORDER + 2 - k, k - 1)
        seen = counted.groupBy(end.alias(f"end{k}")).agg(F.sum("na").alias(f"a{k}"), F.sum("nb").alias(f"b{k}"))
        out = out.withColumn(f"end{k}", end).join(seen, f"end{k}")
        if k == 1:
            ta, tb = total.select("a").scalar(), total.select("b").scalar()
        else:
            context = counted.groupBy(before.alias(f"ctx{k}")).agg(F.sum("na").alias(f"ta{k}"), F.sum("nb").alias(f"tb{k}"))
            out = out.withColumn(f"ctx{k}", before).join(context, f"ctx{k}")
            ta, tb = F.col(f"ta{k}"), F.col(f"tb{k}")
        pa = (F.col(f"a{k}") + SMOOTHING * pa) / (ta + SMOOTHING)
        pb = (F.col(f"b{k}") + SMOOTHING * pb) / (tb + SMOOTHING)
    return stored(out.select("gram", F.log(pa / pb).alias("ratio")), "ratios")


def cut(scored: DataFrame) -> DataFrame:
    """One row, ``cut``: the hundredth of score whose split of the left-out fold errs least.

    Errors count by class, so that a rare class weighs as much. Of equal cuts the lowest is
    taken; without both classes there is no row. The scores fall into 2,001 bins at most.
    """
    held = scored.filter((F.pmod("page_id", F.lit(FOLDS)) == 0) & F.col("given").isNotNull())
    bin_ = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).cast("int")
    bins = held.groupBy(bin_.alias("bin")).agg(
        F.sum((F.col("given") == "allow").cast("long")).alias("a"), F.sum((F.col("given") == "block").cast("long")).alias("b")
    )
    every = Window.partitionBy(F.lit(0))
    below = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.try_divide(F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(every))
    passed = 1 - F.try_divide(F.coalesce(F.sum("b").over(below), F.lit(0)), F.sum("b").over(every))
    erred = bins.withColumn("error", F.round(lost + passed, 9)).filter("error IS NOT NULL")
    return erred.orderBy("error", "bin").limit(1).select((F.col("bin") / 100).alias("cut"))


def url_filter(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each page.

    A rule ``host/path`` fits its host and all subdomains where the url's path starts with
    its own; the longest wins. Other urls are accepted from the calibrated cut on, and all
    of them where rules give no url of either class to calibrate with. NULL and malformed
    urls have empty host and path and are judged as such. Rows with a NULL or repeated
    page_id are judged by one score of all rows of that id.
    """
    host, path = host_and_path("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdict, rule = longest_rule(rules)
    urls = stored(urls.withColumn("given", verdict).withColumn("rule", rule), "urls")
    grams = _grams(urls)
    scored = grams.join(log_ratios(grams), "gram").groupBy("page_id").agg(F.avg("ratio").alias("score"))
    same = urls.alias("u").join(scored.alias("s"), F.col("u.page_id").eqNullSafe(F.col("s.page_id")), "left")
    scored = stored(same.select("u.*", "score"), "scored")
    limit = cut(scored).scalar()
    judged = F.when(limit.isNull() | (F.col("score") >= limit), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", judged).alias("verdict"), "score")
