"""Operator 7: URL filters by rules and a character language-model ratio, with DataFrame functions only.

Rules block or allow a host with its subdomains under a path prefix; the longest that fits decides. Other URLs are
judged by two smoothed variable-order Markov models of characters, one of accepted and one of rejected URLs: the
probability of a character after up to four others, mixed at each order with that of the next shorter one. Accepted URLs are those
that a rule allows, rejected ones those that a rule blocks; so the models carry the rules on to URLs that no rule names. The mean
log ratio over a URL's characters decides; the threshold is a low quantile of it over accepted URLs that were held out of the
counts, so it is calibrated on the input.

Every URL gives its five-character grams; counts are summed inside tasks before they shuffle, and each distinct URL is scored
once. Defined results: null urls and urls without :// have an empty host and path and are judged on that; repeated
rows are judged alike; with no accepted or no rejected URL to learn from, or none held out, the method allows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.shared import written

#: Characters before the one whose probability is asked.
ORDER = 4
Rule = tuple[str, str]


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that decides, and its action; null where none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        text, action = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(action)
    return text, action


def grams(text: Column) -> Column:
    """Each character with the four before it; the text is padded."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - ORDER), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def log_ratios(counts: DataFrame, weight: float, alphabet: int) -> DataFrame:
    """gram, ratio: log(p_accepted / p_rejected) of the last character after the others, from (gram, accepted, rejected).

    Counts of shorter grams are summed from those of longer ones, and probabilities joined on from short to long. Tables are
    written before they are joined, so that Spark can split a context of very many grams.
    """
    both = [F.sum(c).alias(c) for c in ("accepted", "rejected")]
    levels = [counts.withColumnRenamed("gram", "suffix")]
    for k in range(ORDER, 1, -1):
        levels.append(written(levels[-1].groupBy(F.substring("suffix", 2, k).alias("suffix")).agg(*both), "level"))
    shorter = None
    for k, level in enumerate(reversed(levels), 1):  # suffixes of k + 1 characters
        totals = level.groupBy(F.substring("suffix", 1, k).alias("context")).agg(*(F.sum(c).alias(f"all_{c}") for c in ("accepted", "rejected")))
        joined = level.withColumns({"context": F.substring("suffix", 1, k), "lower": F.substring("suffix", 2, k)}).join(written(totals, "totals"), "context")
        joined = joined.join(shorter, "lower") if shorter is not None else joined.withColumns({"p_accepted": F.lit(1.0 / alphabet), "p_rejected": F.lit(1.0 / alphabet)})
        p = [((F.col(c) + weight * F.col(f"p_{c}")) / (F.col(f"all_{c}") + weight)).alias(f"p_{c}") for c in ("accepted", "rejected")]
        shorter = written(joined.select(F.col("suffix").alias("lower"), *p), "probabilities")
    return shorter.select(F.col("lower").alias("gram"), (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def url_filter(pages: DataFrame, rules: list[Rule], loss: float = 0.01, held_out: int = 5, weight: float = 2.0, alphabet: int = 64, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    parts = split.withColumn("rule", rule).withColumn("action", action)
    texts = parts.withColumn("text", F.concat("host", "path")).withColumn("sort", F.when(F.col("action") == "block", "rejected").when(F.col("action") == "allow", "accepted"))
    key = [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]
    urls = texts.groupBy(*key).agg(F.min("text").alias("text"), F.min("sort").alias("sort"))
    urls = written(urls.withColumn("held", (F.pmod("k1", F.lit(held_out)) == 0) & (F.col("sort") == "accepted")), "urls")
    count = lambda c: F.sum(F.when((F.col("sort") == c) & ~F.col("held"), 1).otherwise(0)).alias(c)
    spread = urls.select("k1", "k2", "sort", F.coalesce("held", F.lit(False)).alias("held"), F.explode(grams(F.col("text"))).alias("gram"))
    counts = written(spread.groupBy("gram").agg(count("accepted"), count("rejected")), "grams")
    ratios = written(log_ratios(counts, weight, alphabet), "ratios")
    scored = written(spread.join(ratios, "gram").groupBy("k1", "k2", "held").agg(F.round(F.avg("ratio"), 4).alias("score")), "scores")
    learned = counts.agg(F.sum("accepted"), F.sum("rejected")).first()
    threshold = scored.where("held").agg(F.percentile("score", F.lit(loss))).first()[0]
    usable = bool(learned[0] and learned[1]) and threshold is not None
    kept = (F.col("score") >= threshold) if usable else F.lit(True)
    judged = texts.select("page_id", "host", "path", "rule", "action", *key).join(scored.select("k1", "k2", "score"), ["k1", "k2"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(kept, "allow").otherwise("block")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
