"""URL filters: listed rules, then association rules mined from labels.

Listed rules name a host, with its subdomains, and the beginning of a path; of those
that fit, the longest decides.  All other URLs are judged by association rules: the
tokens of labelled URLs (scheme, host labels and suffixes, path words, query keys,
file type) are mined by Spark's FP-growth together with the label.  Rules that lead
to either verdict are kept if their support and confidence suffice and they are right
more often than the verdict is anyway (lift of 1 or more).  Each rule is posted in an
inverted index under its rarest token.  A URL meets only the rules posted under its
own tokens and a rule applies if the URL has all its tokens.  The one with the
highest rank decides, then the more confident, then the one with more support, then
block.  The rank of a rule is its lift, but not below that of a less confident rule
whose tokens are among its own: the exception beats what it is an exception to.
URLs with equal token sets are judged once.  The support floor is a share of the labelled
URLs, so a host with fewer labelled URLs than that has no rule of its own.

Labels belong to documents; a page shows the document whose id is the last number
of its path.

Defined results: a null URL and one without ``://`` have empty host and path, fit no
listed rule and, having no tokens, are allowed; repeated rows repeat; other columns
are ignored; an empty table gives no rows; without labelled pages no rule is mined
and all that the list leaves open is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, written

# The listed rules (verdict, host, path).
LISTED = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Least share of the labelled URLs, least number of them and least confidence of a mined rule.
MIN_SUPPORT, MIN_EXAMPLES, MIN_CONFIDENCE = 0.002, 20, 0.6
DEFAULT = "allow"

RULES = "rule_id long, tokens array<string>, verdict string, confidence double, support double, lift double, rank double, rarest string"

_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _upper, _lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LISTED) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null. ``rules``: a short list, tried in order of length."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; runs of digits count as one token."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.when(n > 1, F.concat(F.lit("suffix:"), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1)))
    words = lambda kind, parts: F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.concat(F.lit(kind), F.regexp_replace(w, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "(?s)^(.*?)://", 1)))
    none = F.lit([]).cast("array<string>")
    every = F.concat(
        scheme, words("host:", F.when(n > 2, F.slice(labels, 1, n - 2)).otherwise(none)), F.array(suffix),
        words("path:", F.split(path, "[/._-]+")), words("query:", F.split(query, "&")), F.array(F.when(F.contains(url, F.lit("#")), F.lit("fragment"))),
    )
    return F.when(F.contains(url, F.lit("://")), F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull())))).otherwise(none)


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and verdict (block: toxic or of low quality) of the pages whose document has a label."""
    shown = pages.select(tokens_of(F.col("url")).alias("tokens"), F.regexp_extract(path_of(F.col("url")), "([0-9]+)[^0-9]*$", 1).try_cast("long").alias("_doc"))
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.when((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0), "block").otherwise("allow").alias("verdict"))
    return shown.join(known, "_doc").select("tokens", "verdict")


def mine(examples: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_examples: int = MIN_EXAMPLES) -> DataFrame:
    """Rules (see ``RULES``) from tokens to a verdict, mined from all of ``examples`` (tokens, verdict)."""
    spark = examples.sparkSession
    baskets = examples.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    if not (n := baskets.count()):
        return spark.createDataFrame([], RULES)
    support = min(1.0, max(min_support, min_examples / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    ones = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("_token"), F.col("freq").alias("_freq"))
    told = F.col("consequent")[0]
    rules = model.associationRules.where(F.startswith(told, F.lit("verdict:")) & (F.col("lift") >= 1))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(told, 9, 100).alias("verdict"), "confidence", "support", "lift").withColumn("rule_id", F.xxhash64("tokens", "verdict"))
    rarest = rules.select("rule_id", F.explode("tokens").alias("_token")).join(ones, "_token").groupBy("rule_id").agg(F.min_by("_token", F.struct("_freq", "_token")).alias("rarest"))
    rules = written(rules.join(rarest, "rule_id"), "rules")
    within = fitting(rules.select("tokens", F.col("confidence").alias("_sure")), rules).where(F.col("confidence") < F.col("_sure"))
    beaten = within.groupBy("tokens").agg(F.max("lift").alias("_beaten"))
    ranked = rules.join(beaten, "tokens", "left").withColumn("rank", F.greatest("lift", F.coalesce("_beaten", "lift")))
    return written(ranked.select("rule_id", "tokens", "verdict", "confidence", "support", "lift", "rank", "rarest"), "rules")


def fitting(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``token_sets`` (sorted ``tokens`` and other columns) with each rule that applies, found under its rarest token."""
    index = rules.select(F.col("rarest").alias("_token"), F.col("tokens").alias("needs"), *(c for c in ("verdict", "confidence", "support", "lift", "rank") if c in rules.columns))
    met = token_sets.withColumn("_token", F.explode("tokens")).join(bounded_broadcast(index, rules.count()), "_token").drop("_token")
    return met.where(F.size(F.array_except("needs", "tokens")) == 0)


def judge(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, verdict and the deciding rule (its tokens) for the token sets to which a rule applies; ``token_sets`` has distinct sorted ``tokens``."""
    best = fitting(token_sets.select("tokens"), rules).groupBy("tokens").agg(F.max(F.struct("rank", "confidence", "support", "verdict", "needs")).alias("_best"))
    return best.select("tokens", F.col("_best.verdict").alias("verdict"), F.col("_best.needs").alias("needs"))


def judge_pages(pages: DataFrame, labels: DataFrame, listed: Sequence[tuple[str, str, str]] = LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_examples: int = MIN_EXAMPLES) -> DataFrame:
    """page_id, host, path, rule, verdict, what decided (``by``: list, mined or default) and the tokens of a mined rule for each page."""
    rules = mine(labelled(pages, labels), min_support, min_confidence, min_examples)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_listed", listed_rule(F.col("host"), F.col("path"), listed))
    by_list = ruled.where("_listed is not null").select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), F.col("_listed.verdict").alias("verdict"), F.lit("list").alias("by"), F.lit(None).cast("array<string>").alias("mined_rule"))
    rest = ruled.where("_listed is null").select("page_id", "host", "path", tokens_of(F.col("url")).alias("tokens"))
    mined = judge(rest.select("tokens").distinct(), rules).withColumnRenamed("verdict", "_mined")
    by_rule = rest.join(mined, "tokens", "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("_mined", F.lit(DEFAULT)).alias("verdict"), F.when(F.col("_mined").isNotNull(), "mined").otherwise("default").alias("by"), F.col("needs").alias("mined_rule"),
    )
    return by_list.unionByName(by_rule)
