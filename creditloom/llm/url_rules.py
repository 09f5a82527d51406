"""URL filters: host and path rules, and association rules mined from labelled pages.

Spark's FP-growth mines sets of URL tokens that occur with the label ``bad``; rules below the least support,
confidence or lift are pruned. The rules lie in an inverted index under their rarest token. A URL's tokens are looked up
there, and a rule matches if the URL has all its tokens. The index is joined, not broadcast by hint: Spark knows
its size, and splits a token that very many URLs have.

The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path follows up to ``?``, ``#`` or
the end. A URL that is null or has no ``://`` has an empty host and path, and no tokens. A given rule fits its
host and all subdomains, if the path starts with the rule's; the longest wins and is final. Otherwise a URL that a
mined rule matches is blocked. Repeated rows come out as often as they came in. Without labels nothing is mined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import quoted, stored

BAD, GOOD = "label=bad", "label=good"
#: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


@dataclass(frozen=True)
class Mining:
    support: float = 0.001
    #: A rule is seen on this many pages at least, however few are labelled.
    pages: int = 25
    confidence: float = 0.5
    lift: float = 1.5


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Scheme, labels of the host by their place from the right, words of the path, parameter names and the fragment.

    Tokens are distinct, and none follows from others: every redundant one would double the frequent sets. Numbers
    say nothing about other pages and are left out.
    """
    host, path = host_of(url), path_of(url)
    scheme = F.regexp_extract(url, r"^(?s:(.*?))://", 1)
    labels = F.transform(
        F.reverse(F.split(host, r"\.")), lambda x, k: F.concat(F.lit("host"), (k + 1).cast("string"), F.lit(":"), x)
    )
    words = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parameters = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0]))
    fragment = F.when(url.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.concat(F.lit("scheme:"), scheme)), labels, words, parameters, fragment)
    telling = F.filter(F.array_distinct(every), lambda x: ~x.rlike(r"^\w+:[0-9]*$") | (x == "fragment:"))
    return F.when(url.contains("://"), telling).otherwise(F.array().cast("array<string>"))


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, own_verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule = F.when(fits, F.lit(own_host + own_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(own_verdict)).otherwise(verdict)
    return rule, verdict


def labelled_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """items: the tokens of each labelled URL and its label; a page with a poor or a toxic label is bad. Stored."""
    poor = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(poor).alias("bad"))
    urls = pages.select(quoted(id_col).alias("doc_id"), tokens_of(quoted(url_col)).alias("tokens"))
    label = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    met = urls.where(F.size("tokens") > 0).join(known, "doc_id")
    return stored(met.select(F.array_append("tokens", label).alias("items")), "labelled-urls")


def mined_rules(transactions: DataFrame, mining: Mining = Mining()) -> DataFrame | None:
    """rule_id, tokens, anchor, confidence, support of the rules for bad pages; None with fewer labels than a rule needs. Stored."""
    pages = transactions.count()
    if pages < mining.pages:
        return None
    support = max(mining.support, mining.pages / pages)
    parts = int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = FPGrowth(itemsCol="items", minSupport=support, minConfidence=mining.confidence, numPartitions=parts)
    model = mine.fit(transactions)
    rules = model.associationRules.where(
        (F.element_at("consequent", 1) == BAD)
        & (F.col("lift") >= mining.lift)
        & ~F.array_contains("antecedent", GOOD)
    )
    rules = rules.select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule_id"),
        F.array_sort("antecedent").alias("tokens"),
        "confidence",
        "support",
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    anchors = (
        rules.select("rule_id", F.explode("tokens").alias("token"))
        .join(single, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("freq", "token")).alias("rarest"))
        .select("rule_id", F.col("rarest.token").alias("anchor"))
    )
    return stored(rules.join(anchors, "rule_id"), "url-rules")


def judged_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    mining: Mining = Mining(),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the best mined rule's tokens, or null) and its confidence."""
    url = F.col("url")
    pairs = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("url"))
    distinct = pairs.groupBy("page_id", "url").agg(F.count("*").alias("times"))
    mined = mined_rules(labelled_urls(pages, labels, id_col, url_col), mining)
    if mined is None:
        best = distinct.withColumn("best", F.lit(None).cast("struct<confidence:double,tokens:array<string>>"))
    else:
        tokens = distinct.withColumn("tokens", tokens_of(url))
        met = tokens.withColumn("token", F.explode_outer("tokens")).join(
            mined.select(F.col("anchor").alias("token"), F.col("tokens").alias("needs"), "confidence"), "token", "left"
        )
        match = F.when(
            F.size(F.array_except("needs", "tokens")) == 0, F.struct("confidence", F.col("needs").alias("tokens"))
        )
        best = met.groupBy("page_id", "url").agg(F.max("times").alias("times"), F.max(match).alias("best"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.withColumns({"host": host_of(url), "path": path_of(url)}).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, method).alias("verdict"),
        F.array_join("best.tokens", " ").alias("mined"),
        F.col("best.confidence").alias("confidence"),
    )
