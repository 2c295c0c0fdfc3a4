"""URL filter: association rules mined from labelled URLs, matched by an inverted index.

A URL is a set of tokens: the letter runs of its host, path and query, marked by
where they stand. Labelled URLs become transactions of their tokens and their
label; Spark's FP-growth finds the frequent sets, and rules whose consequent is a
label stay if support, confidence and lift suffice and no shorter rule is as sure.
The index lists each rule under its rarest token only; a URL's tokens look rules
up there, and a rule fires if all of its tokens are among the URL's. Explicit rules
of host and path come before mined ones. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import LOWER, UPPER, cut, table

# Explicit rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Least share and number of labelled URLs behind a rule; least confidence and lift.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 20, 0.6, 1.05
DEFAULT = "allow"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none if it is null."""

    def marked(mark: str, part: Column) -> Column:
        runs = F.regexp_extract_all(F.lower(part), F.lit(r"(\p{L}+)"), F.lit(1))
        return F.transform(runs, lambda t: F.concat(F.lit(f"{mark}:"), t))

    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = (marked("h", host(url)), marked("p", path(url)), marked("q", query))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*parts))), F.array().cast("array<string>"))


def explicit(host_of: Column, path_of: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits; null if none does."""
    fits = [
        F.when(
            ((host_of == h) | host_of.endswith(f".{h}")) & path_of.startswith(p),
            F.struct(
                F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")
            ),
        )
        for verdict, h, p in rules
    ]
    if not fits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    best = F.array_max(F.array(*fits))
    return best["rule"], best["verdict"]


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of pages with a label of the same id: block if of quality 0 or toxic."""
    of = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")
    )
    return (
        pages.filter("url is not null")
        .select("page_id", "url")
        .join(of, "page_id")
        .select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))
    )


def mine(
    known: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """(needs, verdict, confidence, support, rarest) of the rules of (url, label) rows.

    All frequent tokens of a URL are mined. Tokens that stand in exactly the same URLs
    are one item: boilerplate of many tokens would else give a set for each of its
    subsets. Each rule comes once for every token that may stand for its items.
    Repeated URLs of equal label count once. Without labelled URLs there are no rules.
    """
    rows = cut(known.distinct().select("url", "label", tokens(F.col("url")).alias("tokens")), "labelled-urls")
    n, blocked = rows.agg(F.count("*"), F.count_if(F.col("label") == "block")).first()
    empty = rows.limit(0).select(
        F.col("tokens").alias("needs"),
        F.col("label").alias("verdict"),
        F.lit(0.0).alias("confidence"),
        F.lit(0.0).alias("support"),
        F.col("label").alias("rarest"),
    )
    if not n:
        return empty
    least = max(min_count, min_support * n)
    if least > n:
        return empty
    apart = rows.select("url", "label", F.explode("tokens").alias("token"))
    # Equal counts, sums and combinations of 64-bit hashes: the same URLs. Sums are of 32 bits
    # each, so they do not overflow.
    mark = F.xxhash64("url", "label")
    counts = apart.groupBy("token").agg(
        F.count("*").alias("n"),
        F.bit_xor(mark).alias("xor"),
        F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("high"),
    )
    same = counts.filter(F.col("n") >= least).groupBy("n", "xor", "low", "high").agg(F.collect_list("token").alias("members"))
    counts = cut(
        same.select(
            "n", F.array_min("members").alias("item"), F.array_sort("members").alias("members"), F.explode("members").alias("token")
        ),
        "url-tokens",
    )
    chosen = (
        apart.join(counts.filter("token = item").select("token"), "token")
        .groupBy("url", "label")
        .agg(F.collect_list("token").alias("tokens"))
        .select(F.array_append("tokens", F.concat(F.lit("="), "label")).alias("items"))
    )
    # URLs without a frequent token still count as transactions
    rest = rows.join(chosen_urls(apart, counts), ["url", "label"], "left_anti").select(
        F.array(F.concat(F.lit("="), "label")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min_confidence).fit(chosen.unionByName(rest))
    rules = cut(
        model.associationRules.filter(F.col("consequent")[0].startswith("=") & (F.col("lift") >= min_lift)).select(
            F.array_sort("antecedent").alias("needs"),
            F.substring(F.col("consequent")[0], 2, 100).alias("verdict"),
            "confidence",
            "support",
        ),
        "url-rules",
    )
    # a rule is pruned if leaving one of its tokens out gives one that is as sure
    shorter = rules.select(
        F.col("needs").alias("whole"),
        "verdict",
        F.col("confidence").alias("own"),
        F.explode(F.transform("needs", lambda t: F.array_remove("needs", t))).alias("needs"),
    )
    worse = (
        shorter.join(rules.select("needs", "verdict", "confidence"), ["needs", "verdict"])
        .filter("confidence >= own")
        .select(F.col("whole").alias("needs"), "verdict")
    )
    kept = rules.join(worse, ["needs", "verdict"], "left_anti")
    return cut(_spelled_out(kept, counts), "url-index")


def _spelled_out(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules over items as rules over tokens: each token of an item in its place, and the
    rarest token of each rule (ties: the smallest)."""
    own = ["needs", "verdict", "confidence", "support"]
    members = counts.filter("token = item").select("token", "n", "members")
    parts = (
        rules.select(*own, F.posexplode("needs").alias("at", "token"))
        .join(members, "token")
        .groupBy(*own)
        .agg(F.array_sort(F.collect_list(F.struct("at", "n", "members"))).alias("parts"))
    )
    # one list of tokens after the other: all ways to take a member of each
    grown = F.aggregate(
        "parts",
        F.array(F.array().cast("array<struct<n:bigint,token:string>>")),
        lambda done, part: F.flatten(
            F.transform(
                done,
                lambda head: F.transform(
                    part["members"], lambda t: F.array_append(head, F.struct(part["n"].alias("n"), t.alias("token")))
                ),
            )
        ),
    )
    each = parts.select("verdict", "confidence", "support", F.explode(grown).alias("of"))
    return each.select(
        F.array_sort(F.transform("of", lambda x: x["token"])).alias("needs"),
        "verdict",
        "confidence",
        "support",
        F.array_min("of")["token"].alias("rarest"),
    )


def chosen_urls(apart: DataFrame, counts: DataFrame) -> DataFrame:
    return apart.join(counts.select("token"), "token", "left_semi").select("url", "label").distinct()


def matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, mined) of the distinct ``urls`` that a rule fires for: the verdict of the
    surest, then best supported, then longest rule; ties go to the smallest tokens."""
    looked_up = urls.select("url", tokens(F.col("url")).alias("tokens")).select(
        "url", "tokens", F.explode("tokens").alias("rarest")
    )
    fired = looked_up.join(index, "rarest").filter(F.size(F.array_except("needs", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("needs"), F.array_join("needs", " "), "verdict")
    return fired.groupBy("url").agg(F.max(order)["verdict"].alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, default: str = DEFAULT, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    The verdict is the explicit rule's, else the mined rule's, else ``default``.
    A null url has an empty host and path and gets the default; repeated rows each
    get a row. Other columns are not read. Empty in, empty out.
    """
    index = mine(labelled(pages, labels), **mining)
    found = matches(pages.select("url").filter("url is not null").distinct(), index)
    url = F.col("url")
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    return (
        pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
        .join(found, "url", "left")
        .select(
            "page_id",
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(verdict, "mined", F.lit(default)).alias("verdict"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
