"""URL filters from association rules that FP-growth mines out of labelled urls.

A url is a set of tokens. Frequent combinations of tokens that come with one label
often enough are rules; a rule that a shorter one already covers goes. Rules are found
by their rarest token, then checked whole, and the surest one that matches decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables

#: Production parameters of mining: share of the distinct labelled urls, and number of them at least; confidence.
SUPPORT, LEAST, CONFIDENCE = 0.002, 20, 0.9
#: A rule below that confidence stands if its label is the likelier one and comes so many times as often as among all urls.
LIKELIER, LIFT = 0.5, 2.0
#: Standard errors that a rule's confidence is above the share of its label.
ERRORS = 3.0


@dataclass(frozen=True)
class Rule:
    """A stated rule: host with all its subdomains, and how the path begins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Production parameters: the stated rules.
STATED = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: What a url is that neither a stated nor a mined rule fits.
OTHERWISE = "allow"


def host_of(url: str = "url") -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, tables.UPPER, tables.LOWER)


def path_of(url: str = "url") -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated(rules=STATED) -> Column:
    """The longest of the stated rules that fits host and path: struct(rule, verdict), or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        made = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        fits = F.when(host & F.startswith(F.col("path"), F.lit(rule.path)), made).otherwise(fits)
    return fits


def tokens() -> Column:
    """Labels of the host, each with its place from the end, and parts of the path: distinct, sorted."""
    labels = F.reverse(F.split("host", r"\."))
    host = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    path = F.transform(F.split("path", r"[^A-Za-z0-9]+"), lambda x: F.concat(F.lit("p:"), x))
    known = F.filter(F.concat(host, path), lambda x: ~F.endswith(x, F.lit(":")))
    return F.array_sort(F.array_distinct(known))


def baskets(labelled: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(items, verdict) of the distinct labelled(tokens, verdict), and what each item stands for: item, of (tokens).

    Tokens that fewer than `least` distinct urls have are left out. Tokens that the same urls have, such as the parts of one long path,
    say the same: they are one item. Two tokens have the same urls if number, sum and exclusive or of the urls' hashes agree.
    """
    urls = labelled.select("tokens", "verdict").distinct()
    named = urls.select("verdict", "tokens", F.xxhash64("tokens", "verdict").alias("a"), F.xxhash64("verdict", "tokens").alias("b"))
    each = named.select("a", "b", "verdict", F.explode("tokens").alias("token"))
    holders = [F.sum(F.col("a").cast("decimal(38,0)")).alias("sum"), F.bit_xor("b").alias("xor"), F.count(F.lit(1)).alias("n")]
    known = each.groupBy("token").agg(*holders).filter(F.col("n") >= least)
    groups = known.groupBy("n", "sum", "xor").agg(F.array_sort(F.collect_list("token")).alias("of"))
    items = tables.stored(groups.select(F.get("of", F.lit(0)).alias("item"), "of"), "items")
    name = items.select("item", F.explode("of").alias("token"))
    found = each.join(name, "token").groupBy("a", "b", "verdict").agg(F.collect_set("item").alias("items"))
    return found.select("items", "verdict"), items


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from labelled(tokens, verdict).

    A rule needs `least` distinct labelled urls, and the share `support` of them; equal urls with one verdict count once. Tokens that
    the same labelled urls have are in a rule together. Of the rules of one verdict, one whose tokens contain
    those of another of at least its confidence is dropped. No labelled url gives no rule.
    """
    schema = "tokens array<string>, verdict string, confidence double, support double"
    labelled = labelled.filter(F.size("tokens") > 0)
    urls = labelled.distinct().count()
    if urls < least:
        return labelled.sparkSession.createDataFrame([], schema)
    rows, items = baskets(labelled, max(least, support * urls))
    rows = tables.stored(rows.select(F.array_append("items", F.concat(F.lit("="), F.col("verdict"))).alias("items")), "baskets")
    kept = max(1, rows.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support * urls, least) / kept), minConfidence=confidence).fit(rows)
    found = model.associationRules.select("antecedent", F.col("consequent")[0].alias("to"), "confidence", (F.col("support") * kept / urls).alias("support"))
    found = found.filter(F.startswith("to", F.lit("=")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("="))))
    found = found.select("antecedent", F.substring("to", 2, 1_000).alias("verdict"), "confidence", "support")
    whole = found.select("*", F.explode("antecedent").alias("item")).join(items, "item")
    whole = whole.groupBy("antecedent", "verdict", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("of"))).alias("tokens"))
    whole = tables.stored(whole.select("tokens", "verdict", "confidence", "support"), "rules")
    # a rule that covers another has all its tokens there, so its rarest one too
    short = indexed(whole, whole).select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), "key")
    asked = whole.select("tokens", "verdict", "confidence", F.explode("tokens").alias("key")).join(short, "key")
    inside = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    covered = asked.filter((F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence")) & inside)
    return tables.stored(whole.join(covered.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti"), "pruned")


def surprising(rules: DataFrame, labelled: DataFrame, confidence: float = CONFIDENCE, lift: float = LIFT, errors: float = ERRORS) -> DataFrame:
    """The rules that say more than the share of their verdict among the distinct labelled(tokens, verdict).

    The lower end of a rule's confidence, by Wilson's interval of `errors` standard errors, must be above that share;
    the confidence itself must be `confidence` or more, or `lift` times the share. A part of a rule with at least its confidence has more urls, so a rule
    that stands is never one that a dropped shorter one covered.
    """
    urls = labelled.filter(F.size("tokens") > 0).distinct()
    total = urls.count()
    if not total:
        return rules
    shares = urls.groupBy("verdict").agg((F.count(F.lit(1)) / total).alias("share"))
    p, n, z = F.col("confidence"), F.col("support") * total / F.col("confidence"), errors
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = (p + z * z / (2 * n) - spread) / (1 + z * z / n)
    known = rules.join(shares, "verdict").filter((low > F.col("share")) & ((p >= confidence) | (p >= lift * F.col("share"))))
    return known.select(*rules.columns)


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """rules with `key`, the token of each that the fewest urls have."""
    often = urls.select(F.explode("tokens").alias("token")).groupBy("token").count()
    each = rules.select("*", F.explode("tokens").alias("token")).join(often, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("key")
    return each.groupBy("tokens", "verdict", "confidence", "support").agg(rarest)


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct tokens of urls that a rule fits: tokens, verdict, matched (the rule's tokens)."""
    distinct = urls.select("tokens").distinct()
    index = indexed(rules, distinct).withColumnRenamed("tokens", "rule")
    asked = distinct.select("tokens", F.explode("tokens").alias("key"))
    hits = asked.join(index, "key").filter(F.size(F.array_except("rule", "tokens")) == 0)
    # the surest; then the better supported, the longer, and block before allow
    rank = F.struct("confidence", "support", F.size("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")
    best = hits.groupBy("tokens").agg(F.max(rank).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("verdict"), F.array_join("best.rule", " ").alias("matched"))


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules=STATED,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, matched.

    Urls that a stated rule fits get its verdict. The others are judged by rules mined from labels(id,
    bad), id being a page_id, that say more than the share of their label, and allowed if none fits; a null label is none. A null url, or one without
    ://, has an empty host and path. Repeated rows are judged alike, and ids with several labels
    count with each; an empty table gives an empty result. Only page_id and url are read.
    """
    urls = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    urls = tables.stored(urls.select("*", stated(rules).alias("said"), tokens().alias("tokens")), "urls")
    known = labels.filter("bad is not null").select("id", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    labelled = tables.stored(urls.join(known, F.col("page_id") == F.col("id")).select("tokens", "verdict"), "labelled")
    mined = surprising(mine(labelled, support, min(confidence, LIKELIER)), labelled, confidence)
    open_ = urls.filter("said is null")
    found = matched(open_, mined).withColumnsRenamed({"tokens": "of", "verdict": "mined"})
    both = urls.join(found, F.col("said").isNull() & (F.col("tokens") == F.col("of")), "left")
    return both.select(
        "page_id", "host", "path", F.col("said.rule").alias("rule"),
        F.coalesce("said.verdict", "mined", F.lit(OTHERWISE)).alias("verdict"), "matched",
    )
