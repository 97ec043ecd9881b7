"""URL filtering by association rules, in DataFrame operations only.

A URL's tokens are the parts of its host and path, all of them. Over labelled URLs, rules "tokens -> verdict" are
mined level by level (Apriori) and pruned by support, confidence and lift; a rule is dropped when a rule on
fewer of its tokens says the same with as much confidence. Matching uses an inverted index: each rule is filed under
its rarest token, URLs are joined on their tokens, and the remaining tokens of the rule are checked by array
containment, so one row per URL and filed rule comes out, never one per token that hits. Fixed rules on host and
path go first: the longest that fits decides.

Scale: transactions are the distinct token sets of labelled URLs, with how often each has which verdict; counting is
distributed and nothing is gathered on the driver. A rule covers at least ``MIN_COUNT`` labelled URLs, whatever their number,
so a host needs as many labels in a large table as in a small one; confidence, lift and redundancy do the pruning.
Lift prunes rules for a verdict that nearly all URLs have anyway: they say what the default says. A token set is
extended only while each of its tokens excludes URLs of the other verdict and some are left to exclude: a
rule on more tokens could not be surer than one on fewer otherwise, so no rule is lost, and tokens that always come
together, as in long paths, are not combined. The rule table is left to the optimizer, which broadcasts it by its measured size.

Defined cases: a URL that is null or has no ``://`` has empty host and path, no tokens and the default
verdict; labels that are null are left out; without labelled URLs no rule is mined; of rules that match,
the most confident, then best supported, then first by its tokens decides; repeated page ids are judged
row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import settle

ALLOW, BLOCK = "allow", "block"
MIN_COUNT = 30
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of ``rules`` (verdict, host/path) that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest goes last and so decides
        rule_host, slash, rest = rule.partition("/")
        fits = (host == rule_host) | host.endswith("." + rule_host)
        fits = fits & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, host words and path parts, each marked by its place."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.split(host, r"[.-]"), lambda x: F.concat(F.lit("word:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), x))
    every = F.array_distinct(F.concat(labels, words, parts))
    return F.filter(every, lambda x: F.length(x) > 5)  # more than the mark of its place


def mine_rules(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_labelled: int | None = None) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from ``labelled`` (tokens, verdict); of all of it unless the caller sets ``max_labelled``."""
    baskets = labelled.filter(F.col("verdict").isin(ALLOW, BLOCK) & (F.size("tokens") > 0)).select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict")
    n = (baskets := settle(baskets)).count()
    if max_labelled is not None and n > max_labelled:  # repeated rows are drawn one by one, so that none of them fills the sample
        place = F.pmod(F.xxhash64("tokens", "verdict", F.monotonically_increasing_id()), F.lit(1 << 30))
        baskets = settle(baskets.filter(place < int(max_labelled / n * (1 << 30))))
        n = baskets.count()
    needed = math.ceil(min(1.0, min_count / max(n, 1)) * n)
    held, found = _single_tokens(baskets, needed)
    levels = []
    while True:
        sure = (F.col("confidence") >= min_confidence) & (F.col("confidence") / (F.col("total") / n) >= min_lift)
        levels.append(
            found.filter(sure & (F.col("confidence") > F.col("surest"))).select(
                F.xxhash64(F.array_join("tokens", "\x00"), "verdict").alias("rule_id"), "tokens", "verdict", "confidence", (F.col("hits") / n).alias("support")
            )
        )
        grows = found.filter("misses > 0 AND misses < spared").select("verdict", "tokens")
        if grows.isEmpty():
            break
        held = settle(held.join(grows, ["verdict", "tokens"]))
        held, found = _longer(held, found, needed)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _measured(sets: DataFrame) -> DataFrame:
    return sets.withColumn("confidence", F.col("hits") / (F.col("hits") + F.col("misses")))


def _single_tokens(baskets: DataFrame, needed: int) -> tuple[DataFrame, DataFrame]:
    """The token sets of one token: where each is held, and its counts for each verdict.

    Held: (basket, verdict, tokens, hits, misses), the URLs of a basket with and without that verdict. Found: (verdict,
    tokens, hits, misses, total, confidence, surest, spared); ``surest`` is the confidence of the surest rule on some of the
    tokens, ``spared`` the fewest misses with one token less, at first all there are.
    """
    blocked = F.col("verdict") == BLOCK
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked")]
    for_each = [F.struct(F.lit(v).alias("verdict"), hits.alias("hits"), (F.col("n") - hits).alias("misses")) for v, hits in ((BLOCK, F.col("blocked")), (ALLOW, F.col("n") - F.col("blocked")))]

    def both(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*columns, F.inline(F.array(*for_each)))

    every = both(baskets.agg(*counts)).select("verdict", F.col("hits").alias("total"), F.col("misses").alias("spared"))
    single = baskets.select(F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(*counts).filter((F.col("blocked") >= needed) | (F.col("n") - F.col("blocked") >= needed))
    single = settle(single)
    found = _measured(both(single, "token").filter(F.col("hits") >= needed).join(F.broadcast(every), "verdict"))
    found = settle(found.select("verdict", F.array("token").alias("tokens"), "hits", "misses", "total", "confidence", F.lit(-1.0).alias("surest"), "spared"))
    # Equal sets of frequent tokens are one basket.
    numbered = settle(baskets.withColumn("url", F.monotonically_increasing_id()))
    frequent = numbered.select("url", "verdict", F.explode("tokens").alias("token")).join(single.select("token"), "token")
    frequent = frequent.groupBy("url", "verdict").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    frequent = settle(frequent.groupBy("tokens").agg(*counts).withColumn("basket", F.monotonically_increasing_id()))
    held = both(frequent, "basket", "tokens").select("basket", "verdict", F.explode("tokens").alias("token"), "hits", "misses")
    return held.select("basket", "verdict", F.array("token").alias("tokens"), "hits", "misses"), found


def _longer(held: DataFrame, found: DataFrame, needed: int) -> tuple[DataFrame, DataFrame]:
    """Held and found of the sets of one token more, where every set of one token less may grow."""
    ends = held.select("basket", "verdict", F.slice("tokens", 1, F.size("tokens") - 1).alias("stem"), F.element_at("tokens", -1).alias("end"), "hits", "misses")
    other = ends.select("basket", "verdict", "stem", F.col("end").alias("later"))
    held = settle(
        ends.join(other, ["basket", "verdict", "stem"])
        .filter("end < later")
        .select("basket", "verdict", F.concat("stem", F.array("end", "later")).alias("tokens"), "hits", "misses")
    )
    sets = held.groupBy("verdict", "tokens").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).filter(F.col("hits") >= needed)
    parts = sets.select("*", F.explode(F.transform(F.col("tokens"), lambda gone: F.filter("tokens", lambda x: x != gone))).alias("part"))
    parents = found.filter("misses > 0 AND misses < spared").select(
        "verdict", F.col("tokens").alias("part"), F.col("misses").alias("fewer"), "total", F.greatest("confidence", "surest").alias("sure")
    )
    found = (
        parts.join(parents, ["verdict", "part"])
        .groupBy("verdict", "tokens", "hits", "misses", "total")
        .agg(F.max("sure").alias("surest"), F.min("fewer").alias("spared"), F.count(F.lit(1)).alias("parts"))
        .filter((F.col("parts") == F.size("tokens")) & (F.col("misses") < F.col("spared")))
    )
    return held, settle(_measured(found).select("verdict", "tokens", "hits", "misses", "total", "confidence", "surest", "spared"))


def _filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules under their rarest token."""
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    found = urls.select(F.explode("tokens").alias("token")).join(used, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        rules.select("rule_id", F.explode("tokens").alias("token"))
        .join(found, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("n", "token")).getField("token").alias("token"))
    )
    return rules.join(rarest, "rule_id").select("token", F.col("tokens").alias("needed"), F.col("verdict").alias("mined"), "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined, confidence) of the distinct token sets in ``urls`` that some rule matches."""
    filed = settle(_filed(rules, urls))
    sets = urls.select("key", "tokens").distinct()
    hits = (
        sets.select("key", "tokens", F.explode("tokens").alias("token"))
        .join(filed, "token")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
    )
    order = F.struct(-F.col("confidence"), -F.col("support"), F.array_join("needed", " "), "mined")
    best = F.min_by(F.struct("mined", "confidence", F.array_join("needed", " ").alias("mined_rule")), order)
    return hits.groupBy("key").agg(best.alias("best")).select("key", "best.*")


def judge(pages: DataFrame, labelled_urls: DataFrame, fixed: list[tuple[str, str]], default: str = ALLOW, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A row per row of ``pages`` (page_id, url): host, path, rule, verdict, and the mined rule that decided.

    ``labelled_urls`` has columns url and verdict.
    """
    def parsed(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*more, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    tokens = tokens_of(F.col("host"), F.col("path"))
    rules = settle(mine_rules(parsed(labelled_urls, "verdict").select(tokens.alias("tokens"), "verdict"), min_count, min_confidence))
    judged = parsed(pages, "page_id").withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    key = F.sha2(F.concat_ws("\x00", "host", "path"), 256)
    urls = judged.filter(F.col("fixed").isNull()).select(key.alias("key"), tokens.alias("tokens"))
    matched = match_rules(urls, rules)
    return (
        judged.withColumn("key", key)
        .join(matched, "key", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fixed.rule").alias("rule"),
            F.coalesce("fixed.verdict", "mined", F.lit(default)).alias("verdict"),
            "mined_rule",
            "confidence",
        )
    )


def labels_by_number(pages: DataFrame, labels: DataFrame, bad: Column) -> DataFrame:
    """(url, verdict) of the pages whose url ends with the number of a labelled document: block if ``bad`` holds."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id IS NOT NULL")
    verdicts = labels.select("doc_id", F.when(bad, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"))
    return numbered.join(verdicts, "doc_id").select("url", "verdict")
