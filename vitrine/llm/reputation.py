"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
public suffix. The rate of each is a beta-binomial posterior: the suffix is shrunk
towards all pages, the domain towards its suffix, the host towards its domain, by a
prior strength that the spread of the rates on that level gives (method of
moments). A host without outcomes has its domain's posterior, one of a domain without any
its suffix's. A page is blocked if the lower posterior bound of its host's bad rate is
above the limit. Explicit rules come first. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store

#: Prior strengths, in pages, are held within these bounds.
LEAST, MOST = 1.0, 1_000.0
#: Normal quantile of the one-sided bound, and the bad rate that it must be above.
QUANTILE = 1.645
LIMIT = 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that holds, as ``host/path``, and its verdict; null if none.

    Rules are (verdict, host, path); a rule holds for its host and all subdomains where the path
    starts with the rule's. Of equally long ones the first in the list wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        holds = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(holds, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(holds, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _level(counts: DataFrame, key: str, parent: str | None) -> DataFrame:
    return counts.groupBy(key, *([parent] if parent else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def strength(counts: DataFrame) -> float:
    """Beta prior strength of rates ``bad / n`` by moments: how many pages the mean is worth."""
    totals = counts.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.count("*")).first()
    n, bad, squares, groups = totals
    if not n or groups < 2 or not 0 < bad < n:
        return MOST
    mean = bad / n
    spread = counts.agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - mean) * (F.col("bad") / F.col("n") - mean))).first()[0]
    scale = n - squares / n
    between = (spread - (groups - 1) * mean * (1 - mean)) / scale if scale > 0 else 0.0
    if between <= 0:
        return MOST
    return min(MOST, max(LEAST, mean * (1 - mean) / between - 1))


def reputations(outcomes: DataFrame, store: Store, asked: DataFrame | None = None) -> DataFrame:
    """``(host, n, bad, rate, low)`` from ``outcomes(host, bad)``: posterior mean and lower bound of the bad rate.

    Outcomes are summed by host before anything else moves, so a hot host is a few rows. Null
    outcomes take no part. Hosts of one registered domain share its posterior as their prior. Hosts that
    only ``asked(host)`` has, each once, have n = 0 and what is above them: the posterior of the domain,
    else of the suffix, else the rate everywhere; an empty host without outcomes is left out.
    """
    hosts = store.put(
        outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))),
        "hosts",
    )
    domains, suffixes = _level(hosts, "domain", "suffix"), _level(hosts, "suffix", None)
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    everywhere = (bad + 1) / (n + 2)
    of_suffix, of_domain, of_host = strength(suffixes), strength(domains), strength(hosts)
    suffixes = suffixes.select("suffix", ((F.col("bad") + of_suffix * everywhere) / (F.col("n") + of_suffix)).alias("above"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", ((F.col("bad") + of_domain * F.col("above")) / (F.col("n") + of_domain)).alias("above")
    )
    weight = F.col("n") + of_host
    rate = (F.col("bad") + of_host * F.col("above")) / weight
    low = F.col("rate") - QUANTILE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    placed = hosts.join(domains, "domain")
    if asked is not None and n:
        new = asked.where("host <> ''").join(hosts, "host", "left_anti").select(
            "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")
        )
        new = new.join(domains, "domain", "left").join(suffixes.withColumnRenamed("above", "of_suffix"), "suffix", "left")
        placed = placed.select("host", "n", "bad", "above").unionByName(
            new.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"), F.coalesce("above", "of_suffix", F.lit(everywhere)).alias("above"))
        )
    return placed.withColumn("rate", rate).select("host", "n", "bad", "rate", low.alias("low"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    limit: float = LIMIT, store: Store | None = None,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``outcomes(host, bad)`` are labelled pages. The verdict is the longest rule's, else ``block``
    where the host's lower bound is above ``limit``, else ``allow``; hosts without outcomes are
    judged by their domain, else by their suffix, else by all pages. A null url, or one without ``://``, has an empty host and path. Repeated rows
    and rows with a null id are judged like any other.
    """
    store = store or Store(pages.sparkSession, "reputation")
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = reputations(outcomes, store, parts.select("host").distinct()).where(F.col("low") > limit).select("host", F.lit("block").alias("method"))
    return parts.join(blocked, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, "method", F.lit("allow")).alias("verdict")
    )
