"""URL verdicts: written rules first, then trust and distrust spread over the links between hosts.

Personalised PageRank runs twice over the host graph: trust flows along links from hosts whose pages
rules allow, distrust flows against them from hosts whose pages rules block (whoever links to a
blocked host shares its blame).  A host is blocked when distrust makes up too much of both.
Everything is DataFrame code; ranks live in saved tables, one small row for each host.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tables import drop, save, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where paths start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Iterations of a spread of fixed length, share of a rank that is handed on, and share of distrust from
#: which a host is blocked.
ROUNDS, DAMPING, LIMIT = 8, 0.85, 0.5
#: Share of its rank by which no host may change in the last round of a spread that runs until it settles.
TOLERANCE = 1e-9

#: Host part of absolute links, and host names of two labels or more that the page's text mentions.
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"
#: Labels are taken for good (++): Java would go one call deeper for each otherwise, and a page may have thousands.
_MENTION = r"(?<![A-Za-z0-9.@-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to / ? # or the end, A-Z lowered; then up to ? # or
    the end.  Both are empty for null urls and urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(text, verdict) of the longest rule that fits (ties: the lesser text), or null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) for links and mentions between different hosts that both have pages.

    pages: host, html.
    """
    named = pages.where("host <> ''")
    found = F.array_union(F.regexp_extract_all("html", F.lit(_LINK), 1), F.regexp_extract_all("html", F.lit(_MENTION), 0))
    pairs = (
        named.where("html is not null")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pairs.join(named.select(F.col("host").alias("dst")).distinct(), "dst").select("src", "dst", "n")


def _settled(old: DataFrame, new: DataFrame) -> bool:
    """Whether each rank of new is that of old, but for TOLERANCE of itself."""
    before = old.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
    moved = (F.abs(F.col("trust") - F.col("t")) > TOLERANCE * F.col("trust")) | (F.abs(F.col("distrust") - F.col("d")) > TOLERANCE * F.col("distrust"))
    return new.join(before, "host").where(moved).limit(1).count() == 0


def spread(links: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust): personalised PageRank along links and, for distrust, against them.

    links: src, dst, n; seeds: host, good, bad (any weights; hosts without seeds have zeros).  What a
    host without onward links would hand on is lost, so ranks sum to one at most.

    rounds: so many iterations, or None: until no host gains a first rank and none changes by more than
    TOLERANCE of its own, however small it is, as verdicts are ratios.
    """
    totals = seeds.agg(F.greatest(F.sum("good"), F.lit(1e-300)).alias("g"), F.greatest(F.sum("bad"), F.lit(1e-300)).alias("b"))
    seeds = save(
        seeds.crossJoin(F.broadcast(totals)).select(  # one row of totals
            "host", (F.col("good") / F.col("g")).alias("good"), (F.col("bad") / F.col("b")).alias("bad")
        )
    )
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("into"))
    links = save(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back")))
    ranks = save(seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")))
    for _ in itertools.count() if rounds is None else range(rounds):
        # Both sides are written tables: where ranks are too many to be broadcast, a hub's edges are split by skew.
        of = small(ranks)
        trust = links.join(of, F.col("src") == F.col("host")).where("trust > 0").select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        distrust = links.join(of, F.col("dst") == F.col("host")).where("distrust > 0").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        gained = trust.unionByName(distrust).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        mix = lambda seed, gain: F.lit(1 - damping) * F.col(seed) + F.lit(damping) * F.coalesce(gain, F.lit(0.0))
        new = save(seeds.join(gained, "host", "left").select("host", mix("good", F.col("t")).alias("trust"), mix("bad", F.col("d")).alias("distrust")))
        settled = rounds is None and _settled(ranks, new)
        drop(ranks)
        ranks = new
        if settled:
            break
    return ranks


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, limit: float = LIMIT) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, host, path, rule, verdict,
    trust, distrust, blame (distrust's share of both; null without either).

    verdict is the longest fitting rule's, or block where the host's blame reaches limit, or allow.
    Null or odd urls have an empty host, which no rule fits and no rank reaches: they are allowed.
    Null html has no links; repeated rows are judged each by itself; further columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = parsed.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules))
    seeds = (
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("fit.verdict") == "block").cast("double").alias("bad"))
    )
    ranks = small(save(spread(save(host_links(parsed)), seeds, rounds=None).withColumnRenamed("host", "ranked")))
    blame = F.col("distrust") / F.expr("nullif(trust + distrust, 0)")
    return (
        ruled.join(ranks, F.col("host") == F.col("ranked"), "left")
        .select(
            "page_id", "host", "path", F.col("fit.text").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(blame >= limit, "block").otherwise("allow")).alias("verdict"),
            F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), F.round(blame, 6).alias("blame"),
        )
    )
