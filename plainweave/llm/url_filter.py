"""URL filtering: explicit rules first, then exact membership of the host in a list by a Bloom filter cascade.

The cascade encodes the listed keys over the complete universe of keys in the corpus. Level 0 holds the listed keys;
each further level holds the keys of the other class that the level before lets through by mistake. As the universe is
known, the levels end when no mistake is left, and a key's class is told by the first level that
refuses it: exact for every key of the universe, without a join. Each level hashes the key anew.

What goes to the workers are the levels' bit arrays, 12 to 24 bits for each key that a level holds; a level of more than
2^27 bits (16 MB, about 11 million keys) stops the job rather than being sent.

The list is a table of hosts (``judge``'s ``block``).

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits it, and the empty host is a key like any other.
Repeated rows are judged one by one. An empty table, or one without listed hosts, needs one empty level. Of rules of one length
the first by name counts. Urls of any length are taken whole; only their hosts are shuffled. Further columns of the pages, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainweave.llm.cascade import Cascade
from plainweave.llm.common import stored

#: A host is listed if a part of it (between dots and hyphens) is one of these.
LISTED_PARTS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "warez")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(F.col("path"), F.lit(self.path))


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def listed(host: Column, parts: tuple[str, ...] = LISTED_PARTS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(x) for x in parts]))


def listed_hosts(pages: DataFrame, parts: tuple[str, ...] = LISTED_PARTS) -> DataFrame:
    """(host): a list to go with tables that bring none: the hosts of the pages with a listed part."""
    host, _ = host_and_path(F.col("url"))
    return pages.select(host.alias("host")).filter(listed(F.col("host"), parts)).distinct()


def judge(pages: DataFrame, block: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict (allow or block).

    ``block`` (host) is the list, by default ``listed_hosts`` of the pages; hosts on it that no page has don't enter the cascade. Nulls in it are left out.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = parsed.groupBy(F.col("host").alias("key")).agg(F.count("*").alias("urls"))
    named = (listed_hosts(pages) if block is None else block).select(F.col("host").alias("key"), F.lit(True).alias("on_list")).filter("key IS NOT NULL").distinct()
    cascade = Cascade(stored(universe.join(named, "key", "left").select("key", F.coalesce("on_list", F.lit(False)).alias("listed")), "hosts"))
    rule, verdict = F, F
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):  # the longest rule that fits wins
        rule, verdict = rule.when(r.fits(), F.lit(r.name)), verdict.when(r.fits(), F.lit(r.verdict))
    by_list = F.when(cascade.contains(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    if not rules:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), by_list.alias("verdict"))
    return parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.otherwise(by_list).alias("verdict"))
