"""URL filter with redirect equivalence (operator 1, DataFrame functions only).

Rules judge urls by host suffix and path prefix, the longest rule first. Redirects, canonical links
and refresh targets tie urls together; connected components of these ties are computed with
distributed star steps, and a block decision for one member reaches the members that no rule names.
A url's own rule always stands, and an explicit allow anywhere in a component keeps its unnamed
members allowed. Urls in no component, and without a rule, are allowed.

Defined results: null urls and urls without ``://`` have empty host and path and no rule, so they
are allowed; null pages give no ties; repeated rows are judged one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

MAX_RULES = 1_000  # rules are part of the plan; longer lists belong in a table joined by host suffix


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str  # host and path, like example.com/en/

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the query's contract (fixed values).
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)

LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What ties compare: host, path and query; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Text of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = [
        F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.lit(r.text))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules=RULES) -> Column:
    named = [F.when(rule == r.text, F.lit(r.verdict)) for r in rules]
    return F.coalesce(*named, F.lit(None).cast("string"))


def page_ties(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) nodes tied by canonical links and refresh targets of pages."""
    source = pages.where(F.col(html).rlike("(?i)canonical|http-equiv") & F.contains(F.col(url), F.lit("://")))
    target = F.explode(F.filter(F.array(F.regexp_extract(html, LINK, 1), F.regexp_extract(html, REFRESH, 1)), lambda t: t != ""))
    found = source.select(F.col(url).alias("u"), target.alias("t"))
    scheme, site = F.regexp_extract("u", r"(?s)^(.*?)://", 1), F.concat(F.regexp_extract("u", r"(?s)^(.*?://)", 1), host_of(F.col("u")))
    full = (
        F.when(F.startswith("t", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("t")))
        .when(F.startswith("t", F.lit("/")), F.concat(site, F.col("t")))
        .when(F.contains("t", F.lit("://")), F.col("t"))
        .otherwise(F.concat(site, F.regexp_extract(path_of(F.col("u")), r"(?s)^(.*/)?", 0), F.col("t")))
    )
    return found.select(node_of(F.col("u")).alias("a"), node_of(full).alias("b"))


def judge_pages(
    pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_blocked) for every row; ``redirects`` adds (from_url, to_url) ties."""
    ties = page_ties(pages, url, html)
    if redirects is not None:
        ties = ties.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    ties = materialize(ties.where("a is not null and b is not null and a != b").distinct(), "url-ties")
    own = F.col(url).cast("string")
    judged = pages.select(F.col(key), own.alias("__url")).select(
        key, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), node_of(F.col("__url")).alias("__node")
    )
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if ties.isEmpty():
        judged = judged.withColumn("alias_blocked", F.lit(False))
    else:
        blocked = blocked_nodes(ties, rules)
        judged = judged.join(blocked, F.col("__node") == F.col("node"), "left").withColumn("alias_blocked", F.col("node").isNotNull())
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("alias_blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"), "alias_blocked")


def blocked_nodes(ties: DataFrame, rules=RULES) -> DataFrame:
    """Nodes of components that hold a blocked url and no explicitly allowed one."""
    members = materialize(connected_components(ties, "url-components"), "url-members")
    url = F.concat(F.lit("x://"), F.col("node"))
    verdict = verdict_of(rule_of(host_of(url), path_of(url), rules), rules)
    per_node = members.withColumn("v", verdict)
    bad = (
        per_node.groupBy("component")
        .agg(F.bool_or(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocks"), F.bool_or(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allows"))
        .where("blocks and not allows")
    )
    return members.join(bad.select("component"), "component", "left_semi").select("node").distinct()


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))
