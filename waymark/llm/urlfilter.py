"""URL verdicts by host-and-path rules and redirect equivalence.

A rule fits its host, all its subdomains and the paths that start with its
path; the longest rule wins.  Redirects and canonical links make urls aliases:
connected components of that graph carry a block decision to every alias.  A
url's own rule comes first, so an explicit allow is never overturned and an
allowed alias does not lift a block from the others.  Without a block in its
component a url is allowed.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is allowed; repeated rows get the same verdict; pages without html
make no edges; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import connected_components

#: The contract's rules, (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# a refresh's target: after the seconds, after url=, or both; quotes are cut off
_REFRESH = re.compile(r"\s*+(?:[\d.]++[\s;,]*+(?:url\s*=\s*)?|url\s*=\s*)(?:\"([^\"]*)|'([^']*)|(.+))", re.I | re.S)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to distinct (host, path) rows.

    Each host is looked up by each of its dotted suffixes, an equi-join that
    holds for rule tables of any size; ties in length go to the host, then path.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked_up = urls.withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host")
    fits = looked_up.where(F.col("path").startswith(F.col("rule_path")))
    size = F.length("rule_host") + F.length("rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), "rule_host", "rule_path", "rule_verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")
    )


class _Links(HTMLParser):
    """The targets of a page's canonical links and meta refreshes, and its base."""

    def __init__(self):
        super().__init__()
        self.targets: list[str] = []
        self.base: str | None = None

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        at = self.rawdata.find(">", i)  # as browsers read <![...: to the next > or the end
        return at + 1 if at >= 0 else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("link", "meta", "base"):
            values = {name: value or "" for name, value in reversed(attrs)}  # of a repeated attribute the first counts
            if tag == "base":
                self.base = values.get("href") if self.base is None else self.base
            elif tag == "link" and "canonical" in values.get("rel", "").lower().split():
                self.targets.append(values.get("href", ""))
            elif tag == "meta" and values.get("http-equiv", "").strip().lower() == "refresh" and (found := _REFRESH.match(values.get("content", ""))):
                self.targets.append(next((x for x in found.groups() if x), ""))


def _resolved(base: str, target: str) -> str:
    target = re.sub(r"[\t\r\n]", "", target).strip()
    if not target or re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", target):
        return target
    try:
        return urljoin(base, target)
    except ValueError:  # a base or target that is no url
        return ""


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, dst = [], []
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            links = _Links()
            links.feed(page.as_py())
            links.close()
            url = url.as_py()
            base = _resolved(url, links.base or "") or url
            for target in links.targets:
                src.append(url)
                dst.append(_resolved(base, target))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges url -> target from all canonical links and meta refreshes of the html, targets resolved against the page's url or base."""
    has_links = F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull()
    rows = pages.where(has_links).select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = rows.mapInArrow(_targets, "src string, dst string")
    return edges.where((F.col("src") != F.col("dst")) & F.col("dst").contains("://"))


def url_verdicts(urls: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(page_id, url) judged; edges(src, dst) are redirects and canonical links between urls."""
    rows = urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    linked = connected_components(edges)  # node, component
    nodes = linked.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    judged = match_rules(rows.select("host", "path").unionByName(nodes.select("host", "path")).distinct(), rules)
    blocked = nodes.join(judged.where("rule_verdict = 'block'"), ["host", "path"], "left_semi").select("component").distinct()
    spread = nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("url"), F.lit("block").alias("spread")).distinct()
    verdict = F.coalesce("rule_verdict", "spread", F.lit("allow"))
    return rows.join(judged, ["host", "path"], "left").join(spread, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
