"""URL rules, with block decisions carried over redirect and canonical-link equivalence."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import read, store
from graftline.llm.components import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(lines: str) -> list[Rule]:
    """`allow org/` or `block example.org/es/`, one a line."""
    found = [x.split() for x in lines.splitlines() if x.strip()]
    return [Rule(v, at.partition("/")[0], "/" + at.partition("/")[2]) for v, at in found]


RULES = rules("""
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
""")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; without :// empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, own: list[Rule]) -> Column:
    """The rule's index: the longest host that fits, then the longest path."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(own)), key=lambda i: (len(own[i].name), own[i].host)):
        r = own[i]
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(i)).otherwise(out)
    return out


def _of(index: Column, values: list[str]) -> Column:
    """values[index]; null for null."""
    out = F.lit(None).cast("string")
    for i, x in enumerate(values):
        out = F.when(index == i, F.lit(x)).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The page that a url names: host in lower case, default ports, fragment and utm_ parameters dropped. Scheme, path and other parameters count."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), r"([?&])utm_[A-Za-z]+=[^&]*&?", "$1")
    plain = F.regexp_replace(plain, r"[?&]+$", "")
    scheme = F.lower(F.regexp_extract(plain, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    host = F.regexp_replace(host_of(plain), r":(80|443)$", "")
    return F.when(plain.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest))).otherwise(plain)


def links_of(html: Column) -> Column:
    """Targets of the canonical link and of the refresh redirect, as written. Only pages with such a tag are searched for its address."""
    html = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    href = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b")), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.when(html.rlike("(?i)canonical|http-equiv"), F.filter(F.concat(href, to), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def resolved(base: Column, link: Column) -> Column:
    """A link against its page's url: absolute, //host, /path or a name beside the page."""
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    folder = F.when(folder.rlike(r"://[^/]*/"), folder).otherwise(F.concat(root, F.lit("/")))
    link = F.regexp_replace(link, "&amp;", "&")
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def judge(pages: DataFrame, own: list[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """-> page_id, host, path, rule, verdict, alias_of (the least address of its class), one row for each row of pages.

    Edges: each page's canonical link and refresh redirect, and further `redirects` (src, dst). A class is a component of addresses.
    A page that a rule fits has that rule's verdict. Another takes its class's: allow if a rule allows any address of it (explicit
    allow goes first), else block if a rule blocks one, else allow; without links its class is its own normalised address. Targets that aren't pages count too. Null and malformed urls have
    empty host and path, no links and no class; they are allowed. Repeated rows get the same verdict, rows of one page_id each their own url's; no rows give no rows. Columns
    besides page_id, url and html, of any name, aren't read."""
    url = F.col("url")
    held = store(
        pages.select("page_id", "url", "html")
        .select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), node_of(url)).alias("node"), F.when(url.contains("://"), F.transform(links_of(F.col("html")), lambda x: node_of(resolved(url, x)))).alias("targets"))
        .withColumn("r", rule_for(F.col("host"), F.col("path"), own))
        .withColumn("nr", rule_for(host_of(F.col("node")), path_of(F.col("node")), own)),
        "pages",
    )
    edges = held.filter(F.size("targets") > 0).select(F.col("node").alias("u"), F.explode("targets").alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v")))
    classes = store(components(edges), "classes")
    verdict_of = lambda r: _of(r, [x.verdict for x in own])
    blocked = lambda r: F.max(F.when(verdict_of(r) == "block", 1).otherwise(0)).alias("block")
    allowed = lambda r: F.max(F.when(verdict_of(r) == "allow", 1).otherwise(0)).alias("allow")
    # every address of a class is a node of it, so rules are tried on the addresses themselves
    by_class = classes.withColumn("nr", rule_for(host_of(F.col("node")), path_of(F.col("node")), own)).groupBy("component").agg(blocked(F.col("nr")), allowed(F.col("nr")))
    decided = classes.join(by_class, "component").select("node", "component", F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").otherwise("allow").alias("carried"))
    out = held.join(decided, "node", "left")
    return out.select("page_id", "host", "path", _of(F.col("r"), [x.name for x in own]).alias("rule"), F.coalesce(verdict_of(F.col("r")), F.col("carried"), verdict_of(F.col("nr")), F.lit("allow")).alias("verdict"), F.coalesce("component", "node").alias("alias_of"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).drop("alias_of")
