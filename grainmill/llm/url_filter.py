"""URL filters: rules by host and path, and a path-template tree learnt from the pages the rules label.

A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins. Pages
that no rule fits are judged by their template. Per host the paths form a tree of segments, walked level by level:

* numbers within segments become ``#``, and a node with more than ``most_children`` different segments gets a wildcard in their place;
* a branch is merged with its siblings, also under a wildcard, where neither test tells it from all of them together. The first holds the shares
  of what follows the segment against theirs (total variation, within the bound that chance keeps with probability 1 - ``alpha``). The second
  holds its share of blocked pages among labelled ones against theirs (``z`` standard errors); a branch without labelled pages passes it, as nothing
  speaks against it.

So pages without a rule meet labelled pages where a host's branches look alike and its labels do not contradict each other. A template is
rejected when it has labelled pages and its share of blocked pages among them, smoothed towards the host's, reaches
``purity``; the host's share is smoothed towards one half. With the defaults, four labelled pages of a template, all blocked, on a host without
other labels are the least that reject it. Since a branch without labels passes the second test, the pages of a host whose only labels are
blocks can be rejected with them, where the branches look alike.

Counts are summed by host and shape of path before any of that, so a host that holds a third of all pages is
as many rows as it has shapes. Null URLs and those without ``://`` have empty host and path, no rule, and are
judged like any other template; a template without labelled pages is allowed. Very long URLs are handled whole; segments
beyond ``most_levels`` count as one. Repeated rows count as often as they stand there. The other columns of ``pages`` pass through whatever their names, but that the
results replace columns of theirs. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import scratch

#: Verdict and rule, host then path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path with its runs of digits as ``#``, without the leading slash."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#")


def templates(counts: DataFrame, most_children: int = 32, most_levels: int = 8, z: float = 2.0, alpha: float = 0.05) -> DataFrame:
    """``host``, ``shape``, ``labelled``, ``blocked`` and ``template`` from ``host``, ``shape``, ``n``, ``labelled``, ``blocked``.

    Segments beyond ``most_levels`` share the template's last place.
    """
    now = counts.withColumn("seg", F.split("shape", "/")).withColumn("template", F.lit(""))
    now = scratch.materialize(now, "url-tree")
    deepest = now.agg(F.max(F.size("seg"))).first()[0] or 0
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    for level in range(min(deepest, most_levels)):
        at = F.get(F.col("seg"), F.lit(level)) if level < most_levels - 1 else F.array_join(F.slice("seg", level + 1, 1 << 20), "/")
        now = now.withColumn("at", F.when(F.size("seg") > level, at)).withColumn("next", F.coalesce(F.get(F.col("seg"), F.lit(level + 1)), F.lit("/")))
        after = now.where("at IS NOT NULL").groupBy(*node, "at", "next").agg(*sums)
        kids = after.groupBy(*node, "at").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        nodes = kids.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("n").alias("pages"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        pool = after.groupBy(*node, "next").agg(F.sum("n").alias("with_next"))
        kinds = pool.groupBy(*node).agg(F.count("*").alias("kinds"))
        shares = after.select(*node, "at", "next", F.col("n").alias("m")).join(pool, [*node, "next"]).join(kids.select(*node, "at", "n"), [*node, "at"]).join(nodes, node)
        common = shares.groupBy(*node, "at").agg(F.sum(F.least(F.col("m") / F.col("n"), F.col("with_next") / F.col("pages"))).alias("common"))
        kids = kids.join(nodes, node).join(kinds, node).join(common, [*node, "at"])
        chance = F.sqrt((F.col("kinds") * log(2) + log(1 / alpha)) / (2 * F.col("n")))
        looks = (F.col("kids") > 1) & (1 - F.col("common") <= chance)
        share, own = F.try_divide("b", "l"), F.try_divide("blocked", "labelled")
        agrees = F.abs(own - share) <= z * F.sqrt(F.try_divide(share * (1 - share), F.col("labelled")))  # null without labels
        name = F.when((F.col("kids") > most_children) | (looks & F.coalesce(agrees, F.lit(True))), F.lit("*")).otherwise(F.col("at"))
        now = now.join(kids.select(*node, "at", name.alias("name")), [*node, "at"], "left")
        now = now.withColumn("template", F.when(F.col("name").isNotNull(), F.concat("template", F.lit("/"), "name")).otherwise(F.col("template"))).drop("at", "name", "next")
        now = scratch.materialize(now, "url-tree")
    return now.select("host", "shape", "labelled", "blocked", "template")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", purity: float = 0.9, weight: float = 3.0, labelled: Column | None = None, **tree: float) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which replace columns of these names.

    With a condition ``labelled`` the rules label only the pages it holds for: the others are judged by their template alone,
    as to hold the tree against rules it has not seen.
    """
    seen = F.coalesce(labelled, F.lit(False)) if labelled is not None else F.lit(True)
    rows = pages.select(F.struct("*").alias("page"), F.col(url_col).alias("url"), seen.alias("seen"))
    rows = rows.select("page", "seen", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": F.when(F.col("seen"), rule), "ruled": F.when(F.col("seen"), ruled), "shape": shape_of(F.col("path"))})
    blocked = F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0))
    tree_rows = templates(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), blocked.alias("blocked")), **tree)
    shares = tree_rows.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).where("l > 0")
    hosts = shares.groupBy("host").agg(((F.sum("b") + weight * 0.5) / (F.sum("l") + weight)).alias("prior"))
    smoothed = (F.col("b") + weight * F.col("prior")) / (F.col("l") + weight)
    bad = shares.join(hosts, "host").where(smoothed >= purity).select("host", "template")
    bad = tree_rows.join(bad, ["host", "template"]).select(F.col("host").alias("asked"), "shape", F.lit(True).alias("bad"))
    # Only pages without a rule ask for their template's verdict; the rest pass by the join.
    out = rows.withColumn("asked", F.when(F.col("ruled").isNull(), F.col("host"))).join(bad, ["asked", "shape"], "left")
    final = F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col("page")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, "host", "path", "rule", final.alias("verdict"))
