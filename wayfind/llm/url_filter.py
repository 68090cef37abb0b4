"""URL filters: an explicit rule list, and a path-template tree for what no rule decides. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (verdict, host, path) that fits; null where none does. A rule fits its host and all subdomains."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def lexical(segment: Column) -> Column:
    """A segment with its variable parts generalised: {n} for digits, {x} for long hexadecimal, {w} for anything over 40 characters; a file's extension stays."""
    return (
        F.when(F.length(segment) > 40, F.lit("{w}"))
        .when(segment.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.when(segment.rlike(r"^\d+$"), F.lit("{n}")).otherwise(F.lit("{x}")))
        .otherwise(F.regexp_replace(segment, r"\d+", "{n}"))
    )


def segments_of(path: Column, depth: int) -> Column:
    """A path's segments, generalised one by one; those past `depth` fold into one {*}. [0] is what comes before the first slash."""
    flat = F.transform(F.split(path, "/"), lexical)
    return F.when(F.size(flat) > depth, F.concat(F.slice(flat, 1, depth), F.array(F.lit("{*}")))).otherwise(flat)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def merged(branches: DataFrame, fanout: int, z: float) -> DataFrame:
    """host, _parent, _here and _to of the branches (host, _parent, _here, l labelled, b of them bad) that merge.

    Where a parent has more than `fanout` literal branches, they become {*}. Else its labelled branches, by rate, form groups
    in which none differs from the one of the least rate by more than z standard errors; rates here have one good and one bad label
    added, so that a few equal labels prove little. A group of two and more becomes {~name}, after its least name.
    """
    literal = ~F.col("_here").startswith("{")
    few = branches.groupBy("host", "_parent").agg(F.count_if(literal).alias("kids"))
    rate = (F.col("b") + 1) / (F.col("l") + 2)
    error = rate * (1 - rate) / (F.col("l") + 2)
    at = branches.join(few, ["host", "_parent"])
    wide = at.where(literal & (F.col("kids") > fanout)).select("host", "_parent", "_here", F.lit("{*}").alias("_to"))
    # at most `fanout` literals, and the few placeholders that lexical() makes
    one = F.struct(rate.alias("r"), F.col("_here").alias("name"), error.alias("v"))
    own = at.where((F.col("l") > 0) & ((F.col("kids") <= fanout) | ~literal)).groupBy("host", "_parent").agg(F.sort_array(F.collect_list(one)).alias("all"))
    # each is told where its group starts: the first branch from which it does not differ, if that one starts a group
    start = F.array().cast("array<struct<r:double,name:string,v:double,first:double,spread:double,group:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = last.isNotNull() & (x["r"] - last["first"] <= z * F.sqrt(x["v"] + last["spread"]))
        first, spread = F.when(joins, last["first"]).otherwise(x["r"]), F.when(joins, last["spread"]).otherwise(x["v"])
        group = F.when(joins, last["group"]).otherwise(F.coalesce(last["group"] + 1, F.lit(0)))
        return F.concat(acc, F.array(F.struct(x["r"].alias("r"), x["name"].alias("name"), x["v"].alias("v"), first.alias("first"), spread.alias("spread"), group.cast("int").alias("group"))))

    grouped = own.select("host", "_parent", F.explode(F.aggregate("all", start, step)).alias("x")).groupBy("host", "_parent", "x.group").agg(F.collect_list("x.name").alias("names")).where(F.size("names") > 1)
    to = F.concat(F.lit("{~"), F.array_min("names"), F.lit("}"))
    return wide.unionByName(grouped.select("host", "_parent", F.explode("names").alias("_here"), to.alias("_to")))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labels: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    depth: int = 6,
    fanout: int = 50,
    z: float = 1.96,
    prior_weight: float = 5.0,
    reject: float = 0.9,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url.

    The tree: the segments of each path, generalised one by one, make its template; segments past `depth` fold into one
    {*}; level by level, branches of one parent merge as merged() says. A template's purity is the smoothed rate of bad ones
    among its labelled urls: (bad + w * prior) / (labelled + w), whose prior backs off to labels that others have. It is the purity,
    smoothed the same way, of the path over all hosts of the domain; whose prior is that of the path over all hosts; whose prior is
    that of the path without its last segment over all hosts, and so on up to the rate of all labels. At `reject` and
    above a template's urls are blocked. labels: url and bad (0 or 1); without them, the urls that rules decide are the labels.

    Null urls and urls without :// have an empty host and path and no rule. Rows that repeat keep their number; an
    empty table gives no rows; no column but page_id and url is read. The tree is built from one row per host and
    template, aggregated before anything moves, so a host or template with any share of the rows is one row in it.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("_ruled"), segments_of(F.col("path"), depth).alias("_seg"))
    if labels is None:
        seen = rows.select("host", "_seg", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0).alias("bad"))
    else:
        lab = labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad"))
        seen = rows.select("host", "_seg", F.lit(None).cast("int").alias("bad")).unionByName(lab.select("host", segments_of(F.col("path"), depth).alias("_seg"), "bad"))
    leaf = seen.groupBy("host", "_seg").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # _seg stays the join key; _tpl is rewritten level by level
    scratch = Scratch(pages.sparkSession, "urls", pages)
    leaf = scratch.keep(leaf, "leaves")
    tree = leaf.withColumn("_tpl", F.col("_seg"))
    for level in range(1, depth):
        tree = tree.withColumns({"_parent": F.concat_ws("/", F.slice("_tpl", 1, level)), "_here": F.get(F.col("_tpl"), F.lit(level))})
        branch = scratch.keep(tree.where("_here is not null").groupBy("host", "_parent", "_here").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")), f"branches{level}")
        to = F.concat(F.slice("_tpl", 1, level), F.array("_to"), F.slice("_tpl", level + 2, depth + 2))
        tree = tree.join(merged(branch, fanout, z), ["host", "_parent", "_here"], "left").withColumn("_tpl", F.when(F.col("_to").isNull(), F.col("_tpl")).otherwise(to))
        tree = scratch.keep(tree.drop("_to", "_parent", "_here"), f"level{level}")  # one row per host and template, far fewer than pages
        scratch.drop(f"level{level - 1}", f"branches{level}")
    sums = (F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    smooth = lambda l, b, prior: (b + prior_weight * prior) / (l + prior_weight)
    # over all hosts: every path, then its beginnings, longest first; the whole path's node ends in $
    nodes = F.transform(F.sequence(F.lit(2), F.size("_seg") + 1), lambda i: F.concat_ws("/", F.slice(F.concat("_seg", F.array(F.lit("$"))), F.lit(1), i)))
    known = leaf.where("labelled > 0").select(F.explode(nodes).alias("node"), "labelled", "bad").groupBy("node").agg(*sums)
    places = leaf.select("_seg").distinct().select("_seg", F.posexplode(nodes).alias("i", "node"))
    chains = scratch.keep(places.join(scratch.keep(known, "nodes"), "node"), "chains").groupBy("_seg").agg(F.sort_array(F.collect_list(F.struct("i", "l", "b"))).alias("chain"))
    prior = leaf.agg(F.coalesce(F.sum("bad") / F.sum("labelled"), F.lit(0.0)).alias("g"))  # one row
    chains = leaf.select("_seg").distinct().join(chains, "_seg", "left").join(F.broadcast(prior))
    chains = chains.select("_seg", F.coalesce(F.aggregate("chain", F.col("g"), lambda p, x: smooth(x["l"], x["b"], p)), F.col("g")).alias("_path"))
    domains = leaf.withColumn("_d", domain_of(F.col("host"))).groupBy("_d", "_seg").agg(*sums).join(chains, "_seg")
    domains = scratch.keep(domains.select("_d", "_seg", smooth(F.col("l"), F.col("b"), F.col("_path")).alias("_domain")), "domains")
    template = scratch.keep(tree.groupBy("host", "_tpl").agg(*sums), "templates")
    scored = tree.select("host", "_seg", "_tpl", domain_of(F.col("host")).alias("_d")).join(domains, ["_d", "_seg"]).join(template, ["host", "_tpl"])
    purity = smooth(F.col("l"), F.col("b"), F.col("_domain")).alias("purity")
    by_leaf = scratch.keep(scored.select("host", F.concat_ws("/", "_seg").alias("_s"), F.concat_ws("/", "_tpl").alias("template"), purity), "scored")
    out = rows.withColumn("_s", F.concat_ws("/", "_seg")).join(by_leaf, ["host", "_s"], "left")
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), "template", "purity")
