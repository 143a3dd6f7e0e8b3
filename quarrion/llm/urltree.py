"""URL filters by rules and by a path-template tree for each host.

A host's paths form a tree of segments. Segments that look like numbers or
identifiers are wildcards at once. Siblings with the same most frequent child
are held against each other: one whose children are distributed like theirs
(chi-square), and whose share of bad labels is like theirs, is merged with
them, so a template spans segments with and without labels. A segment without labels on its
host is compared by what its path's labels on other hosts say; with none at all,
its children alone decide. A template's share of bad labels is smoothed along the tree, from
the host's parent domains to the whole template, and a template is rejected if it is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (host, path prefix, verdict) of the curated rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Smoothing: so many labels at the share of the node above count for every node; a domain's stands below PRIOR.
STRENGTH, PRIOR = 4.0, 0.3
REJECT = 0.8
#: Labels of a path on other hosts count as no more than this many.
TRANSFER = 8.0
#: Siblings differ from this z on, of their shares of bad labels or of the chi-square of their children.
ALIKE_Z = 1.64


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a parent domain and whose path starts the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path as an array, with numbers, dates and long identifiers as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        s = F.regexp_replace(s, r"^\d+(?=\.[A-Za-z0-9]{1,5}$|$)", "{n}")
        s = F.regexp_replace(s, r"^\d{4}-\d{2}(-\d{2})?$", "{date}")
        return F.regexp_replace(s, r"^[0-9A-Fa-f-]{12,}$", "{id}")

    return F.transform(parts, general)


def _elsewhere(bad: Column, labels: Column) -> tuple[Column, Column]:
    """Labels of other hosts as (bad, labels) of a weight of TRANSFER at most."""
    weight = F.least(labels, F.lit(TRANSFER))
    return F.when(labels > 0, bad / labels * weight).otherwise(0.0), weight


def _branches(nodes: DataFrame, merge: bool = True) -> DataFrame:
    """(host, node, step) from nodes of (host, node, above, n, bad, labels, o_bad, o_labels): the name of each node's template segment.

    Everything is sums by (host, parent, child) and joins of many rows to one,
    so a node with any number of children is no unbounded group.
    """
    own_name = F.element_at("node", -1)
    if not merge:
        return nodes.select("host", "node", own_name.alias("step"))
    # Children of each node, those that end there under an empty name.
    below = nodes.where(F.size("node") > 1).select("host", F.col("above").alias("node"), own_name.alias("child"), "n")
    ends = nodes.select("host", "node", "n").join(below.groupBy("host", "node").agg(F.sum("n").alias("m")), ["host", "node"], "left")
    ends = ends.select("host", "node", F.lit("").alias("child"), (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
    kids = below.unionByName(ends)
    modes = kids.groupBy("host", "node").agg(F.max(F.struct("n", "child"))["child"].alias("mode"))
    kin = ["host", "above", "mode"]
    tree = materialise(nodes.join(modes, ["host", "node"]), "url-kin")
    dealt = kids.withColumnRenamed("n", "seen").join(tree.select("node", "n", *kin), ["host", "node"])
    pool = dealt.groupBy(*kin, "child").agg(F.sum("seen").alias("pooled"))
    whole = pool.groupBy(*kin).agg(F.sum("pooled").alias("whole"), (F.count("*") - 1).alias("df"))
    square = F.sum(F.col("seen") * F.col("seen") / (F.col("n") * F.col("pooled") / F.col("whole"))) - F.max("n")
    chi = dealt.join(pool, [*kin, "child"]).join(whole, kin).groupBy("host", "node").agg((square <= F.max("df") + ALIKE_Z * F.sqrt(2 * F.max("df")) + 1e-9).alias("alike"))
    # Labels of the host itself, or else those of other hosts.
    far_bad, far = _elsewhere(F.col("o_bad"), F.col("o_labels"))
    tree = tree.join(chi, ["host", "node"]).withColumn("y", F.when(F.col("labels") > 0, F.col("bad").cast("double")).otherwise(far_bad))
    tree = tree.withColumn("w", F.when(F.col("labels") > 0, F.col("labels").cast("double")).otherwise(far))
    around = tree.where("alike").groupBy(*kin).agg(F.sum("y").alias("all_y"), F.sum("w").alias("all_w"))
    rest, rest_y = F.col("all_w") - F.col("w"), F.col("all_y") - F.col("y")
    share = F.col("all_y") / F.col("all_w")
    z = (F.col("y") / F.col("w") - rest_y / rest) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / F.col("w") + 1 / rest))
    branch = F.when((F.col("w") <= 1e-9) | (rest <= 1e-9), "*").when(z >= ALIKE_Z, "+").when(z <= -ALIKE_Z, "-").otherwise("*")
    classed = tree.where("alike").join(around, kin).select("host", "node", *kin[1:], own_name.alias("part"), branch.alias("branch"))
    members = classed.groupBy(*kin, "branch").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    # A class of one segment keeps its name.
    named = classed.join(members, [*kin, "branch"]).select("host", "node", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("branch", F.lit("~"), "mode")).alias("step"))
    return named.unionByName(tree.where(~F.col("alike")).select("host", "node", own_name.alias("step")))


def template_verdicts(urls: DataFrame, merge: bool = True) -> DataFrame:
    """(host, parts, template, impurity, method) from rows of (host, parts, n, bad, good), one for each host and shape.

    Shares of bad labels are smoothed downward: all below a domain of two
    labels towards PRIOR, a host towards its domain, and each beginning of a
    template towards the one above it. Labels of the same paths on other hosts count
    once, with those of the longest beginning that has any, as TRANSFER labels at most. ``merge=False`` leaves all segments apart.
    """
    urls = materialise(urls.withColumn("domain", F.substring_index("host", ".", -2)), "url-shapes")
    level = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.slice("parts", F.lit(1), k))).alias("level", "node")
    on_way = urls.where(F.size("parts") > 0).select("host", "parts", "n", "bad", "good", level)
    nodes = on_way.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labels"))
    everywhere = nodes.where("labels > 0").groupBy("node").agg(F.sum("bad").alias("g_bad"), F.sum("labels").alias("g_labels"))
    nodes = nodes.join(everywhere, "node", "left").select(
        "host", "node", F.slice("node", F.lit(1), F.size("node") - 1).alias("above"), "n", "bad", "labels",
        (F.coalesce("g_bad", F.lit(0)) - F.col("bad")).alias("o_bad"), (F.coalesce("g_labels", F.lit(0)) - F.col("labels")).alias("o_labels"),
    )
    nodes = materialise(nodes, "url-nodes")
    steps = on_way.select("host", "parts", "level", "node").join(_branches(nodes, merge), ["host", "node"])
    found = steps.groupBy("host", "parts").agg(F.sort_array(F.collect_list(F.struct("level", "step"))).alias("steps"))
    found = materialise(found.select("host", "parts", F.transform("steps", lambda s: s["step"]).alias("template")), "url-templates")

    both = [F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labels")]
    hosts = urls.groupBy("domain", "host").agg(*both)
    domains = hosts.groupBy("domain").agg(_smooth(F.sum("bad"), F.sum("labels"), F.lit(PRIOR)).alias("of_domain"))
    hosts = hosts.join(domains, "domain").select("host", _smooth(F.col("bad"), F.col("labels"), F.col("of_domain")).alias("of_host"))

    # Each beginning of a template with the sums of its nodes; every node counts once.
    place = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(F.slice("parts", F.lit(1), k).alias("node"), F.slice("template", F.lit(1), k).alias("start")))).alias("level", "p")
    places = found.select("host", place).select("host", F.col("p.node").alias("node"), F.col("p.start").alias("start")).distinct()
    far_bad, far = _elsewhere(F.sum("o_bad"), F.sum("o_labels"))
    starts = places.join(nodes, ["host", "node"]).groupBy("host", "start").agg(F.sum("bad").alias("y"), F.sum("labels").alias("w"), far_bad.alias("far_y"), far.alias("far_w"))
    leaves = found.select("host", "template").distinct()
    along = leaves.select("host", "template", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("template")), lambda k: F.slice("template", F.lit(1), k))).alias("level", "start"))
    along = along.join(starts, ["host", "start"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "y", "w", "far_y", "far_w"))).alias("way"))
    none = F.array().cast("array<struct<level:int,y:bigint,w:bigint,far_y:double,far_w:double>>")
    along = along.unionByName(urls.where(F.size("parts") == 0).select("host", F.array().cast("array<string>").alias("template"), none.alias("way")))
    last = F.coalesce(F.array_max(F.transform(F.filter("way", lambda at: at["far_w"] > 0), lambda at: at["level"])), F.lit(-1))
    here = lambda at, name: at[name] + F.when(at["level"] == last, at["far_" + name]).otherwise(0.0)
    impurity = F.aggregate("way", F.col("of_host"), lambda above, at: _smooth(here(at, "y"), here(at, "w"), above))
    judged = along.join(hosts, "host").select("host", "template", impurity.alias("impurity"))
    judged = judged.withColumn("method", F.when(F.col("impurity") >= REJECT, "block").otherwise("allow"))
    roots = urls.where(F.size("parts") == 0).select("host", "parts", F.array().cast("array<string>").alias("template"))
    return found.unionByName(roots).join(judged, ["host", "template"])


def _smooth(bad: Column, labels: Column, expected: Column) -> Column:
    return (bad + F.lit(STRENGTH) * expected) / (labels + F.lit(STRENGTH))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", merge: bool = True) -> DataFrame:
    """(id, host, path, rule, verdict, template, impurity) of every row.

    Labels are rows of (id, bad); without them the curated rules' verdicts
    label the pages that they fit. A null or malformed url has an empty host
    and path and is judged as the host of that name; repeated rows each give
    a row; an empty table gives none; other columns are not read. The tree is
    built over distinct (host, shape), aggregated before any exchange; the
    join back to pages is on narrow rows.
    """
    host, path = host_path(F.col(url_col))
    rows = pages.select(id_col, host.alias("host"), path.alias("path")).withColumn("parts", shape(F.col("path")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict)
    if labels is None:
        known = rows.withColumn("_bad", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0))
    else:
        known = rows.join(labels.select(F.col(id_col), F.col("bad").cast("int").alias("_bad")).dropDuplicates([id_col]), id_col, "left")
    urls = known.groupBy("host", "parts").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"), F.count(F.when(F.col("_bad") == 0, 1)).alias("good")
    )
    judged = template_verdicts(urls, merge).select("host", "parts", F.concat_ws("/", "template").alias("template"), "method", "impurity")
    out = rows.join(judged, ["host", "parts"])
    return out.select(id_col, "host", "path", "rule", F.coalesce("_ruled", "method").alias("verdict"), "template", "impurity")
