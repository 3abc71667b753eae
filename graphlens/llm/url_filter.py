"""URL verdicts from host rules and, where no rule fits, from a tree of path templates.

Paths form a tree per host. Level by level, segments that vary become wildcards: segments of
digits (with an affix that has none, such as `.html`) always, other segments where a node has
more than MAX_CHILDREN distinct ones. Sibling branches (templates of a host that differ in one segment
alone, at any level) whose labelled block rates do not differ significantly are merged, deepest
level first, and their evidence is pooled. Above the templates evidence moves up the tree: in a
node every labelled template below it is one vote, smoothed towards the node above, so that one
blocked branch does not condemn its siblings and many do. A template is rejected if its share of
blocked labelled pages, smoothed towards the node above it, is high enough. Labelled pages are those that a rule decides, and those labelled by the caller.

DataFrame functions only. The tree works on distinct (host, path) pairs with counts, which
partial aggregates form before any shuffle; joins against a host's few tree nodes are salted, so
that a host with a third of all pages is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct children of one kind beyond which they are one wildcard.
MAX_CHILDREN = 32
#: Pseudo-pages (of a node: votes) of the rate above that are added to the evidence; PRIOR above all hosts.
STRENGTH, PRIOR = 4.0, 0.5
#: Smoothed block rate from which a template is rejected.
REJECT = 0.8
#: Two block rates differ significantly beyond this many standard errors.
Z = 1.96
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """block or allow for a host with its subdomains, below a path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit(f".{self.host}"))) & F.startswith(path, F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url and for one without ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does. Equal lengths: block first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _shape(seg: Column) -> tuple[Column, Column]:
    """seg with its digits as #, and whether it is a number."""
    shape = F.regexp_replace(seg, "[0-9]+", "#")
    return shape, shape.rlike(r"^[^#A-Za-z]*#(\.[a-z]+)?$")


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, ...) with head (first segment's template) and rest (that of the others)."""
    depth = paths.agg(F.max(F.size(F.split("path", "/")) - 1)).first()[0] or 0
    at = paths.select("*", F.split(F.expr("substring(path, 2)"), "/").alias("segs"), F.lit("").alias("prefix"), F.array().cast("array<string>").alias("parts"))
    level = 1
    while level <= max(1, depth):
        # a node with few paths has nowhere below it more children than that
        busy = at.filter(F.size("segs") >= level).groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_CHILDREN)
        if busy.isEmpty():
            break
        seg = F.get("segs", F.lit(level - 1))
        shape, number = _shape(seg)
        at = at.select("*", seg.alias("seg"), number.alias("number"), shape.alias("shape"))
        words = at.filter(F.col("seg").isNotNull() & ~F.col("number"))
        wide = (
            words.select("host", "prefix", "seg").distinct().groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"))
            .filter(F.col("children") > MAX_CHILDREN).select("host", "prefix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("wide"))
        )
        at = at.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(wide, ["host", "prefix", "salt"], "left")
        own = F.when(F.col("number"), F.col("shape")).when(F.col("wide"), "*").otherwise(F.col("seg"))
        at = at.withColumn("own", F.when(F.col("seg").isNotNull(), own))
        at = at.withColumn("prefix", F.concat("prefix", F.when(F.col("own").isNotNull(), F.concat(F.lit("/"), "own")).otherwise("")))
        at = at.withColumn("parts", F.when(F.col("own").isNotNull(), F.concat("parts", F.array("own"))).otherwise(F.col("parts")))
        at = stored(at.drop("seg", "number", "shape", "salt", "wide", "own"), "url-tree")
        level += 1
    left = F.transform(F.slice("segs", F.lit(level), F.size("segs")), lambda x: F.when(_shape(x)[1], _shape(x)[0]).otherwise(x))
    at = at.withColumn("parts", F.concat("parts", left))
    rest = F.concat_ws("/", F.array(F.lit("")), F.slice("parts", F.lit(2), F.size("parts")))
    return at.select(*paths.columns, F.coalesce(F.get("parts", F.lit(0)), F.lit("")).alias("head"), F.when(F.size("parts") > 1, rest).otherwise("").alias("rest"))


def purities(leaves: DataFrame) -> DataFrame:
    """leaves (host, head, rest, blocked, labelled) with merged and purity (smoothed block rate)."""
    leaves = stored(leaves.withColumn("leaf", F.concat("head", "rest")), "url-leaves")
    at = leaves.select("host", "leaf", (F.col("labelled") > 0).alias("known"), F.split("leaf", "/").alias("parts"), F.posexplode(F.split("leaf", "/")).alias("level", "own"))
    side = lambda a, n: F.concat_ws("/", F.slice("parts", a, n))
    at = at.withColumn("place", F.struct(side(F.lit(1), F.col("level")).alias("above"), side(F.col("level") + 2, F.size("parts")).alias("below"), F.size("parts").alias("n")))
    among = Window.partitionBy("host", "level", "place", "known")
    siblings = stored(at.withColumn("n", F.count(F.lit(1)).over(among)).filter("n > 1").select("host", "leaf", "level", "place", "own"), "url-siblings")
    groups = leaves.select("host", "leaf", F.col("leaf").alias("group"), "blocked", "labelled")
    # as many levels as the deepest path has at most
    for level in sorted((r.level for r in siblings.select("level").distinct().collect()), reverse=True):
        whole = Window.partitionBy("host", "group")
        pooled = groups.select("host", "leaf", "group", F.sum("blocked").over(whole).alias("b"), F.sum("labelled").over(whole).alias("all"))
        links = siblings.filter(F.col("level") == level).join(pooled, ["host", "leaf"])
        links = links.withColumn("known", F.col("all") > 0).withColumn("n", F.when(F.col("all") > 0, F.col("all"))).withColumn("rate", F.col("b") / F.col("n"))
        order = Window.partitionBy("host", "place", "known").orderBy("rate", "own")
        rate = (F.col("b") + F.lag("b").over(order)) / (F.col("n") + F.lag("n").over(order))
        spread = F.sqrt(rate * (1 - rate) * (1 / F.col("n") + 1 / F.lag("n").over(order)))
        links = links.withColumn("cut", F.when(F.abs(F.col("rate") - F.lag("rate").over(order)) > Z * spread, 1).otherwise(0))
        links = links.withColumn("branch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        links = stored(links.select("host", "group", "place", "known", "branch", F.col("group").alias("label")), "url-links")
        # groups that a branch holds together become one, and so on until nothing changes
        while True:
            one = links.withColumn("least", F.min("label").over(Window.partitionBy("host", "place", "known", "branch")))
            one = stored(one.withColumn("least", F.min("least").over(whole)), "url-links")
            changed = not one.filter("least != label").isEmpty()
            links = one.drop("label").withColumnRenamed("least", "label")
            if not changed:
                break
        new = links.select("host", "group", "label").distinct()
        groups = groups.join(new, ["host", "group"], "left").select("host", "leaf", F.coalesce("label", "group").alias("group"), "blocked", "labelled")
        groups = stored(groups, "url-groups")
    groups = groups.join(priors(leaves), ["host", "leaf"])
    merged = Window.partitionBy("host", "group")
    block, every, prior = F.sum("blocked").over(merged), F.sum("labelled").over(merged), F.avg("prior").over(merged)
    purity = groups.select("host", "leaf", ((block + STRENGTH * prior) / (every + STRENGTH)).alias("purity"))
    return leaves.join(purity, ["host", "leaf"]).select("host", "head", "rest", "purity")


def priors(leaves: DataFrame) -> DataFrame:
    """(host, leaf, prior): the smoothed rate of the node above each template (host, leaf, blocked, labelled)."""
    parts = F.split("leaf", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), k)).alias("prefix")))
    at = leaves.select("host", "leaf", F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).alias("rate"), F.explode(above).alias("node"))
    # rates are summed as whole numbers, in any order
    votes = at.groupBy("host", "node").agg(F.count("rate").alias("votes"), F.coalesce(F.sum(F.round(F.col("rate") * 1e9).cast("long")), F.lit(0)).alias("sum"))
    path = at.join(votes, ["host", "node"]).groupBy("host", "leaf").agg(F.sort_array(F.collect_list(F.struct("node.depth", "votes", "sum"))).alias("path"))
    down = F.aggregate("path", F.lit(PRIOR), lambda rate, n: (n["sum"] / 1e9 + STRENGTH * rate) / (n.votes + STRENGTH))
    return path.select("host", "leaf", down.alias("prior"))


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict in place of such columns.

    verdict: that of the longest rule that fits, else block where the template's smoothed block
    rate (purity) is at least REJECT, else allow. labels: optional (host, path, blocked) counts
    as evidence beside the rules: column `blocked` boolean, one row per labelled page. template
    and purity are null where a rule decides. Null urls and urls without :// have an empty host
    and path and meet in one template; repeated rows count each and all stay; an empty table
    gives an empty result; other columns stay as they are.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict")
    host, path = host_and_path(F.col(url))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    kept = [c for c in pages.columns if c not in new]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rows = rows.select("*", text.alias("rule"), verdict.alias("__ruled"))
    blocked = F.col("__ruled") == "block"
    paths = rows.groupBy("host", "path").agg(
        F.count_if(blocked).alias("blocked"), F.count_if(F.col("__ruled").isNotNull()).alias("labelled"), F.first("__ruled").alias("__ruled")
    )
    if labels is not None:
        given = labels.groupBy("host", "path").agg(F.count_if("blocked").alias("b"), F.count("blocked").alias("l"))
        more = (F.coalesce(F.col(c), F.lit(0)) for c in ("b", "l"))
        paths = paths.join(given, ["host", "path"], "left").select(
            "host", "path", (F.col("blocked") + next(more)).alias("blocked"), (F.col("labelled") + next(more)).alias("labelled"), "__ruled"
        )
    tree = stored(templates(stored(paths, "url-paths")), "url-templates")
    leaves = tree.groupBy("host", "head", "rest").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    scored = purities(leaves).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = (
        tree.filter(F.col("__ruled").isNull()).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
        .join(scored, ["host", "head", "rest", "salt"])
        .select("host", "path", F.concat(F.lit("/"), "head", "rest").alias("template"), "purity")
    )
    # both sides of this join are plain rows, so a hot path is split at run time
    out = rows.join(stored(judged, "url-judged"), ["host", "path"], "left")
    own = F.coalesce("__ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", "template", "purity", own.alias("verdict"))
