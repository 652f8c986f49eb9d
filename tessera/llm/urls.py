"""URL filters by path-template trees.

For each host the paths form a tree of segments. Segments that vary (numbers, hashes, dates, or one of many rare
children of a node) become wildcards, level by level. Pages that a rule judges are the labels. Sibling branches
whose labelled shares do not differ significantly are merged, and a template is rejected where the smoothed
share of blocked labels reaches the limit on enough labels. A branch with too few labels of its own is judged by
the same template in the nearest parent domain that has enough, the last of which is the whole table: a site
that no rule names is judged by how its template fares on its neighbours. A rule's own verdict always stands for
its pages.

The tree is built from distinct shapes with counts, never from single pages, so a host with a third of all
pages costs no more than its distinct shapes. Rounds follow branchings: what all shapes of a node share is one step.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, need

# Fixed values of the task's contract: verdict, rule.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node with more children than this generalises those that hold less than the share of its pages.
MANY_CHILDREN, RARE_SHARE = 20, 0.05
#: Branches merge while the z value between neighbours by purity stays below this.
MERGE_Z = 1.64
#: Labels a template needs, weight of the even prior, and the purity from which it is rejected.
MIN_LABELS, PRIOR, REJECT = 5, 2.0, 0.8


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, each up to its end mark; both empty without one."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        fits.append((((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p)), rule, verdict))
    rule, judged = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, r, v in reversed(fits):
        rule, judged = F.when(cond, F.lit(r)).otherwise(rule), F.when(cond, F.lit(v)).otherwise(judged)
    return rule, judged


def _segment(s: Column) -> Column:
    """A path segment, or * and its ending where its form varies: numbers, hashes, several digits, or long."""
    ending = F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0)
    stem = F.substring(s, F.lit(1), F.length(s) - F.length(ending))
    varies = F.rlike(stem, F.lit("^(?:[0-9]+|[0-9a-fA-F]{8,})$")) | (F.regexp_count(stem, F.lit("[0-9]")) >= 3) | (F.length(stem) >= 40)
    return F.when(varies, F.concat(F.lit("*"), ending)).otherwise(s)


def _shape(path: Column) -> Column:
    return F.transform(F.split(path, "/", -1), _segment)


def _generalise(tmp: Scratch, shapes: DataFrame) -> DataFrame:
    """host, path_shape, template, blocked, allowed: the tree, one branching of every node in a round.

    A node with at most MANY_CHILDREN shapes below it has no node with more children, so its shapes keep the rest
    of their segments and take no further part. In any other the segments in which all its shapes agree are passed
    at once: they are what the least and the greatest of its shapes agree in, so their number costs no round. No
    bound on the depth.
    """
    ahead = lambda level: F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(0)))
    told = lambda segments: F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), "")
    at = F.col("level")
    done, now, turn = [], shapes.withColumn("template", F.lit("")).withColumn("level", F.lit(1)), 0  # the piece before the first / is empty
    keep = [c for c in now.columns if c not in ("template", "level")]
    while True:
        nodes = now.withColumn("ahead", ahead(at)).groupBy("host", "template").agg(F.count("*").alias("shapes"), F.min("ahead").alias("a"), F.max("ahead").alias("b")).filter(F.col("shapes") > MANY_CHILDREN)
        differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False).cast("int")
        agree = F.when(differ > 0, differ - 1).otherwise(F.size("a"))
        tops = nodes.select(F.col("host").alias("h"), F.col("template").alias("t"), agree.alias("agree"))
        joined = now.join(tops, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left")
        step = F.coalesce("agree", F.lit(0))
        passed = joined.withColumn("template", F.concat("template", told(F.slice("shape", at + 1, step)))).withColumn("level", at + step)
        marked = tmp.save(passed.withColumn("open", F.col("h").isNotNull() & (F.size("shape") > at)).drop("h", "t", "agree"), f"round{turn}")
        done.append(marked.filter("not open").select(*keep, F.concat("template", told(ahead(at))).alias("template")))
        now = marked.filter("open").drop("open")
        if now.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        child = F.get("shape", at)
        children = now.groupBy("host", "template", child.alias("child")).agg(F.sum("n").alias("n"))
        parents = children.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all")).filter(F.col("children") > MANY_CHILDREN)
        rare = children.join(parents, ["host", "template"]).filter((F.col("n") < RARE_SHARE * F.col("all")) & (F.col("child") != ""))
        names = rare.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("child").alias("c"))
        joined = now.withColumn("child", child).join(names, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("child") == F.col("c")), "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("c").isNotNull(), "*").otherwise(F.col("child")))
        now, turn = joined.select(*keep, step.alias("template"), (at + 1).alias("level")), turn + 1


def _suffixes(host: Column) -> Column:
    """(level, domain) of a host, its parent domains, and "" for the whole table, from the nearest on."""
    parts = F.split(host, r"\.", -1)
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.posexplode(F.when(host == "", F.array(F.lit(""))).otherwise(F.concat(own, F.array(F.lit("")))))


def _merge(templates: DataFrame) -> DataFrame:
    """host, template, merged, blocked, labels: siblings whose shares of blocked labels do not differ are one.

    Siblings: templates with the same last segment below branches of one parent. Generalised nodes have some
    MANY_CHILDREN children with a name of their own at most, so a window over siblings is small. Only branches
    with labels have evidence to merge on; each of the others stays alone.
    """
    t = templates.withColumn("parent", F.regexp_replace("template", r"[^/]*+/([^/]*+)$", "?/$1")).withColumn("labels", F.col("blocked") + F.col("allowed"))
    share = (F.col("blocked") + PRIOR / 2) / (F.col("labels") + PRIOR)
    alone = t.filter("labels = 0").select("host", "template", F.col("template").alias("merged"), "blocked", "labels")
    t = t.filter("labels > 0").withColumn("share", share)
    by = Window.partitionBy("host", "parent").orderBy("share", "template")
    pooled = (F.col("blocked") + F.lag("blocked").over(by) + PRIOR) / (F.col("labels") + F.lag("labels").over(by) + 2 * PRIOR)
    z = (F.col("share") - F.lag("share").over(by)) / F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labels") + PRIOR) + 1 / (F.lag("labels").over(by) + PRIOR)))
    grouped = t.withColumn("z", z).withColumn("branch", F.sum(F.when(F.col("z") > MERGE_Z, 1).otherwise(0)).over(by))
    whole = grouped.groupBy("host", "parent", "branch").agg(F.sum("blocked").alias("b"), F.sum("labels").alias("l"), F.min("template").alias("first"), F.count("*").alias("members"))
    named = whole.select("host", "parent", "branch", F.when(F.col("members") > 1, F.col("parent")).otherwise(F.col("first")).alias("merged"), "b", "l")
    joined = grouped.select("host", "parent", "branch", "template").join(named, ["host", "parent", "branch"])
    return joined.select("host", "template", "merged", F.col("b").alias("blocked"), F.col("l").alias("labels")).unionByName(alone)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, domain, labels, purity of every page.

    A null url, or one without ://, has an empty host and path. template is the merged template of the page's
    branch; domain is whose labels judge it: the host, else its nearest parent domain with MIN_LABELS labels of
    the branch's template, "" for the whole table; labels are their number and purity their smoothed blocked
    share. Where no domain has enough, the host's own few are shown and the page is allowed. Repeated rows count
    once each as labels. Other columns are ignored; an empty table gives no rows.
    """
    tmp = Scratch(pages.sparkSession, "urls")
    host, path = parse(F.col("url"))
    rows = need(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    rule, judged = rule_of(F.col("host"), F.col("path"), rules)
    parsed = rows.select("page_id", "host", "path", rule.alias("rule"), judged.alias("judged"), _shape(F.col("path")).alias("shape"))
    parsed = parsed.withColumn("path_shape", F.array_join("shape", "/"))
    is_ = lambda v: F.coalesce((F.col("judged") == v).cast("long"), F.lit(0))
    shapes = tmp.save(
        parsed.groupBy("host", "path_shape", "shape").agg(F.count("*").alias("n"), F.sum(is_("block")).alias("blocked"), F.sum(is_("allow")).alias("allowed")),
        "shapes",
    )
    tree = tmp.save(_generalise(tmp, shapes), "tree")
    templates = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    merged = tmp.save(_merge(templates), "merged")
    # What each domain knows of a template, from the labels of all hosts below it.
    spread = templates.filter("blocked + allowed > 0").select("template", "blocked", (F.col("blocked") + F.col("allowed")).alias("labels"), _suffixes(F.col("host")).alias("level", "domain"))
    known = spread.groupBy("domain", "template").agg(F.sum("blocked").alias("kb"), F.sum("labels").alias("kl")).filter(F.col("kl") >= MIN_LABELS)
    poor = merged.filter(F.col("labels") < MIN_LABELS).select("host", "template", _suffixes(F.col("host")).alias("level", "domain"))
    near = poor.join(known, ["domain", "template"]).groupBy("host", "template").agg(F.min_by(F.struct("domain", "kb", "kl"), "level").alias("near"))
    at = merged.join(near, ["host", "template"], "left")
    labels, blocked = F.coalesce("near.kl", "labels"), F.coalesce("near.kb", "blocked")
    purity = (blocked + PRIOR / 2) / (labels + PRIOR)
    verdicts = at.select(
        "host", "template", "merged", F.coalesce("near.domain", "host").alias("domain"), labels.alias("labels"), purity.alias("purity"),
        F.when((labels >= MIN_LABELS) & (purity >= REJECT), "block").otherwise("allow").alias("learned"),
    )
    of_shape = tree.select("host", "path_shape", "template").join(verdicts, ["host", "template"])
    final = tmp.save(of_shape.select(F.col("host").alias("h"), F.col("path_shape").alias("s"), "merged", "domain", "labels", "purity", "learned"), "verdicts")
    tmp.drop(shapes, tree, merged)
    out = parsed.join(final, (F.col("host") == F.col("h")) & (F.col("path_shape") == F.col("s")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("judged", "learned").alias("verdict"), F.col("merged").alias("template"), "domain", "labels", "purity")
