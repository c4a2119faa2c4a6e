"""URL filters: rules, and for the rest trees of path templates, for each host and for the domains above it.

Level by level, as deep as the paths go, a segment stays only if its share of bad labels
differs from its siblings' by more than chance; all others are merged into a wildcard. A
template's share of good labels is smoothed towards that of the template its path has one
domain up, so hosts with few labels go by their domain and at last by all hosts; it is rejected if
that share is too low. Pages that a rule decides are labelled by it. Only counts of
distinct paths are shuffled, so a host with a third of all pages is as many rows as it
has paths, and these are counted in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.frames import quoted, written

#: (verdict, host, path): hold for the host and its subdomains, where the path starts so.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Levels after which a template's last wildcards are shown as one; they are told apart all the same.
LEVELS = 8
#: Standard errors between a branch's share of bad labels and its siblings', corrected for whole counts, that keep it apart.
APART = 3.0
#: Labels that the share one domain up counts for in a template's own share, and the share of good ones it needs.
PRIOR = 10.0
PURITY = 0.5
ANY, REST = "*", "**"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for addresses without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, end, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == end) | host.endswith("." + end)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(end + start)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def pools(host: Column) -> Column:
    """From wide to narrow: all hosts (empty), the last label, the last two labels, the host itself."""
    return F.array_distinct(F.array(F.lit(""), F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (pool, path, good, bad; each path of a pool once) with the template that each path falls under.

    Below a parent without both kinds of labels no segment can stay; once there are only
    such parents, all that is deeper is wildcards.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    table = paths.withColumn("segments", segments).withColumn("template", F.lit(""))
    level = 0
    while True:
        table = written(table.withColumn("segment", F.get("segments", F.lit(level))), "templates")
        here = table.where("segment IS NOT NULL AND good + bad > 0")
        children = here.groupBy("pool", "template", "segment").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        parents = (children.groupBy("pool", "template").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
                   .where("all_good > 0 AND all_bad > 0"))
        if parents.isEmpty():
            break
        own, all_labels = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
        others, share = all_labels - own, F.col("all_bad") / all_labels
        each = 1 / own + 1 / others
        distance = F.abs(F.col("bad") / own - (F.col("all_bad") - F.col("bad")) / others) - each / 2
        literal = (children.join(parents, ["pool", "template"]).where(others > 0)
                   .where(distance > APART * F.sqrt(share * (1 - share) * each))
                   .select("pool", "template", "segment", F.lit(True).alias("literal")))
        step = F.when(F.col("segment").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise(F.lit(ANY))))
        table = table.join(literal, ["pool", "template", "segment"], "left").withColumn(
            "template", F.concat("template", step)).drop("segment", "literal")
        level += 1
    deeper = F.repeat(F.lit("/" + ANY), F.greatest(F.size("segments") - level, F.lit(0)))
    return written(table.withColumn("template", F.concat("template", deeper)).drop("segments", "segment"), "templates")


def shown(template: Column) -> Column:
    """Wildcards at the end of ``template`` below LEVELS as one."""
    return F.regexp_replace(template, r"^((?:/[^/]*){%d})(?:/\*)+$" % LEVELS, "$1/" + REST)


def judged(pages: DataFrame, labels: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of ``pages``.

    A page that a rule decides is labelled by it: bad if blocked. Others take the label of the
    row of ``labels`` whose doc_id is their key, if given: bad if toxic or of quality 0; a null key has
    none. Without any label, every template is allowed. Null addresses have an empty host and
    path, and the template of those.
    """
    host, path = host_and_path(quoted("url").cast("string"))
    cut = pages.select(quoted(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"))
    known = cut.withColumn("is_bad", (decided == "block").cast("int"))
    if labels is not None:
        marks = (labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("page_id"))
                 .agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("marked")))
        known = known.join(marks, "page_id", "left").withColumn("is_bad", F.coalesce("is_bad", "marked"))
    paths = written(known.groupBy("host", "path").agg(
        F.count_if(F.col("is_bad") == 0).alias("good"), F.count_if(F.col("is_bad") == 1).alias("bad")), "paths")
    pooled = paths.select("host", "path", "good", "bad", F.posexplode(pools(F.col("host"))).alias("width", "pool"))
    tree = templates(pooled.groupBy("pool", "path").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    total = paths.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    usual = ((total["good"] or 0) + PRIOR) / ((total["good"] or 0) + (total["bad"] or 0) + PRIOR)
    counts = tree.groupBy("pool", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    placed = tree.select("pool", "path", "template").join(counts, ["pool", "template"])
    steps = (pooled.select("host", "path", "width", "pool").join(placed, ["pool", "path"]).groupBy("host", "path")
             .agg(F.array_sort(F.collect_list(F.struct("width", "template", "good", "bad"))).alias("steps")))  # four at most
    purity = F.aggregate("steps", F.lit(float(usual)),
                         lambda p, s: (s["good"] + PRIOR * p) / (s["good"] + s["bad"] + PRIOR))
    verdicts = steps.select("host", "path", F.element_at("steps", -1)["template"].alias("template"), purity.alias("purity"))
    learned = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return cut.join(verdicts, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(decided, learned).alias("verdict"),
        shown(F.col("template")).alias("template"), "purity")
