"""URL filter by a path-template tree.

Rules come first: a rule fits its host and the host's subdomains if the path starts with the
rule's, and the longest one decides. For the others, each host has a tree of path segments:

1. Segments that look variable (numbers, long hexadecimal strings, dates, mixed letters and
   digits) become wildcards at once, which turns urls into few shapes; all later work is on
   counted shapes, so a host with a third of all pages is no larger than others.
2. Level by level from the host down, the children of a node become one wildcard if they are
   many and mostly rare.
3. Level by level from the leaves up, sibling branches below one node that differ in a single
   segment are merged as long as their shares of good labelled pages do not differ by a
   two-proportion test, in the order of their shares. Shares are counted in 1/256 steps, so a node
   may have any number of children. Siblings without labelled pages say nothing and are one branch
   of their own.
4. A template is rejected if the share of good among its labelled pages is below the limit. The
   share is smoothed towards that of the same template on all hosts, and that towards the
   corpus's, so a host with few labels is judged by what others show.

Labels are a table (page_id, good). Here they come from the documents that the urls name by
number, as `labels` marks them; a page of a template without labels has the share of its
template elsewhere, or the corpus's.

Defined results: a null url, or one without ://, has an empty host and path, and is judged with
the others of that host; an empty segment is a segment; what follows the 16th segment counts as
one more; pages with a null page_id and repeated rows get verdicts like others; an empty table
gives no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path prefix, verdict). Fixed values of the task.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: More children than this, if they average fewer pages than the second number, are one wildcard.
MANY, RARE = 24, 8
LEVELS = 16
#: Steps in which shares are counted.
STEPS = 256
#: Labelled pages that the corpus's share of good weighs as much as; share below which a template goes.
PRIOR, LIMIT = 8.0, 0.5
#: Shares that differ by fewer standard errors are similar.
SIMILAR = 1.64
WILD, MERGED, UNSEEN = "*", "+", "+?"

_VARIABLE = r"^(?:\d+|[0-9a-fA-F]{8,}|\d{4}-\d{2}-\d{2}|(?=[^/]*\d)(?=[^/]*[A-Za-z])[A-Za-z0-9_-]{6,})(\.[A-Za-z0-9]{1,5})?$"


def host_of(url: str = "url") -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(prefix))
        rule, verdict = F.when(fits, host + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path, variable ones as wildcards; a file ending stays."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    cut = F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS), F.array(F.array_join(F.slice(parts, LEVELS + 1, 1 << 30), "/")))).otherwise(parts)
    return F.transform(cut, lambda s: F.when(s.rlike(_VARIABLE), F.concat(F.lit(WILD), F.regexp_extract(s, _VARIABLE, 1))).otherwise(s))


def _generalise(shapes: DataFrame) -> DataFrame:
    """shapes: host, shape, n, seen, good. Adds template: the shape with crowded levels as wildcards."""
    now = shapes.withColumn("template", F.col("shape"))
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(deepest):
        at = F.get("template", F.lit(level))
        held = F.when(F.size("template") > level, F.slice("template", 1, level))
        now = now.withColumn("_at", at).withColumn("_above", F.array_join(held, "/"))
        children = now.where("_at is not null").groupBy("host", "_above", "_at").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "_above").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
        wide = nodes.where((F.col("kinds") > MANY) & (F.col("pages") < RARE * F.col("kinds"))).select("host", "_above", F.lit(True).alias("_wide"))
        joined = now.join(wide, ["host", "_above"], "left")
        changed = F.transform("template", lambda s, i: F.when((i == level) & F.col("_wide").isNotNull(), F.lit(WILD)).otherwise(s))
        now = common.checkpointed(joined.withColumn("template", changed).drop("_at", "_above", "_wide"))
    return now


def merge_steps(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one parent: the branch of each step of shares, after merging similar ones in order. rows: step (-1: no labels), n (siblings), seen, good.

    branch is null where a branch is a single sibling, which keeps its segment.
    """
    branches: list[list] = []
    for step, n, seen, good in sorted(zip(rows["step"], rows["n"], rows["seen"], rows["good"], strict=True)):
        last = branches[-1] if branches else None
        if last and last[0][0] >= 0 and _similar(last[2], last[3], seen, good):
            last[0].append(step)
            last[1:] = [last[1] + n, last[2] + seen, last[3] + good]
        else:
            branches.append([[step], n, seen, good])
    names = {}
    for steps, n, _, _ in branches:
        name = UNSEEN if steps[0] < 0 else f"{MERGED}{steps[0] / STEPS:.3f}-{steps[-1] / STEPS:.3f}"
        names |= dict.fromkeys(steps, name if n > 1 else None)
    return rows.assign(branch=rows["step"].map(names))[["host", "above", "below", "step", "branch"]]


def _similar(n1: int, k1: int, n2: int, k2: int) -> bool:
    p = (k1 + k2) / (n1 + n2)
    error = math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n2))
    return abs(k1 / n1 - k2 / n2) <= SIMILAR * error


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template (text), after generalising and merging."""
    now = _generalise(shapes)
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        has = F.size("template") > level
        above = F.when(has, F.array_join(F.slice("template", 1, level), "/"))
        below = F.when(has, F.array_join(F.slice("template", level + 2, 1 << 30), "/"))
        seg = F.when(has, F.get("template", F.lit(level)))
        keyed = now.withColumn("above", above).withColumn("below", below).withColumn("seg", seg)
        kinds = keyed.where("seg is not null").groupBy("host", "above", "below", "seg").agg(F.sum("seen").alias("seen"), F.sum("good").alias("good"))
        kinds = common.checkpointed(kinds.withColumn("step", F.when(F.col("seen") > 0, F.floor(F.col("good") * STEPS / F.col("seen") + 0.5)).otherwise(-1).cast("int")))
        steps = kinds.groupBy("host", "above", "below", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("seen"), F.sum("good").alias("good"))
        # at most STEPS + 2 rows in a group
        merged = steps.groupBy("host", "above", "below").applyInPandas(merge_steps, "host string, above string, below string, step int, branch string").where("branch is not null")
        named = common.spread_join(kinds.select("host", "above", "below", "seg", "step"), common.checkpointed(merged), ["host", "above", "below", "step"]).drop("step")
        joined = common.spread_join(keyed, common.checkpointed(named), ["host", "above", "below", "seg"], "left")
        changed = F.transform("template", lambda s, i: F.when((i == level) & F.col("branch").isNotNull(), F.col("branch")).otherwise(s))
        now = common.checkpointed(joined.withColumn("template", changed).drop("above", "below", "seg", "branch"))
    return now.withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/")))


def judge(pages: DataFrame, labels: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. labels: page_id, good (0 or 1)."""
    common.prepare(pages.sparkSession)
    rule, verdict = rule_columns(rules)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), path_of().alias("path"))
    urls = urls.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shape", shape_of(F.col("path")))
    urls = common.checkpointed(urls)
    told = labels.where("page_id is not null and good in (0, 1)").groupBy("page_id").agg(F.min("good").alias("good"), F.max("good").alias("other")).where("good = other").drop("other")
    counted = urls.join(told, "page_id", "left").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("seen"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    named = templates(common.checkpointed(counted))
    pure = named.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("good").alias("good"))
    everywhere = named.groupBy("template").agg(F.sum("seen").alias("all_seen"), F.sum("good").alias("all_good"))
    whole = counted.agg(F.sum("seen"), F.sum("good")).first()
    share = (whole[1] + 1) / (whole[0] + 2) if whole[0] else 0.5
    smoothed = lambda good, seen, prior: (F.col(good) + PRIOR * prior) / (F.col(seen) + F.lit(PRIOR))
    judged = pure.join(everywhere, "template").withColumn("purity", smoothed("good", "seen", smoothed("all_good", "all_seen", F.lit(share))))
    known = common.checkpointed(named.select("host", "shape", "template").join(judged.select("host", "template", "purity"), ["host", "template"]).select("host", "shape", "template", "purity"))
    out = common.spread_join(urls, known, ["host", "shape"], "left")
    decided = F.coalesce("ruled", F.when(F.col("purity") < min(LIMIT, share), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), "template", "purity")


def labels_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, good: a page whose url ends in a document's number is good if that is of quality and not toxic."""
    number = F.regexp_extract(path_of(), r"/(\d{1,18})(?:\.[A-Za-z0-9]{1,5}|/)?$", 1)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(number != "", number.cast("long")).alias("doc_id"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marked = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), good.cast("int").alias("good"))
    return named.join(marked, "doc_id").select("page_id", "good")
