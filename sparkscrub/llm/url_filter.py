"""URL filter by path templates.

The paths of a host form a tree. A child of a node is generalised to ``*`` where it looks variable:
it holds a digit, or it is one of many rare children. Branches that differ in one literal segment are
then merged where their shares of bad labels are statistically alike (a two-proportion test of the
branch against the rest of its parent). Each resulting template of a host gets a purity: the share of
bad labels among its pages, smoothed towards its host's share and that towards the overall one.
Templates with a smoothed share of ``reject_at`` or more are rejected. Fixed rules on host and path
come first; the longest rule that fits wins.

Scale: one row per path segment is combined map-side into counts per (host, place, shape of the
prefix, segment); a host with a third of all pages is spread over its segments. Segments that stay
literal have ``min_pages`` pages or more, so the table of them is a small share of the input. It is
joined back by (host, place, prefix, segment), the verdicts by (host, template); both sides are read
from written tables, so AQE can split a hot key or broadcast what its size allows. Pages are numbered
first, as ids may repeat.

The prefix of a segment is a hash of the shapes before it (digits to ``9``, others as they are, long
ones cut to their class), so that no pass per tree level is needed.

Defined results: a null url, or one without ``://``, has empty host and path and the verdict of the
method for that host; labels may be missing or empty (then no template is rejected); repeated rows
count as often as they occur; an empty table gives an empty result; other columns are ignored.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkscrub.llm.common import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlPolicy:
    """``min_pages``: a rarer segment is variable if its siblings are many; ``many``: so many siblings;
    ``z``: a branch is like its siblings below this deviation; ``weight``: pages' worth of the prior."""

    min_pages: int = 8
    many: int = 12
    z: float = 1.96
    weight: float = 4.0
    reject_at: float = 0.5
    least_labels: int = 3


#: (verdict, host, path prefix)
Rules = tuple[tuple[str, str, str], ...]


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """(verdict, rule) of the longest rule that fits host (or a parent of it) and path; null if none does."""
    chosen = F.lit(None).cast("struct<verdict: string, rule: string>")
    # the last of the whens that fits shall be the longest: build from the shortest up
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + prefix).alias("rule"))).otherwise(chosen)
    return chosen


def _shape(segment: Column) -> Column:
    """Runs of digits as one 9; segments over 32 characters as their class."""
    return F.when(F.length(segment) > 32, F.lit("<long>")).otherwise(F.regexp_replace(segment, "[0-9]+", "9"))


def page_segments(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Numbered pages with host, path and segments: place, text, shape and the hash of the shapes before."""
    url = F.col(url_col)
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("page_id"),
                        host_of(url).alias("host"), path_of(url).alias("path"))
    segments = F.split("path", "/")
    rows = rows.withColumn("segments", F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))))
    start = F.struct(F.lit(0).cast("long").alias("hash"), F.array().cast("array<bigint>").alias("all"))
    hashes = F.aggregate(F.transform("segments", _shape), start, lambda a, s: F.struct(
        F.xxhash64(a["hash"], s).alias("hash"), F.array_append(a["all"], a["hash"]).alias("all")), lambda a: a["all"])
    return rows.withColumn("before", hashes)


def learn_templates(segmented: DataFrame, labels: DataFrame, policy: UrlPolicy = UrlPolicy()) -> tuple[DataFrame, DataFrame]:
    """(pages with ``template``, templates with counts, smoothed share and ``rejected``).

    ``labels`` has page_id and bad (0 or 1); a page without label counts for the tree only."""
    each = segmented.select("rid", "host", F.posexplode(F.arrays_zip("segments", "before")).alias("place", "s")).select(
        "rid", "host", "place", F.col("s.segments").alias("segment"), F.col("s.before").alias("before"))
    nodes = shared(each.groupBy("host", "place", "before", "segment").agg(F.count(F.lit(1)).alias("n")), "url-nodes")
    parents = shared(nodes.groupBy("host", "place", "before").agg(F.count(F.lit(1)).alias("children")), "url-parents")
    plain = ~F.col("segment").rlike("[0-9]") & (F.length("segment") <= 32)
    literal = (nodes.where(plain).join(parents, ["host", "place", "before"])
               .where((F.col("n") >= policy.min_pages) | (F.col("children") <= policy.many))
               .select("host", "place", "before", "segment", F.lit(True).alias("literal")))
    literal = shared(literal, "url-literals")
    told = each.join(literal, ["host", "place", "before", "segment"], "left").select(
        "rid", "place", F.when(F.col("literal"), F.col("segment")).otherwise("*").alias("token"))
    tokens = told.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t"))
    pages = segmented.select("rid", "page_id", "host", "path").join(tokens.select("rid", F.col("t.token").alias("tokens")), "rid", "left")
    one = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    pages = shared(pages.join(one, "page_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "url-pages")
    counted = shared(pages.groupBy("host", "tokens").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"),
                                                          F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "url-counted")
    merged = shared(_merge(counted, policy), "url-merged")
    templates = _purity(merged, policy)
    return pages.join(merged.select("host", "tokens", "template"), ["host", "tokens"]).select("rid", "page_id", "host", "path", "template"), templates


def _merge(counted: DataFrame, policy: UrlPolicy) -> DataFrame:
    """``counted`` with ``template``: literal branches that are like their siblings become ``*``."""
    branch = counted.select("host", "labelled", "bad", F.posexplode("tokens").alias("place", "token"), F.xxhash64("tokens").alias("of"), "tokens")
    parent = F.array_join(F.slice("tokens", F.lit(1), F.col("place")), "/")
    branch = branch.where("token != '*'").withColumn("parent", parent)
    key = ["host", "place", "parent"]
    children = branch.groupBy(*key, "token").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    all_of = children.groupBy(*key).agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count(F.lit(1)).alias("k"))
    rest_l, rest_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
    share, rest = F.col("b") / F.col("l"), rest_b / rest_l
    pooled = F.col("pb") / F.col("pl")
    sd = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / rest_l))
    unlike = (F.col("l") > 0) & (rest_l > 0) & (F.abs(share - rest) > policy.z * sd)
    distinct = children.join(all_of, key).where((F.col("k") == 1) | unlike).select(*key, "token", F.lit(True).alias("stays"))
    marked = branch.join(distinct, [*key, "token"], "left").groupBy("host", "of", "tokens").agg(
        F.collect_set(F.when(F.col("stays").isNull(), F.col("place"))).alias("open"))
    back = counted.join(marked.select("host", "tokens", "open"), ["host", "tokens"], "left")
    star = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.coalesce("open", F.array().cast("array<int>")), i), F.lit("*")).otherwise(t))
    return back.withColumn("template", F.concat(F.lit("/"), F.array_join(star, "/"))).drop("open")


def _purity(merged: DataFrame, policy: UrlPolicy) -> DataFrame:
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    templates = merged.groupBy("host", "template").agg(*sums)
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    total = hosts.agg(F.coalesce(F.sum("hl"), F.lit(0)).alias("al"), F.coalesce(F.sum("hb"), F.lit(0)).alias("ab"))  # one row
    w = F.lit(policy.weight)
    overall = (F.col("ab") + 0.5) / (F.col("al") + 1.0)
    of_host = (F.col("hb") + w * overall) / (F.col("hl") + w)
    smoothed = (F.col("bad") + w * of_host) / (F.col("labelled") + w)
    rejected = (smoothed >= policy.reject_at) & (F.col("hl") >= policy.least_labels)
    return templates.join(hosts, "host").crossJoin(F.broadcast(total)).select(
        "host", "template", "n", "labelled", "bad", smoothed.alias("bad_share"), rejected.alias("rejected"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Rules = (), policy: UrlPolicy = UrlPolicy(),
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and its smoothed share, for every page."""
    segmented = shared(page_segments(pages, id_col, url_col), "url-segments")
    with_template, templates = learn_templates(segmented, labels, policy)
    known = shared(templates.select("host", "template", "bad_share", "rejected"), "url-templates")
    judged = with_template.join(known, ["host", "template"], "left")
    by = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.withColumn("by", by).select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", method).alias("verdict"), "template", "bad_share")
