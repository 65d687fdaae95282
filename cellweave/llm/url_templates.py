"""URL filters: explicit rules first, then a path-template tree for each host.

The tree: a node is a host and a generalised prefix. A path's segments each have a shape (number,
hexadecimal, long mixed token, or text), which generalises variable segments in place. Level by level,
a node's text branches are compared by what follows them: the next segment's shape, or the segment
itself where several branches of the node have it. Branches with the same most frequent follower merge
with the largest of these where a two-sample G test finds no difference; the branches of a merged branch
are one node on the next level. Labels have no part in this.

A template (host and generalised path) is made of strata, the branches that were merged into it. A
stratum's share of bad rows is smoothed towards the template's mean over labelled strata, which is
smoothed towards `prior`; the template's purity is their mean by rows. So a stratum without labels
counts by its rows with the template's mean only, and one labelled branch can't reject its
larger siblings. Labels come from the URLs that a rule decides, and optionally from a table.

Scale: DataFrame functions only. Everything is counted per distinct (host, path) first; a node's
statistics are partial sums, so a host with a third of all pages is no large group. One round of
aggregates for each level, `levels` at most; the segments beyond keep their shapes and aren't merged.

Defined cases: a null url or one without `://` has an empty host and path and fits no rule; it's
allowed unless its (empty) template is labelled bad; repeated rows stay rows; ties of rules go to the
longer host, then to block; of equal branches the one later in order leads; empty tables give none;
other columns aren't read.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import discard, materialise, pick, small

MOST_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. A rule is (host + path, verdict)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    # the last that is wrapped around is looked at first: shortest first, so the longest wins
    for rule, v in sorted(rules, key=lambda r: (len(r[0]), len(r[0].split("/", 1)[0]), r[1] == "block")):
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    """A wildcard for what varies by its look (an extension is kept); else the segment."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    mixed = stem.rlike("[0-9]") & stem.rlike("[A-Za-z]")
    return F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("{n}"), ext)).when(stem.rlike("^[0-9A-Fa-f-]{8,}$") & mixed, F.concat(F.lit("{h}"), ext)).when(mixed & (F.length(stem) >= 12), F.concat(F.lit("{t}"), ext)).otherwise(segment)


def _is_text(segment: Column) -> Column:
    return (segment != "") & ~segment.rlike(r"^\{[nht]\}")


def _merged(cells: DataFrame, apart: float) -> DataFrame:
    """(host, prefix, seg, token) of the branches to merge, from counts c of cells(host, prefix, seg, after)."""
    node = ["host", "prefix"]
    shared = cells.where(_is_text(F.col("after"))).groupBy(*node, "after").agg(F.count("*").alias("n")).where("n > 1").select(*node, "after", F.lit(True).alias("shared"))
    what = F.when(_is_text(F.col("after")) & F.col("shared").isNull(), "{w}").otherwise(F.col("after"))
    cells = cells.join(shared, [*node, "after"], "left").groupBy(*node, "seg", what.alias("what")).agg(F.sum("c").alias("c"))
    cells = materialise(cells, "url-cells")
    branches = cells.groupBy(*node, "seg").agg(F.sum("c").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("c", "what"))["what"].alias("lead"))
    branches = materialise(branches, "url-branches")
    side = [*node, "lead"]
    few = branches.groupBy(*side).agg(F.count("*").alias("branches"), F.max(F.struct("size", "seg", "kinds")).alias("top")).where("branches > 1")
    few = materialise(few.select(*side, F.col("top.size").alias("top_size"), F.col("top.seg").alias("top_seg"), F.col("top.kinds").alias("top_kinds")), "url-leads")
    # G of each branch against the largest of its lead: 2 * sum over outcomes of a ln(a / expected), for both;
    # outcomes that only the largest has add up to one term
    top = cells.join(small(few.select(*side, F.col("top_seg").alias("seg"))), [*node, "seg"]).select(*side, "what", F.col("c").alias("t"))
    own = cells.join(branches.drop("kinds"), [*node, "seg"]).join(small(few), side).where("seg <> top_seg").join(small(materialise(top, "url-tops")), [*side, "what"], "left")
    both = F.col("size") + F.col("top_size")
    t = F.coalesce("t", F.lit(0))

    def part(x: Column, size: str) -> Column:
        return F.when(x > 0, x * F.ln(x / ((F.col("c") + t) * F.col(size) / both))).otherwise(0.0)

    tested = own.groupBy(*side, "seg", "size", "top_size", "top_kinds").agg(F.sum(part(F.col("c"), "size") + part(t, "top_size")).alias("met"), F.sum(t).alias("seen"), F.count_if(F.col("t").isNull()).alias("more"))
    g = 2 * (F.col("met") + (F.col("top_size") - F.col("seen")) * F.ln(both / F.col("top_size")))
    df = F.col("more") + F.col("top_kinds") - 1
    like = materialise(tested.where(g - df <= apart * F.sqrt(F.greatest(F.lit(1.0), 2 * df))).select(*side, "seg"), "url-like")
    heads = few.join(small(like.select(*side).distinct()), side, "left_semi").select(*side, F.col("top_seg").alias("seg"))
    out = materialise(like.unionByName(heads).select(*node, "seg", F.concat(F.lit("{~"), F.col("lead"), F.lit("}")).alias("token")), "url-merged")
    discard(cells, branches, few, like)
    return out


def templates(paths: DataFrame, levels: int = 8, apart: float = 3.0) -> DataFrame:
    """(host, path, template, stratum) of distinct paths(host, path, n), with all columns of paths."""
    segs = F.transform(F.filter(F.split("path", "/", -1), lambda s: s != ""), _shape)
    state = paths.select("*", segs.alias("segs"), F.lit("").alias("prefix"), F.lit("").alias("stratum"))
    state = materialise(state, "url-tree")
    deepest = state.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(min(levels, deepest)):
        seg, after = F.get("segs", F.lit(d)), F.coalesce(F.get("segs", F.lit(d + 1)), F.lit(""))
        cells = state.where(F.size("segs") > d).select("host", "prefix", seg.alias("seg"), after.alias("after"), "n").where(_is_text(F.col("seg")))
        merged = _merged(cells.groupBy("host", "prefix", "seg", "after").agg(F.sum("n").alias("c")), apart)
        named = state.withColumn("seg", seg).join(small(merged), ["host", "prefix", "seg"], "left")
        prefix = F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), F.coalesce("token", "seg")))
        stratum = F.when(F.col("token").isNull(), F.col("stratum")).otherwise(F.concat("stratum", F.lit("/"), "seg"))
        last = state
        state = materialise(named.select(*paths.columns, "segs", prefix.alias("prefix"), stratum.alias("stratum")), "url-tree")
        discard(last, merged)
    rest = F.transform(F.slice("segs", levels + 1, F.greatest(F.size("segs"), F.lit(1))), lambda s: F.concat(F.lit("/"), s))
    end = F.when(F.size("segs") == 0, "/").when(F.col("path").endswith("/"), "/").otherwise("")
    return state.select(*paths.columns, F.concat("host", "prefix", F.array_join(rest, ""), end).alias("template"), "stratum")


def purities(named: DataFrame, smooth: float, prior: float) -> DataFrame:
    """(template, labels, purity) from rows (template, stratum, n, good, bad)."""
    strata = named.groupBy("template", "stratum").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    known = F.col("good") + F.col("bad")
    sums = strata.groupBy("template").agg(
        F.sum("n").alias("n"), F.sum(known).alias("labels"), F.count_if(known > 0).alias("strata"), F.sum(F.when(known > 0, F.col("bad") / known).otherwise(0.0)).alias("shares"),
        F.sum(F.col("n") * F.col("bad") / (known + smooth)).alias("own"), F.sum(F.col("n") * smooth / (known + smooth)).alias("pulled"),
    )
    mean = (F.col("shares") + smooth * prior) / (F.col("strata") + smooth)
    purity = (F.col("own") + mean * F.col("pulled")) / F.col("n")
    # to six digits, as the order of the sums isn't fixed
    return sums.select("template", "labels", (F.floor(purity * 1e6 + 0.5) / 1e6).alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, purity: float = 0.8, least: int = 5, smooth: float = 2.0, prior: float = 0.1, id_col: str = "page_id", url_col: str = "url", **tree: float) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages.

    labelled: optional (page_id, bad boolean); a rule comes first. A template with `least` labelled rows
    or more is rejected at a purity of `purity` or more."""
    pages = pick(pages, id_col, url_col)
    host, path = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    known = rows.withColumn("bad", F.col("ruled") == "block")
    if labelled is not None:
        votes = pick(labelled, "page_id", "bad").where("bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg((F.avg(F.col("bad").cast("int")) > 0.5).alias("voted"))
        known = known.join(votes, "page_id", "left").withColumn("bad", F.coalesce("bad", "voted"))
    paths = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    named = materialise(templates(paths, **tree), "url-templates")
    score = materialise(purities(named, smooth, prior), "url-purities")
    judged = named.select("host", "path", "template").join(small(score), "template")
    method = F.when((F.col("labels") >= least) & (F.col("purity") >= purity), "block").otherwise("allow")
    judged = judged.select("host", "path", "template", "purity", method.alias("method"))
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), "template", "purity")
