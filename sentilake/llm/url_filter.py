"""URL verdicts from rules and from a tree of path templates.

Each host's paths are cut into segments, of which plain numbers, dates and long hex
words become kinds. The tree grows level by level, as deep as paths go, on counts of
distinct paths:

* A node with many children of which most came once has a variable segment; its rare
  children become a wildcard, but for those whose labels differ significantly.
* Other children are branches. Those that are alike, in that samples of what comes below
  them are the same and their shares of bad labels don't differ significantly, are merged
  into one, named after the first and the last of them.
* A node with too few labels to tell anything apart has one template for all below it.

What is left are templates. A template's purity, its share of good labels, is smoothed
towards its host's, and that towards the whole table's. A template is rejected if even
the upper end of what its purity may be is below a stated share of what its host, or the
whole table if that is purer, would let one expect. Rules by host and path come before
templates.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SMALL, meet, only, stage, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, REST = "*", "**"


@dataclass(frozen=True)
class Tree:
    """When segments vary, when branches differ, and when a template is rejected."""

    many: int = 20  # children from which a segment may be variable
    rare: int = 20  # a variable segment's child is rare with less than one in so many of the node's urls
    few: int = 10  # labels below which a node or child can't tell
    z: float = 3.0  # standard errors that make a branch differ
    host_weight: int = 20  # labels that the whole table's purity counts for in a host's
    template_weight: int = 10  # labels that a host's purity counts for in a template's
    errors: float = 2.0  # standard errors up to which a template's purity may be higher
    share: float = 0.75  # a template is rejected below this share of the purity to expect


def _after_scheme(url: Column, pattern: str) -> Column:
    """Group 1 of a pattern in what follows the first ``://``; empty where there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at == 0, F.lit("")).otherwise(F.regexp_extract(F.substr(url, at + 3), pattern, 1))


def host_of(url: Column) -> Column:
    return F.translate(_after_scheme(url, "^([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _after_scheme(url, "^[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """rule and verdict of the longest of (verdict, host, path) that fits; rules are a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def path_kind(path: Column) -> Column:
    """A path with numbers, dates and long hex words as kinds; endings stay."""
    x = F.regexp_replace(path, "[0-9]{4}-[0-9]{2}-[0-9]{2}", "{date}")
    x = F.regexp_replace(x, "[0-9a-f]{16,}", "{hex}")
    return F.regexp_replace(x, "[0-9]+", "{n}")


def _smooth(good: Column, n: Column, prior: Column, weight: int) -> Column:
    return (good + weight * prior) / (n + weight)


def _differs(n: str, bad: str, all_n: str, all_bad: str, z: float) -> Column:
    """Whether a part's share of bad labels differs from that of the rest by more than z standard errors."""
    d = lambda c: F.col(c).cast("double")
    gap = d(bad) * (d(all_n) - d(n)) - (d(all_bad) - d(bad)) * d(n)
    var = d(all_bad) * (d(all_n) - d(all_bad)) / F.greatest(d(all_n), F.lit(1.0)) * d(n) * (d(all_n) - d(n))
    return gap * gap > z * z * var


def _few(df: DataFrame) -> DataFrame:
    """A staged table, broadcast if it has few rows; else Spark chooses, and splits what is skewed."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _branches(open_: DataFrame, level: int, tree: Tree) -> DataFrame:
    """host, template, key and the branch that each child of each open node comes to."""
    below = F.md5(F.get("segments", F.lit(level + 1)))
    # the least hash of each quarter of what comes below: a sample that doesn't depend on how often it came
    slots = [F.coalesce(F.min(F.when(F.substring(below, 1, 1).between(a, b), below)), F.lit("-")) for a, b in ("03", "47", "8b", "cf")]
    alike = F.concat_ws("|", F.max(below.isNull()).cast("string"), *slots)
    child = stage(open_.where("key is not null").groupBy("host", "template", "key").agg(F.sum("n").alias("c_n"), F.sum("labelled").alias("c_l"), F.sum("bad").alias("c_b"), alike.alias("alike")))
    node = stage(child.groupBy("host", "template").agg(F.count("*").alias("m"), F.count_if(F.col("c_n") == 1).alias("once"), F.sum("c_n").alias("p_n"), F.sum("c_l").alias("p_l"), F.sum("c_b").alias("p_b")))
    tells = F.col("c_l") >= tree.few
    variable = (F.col("m") >= tree.many) & (2 * F.col("once") >= F.col("m")) & (F.col("c_n") * tree.rare < F.col("p_n"))
    wild = variable & ~(tells & _differs("c_l", "c_b", "p_l", "p_b", tree.z))
    children = stage(child.join(_few(node), ["host", "template"]).select("host", "template", "key", "alike", "c_l", "c_b", "p_l", wild.alias("wild")))
    merged = stage(children.where(~F.col("wild") & (F.col("p_l") >= tree.few)).groupBy("host", "template", "alike").agg(F.count("*").alias("g"), F.sum("c_l").alias("g_l"), F.sum("c_b").alias("g_b"), F.min("key").alias("first"), F.max("key").alias("last")))
    own = (F.col("g") == 1) | (tells & _differs("c_l", "c_b", "g_l", "g_b", tree.z))
    branch = F.when(F.col("p_l") < tree.few, F.lit(REST)).when(F.col("wild"), F.lit(WILD)).when(own, F.col("key")).otherwise(F.concat(F.lit("("), "first", F.lit(".."), "last", F.lit(")")))
    named = stage(children.join(_few(merged), ["host", "template", "alike"], "left").select("host", "template", "key", branch.alias("branch")))
    unstage(child, node, children, merged)
    return named


def templates(urls: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """host, kind (a path's), n (its urls) and the template, purity and verdict that they come to.

    ``urls`` has host, kind and good (true, false or null where unlabelled).
    """
    leaves = urls.groupBy("host", "kind").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.count_if(~F.col("good")).alias("bad"))
    cut = F.split(F.regexp_replace("kind", "^/", ""), "/")
    open_ = stage(leaves.withColumn("segments", cut).withColumn("template", F.lit("")))
    done, level = [], 0
    while not open_.isEmpty():
        keyed = open_.withColumn("key", F.get("segments", F.lit(level)))
        named = _branches(keyed, level, tree)
        joined = stage(keyed.join(_few(named), ["host", "template", "key"], "left"))
        unstage(open_, named)
        grown = F.concat("template", F.lit("/"), "branch")
        facts = ("host", "kind", "n", "labelled", "bad")
        # paths that have ended, and nodes that can't tell
        done.append(joined.where(F.col("branch").isNull() | (F.col("branch") == REST)).select(*facts, F.coalesce(grown, "template").alias("template")))
        open_ = stage(joined.where(F.col("branch") != REST).select(*facts, "segments", grown.alias("template")))
        level += 1
    leaves = leaves.select(*("host", "kind", "n", "labelled", "bad")).withColumn("template", F.lit("")).limit(0)
    for part in done:
        leaves = leaves.unionByName(part)
    leaves = stage(leaves)
    own = leaves.groupBy("host", "template").agg(F.sum(F.col("labelled") - F.col("bad")).alias("good"), F.sum("labelled").alias("labelled"))
    hosts = own.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("labelled").alias("h_labelled"))
    # one row
    whole = hosts.agg(F.when(F.sum("h_labelled") > 0, F.sum("h_good") / F.sum("h_labelled")).otherwise(F.lit(1.0)).alias("all_purity"))
    priors = hosts.join(F.broadcast(whole)).select("host", "all_purity", _smooth(F.col("h_good"), F.col("h_labelled"), F.col("all_purity"), tree.host_weight).alias("h_purity"))
    pure = own.join(priors, "host").withColumn("purity", _smooth(F.col("good"), F.col("labelled"), F.col("h_purity"), tree.template_weight))
    upper = F.col("purity") + tree.errors * F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("labelled") + tree.template_weight))
    verdict = F.when(upper < tree.share * F.greatest("h_purity", "all_purity"), F.lit("block")).otherwise(F.lit("allow"))
    pure = stage(pure.select("host", "template", "purity", verdict.alias("tree_verdict")))
    return leaves.select("host", "kind", "n", "template").join(_few(pure), ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", quality_col: str = "quality", tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url.

    A null url, or one without ``://``, has an empty host and path and forms a template
    with others like it. Labels are joined by id; of several the worst counts, null is
    unlabelled. Without labels nothing is rejected but by rules. Repeated rows are judged
    each. An empty table gives no rows; other columns aren't read.
    """
    urls = only(pages, page_id=id_col, url=url_col)
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("kind", path_kind(F.col("path")))
    known = only(labels, label_id=label_id_col, quality=quality_col).where("label_id is not null and quality is not null").groupBy("label_id").agg(F.min("quality").alias("quality"))
    labelled = urls.join(known, urls["page_id"] == known["label_id"], "left").select("host", "kind", (F.col("quality") > 0).alias("good"))
    key = F.concat("host", F.lit(" "), "kind")
    found = stage(templates(labelled, tree).select(key.alias("key"), "n", "template", "purity", "tree_verdict"))
    joined = meet(urls.withColumn("key", key), found, "key")
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = joined.select("page_id", "host", "path", ruled.alias("r"), "tree_verdict", "template", "purity")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "tree_verdict").alias("verdict"), "template", "purity")
