"""URL filters: host rules first, then a path-template tree learned per host.

Learning runs on labelled urls (0 fine, 1 unwanted). Each url's path is cut into segments, whatever
their number; a segment that varies by its look (digits, very long) becomes ``*``, with ``.ext`` if it
has a file's extension. A host is the top of its tree. A node whose labels differ is split by the next
segment: children on the same side of ``threshold`` whose share of unwanted urls lies within ``merge_z``
standard errors of what they have together are merged into one branch with a common subtree, others stay
by name. If a merged branch has at least ``star_share`` of the node's child segments, it is the node's
wildcard: segments that training has not seen follow it. A run of segments that all labelled urls of a
node share is one step (a radix tree), and a node whose labels agree is a leaf, so the work goes as deep
as labels differ, not as paths are long.

A node's purity is its share of unwanted urls, smoothed with ``prior`` pseudo-urls towards its parent's
purity; above the hosts is the share in all labelled urls. A url is judged by the deepest node that its
template reaches, unwanted from a purity of ``threshold``.

Distinct templates are counted before anything else, and every step sums by node and segment, so a host
with a third of all urls is spread like any others and no task or driver holds a tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import held_out, lower_ascii, read_table, staged

#: Rules of the query: (verdict, host suffix, path prefix).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words of the query that label a page as unwanted if the text that it shows has one.
SEED_WORDS = ("adult", "ads", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")


def host_of(url: Column) -> Column:
    """Lower-cased text between the first :// and the next /, ?, # or the end; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text from the end of the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list) -> Column:
    """(rule, verdict) struct of the longest rule that fits; null if none does.

    Longest means most characters of host and path together; ties go to the longer host.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    out = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in ranked]
    return F.coalesce(*[F.when(f, o) for f, o in zip(fits, out)])


def template_of(path: Column) -> Column:
    """All segments of a path, variable ones as ``*`` or ``*.ext``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(
        s.rlike(r"[0-9]") | (F.length(s) > 24), F.when(s.rlike(r"\.[A-Za-z]{2,5}$"), F.lit("*.ext")).otherwise(F.lit("*"))).otherwise(s))


def _split_nodes(nodes: DataFrame, shapes: DataFrame, prior: float, threshold: float, merge_z: float, star_share: float) -> DataFrame:
    """(host, node, seg, child) of the branches below ``nodes``; the branch of seg null is the wildcard."""
    taught = shapes.where("n > 0").join(nodes.where("not leaf"), ["host", "node"]).where("size(rest) > 0")
    seg = F.array_join(F.slice("rest", F.lit(1), F.col("take")), "/")
    children = staged(taught.groupBy("host", "node", seg.alias("seg")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("purity").alias("purity")).withColumn(
        "side", (F.col("bad") + prior * F.col("purity")) / (F.col("n") + prior) >= threshold), "url-children")
    sides = children.groupBy("host", "node", "side").agg(F.sum("n").alias("s_n"), F.sum("bad").alias("s_bad"))
    rate = F.col("s_bad") / F.col("s_n")
    error = F.sqrt(F.greatest(rate * (1 - rate), 1 / (4 * F.col("s_n"))) / F.col("n"))
    alike = children.join(sides, ["host", "node", "side"]).withColumn("alike", F.abs(F.col("bad") / F.col("n") - rate) <= merge_z * error)
    counted = alike.groupBy("host", "node").agg(
        F.count("*").alias("kinds"), F.count(F.when(F.col("alike") & F.col("side"), 1)).alias("bad_kinds"), F.count(F.when(F.col("alike") & ~F.col("side"), 1)).alias("fine_kinds"))
    mine = F.when(F.col("side"), F.col("bad_kinds")).otherwise(F.col("fine_kinds"))
    merged = F.concat(F.col("node"), F.when(F.col("side"), "/{unwanted}").otherwise("/{fine}"))
    named = alike.join(counted, ["host", "node"]).select("host", "node", "seg", F.when(F.col("alike") & (mine >= 2), merged).otherwise(F.concat("node", F.lit("/"), "seg")).alias("child"))
    most = F.greatest("bad_kinds", "fine_kinds")
    stars = counted.where((most >= 2) & (most >= star_share * F.col("kinds"))).select(
        "host", "node", F.lit(None).cast("string").alias("seg"), F.concat("node", F.when(F.col("bad_kinds") > F.col("fine_kinds"), "/{unwanted}").otherwise("/{fine}")).alias("child"))
    return staged(named.unionByName(stars), "url-branches")


def judge_templates(shapes: DataFrame, *, prior: float = 1.0, threshold: float = 0.5, merge_z: float = 2.0, star_share: float = 2 / 3) -> DataFrame:
    """(host, template, node, purity) of every row of ``shapes``: host, template array, n labelled urls, bad unwanted ones.

    (host, template) are distinct. A shape without labels is judged by the others. Without any label
    node and purity are null.
    """
    n, bad = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n:
        return shapes.select("host", "template", F.lit(None).cast("string").alias("node"), F.lit(None).cast("double").alias("purity"))
    here = shapes.select("host", "template", "n", "bad", F.col("host").alias("node"), F.col("template").alias("rest"), F.lit(bad / n).alias("over"))
    done = []
    while True:
        taught = F.when((F.col("n") > 0) & (F.size("rest") > 0), F.col("rest"))
        nodes = here.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.first("over").alias("over"), F.min(taught).alias("lo"), F.max(taught).alias("hi"))
        nodes = staged(nodes.select(
            "host", "node", ((F.col("all_bad") + prior * F.col("over")) / (F.col("all_n") + prior)).alias("purity"),
            ((F.col("all_bad") == 0) | (F.col("all_bad") == F.col("all_n")) | F.col("lo").isNull()).alias("leaf"),
            F.expr("greatest(1, aggregate(sequence(0, least(size(lo), size(hi)) - 1), 0, (k, i) -> if(k = i and lo[i] = hi[i], k + 1, k)))").alias("take")), "url-nodes")
        if nodes.where("not leaf").isEmpty():
            done.append(here.join(nodes, ["host", "node"]).select("host", "template", "node", "purity"))
            break
        branches = _split_nodes(nodes, here, prior, threshold, merge_z, star_share)
        stars = branches.where("seg is null").select("host", "node", F.col("child").alias("star"))
        known = branches.where("seg is not null").select(F.col("host").alias("k_host"), F.col("node").alias("k_node"), F.col("seg").alias("k_seg"), "child")
        walked = here.drop("over").join(nodes, ["host", "node"]).withColumn("seg", F.when(~F.col("leaf") & (F.size("rest") >= F.col("take")) & (F.size("rest") > 0), F.array_join(F.slice("rest", F.lit(1), F.col("take")), "/")))
        walked = walked.join(stars, ["host", "node"], "left").join(known, (F.col("host") == F.col("k_host")) & (F.col("node") == F.col("k_node")) & (F.col("seg") == F.col("k_seg")), "left")
        walked = staged(walked.withColumn("next", F.coalesce("child", F.when(F.col("seg").isNotNull(), F.col("star")))).select("host", "template", "n", "bad", "node", "purity", "next", "rest", "take"), "url-walk")
        done.append(walked.where("next is null").select("host", "template", "node", "purity"))
        here = walked.where("next is not null").select("host", "template", "n", "bad", F.col("next").alias("node"), F.expr("slice(rest, take + 1, size(rest))").alias("rest"), F.col("purity").alias("over"))
    return staged(reduce(DataFrame.unionByName, done), "url-verdicts")


def judge_urls(pages: DataFrame, labelled: DataFrame, *, url: str = "url", page_id: str = "page_id", threshold: float = 0.5, **tree) -> DataFrame:
    """(page_id, url, host, path, template, node, purity, unwanted) for every row of ``pages``.

    ``labelled`` has host, path and label, once for each labelled url; rows with a null label teach
    nothing, repeated rows count. Null urls and urls without :// have an empty host and path and are
    judged like any host. Repeated pages stay; null ids pass through, as do no other columns. Without
    labelled urls nothing is unwanted and node and purity are null.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("template", template_of(F.col("path")))
    taught = labelled.where("label is not null").select("host", template_of(F.col("path")).alias("template"), F.col("label").cast("long").alias("label")).groupBy("host", "template").agg(
        F.count("*").alias("n"), F.sum("label").alias("bad"))
    asked = rows.select("host", "template").distinct().select("host", "template", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    shapes = staged(taught.unionByName(asked).groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-shapes")
    found = judge_templates(shapes, threshold=threshold, **tree).withColumnsRenamed({"host": "f_host", "template": "f_template"})
    return rows.join(found, (F.col("host") == F.col("f_host")) & (F.col("template") == F.col("f_template")), "left").select(
        "page_id", "url", "host", "path", F.array_join("template", "/").alias("template"), "node", "purity", F.coalesce(F.col("purity") >= threshold, F.lit(False)).alias("unwanted"))


def page_labels(pages: DataFrame, words: tuple = SEED_WORDS) -> DataFrame:
    """(host, path, label) of the pages whose crc32(page_id as text) is even: 1 if the shown text has one of ``words``."""
    shown = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), "<[^>]*>", " ")
    return pages.where(~held_out(F.col("page_id"), 2, 1)).select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), shown.rlike(f"(?i)(?<![\\p{{L}}0-9])({'|'.join(words)})(?![\\p{{L}}0-9])").cast("int").alias("label"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url under RULES; elsewhere by the tree, taught by the texts of half of the pages (``page_labels``)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = judge_urls(pages, page_labels(pages)).withColumn("ruled", rule_of(F.col("host"), F.col("path"), RULES))
    return judged.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"),
                         F.coalesce(F.col("ruled.verdict"), F.when(F.col("unwanted"), "block").otherwise("allow")).alias("verdict"), "template", "node", "purity")
