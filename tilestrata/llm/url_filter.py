"""URL filtering by a path-template tree per host; DataFrame functions only.

1. Rules (host suffix, path prefix, verdict) are matched; the longest fitting rule decides, and
   what rules decide is the labelled evidence of the tree.
2. Every URL's path is cut into segments. Segments that look variable (numbers with or
   without an extension, hexadecimal ids, words holding digits) become wildcards at once; a
   literal segment becomes a wildcard where its host and parent template show many distinct
   values with few repeats. Segments beyond `depth` are taken together as `**`.
3. Sibling branches that remain literal are merged into one branch when their evidence
   is statistically alike: equal band of the Wilson interval of their blocked share and of their mean
   remaining depth. Branches without any evidence of their own are compared by what the same path has on all hosts.
4. Purity is smoothed down the tree. On all hosts together, a path prefix has (blocked + weight * its parent's) /
   (labelled + weight), from the prior at the root; a host's template has (blocked + weight * q) / (labelled + weight), where q is the
   mean of its parent template's purity and of its paths' purity on all hosts. So a template without labels is judged by its
   host's other pages and by equal paths elsewhere, and rejected only where both speak against it.
5. A template is rejected if its purity reaches `purity`; the prior is below it, so hosts and paths without
   evidence are allowed.

Counting is by aggregation of (host, segments), never by collecting a host's pages, so a
host with a third of all rows is pre-aggregated before it is shuffled; the last join
meets AQE's skew handling.

Defined results: null URLs and URLs without `://` have empty host and path and get the
verdict of the empty host's template; rows that repeat an id are judged each; rows with equal URLs get equal verdicts; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.llm.storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host lower-cased in A-Z; path up to the query or fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[0] + rule[1]


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(rule_name(r)), r)):
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        name, verdict = F.when(fits, F.lit(rule_name(r))).otherwise(name), F.when(fits, F.lit(r[2])).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    number = F.regexp_like(segment, F.lit(r"^[0-9]+(\.[a-z]+)?$"))
    digits = F.regexp_like(segment, F.lit(r"[0-9]"))
    return F.when(number, F.lit("{n}")).when(digits, F.lit("{x}")).otherwise(segment)


def _band(hits: Column, n: Column) -> Column:
    """Band of a share by its 95% Wilson interval: none, low, high or mixed."""
    z2 = 3.8416
    p = hits / n
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), F.sqrt(F.greatest((p * (1 - p) + z2 / (4 * n)) * z2 / n, F.lit(0.0))) / (1 + z2 / n)
    return F.when(n == 0, "none").when(mid - half > 0.5, "high").when(mid + half < 0.5, "low").otherwise("mixed")


def _shared_purity(urls: DataFrame, depth: int, prior: float, weight: float) -> DataFrame:
    """urls with _c, the purity on all hosts of each prefix of their segments, one level more for each segment up to `depth`."""
    out = urls.withColumn("_c", F.array().cast("array<double>"))
    for level in range(depth):
        key = F.when(F.size("_s") > level, F.concat_ws("/", F.slice("_s", 1, level + 1)))
        above = F.when(F.lit(level == 0), F.lit(prior)).otherwise(F.get("_c", F.lit(level - 1)))
        out = out.withColumn("_g", key)
        sums = out.filter("_g is not null").groupBy("_g").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max(above).alias("up"))
        sums = sums.select("_g", ((F.col("b") + weight * F.col("up")) / (F.col("l") + weight)).alias("_x"))
        out = out.join(sums, "_g", "left").withColumn("_c", F.when(F.col("_x").isNull(), F.col("_c")).otherwise(F.concat("_c", F.array("_x")))).drop("_x", "_g")
    return out


def template_tree(urls: DataFrame, depth: int = 4, distinct_share: float = 0.5, least_distinct: int = 8, prior: float = 0.1, weight: float = 2.0) -> DataFrame:
    """Templates of (_host, _s segments, n, labelled, blocked): adds _t, the URL's template, and _p, its purity.

    A level takes a few aggregations of the distinct (host, segments) rows.
    """
    hosts = urls.groupBy("_host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = hosts.select("_host", ((F.col("b") + weight * prior) / (F.col("l") + weight)).alias("_p"))
    tree = _shared_purity(urls, depth, prior, weight).join(hosts, "_host").withColumn("_t", F.lit(""))
    for level in range(depth):
        segment = F.when(F.size("_s") > level, F.get("_s", F.lit(level)))
        tree = cut(tree.withColumn("_seg", segment), "tree")
        total = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        branch = tree.filter("_seg is not null").groupBy("_host", "_t", "_seg").agg(*total, (F.sum(F.col("n") * F.size("_s")) / F.sum("n")).alias("deep"), F.sum(F.col("n") * F.get("_c", F.lit(level))).alias("else"), F.max("_p").alias("up"))
        branch = cut(branch, "branches")
        literal = ~F.col("_seg").startswith("{")
        parent = branch.filter(literal).groupBy("_host", "_t").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
        branch = branch.join(parent, ["_host", "_t"], "left")
        wild = literal & (F.col("kinds") >= least_distinct) & (F.col("kinds") >= F.col("all") * distinct_share)
        elsewhere = F.concat(F.lit("like "), F.round(F.col("else") / F.col("n") * 4).cast("int").cast("string"))
        band = F.when(F.col("labelled") == 0, elsewhere).otherwise(_band(F.col("blocked").cast("double"), F.col("labelled").cast("double")))
        alike = F.concat(F.lit("~"), band, F.lit(" "), F.round("deep").cast("int").cast("string"))
        node = F.when(wild, F.lit("*")).when(literal, alike).otherwise(F.col("_seg"))
        branch = branch.withColumn("_next", F.concat("_t", F.lit("/"), node))
        total = [F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "blocked", "else")]
        nodes = branch.groupBy("_host", "_next").agg(*total, F.max("up").alias("_up"))
        below = (F.col("_up") + F.col("_else") / F.col("_n")) / 2
        nodes = nodes.select("_host", "_next", ((F.col("_blocked") + weight * below) / (F.col("_labelled") + weight)).alias("_pure"))
        named = branch.select("_host", "_t", "_seg", "_next").join(nodes, ["_host", "_next"])
        tree = tree.join(named, ["_host", "_t", "_seg"], "left").withColumns({"_t": F.coalesce("_next", "_t"), "_p": F.coalesce("_pure", "_p")}).drop("_next", "_pure", "_seg")
    return tree


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", purity: float = 0.8, prior: float = 0.1, prior_weight: float = 2.0, depth: int = 4, evidence: Column | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, template, purity.

    evidence: condition on columns of df; where it doesn't hold, a rule still decides its row, but isn't learned from.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    pages = df.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"), (F.lit(True) if evidence is None else F.coalesce(evidence, F.lit(False))).alias("_learn"))
    rule, said = match_rules(F.col("_host"), F.col("_path"), rules)
    segments = F.filter(F.split(F.regexp_replace("_path", r"^/|/$", ""), "/"), lambda x: x != "")
    shaped = F.transform(F.slice(segments, 1, depth), _shape)
    pages = pages.withColumns({"rule": rule, "_said": said, "_s": F.when(F.size(segments) > depth, F.concat(shaped, F.array(F.lit("**")))).otherwise(shaped)})
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    known = F.col("_learn") & F.col("_said").isNotNull()
    urls = cut(pages.groupBy("_host", "_s").agg(F.count(F.lit(1)).alias("n"), one(known).alias("labelled"), one(known & (F.col("_said") == "block")).alias("blocked")), "urls")
    judged = cut(template_tree(urls, depth, prior=prior, weight=prior_weight).select("_host", "_s", "_t", "_p"), "templates")
    out = pages.join(judged, ["_host", "_s"], "left")
    method = F.when(F.coalesce(F.col("_p"), F.lit(0.0)) >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("_said", method).alias("verdict"), F.col("_t").alias("template"), F.round("_p", 6).alias("purity"))
