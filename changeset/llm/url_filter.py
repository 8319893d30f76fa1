"""URL filters with redirect equivalence, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize
from .graph import connected_components

#: Rule lists up to this length become expressions of the scan; longer ones are joined by host suffix.
INLINE_RULES = 64


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The name under which two spellings of one address meet: no scheme, no www., no fragment, no final slash; null without ://."""
    rest = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(F.concat(path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)), r"/$", ""))
    return F.when(F.instr(url, "://") > 0, rest)


def decoded(text: Column) -> Column:
    """HTML's &amp; and its numbered forms as the character; done once, so that &amp;amp; gives &amp;."""
    return F.regexp_replace(text, r"(?i)&(?:amp;?|#0*38;|#x0*26;)", "&")


def resolved(target: Column, url: Column) -> Column:
    """A target against the page's url, by RFC 3986: with its own scheme and host, scheme-relative, from the root, query, fragment or path-relative.

    Dot segments are taken out of what is joined. Null where url has no :// or the target another scheme (mailto:, data:).
    """
    root, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    tail = F.substring(target, F.length(own) + 1, F.length(target))
    parts = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)), "/")
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), up)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    joined = F.concat(root, F.array_join(kept, "/"), tail)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (F.instr(url, "://") == 0), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(root, path, query))
        .otherwise(joined)
    )


def links_of(pages: DataFrame) -> DataFrame:
    """url, to: absolute targets of the pages' canonical links and immediate refreshes: &amp; decoded, relative ones resolved against
    the page's base or else its url. What stands in comments, scripts and styles is no link."""
    attribute = r"""[^>]*?\b%s\s*=\s*["']?([^"'\s>]+)"""
    told = pages.where(F.col("html").rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh") & F.col("url").isNotNull())
    text = told.select("url", F.regexp_replace("html", r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)", "").alias("text"))
    found = F.concat(
        F.regexp_extract_all("text", F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)""" + attribute % "href"), 1),
        F.regexp_extract_all("text", F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)""" + attribute % "url"), 1),
    )
    each = text.select("url", decoded(F.regexp_extract("text", r"(?is)<base\b" + attribute % "href", 1)).alias("base"), F.explode(found).alias("target"))
    based = each.select("url", "target", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("base"), F.col("url")), F.col("url"))).alias("base"))
    return based.select("url", resolved(decoded(F.col("target")), F.col("base")).alias("to"))


def _rule_of(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule struct<rule, verdict> (null: none fits); the longest that fits, then the smallest by text."""
    if len(rules) <= INLINE_RULES:
        fit = [
            F.when((F.col("host").eqNullSafe(h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(-len(h + p)).alias("at"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules
        ]
        best = F.array_min(F.filter(F.array(*fit), lambda x: x.isNotNull())) if fit else F.lit(None).cast("struct<at:int,rule:string,verdict:string>")
        return pages.withColumn("fit", best)
    table = pages.sparkSession.createDataFrame(rules, "verdict string, rhost string, rpath string")
    labels = F.split("host", r"\.")
    hosts = pages.select("host").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 20)), "."))).alias("rhost"))
    fits = pages.select("host", "path").distinct().join(hosts, "host").join(table, "rhost").where(F.col("path").startswith(F.col("rpath")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length(F.concat("rhost", "rpath"))).alias("at"), F.concat("rhost", "rpath").alias("rule"), "verdict")).alias("fit"))
    return pages.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """A verdict for every page.

    pages: page_id, url, html (null or missing links: none). rules: (allow|block, host, path);
    a rule fits its host and all subdomains where the url's path starts with its path, the
    longest wins. redirects: further (source, target) urls.
    Addresses joined by redirects and canonical links are aliases. A page with a rule of its own
    has that rule's verdict. Another page takes its group's: allow if any member is allowed by a
    rule (explicit allow goes first), else block if any is blocked, else allow. Returns page_id,
    host, path, rule, verdict, group (the smallest address of its aliases). Null or odd urls: empty
    host and path, no rule, no alias, allow. Rules of equal length that both fit: the smaller by text, then by verdict. Very long
    urls and pages are read whole; a null page_id is handed on; other columns of pages play no part. Repeated pages give
    repeated rows; an empty table, none.
    """
    own = pages.select("page_id", F.col("url").alias("url"), F.col("html").alias("html"))
    judged = _rule_of(own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")), rules)
    edges = links_of(own).select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col(redirects.columns[0])).alias("a"), node_of(F.col(redirects.columns[1])).alias("b")))
    groups = connected_components(edges)
    judged = judged.join(groups.withColumnRenamed("root", "group"), judged["node"] == groups["node"], "left").drop(groups["node"])
    judged = judged.withColumn("group", F.coalesce("group", "node"))
    # One row for each group that has members with a rule and members without: the others have nothing to hand on, and of them
    # there are as many as addresses. Partial counts first, so a hot group is no hot task.
    said = judged.where("group is not null").groupBy("group").agg(F.max(F.expr("fit.verdict = 'allow'")).alias("allowed"), F.max(F.expr("fit is null")).alias("open"))
    said = materialize(said.where("open and allowed is not null").select("group", "allowed"), "said")
    out = judged.join(said, "group", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("allowed").eqNullSafe(False), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "group")
