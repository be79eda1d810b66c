"""URL block and allow rules, carried to aliases over redirects and canonical links.

A rule has a host and a path; it fits the host and its subdomains where the url's path starts with
the rule's, and the longest rule that fits decides. Urls that redirect to each other or name each
other as canonical are one page: connected components over these edges pass a block on to every
alias without a rule of its own, unless an alias in the component is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm._common import ascii_lower, literal_table, shared_dir, written
from gridkin.llm._graph import components


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What a url stands for among aliases: scheme and host with A-Z lower-cased, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    start = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(ascii_lower(start), F.substr(bare, F.char_length(start) + 1))


def _host_rules(hosts: DataFrame, rules: DataFrame, labels_of_rules: int) -> DataFrame:
    """host, rules (structs rule, path, action; the longest first) for the hosts that have any.

    The suffixes of each distinct host, of as many labels as a rule has at most, meet the rules' hosts in an equi-join.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels_of_rules))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    each = hosts.where("host <> ''").distinct().select("host", F.explode(suffixes).alias("suffix"))
    met = each.join(F.broadcast(rules.withColumnRenamed("host", "suffix")), "suffix")  # the caller's list
    rule = F.struct((-F.length(F.concat("suffix", "path"))).alias("order"), F.concat("suffix", "path").alias("rule"), "path", "action")
    return met.groupBy("host").agg(F.sort_array(F.collect_list(rule)).alias("rules"))  # as many as there are rules at most


def judged(urls: DataFrame, rules: DataFrame, labels_of_rules: int, table: str, folder: str) -> DataFrame:
    """urls with rule and action, null where no rule fits. urls: host, path and other columns.

    The hosts' rules are written first, so that a host with many urls can be split in the join.
    """
    known = written(_host_rules(urls.select("host"), rules, labels_of_rules), folder, table)
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), 0)
    joined = urls.join(known, "host", "left").withColumn("_fit", fits)
    return joined.select(*urls.columns, F.col("_fit.rule").alias("rule"), F.col("_fit.action").alias("action"))


def without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    segments = F.split(path, "/", -1)

    def add(kept: Column, s: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(s == "..", up).when(s == ".", kept).otherwise(F.array_append(kept, s))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), add)
    last = F.element_at(segments, -1)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") | (F.size(kept) == 1), "/").otherwise(""))


def resolved(target: Column, page: Column) -> Column:
    """The url that a link of a page leads to; null if it leads nowhere else or the page has no host."""
    bare = F.regexp_replace(F.regexp_replace(target, "(?i)&(amp|#38|#x26);", "&"), r"(?s)#.*$", "")
    scheme = F.regexp_extract(page, r"^([^:/?#]+:)//[^/?#]*", 1)
    site = F.regexp_extract(page, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(page, r"(?s)^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)?", 1))
    own, query = F.regexp_extract(bare, r"(?s)^[^?]*", 0), F.regexp_extract(bare, r"(?s)\?.*$", 0)
    return (
        F.when(bare == "", None)
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(site == "", None)
        .when(bare.startswith("//"), F.concat(scheme, bare))
        .when(bare.startswith("?"), F.concat(site, path, bare))
        .when(bare.startswith("/"), F.concat(site, without_dots(own), query))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), query))
    )


def html_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """a, b: url of a page and each url that it names as canonical or is refreshed to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    found = lambda tag: F.regexp_extract_all(html, F.lit(tag), F.lit(0))
    canonical = F.transform(found(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(found(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    pairs = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("a"), F.explode(F.concat(canonical, refresh)).alias("b")).where("b <> ''")
    return pairs.select("a", resolved(F.col("b"), F.col("a")).alias("b")).where("b is not null")


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
) -> DataFrame:
    """id, host, path, rule (host and path of the rule that fits, or null), verdict (allow or block).

    rules: (action, host, path). redirects: from_url, to_url; all canonical links and refreshes in the
    html join them, relative ones resolved against the page's url. Aliases are urls that differ in more
    than a fragment or the case of scheme and host. A page
    with a rule of its own gets the rule's action; any other is blocked if an alias is blocked and
    none explicitly allowed. Null urls and urls without :// have no host, fit no rule and are
    allowed; repeated rows get a row each; an empty table gives no rows. Ties between rules of one
    length go to the smaller rule, then action. Other columns are left alone.
    """
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession)
    ruled = literal_table(spark, [(h, p, a) for a, h, p in rules], [("host", "string"), ("path", "string"), ("action", "string")])
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("_id"), node_of(url).alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = judged(own, ruled, most, "page-hosts", folder)
    links = None
    if redirects is not None:
        links = redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")).where("a is not null and b is not null")
    if html_col:
        more = html_links(pages.select(url_col, html_col), url_col, html_col)
        links = more if links is None else links.union(more)
    passed_on = F.lit(None).cast("string")
    if links is not None:
        links = links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        links = written(links.where("a <> b").distinct(), folder, "links")
        if not links.isEmpty():
            alias = components(links, folder)
            named = alias.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
            actions = judged(named, ruled, most, "alias-hosts", folder).where("action is not null")
            verdicts = actions.groupBy("component").agg(F.min("action").alias("passed"))  # allow sorts before block
            known = alias.join(verdicts, "component").select(F.col("node").alias("_node"), "passed")
            found = found.join(known, found["_url"] == known["_node"], "left")
            passed_on = F.col("passed")
    return found.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("action", passed_on, F.lit("allow")).alias("verdict")
    )
