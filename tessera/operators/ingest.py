"""Incremental import: changes, deletions, routes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Entries that differ from the previous scan, with the first reason: new, size (files only), mtime, inode."""
    p = previous.select("key", F.struct("size", "mtime", "inode").alias("p"))
    differs = lambda f: ~F.col(f).eqNullSafe(F.col(f"p.{f}"))
    reason = F.when(F.col("p").isNull(), "new").when((F.col("kind") == "file") & differs("size"), "size").when(differs("mtime"), "mtime").when(differs("inode"), "inode")
    return current.join(p, "key", "left").select("key", reason.alias("reason")).where("reason is not null")


def mirror_deletes(previous: DataFrame, current: DataFrame, enabled: bool) -> DataFrame:
    """Keys to delete because they have definitely gone; nothing unless deletions are mirrored."""
    gone = previous.select("key").join(current, "key", "left_anti")
    return gone if enabled else gone.where(F.lit(False))


def route(key: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """Name of the first route whose glob matches; * stops at a slash, ** does not."""
    found = None
    for glob, name in routes:
        test = key.rlike("^" + _regex(glob) + "$")
        found = F.when(test, name) if found is None else found.when(test, name)
    return F.lit(default) if found is None else found.otherwise(default)


def _regex(glob: str) -> str:
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        c = glob[at]
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_-" else "\\" + c)
        at += 1
    return "".join(out)


def url_key(url: Column) -> Column:
    """scheme/host/path of a URL, without query and fragment."""
    part = lambda n: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", n)
    return F.concat(part(1), F.lit("/"), part(2), F.when(part(3) == "", "/").otherwise(part(3)))


#: The value of an anchor's href, whatever its case, quotes and place among the attributes.
HREF = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): distinct targets of a page's anchors; queries, fragments and relative dots are left out."""
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    rows = pages.select("page_id", F.explode(found).alias("link")).withColumn("link", F.regexp_replace("link", """^["']|["']$""", ""))
    return rows.where(~F.substring("link", 1, 1).isin("?", "#", ".") & (F.col("link") != "")).distinct()


def linked_pages(pages: DataFrame, root: Column) -> DataFrame:
    """(page_id, target): a page's links joined to its URL, below root (a prefix of URLs, of each page) and other than the page itself.

    pages: (page_id, url, html). A link is a URL, or a path from the host on (two slashes: from the scheme on), or one from the page's folder on.
    """
    part = lambda n: F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)", n)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(part(3), "^/", ""), "[^/]*$", ""))
    link = F.col("link")
    target = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(part(1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(part(1), part(2), link))
        .otherwise(F.concat(part(1), part(2), folder, link))
    )
    found = page_links(pages).join(pages.select("page_id", "url", root.alias("root")), "page_id").withColumn("target", target)
    return found.where(F.startswith("target", "root") & (F.col("target") != F.col("url"))).select("page_id", "target").distinct()


def http_state(headers: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """(url, action), one row for each header: new if its keys are not in the state, same if a record of them has its length and time, changed otherwise.

    Nulls are values like others, in keys too. Headers and records that repeat are neither merged nor multiplied.
    """
    same = (*keys, "length", "modified")
    joined = headers
    for columns, mark in ((keys, "known"), (same, "kept")):
        found = state.select(*(F.col(c).alias(f"{mark}_{c}") for c in columns)).distinct().withColumn(mark, F.lit(True))
        joined = joined.join(found, [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in columns], "left")
    return joined.select("url", F.when(F.col("known").isNull(), "new").when(F.col("kept").isNull(), "changed").otherwise("same").alias("action"))


def fresh_path(links: DataFrame, current: DataFrame) -> DataFrame:
    """For each hash the first linked path that is still there unchanged."""
    there = current.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    live = links.join(there, "path").where("size <=> size_now and mtime <=> mtime_now")
    return live.groupBy("hash").agg(F.min("path").alias("path"))
