"""Verdicts on URLs by rules and by a list of canonical URLs.

Rules of (host, path prefix) come first, the longest that fits wins.  Other URLs
are blocked if their canonical form is listed: a blocked Bloom filter of the list
passes possible hits, and an exact hash join removes the false ones.  Only possible
hits are shuffled.  All of it is built-in expressions.

Null URLs and those without ``://`` have empty host and path, fit no rule, and are
not listed.  Rows may repeat; each is judged.  An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters of a query string that do not change the page (fixed values).
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"


def rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))


def parts(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``_host, _path, _canonical`` (null where there is no host)."""
    with_rest = df.withColumn("_url", df[url]).withColumn("_rest", rest(F.col("_url")))
    host = F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER)
    out = with_rest.withColumn("_host", host).withColumn("_path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
    page = F.regexp_replace(F.regexp_replace("_path", r"(\.html)?/*\z", ""), "/+", "/")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)), f"&(({TRACKING})=[^&]*)?(?=&|\\z)", "")
    canonical = F.concat(F.regexp_replace("_host", r"^(www|m)\.|:(80|443)\z", ""), page, query)
    return out.withColumn("_canonical", F.when(F.col("_host") != "", canonical)).drop("_url", "_rest")


def fitting(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        own = (F.col("_host") == host) | F.col("_host").endswith("." + host)
        fits = own & F.col("_path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def judge(df: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``df``."""
    names = parts(listed.select(listed[listed_url].alias("url")), "url").select(F.col("_canonical").alias("listed")).where("listed is not null").distinct()
    names = stage(names, "listed")
    table, blocks = bloom.build(names, "listed", names.count())
    table = stage(table, "filter")
    name, verdict = fitting(rules)
    pages = parts(df.select(df[id].alias("page_id"), df[url].alias("url")), "url").select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), name.alias("rule"), verdict.alias("said"), "_canonical")
    marked = bloom.possible(pages, F.col("_canonical"), table, blocks)
    open_ = F.col("said").isNull() & F.col("maybe")
    hit = marked.where(open_).join(names, F.col("_canonical") == F.col("listed"), "left")
    sure = marked.where(~open_).withColumn("listed", F.lit(None).cast("string"))
    out = hit.unionByName(sure)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).alias("verdict"))
