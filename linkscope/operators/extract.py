"""From pages and crawl output to node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.plans.order import running

LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
HREF = r'href="([^"]*)"'
NAMESPACES = "^(?:File|Image|Category|Template|Help|User|Talk|Special|Wikipedia):"


def extract_links(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, target) of wiki links; namespaces and anchors inside the page are dropped."""
    t = pages.select(key, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK), F.lit(1))).alias("target"))
    return t.filter(~F.col("target").rlike(NAMESPACES) & ~F.col("target").startswith("#"))


def extract_hrefs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, target) of HTML links."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))).alias("target"))


def normalise_title(raw: Column) -> Column:
    """Cut at #, underscores to spaces, spaces squeezed, first letter upper-case."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(raw, "#", 1), "_", " "), " +", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2147483646))


def resolve_redirects(links: DataFrame, redirects: DataFrame, title: str = "title") -> DataFrame:
    """links with landing: the redirect's end, else the title. redirects(source, landing)."""
    r = redirects.select(F.col("source").alias(title), F.col("landing").alias("_to"))
    return links.join(r.hint("merge"), title, "left").withColumn("landing", F.coalesce("_to", title)).drop("_to")


def infobox_kind(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_extract(text, r"\{\{\s*[Ii]nfobox\s+([^|\n}]+)", 1))), F.lit(""))


def infobox_fields(pages: DataFrame, key: str, fields: list[str], text: str = "text") -> DataFrame:
    """(key, field, value): template parameters with nested braces and brackets balanced;
    one pass over the pages for all fields, which looks at braces, brackets and bars only."""
    import re

    import pandas as pd

    schema = T.StructType([pages.schema[key], T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])
    wanted = {f.lower(): f for f in fields}
    opening, marks = re.compile(r"\{\{\s*infobox", re.IGNORECASE), re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")

    def parameters(body: str) -> list[str]:
        """What stands between the bars of the first infobox, outside what is nested."""
        first = opening.search(body)
        open_, since, out = 0, None, []
        for m in marks.finditer(body, first.start()) if first else ():
            mark = m[0]
            if mark in ("{{", "[["):
                open_ += 1
            elif mark != "|":
                open_ -= 1
            if open_ == 0 or (mark == "|" and open_ == 1):
                if since is not None:
                    out.append(body[since : m.start()])
                if open_ == 0:
                    break
                since = m.end()
        return out

    def run(frames):
        for pdf in frames:
            rows = []
            for k, body in zip(pdf[key], pdf[text], strict=True):
                for p in parameters(body or ""):
                    name, sign, value = p.partition("=")
                    if sign and name.strip().lower() in wanted:
                        rows.append((k, wanted[name.strip().lower()], value.strip()))
            yield pd.DataFrame(rows, columns=[key, "field", "value"])

    return pages.select(key, text).mapInPandas(run, schema)


def first_year(field: Column) -> Column:
    """Smallest year from 1930 to 2029, references and comments aside; null if none."""
    clean = F.regexp_replace(field, r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", " ")
    return F.array_min(F.transform(F.regexp_extract_all(clean, F.lit(r"\b(19[3-9][0-9]|20[0-2][0-9])\b"), F.lit(1)), lambda y: y.cast("int")))


def filter_candidates(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """rows with the first reason that applies, else "kept"."""
    reason = F.lit("kept")
    for name, applies in reversed(list(reasons.items())):
        reason = F.when(applies, name).otherwise(reason)
    return rows.withColumn("reason", reason)


def merge_rosters(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, side): first, second or both."""
    x, y = a.select("key").distinct().withColumn("x", F.lit(1)), b.select("key").distinct().withColumn("y", F.lit(1))
    return x.join(y.hint("merge"), "key", "full").select("key", F.when(F.col("y").isNull(), "first").when(F.col("x").isNull(), "second").otherwise("both").alias("side"))


def build_edges(links: DataFrame, roster: DataFrame) -> DataFrame:
    """Distinct (src, dst) with dst in roster(node), without self-links."""
    return links.join(roster.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi").filter("src <> dst").select("src", "dst").distinct()


def edge_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, n_left, n_right, shared, jaccard) of two edge sets."""
    j = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)).hint("merge"), ["src", "dst"], "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return j.groupBy("src").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.sum(both.cast("long")).alias("shared"), (F.sum(both.cast("long")) / F.count("*")).alias("jaccard"))


def spread_sample(rows: DataFrame, score: str, n: int, key: str = "node") -> DataFrame:
    """A fixed sample: half the highest scores, a third around the middle, the rest from the lowest."""
    total = rows.count()
    top, mid = n // 2, n // 3
    low = n - top - mid
    ranked = running(rows, [F.desc(score), F.col(key)], i=F.lit(1))
    start = max(top, total // 2 - mid // 2)
    return ranked.filter((F.col("i") <= top) | F.col("i").between(start + 1, start + mid) | (F.col("i") > total - low)).drop("i")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n), the commonest first."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def attribute_coverage(rows: DataFrame, column: str) -> DataFrame:
    """(n, known, share)."""
    return rows.agg(F.count("*").alias("n"), F.count(column).alias("known"), (F.count(column) / F.count("*")).alias("share"))
