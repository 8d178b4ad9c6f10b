"""robots.txt: a parser for many sites at once, and the decision for a path as a join with rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The name by which robots.txt may address this engine's fetcher.
AGENT = "corpusloombot"
RULES = T.StructType([T.StructField("fetched", T.BooleanType())] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("disallow", "allow", "sitemaps")])


def parse(body: str | None, agent: str = AGENT) -> dict:
    """Rules of the first group that names the agent, else of the first for all. A user-agent line opens a group only after
    rules; an empty rule counts as none, so that agents after it join the group before."""
    sitemaps: list[str] = []
    groups: list[tuple[list[str], dict[str, list[str]]]] = []
    for line in re.split(r"\r?\n", body or ""):
        field, colon, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "sitemap":
            sitemaps.append(value)
        elif field == "user-agent":
            if not groups or any(groups[-1][1].values()):
                groups.append(([], {"allow": [], "disallow": []}))
            groups[-1][0].append(value.lower())
        elif field in ("allow", "disallow") and groups and value:
            groups[-1][1][field].append(value)
    named = [g for names, g in groups if any(agent in n for n in names)]
    general = [g for names, g in groups if "*" in names]
    rules = (named or general or [{"allow": [], "disallow": []}])[0]
    return {"fetched": bool(body), **rules, "sitemaps": sitemaps if body else []}


@F.pandas_udf(RULES)
def parsed(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in body], columns=RULES.names)


def pattern(rule: Column) -> Column:
    """A rule as a regular expression: * is anything, a last $ is the end, and ? makes what stands before it optional."""
    escaped = F.regexp_replace(rule, r"[.+^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$\z", r"\\z"))


def _broken(rule: Column) -> Column:
    """Rules that are no expression after translation (a leading or doubled ?): they are compared as prefixes."""
    return rule.rlike(r"^\?|\?\?\?|\*\?\?\?")


def rule_rows(rules: DataFrame) -> DataFrame:
    """(site_id, rule, allow, rx) of a table with site_id and parsed rules."""
    kinds = F.array(F.struct(F.lit(False).alias("allow"), F.col("disallow").alias("list")), F.struct(F.lit(True).alias("allow"), F.col("allow").alias("list")))
    rows = rules.where("fetched").select("site_id", F.inline(kinds)).select("site_id", "allow", F.explode("list").alias("rule")).where("rule <> ''")
    return rows.withColumn("rx", F.when(~_broken(F.col("rule")), pattern(F.col("rule"))))


def decided(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """paths (site_id, path, …) with allowed: the longest rule that matches wins, of equal ones the one that forbids, and without any all is allowed."""
    r = rule_rows(rules).withColumnRenamed("site_id", "__site")
    p = F.col(path)
    hit = F.when(F.col("rx").isNotNull(), F.rlike(p, F.col("rx"))).otherwise(p.startswith(F.col("rule")))
    # Distinct paths are matched, with map-side aggregation: a site's URLs need not meet in one task.
    keys = paths.select("site_id", path).distinct()
    verdicts = keys.join(r, (F.col("site_id") == F.col("__site")) & hit).groupBy("site_id", path).agg(F.max_by("allow", F.struct(F.length("rule"), ~F.col("allow"))).alias("allowed"))
    return paths.join(verdicts, ["site_id", path], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
