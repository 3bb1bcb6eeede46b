"""robots.txt rules as rows, and the decision for a path."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_RULES = T.ArrayType(
    T.StructType().add("agent", T.StringType()).add("allow", T.BooleanType()).add("path", T.StringType()).add("pattern", T.StringType()).add("length", T.IntegerType())
)


def _normal(path: str) -> str:
    """Percent-escapes of ordinary characters resolved, other bytes escaped in one way."""
    return quote(unquote(path, errors="replace"), safe="/*$?=&:;,@!~'()+-._%[]")


def _pattern(path: str) -> str:
    body, end = (path[:-1], "$") if path.endswith("$") else (path, "")
    return "^" + ".*".join(re.escape(p) for p in body.replace("$", "").split("*")) + end


def rules_of(body: str | None) -> list[dict]:
    """One dict per agent and rule.  Consecutive agent lines share the rules after them; an empty rule allows all and is none."""
    out, agents, open_group = [], [], False
    for line in (body or "").removeprefix("﻿").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if open_group else [value.lower()]
            open_group = True
        elif name in ("allow", "disallow"):
            open_group = False
            if value:
                path = _normal(value)
                out += [{"agent": a, "allow": name == "allow", "path": value, "pattern": _pattern(path), "length": len(value)} for a in agents]
        elif name == "crawl-delay":
            open_group = False
    return out


@pandas_udf(_RULES)
def parse_robots(bodies: pd.Series) -> pd.Series:
    return bodies.map(rules_of)


def status_policy(status: Column) -> Column:
    """What an answer means: ``parse`` its body, ``allow`` all, or ``deny`` all."""
    return F.when(status.between(200, 299), "parse").when(status.between(400, 499) & (status != 429), "allow").otherwise("deny")


def decide(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``(site, path, allowed)``.  ``paths (site, path)``; ``rules (site, agent, allow, pattern, length)``.

    Rules for the agent hold, else those for ``*``; the longest rule that fits a path
    decides, allow before deny; without a rule that fits a path is allowed.
    """
    own = rules.where(F.col("agent") == agent.lower())
    star = rules.where("agent = '*'").join(own.select("site").distinct(), "site", "left_anti")
    used = own.unionByName(star).select("site", "allow", "pattern", "length")
    fitting = paths.join(used, "site").where(F.expr("path RLIKE pattern"))
    best = fitting.groupBy("site", "path").agg(F.max(F.struct("length", "allow")).alias("r")).select("site", "path", F.col("r.allow").alias("allowed"))
    return paths.distinct().join(best, ["site", "path"], "left").select("site", "path", F.coalesce("allowed", F.lit(True)).alias("allowed"))
