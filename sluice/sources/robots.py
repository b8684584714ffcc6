"""robots.txt rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.arrow import per_row
from sluice.functions.urls import parse_url

AGENT = "sluice"


def parse_robots(content: str | None) -> list[dict]:
    """Groups of rules in order. Every User-agent line begins a group of its own."""
    groups: list[dict] = []
    for line in (content or "").split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, _, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            groups.append({"agent": value.lower(), "allow": [], "disallow": []})
        elif key in ("allow", "disallow") and groups and value:
            groups[-1][key].append(value)
    return groups


def path_matches(path: str, rule: str) -> bool:
    return rule == "/" or path.startswith(rule[:-1] if rule.endswith("*") else rule)


def allowed(content: str | None, url: str, agent: str = AGENT) -> bool:
    """The agent's own groups decide before those for all; in a group an allow beats any disallow. No rules, no limits."""
    found = parse_url(url)
    path = found.path if found else "/"
    groups = parse_robots(content)
    for name in (agent.lower(), "*"):
        for g in (g for g in groups if g["agent"] == name):
            if any(path_matches(path, r) for r in g["allow"]):
                return True
            if any(path_matches(path, r) for r in g["disallow"]):
                return False
    return True


def allowed_column(robots: Column, url: Column, agent: str = AGENT) -> Column:
    return per_row(lambda text, u: allowed(text, u or "", agent), "boolean")(robots, url)


def origin(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*?(:\d+)(?=[/?#]|$)", 1)
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), port)


def with_robots(pages: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """pages and robots_allowed, from a table of origin and robots_txt; an origin without one allows everything."""
    own = robots.select(F.col("origin").alias("_origin"), "robots_txt")
    joined = pages.withColumn("_o", origin(F.col("url"))).join(own, F.col("_o") == F.col("_origin"), "left")
    return joined.withColumn("robots_allowed", allowed_column(F.col("robots_txt"), F.col("url"), agent)).drop("_o", "_origin", "robots_txt")
