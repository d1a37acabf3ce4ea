"""Bounded crawls over tables of pages and links: one level a step, visited addresses excluded, the best within the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import urls as U
from gleanspark.session import checkpointed


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 5, budget: int = 1000, words: tuple[str, ...] = (), best_first: bool = True) -> DataFrame:
    """(url, depth, score): addresses taken level by level, at most budget, the seeds among them.

    links has (url, link); seeds has (url). Addresses are compared by their crawl key, whose first form is taken. Within
    a level the best scores come first, or the first in order of the address. Each level is cut by checkpoint().
    """
    edges = links.where("url is not null and link is not null").select(U.crawl_key(F.col("url")).alias("src"), U.crawl_key(F.col("link")).alias("dst")).distinct()
    score = U.composite_score(F.col("url"), words) if best_first else F.lit(0.0)

    def level(df: DataFrame, k: int, left: int) -> DataFrame:
        return checkpointed(df.withColumn("score", score).orderBy(F.desc("score"), "url").limit(left).select("url", F.lit(k).alias("depth"), "score"))

    front = level(seeds.where("url is not null").select(U.crawl_key(F.col("url")).alias("url")).distinct(), 0, budget)
    seen, left, k = front, budget - front.count(), 0
    while left > 0 and k < depth:
        k += 1
        fresh = edges.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = level(fresh, k, left)
        n = front.count()
        if not n:
            break
        seen, left = seen.unionByName(front), left - n
    return seen.select("url", "depth", "score")


def robots_rules(text: str | None, agent: str = "*") -> list[tuple[bool, str]]:
    """(allowed, pattern) of the group for the agent, else of the group for all."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    open_ = False
    for line in (text or "").splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            open_ = False
            if value:
                for n in names:
                    groups[n].append((key == "allow", value))
        elif key:
            open_ = False
    own = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", [])


def robots_allow(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest pattern that matches holds; allow wins ties; * and a last $ are understood."""
    import re

    best = (-1, True)
    for ok, p in rules:
        body = ".*".join(map(re.escape, p.rstrip("$").split("*")))
        if re.match(body + ("$" if p.endswith("$") else ""), path):
            best = max(best, (len(p), ok))
    return best[1]
