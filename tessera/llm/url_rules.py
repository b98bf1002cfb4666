"""URL filtering: given host and path rules first, mined association rules for the rest.

A given rule is ``host/path``; it fits its host and all subdomains where the url's path starts with the rule's, and the
longest that fits decides. Urls that none fits are judged by rules that FP-growth mines: every labelled url is a basket
of tokens (scheme, parts of the host, words of the path, query keys) with its label, and the mined implications from
tokens to a label are kept if their support and confidence suffice and no shorter rule says the same at least as surely.
They are matched by an inverted index: each rule stands under its rarest token, a url looks up the rules of its own
tokens and takes the first in order of confidence, support, length and text whose tokens it has.

Labels default to the verdicts of the given rules on the urls that they fit. The mined table is bounded: a rule has at most ``max_tokens``
tokens that at least ``min_count`` urls and a ``min_support`` of all share, so its size does not grow with the urls. Nothing but that
table leaves the executors, and judging is one pass without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path and, like any url that no rule fits, the
``default`` verdict; repeated rows get equal verdicts; an empty table yields no rows; no labels, no mined rules.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_SPLIT = re.compile(r"[^a-z0-9]+")


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]], what: int | None = None) -> Column:
    """The longest rule that fits, as host and path (or its verdict, for what=2); null if none does."""
    if len(rules) > 1000:
        raise ValueError("given rules are part of the plan: at most 1000")
    found: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_col == rule[0]) | host_col.endswith(f".{rule[0]}")) & path_col.startswith(rule[1])
        found = F.when(fits, F.lit(rule[what] if what is not None else rule[0] + rule[1])).otherwise(found)
    return found


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a url; numbers are left out."""
    text = (url or "").lower()
    scheme, _, rest = text.partition("://")
    if not _:
        return []
    cut = re.split(r"[/?#]", rest, maxsplit=1)
    where, tail = cut[0], rest[len(cut[0]) :]
    route, _, extra = tail.partition("?")
    labels = [x for x in where.split(".") if x]
    out = {f"scheme:{scheme[-16:]}", *(f"host:{x}" for x in labels), *(f"word:{w}" for x in labels for w in x.split("-") if "-" in x and w)}
    out |= {f"top:{labels[-1]}", f"domain:{'.'.join(labels[-2:])}"} if labels else set()
    out |= {f"path:{w}" for w in _SPLIT.split(route.split("#")[0]) if w and not w.isdigit()}
    out |= {f"query:{pair.split('=')[0]}" for pair in extra.split("#")[0].split("&") if pair.split("=")[0]}
    return sorted(out)


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = 0.005, min_confidence: float = 0.9, max_tokens: int = 3, min_count: int = 5) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, label, confidence, support) of the mined rules, in the order in which they are tried.

    FP-growth enumerates every subset of a frequent path, and Spark's has no bound on their length. So it runs once for each
    length up to ``max_tokens``, over baskets of that many tokens of a url and its label; a path has at most one more item than that. Tokens
    that are not frequent, or imply a label without exception (longer rules with them say nothing more), are left out of longer baskets.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tokens": [tokens(u) for u in batch["url"]], "label": batch["label"]})

    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("string").alias("label"))
    rows = rows.mapInPandas(read, "tokens array<string>, label string").persist()
    try:
        total = rows.count()
        least = max(min_count, math.ceil(min_support * total))
        found: dict[tuple[str, ...], dict[str, int]] = {}
        useful: set[str] | None = None
        for k in range(1, max_tokens + 1):
            new = _frequent(rows, k, useful, least)
            found |= new
            sure = {t[0] for t, n in new.items() if k == 1 and n.get("", 0) in [c for v, c in n.items() if v]}
            useful = {t for key in new for t in key} - sure
            if len(useful) <= k:
                break
    finally:
        rows.unpersist()
    kept: dict[tuple[str, ...], tuple] = {}
    for key in sorted(found, key=lambda t: (len(t), t)):
        for label, n in sorted(found[key].items()):
            confidence = n / found[key][""]
            if not label or confidence < min_confidence:
                continue
            subsets = [kept[s] for size in range(1, len(key)) for s in combinations(key, size) if s in kept]
            if not any(s[1] == label and s[2] >= confidence for s in subsets) and (key not in kept or confidence > kept[key][2]):
                kept[key] = (key, label, confidence, n / total)
    return sorted(kept.values(), key=lambda r: (-r[2], -r[3], len(r[0]), r))


def _frequent(rows: DataFrame, k: int, useful: set[str] | None, least: int) -> dict[tuple[str, ...], dict[str, int]]:
    """The sets of k tokens that at least ``least`` urls have: label to number of urls, where it is ``least`` too, and "" to that of all."""
    from pyspark.ml.fpm import FPGrowth

    baskets = rows.select(F.col("tokens").alias("rest"), F.array().cast("array<string>").alias("items"), "label")
    if useful is not None:
        # A table of at most 1 / min_support tokens for each token of a url: part of the plan as one literal.
        baskets = baskets.withColumn("rest", F.array_intersect("rest", F.lit(sorted(useful))))
    for _ in range(k):
        taken = baskets.select("rest", "items", "label", F.posexplode("rest").alias("at", "token"))
        baskets = taken.select(F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), F.array_append("items", F.col("token")).alias("items"), "label")
    baskets = baskets.select(F.array_append("items", F.concat(F.lit("label="), "label")).alias("items")).persist()
    try:
        count = baskets.count()
        if count < least:
            return {}
        sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / count, minConfidence=1.0).fit(baskets).freqItemsets
        is_label = lambda x: x.startswith("label=")
        sets = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.try_element_at(F.filter("items", is_label), F.lit(1)).alias("label"), "freq").filter(F.size("tokens") == k)
        out: dict[tuple[str, ...], dict[str, int]] = {}
        for r in sets.collect():
            out.setdefault(tuple(r["tokens"]), {})["" if r["label"] is None else r["label"][6:]] = r["freq"]
        return out
    finally:
        baskets.unpersist()


def index(rules: list[tuple[tuple[str, ...], str, float, float]]) -> dict[str, list[int]]:
    """Rarest token of each rule to the rules' places."""
    often: dict[str, int] = {}
    for rule in rules:
        for token in rule[0]:
            often[token] = often.get(token, 0) + 1
    out: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        out.setdefault(min(rule[0], key=lambda t: (often[t], t)), []).append(k)
    return out


def judge(pages: DataFrame, given: list[tuple[str, str, str]], mined: list[tuple[tuple[str, ...], str, float, float]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that decided (null where a given rule or the default did)."""
    under = index(mined)
    rules = [(frozenset(r[0]), r[1], " & ".join(r[0])) for r in mined]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts, why = [], []
            for url, fixed in zip(batch["url"], batch["fixed"], strict=True):
                best = None
                if fixed is None:
                    own = set(tokens(url))
                    best = min((k for t in own for k in under.get(t, ()) if rules[k][0] <= own), default=None)
                verdicts.append(fixed or (default if best is None else rules[best][1]))
                why.append(None if best is None else rules[best][2])
            yield pd.DataFrame({"page_id": batch["page_id"], "host": batch["host"], "path": batch["path"], "rule": batch["rule"], "verdict": verdicts, "mined_rule": pd.Series(why, dtype=object)})

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.select("*", given_rule(F.col("host"), F.col("path"), given).alias("rule"), given_rule(F.col("host"), F.col("path"), given, 2).alias("fixed"))
    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, mined_rule string")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labelled = pages.select("url", given_rule(host(F.col("url")), path(F.col("url")), RULES, 2).alias("label"))
    return judge(pages, RULES, mine(labelled))
