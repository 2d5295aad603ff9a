"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every match of a rule has certain whole tokens (runs of ASCII letters and
digits). How often the rules' tokens occur is counted over all urls; each rule
is filed under its rarest one. A url's tokens fetch the few rules that can
match, and only those run their regular expressions.

Two kinds of rules: host rules `host/path` fit a host and its subdomains if
the url's path starts with the rule's, and the longest that fits decides;
where none does, any matching pattern rule (`*` for any text) blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, ship

#: Fixed values of the contract: verdict and host rule.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Pattern rules of the method: what usually isn't text worth keeping.
PATTERNS = ("/wp-admin/", "/wp-login.", "/cgi-bin/", "?sessionid=", "&sessionid=", "?phpsessid=", "&phpsessid=", "/cart/", "/checkout/", "//ads.", "//adserver.", "//tracking.*/pixel", "/doubleclick/", "?replytocom=")
TOKEN = re.compile(r"[A-Za-z0-9]+")


class Rule(NamedTuple):
    text: str
    verdict: str
    regex: str
    host: bool
    tokens: tuple[str, ...]


def host_rule(verdict: str, text: str) -> Rule:
    """A rule on host and path: its labels and whole path segments are its tokens."""
    host, slash, path = text.partition("/")
    whole = [*TOKEN.findall(host), *(t for seg in path.split("/")[:-1] for t in TOKEN.findall(seg))]
    return Rule(text, verdict, r"(?:[^/]*\.)?" + re.escape(host + slash + path), True, tuple(dict.fromkeys(t.lower() for t in whole)))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A rule on the whole url, A-Z lower-cased; tokens between two signs of the pattern are its tokens."""
    whole = [m.group().lower() for part in text.split("*") for m in TOKEN.finditer(part) if m.start() > 0 and m.end() < len(part)]
    if not whole:
        raise ValueError(f"no whole literal token in {text!r}")
    return Rule(text, verdict, ".*".join(re.escape(p) for p in text.lower().split("*")), False, tuple(dict.fromkeys(whole)))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a url or `://`."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    return lower(host), re.split(r"[?#]", rest, maxsplit=1)[0]


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many urls (column url) each of these tokens occurs; as many rows as tokens reach the driver."""
    spark = urls.sparkSession
    sought = spark.createDataFrame([(t,) for t in tokens], "token string")
    seen = urls.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    counts = seen.join(maybe_broadcast(sought), "token").groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r.token: r.n for r in counts}


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = defaultdict(list)
        for rule in rules:
            self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
        self.compiled: dict[str, re.Pattern] = {}

    def candidates(self, url: str) -> list[Rule]:
        return [r for t in {m.lower() for m in TOKEN.findall(url)} & self.by_token.keys() for r in self.by_token[t]]

    def fits(self, rule: Rule, text: str) -> bool:
        regex = self.compiled.get(rule.regex)
        if regex is None:
            regex = self.compiled[rule.regex] = re.compile(rule.regex, re.DOTALL)
        return bool(regex.match(text) if rule.host else regex.search(text))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """Host, path, deciding host rule, verdict, and the pattern that decided where no host rule did."""
        host, path = parts(url)
        best = pattern = None
        for rule in self.candidates(url or ""):
            if rule.host:
                if (best is None or (len(rule.text), rule.text) > (len(best.text), best.text)) and host and self.fits(rule, host + path):
                    best = rule
            elif (pattern is None or rule.text < pattern) and self.fits(rule, lower(url or "")):
                pattern = rule.text
        if best:
            return host, path, best.text, best.verdict, None
        return host, path, None, "block" if pattern else "allow", pattern


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of pages.

    A null url, or one without `://`, has an empty host and path and no host
    rule. Urls are whole, of any length. Of the host rules that fit the longest
    wins, and no two that fit one url are as long; of the pattern rules the first
    in alphabetical order. Repeated rows each give their row; extra columns (html too) are never
    read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    ship(pages.sparkSession)
    rules = [*(host_rule(v, t) for v, t in host_rules), *map(pattern_rule, patterns)]
    counts = token_counts(rows.select("url"), sorted({t for r in rules for t in r.tokens}))
    out = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict", "pattern")])

    @F.pandas_udf(out)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(rules, counts)
        for batch in batches:
            yield pd.DataFrame([index.judge(u if isinstance(u, str) else None) for u in batch], columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)

    judged = rows.select("page_id", judge.asNondeterministic()(F.col("url")).alias("j"))
    return judged.select("page_id", *[F.col(f"j.{n}").alias(n) for n in ("host", "path", "rule", "verdict", "pattern")])
