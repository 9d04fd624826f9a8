"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern must contain its literal tokens (runs of a-z and 0-9 with
something else on either side) wherever it matches.  The tokens of all rules
are counted over all URLs and each rule is filed under its rarest.  A URL's
tokens are joined with that index, and only the rules so fetched run their
regular expressions, on the lower-cased host followed by the path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import narrow

MAX_BROADCAST_RULES = 100_000  # rule rows; more are joined by a shuffle


@dataclass(frozen=True)
class Rule:
    """``pattern``: regular expression over host + path; ``literals``: tokens
    that every match holds; ``length`` decides between rules, longest first,
    then the greater name; ``listed`` rules are named in the result."""

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    length: int
    listed: bool = True


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t))


def host_path_rule(name: str, verdict: str) -> Rule:
    """Rule for ``host/path``: the host and all its subdomains, and every path
    that starts with the rule's."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    literal = lambda s: re.sub(r"([^A-Za-z0-9_\-/])", r"\\\1", s)
    whole = path if re.search(r"[^A-Za-z0-9]$", path) else path.rpartition("/")[0]
    return Rule(
        name, rf"^(?:[^/]*\.)?{literal(host.lower())}{literal(path)}",
        tokens_of(host.lower() + "/" + whole), verdict, len(name),
    )


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Rule for a word standing alone in the host or the path; weaker than any host rule."""
    return Rule(f"word:{word}", rf"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", (word,), verdict, 0, listed=False)


#: Words of pages without prose, blocked unless a host rule says otherwise.
WORD_RULES = tuple(word_rule(w) for w in ("login", "signin", "cart", "checkout", "adserver", "doubleclick"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #``, A-Z
    lower-cased; then up to ``? #``.  NULL or without ``://``: both empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _tokens(subject: Column) -> Column:
    """Distinct tokens, with the empty one for rules that have no literal."""
    split = F.split(F.translate(subject, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+")
    return F.array_union(F.array_distinct(split), F.array(F.lit("")))


def _index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, name, pattern, verdict, length, listed): each rule under the
    token of its literals that fewest URLs hold (ties: the smaller token)."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.literals})
    seen: dict[str, int] = {}
    if wanted:  # one row per distinct literal of the rules comes back
        words = spark.createDataFrame([(t,) for t in wanted], "token string")
        if len(wanted) <= MAX_BROADCAST_RULES:
            words = F.broadcast(words)
        counted = urls.select(F.explode(_tokens(F.col("subject"))).alias("token")).join(words, "token")
        seen = dict(counted.groupBy("token").agg(F.count("*").alias("n")).toPandas().itertuples(index=False))
    rows = [
        (min(r.literals, key=lambda t: (seen.get(t, 0), t), default=""),
         r.name, r.pattern, r.verdict, r.length, r.listed)
        for r in rules
    ]
    index = spark.createDataFrame(
        rows, "token string, name string, pattern string, verdict string, length int, listed boolean"
    )
    return F.broadcast(index) if len(rows) <= MAX_BROADCAST_RULES else index


def filter_urls(
    pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) per row of ``pages``.

    The longest matching rule decides; ``rule`` names it if it is listed.  No
    match, a NULL url and one without ``://`` have the default verdict.  Rows
    with the same url or id are judged alike and all stay.
    """
    host, path = url_parts(F.col("url"))
    parted = narrow(pages, page_id=id_col, url=url_col).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    subject = F.concat("host", "path").alias("subject")
    urls = parted.select(subject)
    if not rules:
        return parted.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    best = (
        urls.select("subject", F.explode(_tokens(F.col("subject"))).alias("token"))
        .join(_index(urls, rules), "token")
        .where(F.expr("subject rlike pattern"))
        .groupBy("subject")
        .agg(F.max(F.struct("length", "name", "verdict", "listed")).alias("best"))
    )
    return (
        parted.withColumn("subject", F.concat("host", "path")).join(best, "subject", "left")
        .select(
            "page_id", "url", "host", "path",
            F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        )
    )
