"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path. Its literal tokens are the runs of
letters and digits that must stand whole in any URL it fits. The token that
occurs in the fewest URLs of the corpus indexes the rule; the tokens of a URL
fetch candidate rules by an equi join, and only those run regular expressions.

Pattern syntax: ``name.tld/path`` fits the host, its subdomains and paths that start
so (a prefix rule); in other patterns ``||`` is the start of a host label, ``*`` any
characters, and the rest stands for itself, without regard to case.

Defined results: a null URL, or one without ``://``, has an empty host and path and
fits no rule that names a host; repeated rows get equal verdicts; an empty table
gives no rows; a rule without a whole token is tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    pattern: str
    prefix: bool = False  # host and subdomains, path prefix; the longest such rule decides first

    def regex(self) -> str:
        if self.prefix:
            return "^(?:[^/]*\\.)?" + re.escape(self.pattern)
        body, start = self.pattern, ""
        if body.startswith("||"):
            body, start = body[2:], "^(?:[^/]*\\.)?"
        return "(?is)" + start + ".*".join(re.escape(p) for p in body.split("*"))

    def tokens(self) -> list[str]:
        """Tokens that any fitting URL holds whole: not cut by a wildcard or an open end of the pattern."""
        body = self.pattern.lower()
        anchored = self.prefix or body.startswith("||")
        body = body.removeprefix("||")
        out = []
        for m in re.finditer(TOKEN, body):
            left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and anchored
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                out.append(m[0])
        return out


# The rules of the query.
PREFIX_RULES = (
    UrlRule("allow", "com/", True),
    UrlRule("block", "example.com/en/", True),
    UrlRule("allow", "www.example.com/en/", True),
    UrlRule("block", "net/es/", True),
    UrlRule("block", "net/fr/", True),
)
PATTERN_RULES = (
    UrlRule("block", "||spam-farm."),
    UrlRule("block", "||casino-win."),
    UrlRule("block", "||cheap-pills."),
    UrlRule("block", "||free-bets."),
    UrlRule("block", "||adult-x."),
    UrlRule("block", "||ads-track."),
    UrlRule("block", "/ads/"),
    UrlRule("block", "/banner/"),
    UrlRule("block", "/sponsored/"),
    UrlRule("block", "/casino/"),
    UrlRule("block", "/track*.gif"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _index(rules: Sequence[UrlRule], tokens: DataFrame) -> DataFrame:
    """``token, pattern, prefix, verdict, regex``: every rule under its rarest token, '' if it has none."""
    spark = tokens.sparkSession
    every = sorted({t for r in rules for t in r.tokens()})
    counts = {
        r["token"]: r["n"]
        for r in tokens.join(F.broadcast(spark.createDataFrame([(t,) for t in every], "token string")), "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # one row per token of a rule
    }
    rows = [(min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=""), r.pattern, r.prefix, r.verdict, r.regex()) for r in rules]
    return spark.createDataFrame(rows, "token string, pattern string, prefix boolean, verdict string, regex string")


def judge(pages: DataFrame, rules: Sequence[UrlRule] = PREFIX_RULES + PATTERN_RULES) -> DataFrame:
    """``page_id, url, host, path, rule, matched, verdict``; ``rule`` is the longest prefix rule, ``matched`` all patterns."""
    rows = pages.select("page_id", "url")
    urls = rows.where(F.col("url").isNotNull()).select("url").distinct()
    host, path = host_and_path(F.col("url"))
    urls = urls.select("url", F.concat(host, path).alias("subject"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("subject"), F.lit(TOKEN), F.lit(0)))
    tokens = materialise(urls.select("url", "subject", F.explode(F.array_append(words, F.lit(""))).alias("token")), "url-tokens")
    index = _index(rules, tokens)
    # The rules are a list of the caller, held at the driver already.
    fits = tokens.join(F.broadcast(index), "token").where(F.expr("subject rlike regex"))
    longest = F.max(
        F.when(F.col("prefix"), F.struct(F.length("pattern").alias("n"), (F.col("verdict") == "block").alias("b"), "pattern", "verdict"))
    )
    other = F.max(F.when(~F.col("prefix"), F.struct((F.col("verdict") == "allow").alias("a"), F.col("verdict").alias("v"))))
    found = fits.groupBy("url").agg(longest.alias("p"), other.alias("o"), F.sort_array(F.collect_set("pattern")).alias("matched"))
    found = materialise(
        found.select(F.col("url").alias("__u"), F.col("p.pattern").alias("rule"), "matched", F.coalesce("p.verdict", "o.v").alias("v")),
        "url-verdicts",
    )
    host, path = host_and_path(F.col("url"))
    return rows.join(found, rows["url"] == found["__u"], "left").select(
        "page_id", "url", host.alias("host"), path.alias("path"), "rule", "matched", F.coalesce("v", F.lit("allow")).alias("verdict")
    )
