"""URL filters: pattern rules found through their rarest literal token.

A filter list is a table of rules; each rule has the literal tokens that any
URL it fits must hold as whole tokens. The rule is filed under the rarest of
them (counted over the URLs at hand), the URL's own tokens fetch the candidate
rules, and only these run their regular expressions. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, as_row, ascii_lower, from_row

#: What splits a URL into tokens (the token alphabet is a-z, 0-9 after folding).
SPLIT = "[^a-z0-9]+"
#: Filed under this token: rules without a literal token of their own.
ANY = ""


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regular expression searched in ``host + path``
    (host lower-cased A-Z); ``tokens`` are literals that every fitting URL holds
    between separators. ``listed`` rules win over the others; among fitting
    rules of one kind the longest name wins, then block, then the smaller name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True


def host_rule(verdict: str, name: str) -> Rule:
    """``example.net/en/``: the host and all its subdomains, paths that start
    with ``/en/``. A path's last piece is a whole token only if a slash ends it."""
    host, _, path = name.partition("/")
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape("/" + path)
    whole = "/" + path
    whole = whole[: re.search(r"[A-Za-z0-9]*$", whole).start()]
    return Rule(name, verdict, pattern, tuple(_tokens(host)) + tuple(_tokens(whole)))


def word_rule(verdict: str, words: str) -> Rule:
    """Words that stand next to each other as host labels or path pieces,
    joined by any one of ``- _ . /``."""
    parts = words.split()
    pattern = r"(?i)(?:^|[^a-z0-9])" + "[-_./]".join(map(re.escape, parts)) + r"(?:[^a-z0-9]|$)"
    return Rule(words, verdict, pattern, tuple(parts), listed=False)


def _tokens(s: str) -> list[str]:
    return [t for t in re.split(SPLIT, s.translate(str.maketrans(UPPER, LOWER))) if t]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    if not rules:
        return spark.createDataFrame([], "rule_id int, rule string, rule_verdict string, pattern string, "
                                         "listed boolean, tokens array<string>")
    rows = [F.struct(F.lit(i).alias("rule_id"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("rule_verdict"),
                     F.lit(r.pattern).alias("pattern"), F.lit(r.listed).alias("listed"),
                     F.array(*map(F.lit, sorted(set(r.tokens)))).cast("array<string>").alias("tokens"))
            for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def filter_urls(urls: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
                ) -> DataFrame:
    """Return the rows of ``urls`` with ``host``, ``path``, ``rule`` (name of the
    listed rule that decides, else NULL), ``matched`` (name of the rule that
    decides, listed or not, else NULL) and ``verdict``.

    A NULL URL or one without ``://`` has an empty host and path and gets
    ``default``. Repeated rows are judged each; columns of ``urls`` named like
    an output column are replaced. An empty rule list gives ``default``.
    The rule table is the caller's literal list (a few bytes a rule), so it is
    broadcast; URLs are counted and joined as distinct (host, path) pairs.
    """
    spark = urls.sparkSession
    kept = [c for c in urls.columns if c not in {"host", "path", "rule", "matched", "verdict"} - {url}]
    # the row travels as one value, so its columns cannot clash with ours
    base = urls.select(as_row(kept), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    table = _rule_table(spark, rules)

    pages = base.select("host", "path").where("host != '' or path != ''").distinct()
    tokens = pages.withColumn("token", F.explode(F.array_union(
        F.split(ascii_lower(F.concat("host", "path")), SPLIT), F.array(F.lit(ANY)))))
    literals = table.select("rule_id", F.explode("tokens").alias("token"))
    # how many URLs hold each literal: only the rules' own tokens are counted
    seen = (tokens.select("token").join(F.broadcast(literals.select("token").distinct()), "token")
            .groupBy("token").agg(F.count("*").alias("n")))
    rarest = (literals.join(F.broadcast(seen), "token", "left")
              .groupBy("rule_id")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
              .select("rule_id", F.col("least.token").alias("token")))
    index = (table.drop("tokens").join(rarest, "rule_id", "left")
             .withColumn("token", F.coalesce("token", F.lit(ANY))))

    fits = (tokens.join(F.broadcast(index), "token")
            .where(F.expr("regexp_like(concat(host, path), pattern)")))
    best = (fits.groupBy("host", "path")
            .agg(F.min(F.struct(~F.col("listed"), -F.length("rule"), F.col("rule_verdict") != "block",
                                F.col("rule").alias("rule"), F.col("rule_verdict").alias("v"),
                                F.col("listed").alias("listed"))).alias("w"))
            .select("host", "path", F.col("w.rule").alias("matched"), F.col("w.v").alias("found"),
                    F.when(F.col("w.listed"), F.col("w.rule")).alias("rule")))
    named = (F.col("host") != "") | (F.col("path") != "")
    judged = base.where(named).join(best, ["host", "path"], "left")
    # rows without a host fit no rule: they need no join and meet in no task
    none = [F.lit(None).cast("string").alias(c) for c in ("matched", "found", "rule")]
    rows = judged.unionByName(base.where(~named).select("row", "host", "path", *none))
    verdict = F.coalesce("found", F.lit(default)).alias("verdict")
    own = {"host", "path", "matched", "rule", "verdict"}
    return rows.select(*[x for c, x in zip(kept, from_row(kept)) if c not in own], "host", "path", "matched", "rule", verdict)
