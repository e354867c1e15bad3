"""URL filters: pattern rules found by their rarest literal token.

Each rule keeps one token, the rarest among its literal tokens in the URLs judged;
a URL's tokens fetch the rules kept under them, and only those rules run their
regular expressions. DataFrame operations only: tokens are a hash join, so the
work per URL does not grow with the number of rules.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.shared import cut, literal_table, unused

#: Rules are broadcast up to this many; beyond it the token join shuffles.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits and of other characters above ASCII."""
    return F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"), 1)


def whole_tokens(rule_host: Column, rule_path: Column) -> Column:
    """The rule's tokens that every URL it fits must hold whole.

    The host is a suffix at a label's boundary, so its tokens are whole. The path is
    a prefix: its last token may go on in the URL unless the path closes it.
    """
    in_path = tokens(rule_path)
    open_end = rule_path.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]$")
    closed = F.when(open_end, F.slice(in_path, F.lit(1), F.greatest(F.size(in_path) - 1, F.lit(0)))).otherwise(in_path)
    return F.concat(F.transform(tokens(rule_host), lambda t: F.concat(F.lit("h:"), t)), F.transform(closed, lambda t: F.concat(F.lit("p:"), t)))


def quoted(text: Column) -> Column:
    """``text`` as a literal of a regular expression."""
    return F.regexp_replace(text, r"([^0-9A-Za-z])", r"\\$1")


def rule_index(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """(token, rule, verdict, regex): each rule under its rarest whole token.

    ``frequency(token, n)`` counts tokens over URLs; ties take the smallest token. A
    rule without a whole token stands under the token "" that every URL has.
    """
    # A URL's path is empty or starts with "/": rules with another path fit nothing.
    each = rules.where("path = '' or path like '/%'").distinct().withColumn("tokens", whole_tokens(F.col("host"), F.col("path")))
    each = each.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))))).drop("tokens")
    rated = each.join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rated.groupBy("host", "path", "verdict").agg(F.min(F.struct("n", "token")).alias("best"))
    # The subject is host and path in a row: a host has no "/", and a path starts with one.
    before = F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), quoted(F.col("host"))))
    after = F.when(F.col("path") == "", F.lit("(?:/|$)")).otherwise(quoted(F.col("path")))
    regex = F.concat(F.lit("^"), before, after)
    return best.select(F.col("best.token").alias("token"), F.concat("host", "path").alias("rule"), "verdict", regex.alias("regex"))


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row's URL.

    * The longest rule (host and path together) that fits wins; of rules as long, a
      blocking one, then the largest by name. No rule: ``rule`` null, verdict ``default``.
    * A null URL, or one without ``://``, has empty host and path, and fits only a rule
      whose host and path are empty.
    * ``rules`` are few, or a table (host, path, verdict) of any size.
    * Repeated rows stay; distinct URLs are judged once. Columns named host, path,
      rule or verdict in the input are an error.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"output column {sorted(clash)[0]!r} already exists")
    if not isinstance(rules, DataFrame):
        rules = literal_table(pages.sparkSession, [(r.host, r.path, r.verdict) for r in rules], {"host": "string", "path": "string", "verdict": "string"})
    table = cut(rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct())
    known = table.count()
    split = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    if not known:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = split.select("host", "path").distinct()
    parts = F.concat(
        F.transform(tokens(F.col("host")), lambda t: F.concat(F.lit("h:"), t)),
        F.transform(tokens(F.col("path")), lambda t: F.concat(F.lit("p:"), t)),
        F.array(F.lit("")),
    )
    held = urls.withColumn("token", F.explode(F.array_distinct(parts)))
    # Only tokens that rules hold need counting: the counted table is as small as the rules.
    small = known <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    asked = table.select(F.explode(whole_tokens(F.col("host"), F.col("path"))).alias("token")).distinct()
    frequency = held.join(hint(asked), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = rule_index(table, frequency)
    candidates = held.join(hint(index), "token")
    fits = candidates.where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    rank = F.struct(F.length("rule").alias("length"), (F.col("verdict") == "block").cast("int").alias("blocks"), F.col("rule"), F.col("verdict"))
    judged = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # The hash as a further key makes both sides shuffle, so a hot URL's rows can be split.
    name = unused(pages.columns, "key", "best")
    key = F.xxhash64("host", "path").alias(name["key"])
    joined = split.select("*", key).join(judged.select("host", "path", F.col("best").alias(name["best"]), key), [name["key"], "host", "path"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", F.col(name["best"])["rule"].alias("rule"), F.coalesce(F.col(name["best"])["verdict"], F.lit(default)).alias("verdict"))
