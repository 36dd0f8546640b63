"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern with ``*`` (any run), ``^`` (a separator or the end), ``||`` (start of
the host or of one of its labels) and ``|`` (start or end of the address). The words that
a pattern must contain whole are its literal tokens; the index files each rule under the
one that the fewest addresses hold. An address fetches the rules filed under its own
tokens, and only those run their regular expressions.

Odd rows: an address that is null or has no ``://`` has empty host and path, meets no rule
and is allowed. Repeated addresses are judged once. Every page gives one row, whatever its
id; no cap on length, rules or candidates. Without rules every page is allowed; among
equals the longest rule wins, then the last in text order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import spare_name
from tracesieve.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"


@dataclass(frozen=True)
class Rule:
    """``listed`` rules compete by length and beat all others; of the others, ``allow`` beats ``block``."""

    pattern: str
    action: str
    listed: bool = False

    @property
    def text(self) -> str:
        return self.pattern.removeprefix("||") if self.listed else self.pattern


#: Host and path rules that were asked for.
LISTED = tuple(
    Rule("||" + place, action, True)
    for place, action in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
)
#: Our own rules: link farms, gambling, shop and account pages, trackers, files without text.
PATTERNS = tuple(Rule(p, "block") for p in (
    "||spam-farm.", "||link-farm.", "||casino.", "/casino/", "/poker/", "||ads.", "/adserver/", "||tracker.", "/wp-login.php", "/wp-admin/",
    "/cgi-bin/", "/cart^", "/checkout^", "/login^", "^replytocom=", ".exe|", ".zip|", ".jpg|", ".png|", ".mp4|",
)) + tuple(Rule(p, "allow") for p in ("/casino/history^", "/poker/rules^"))


def regex(pattern: str) -> str:
    """The regular expression of a pattern, in the dialect that Java and RE2 share."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], r"\z"
    parts = {"*": r"(?s:.*)", "^": SEPARATOR}
    return head + "".join(parts.get(c) or (c if c.isalnum() or c in "/_-=" else "\\" + c if c.isascii() else c) for c in body) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Words that every address fitting the pattern holds whole: both neighbours are fixed and no letters or digits."""
    anchored, low = pattern.startswith("|"), pattern.lower().strip("|")
    low = ("/" if anchored else "*") + low + ("/" if pattern.endswith("|") else "*")
    return sorted({m.group() for m in re.finditer(r"[a-z0-9]+", low) if "*" not in (low[m.start() - 1], low[m.end()])})


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the address from the host on (host in lower case, the rest as it is)."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^(?s:.*?)://", "")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_extract(rest, r"^[^/?#]*((?s:.*))", 1))


def address_tokens(address: Column, always: bool) -> Column:
    """Distinct words of an address; ``always`` adds the empty one, under which rules without a token are filed."""
    words = F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+")
    words = F.filter(words, lambda w: w != "")
    return F.array_distinct(F.concat(words, F.array(F.lit("")))) if always else F.array_distinct(words)


def token_index(addresses: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, pattern, regex, action, listed, text): each rule under its rarest token in ``addresses`` (address)."""
    spark = addresses.sparkSession
    rows = [(t, r.pattern, regex(r.pattern), r.action, r.listed, r.text) for r in rules for t in literal_tokens(r.pattern) or [""]]
    filed = spark.createDataFrame(rows, "token string, pattern string, regex string, action string, listed boolean, text string")
    held = addresses.select(F.explode(address_tokens(F.col("address"), False)).alias("token"))
    counts = held.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.col("token"), F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token")
    return cut(filed.join(counts, "token", "left").groupBy("pattern", "regex", "action", "listed", "text").agg(rarest))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, url: str = "url") -> DataFrame:
    """``pages`` with a struct column ``judged`` (host, path, rule, verdict, pattern); its name grows if it is taken.

    ``rule`` is the listed rule that decided, ``pattern`` any other one. Distinct addresses
    are shuffled once; the index travels to them by the join that its size calls for.
    """
    name = spare_name(pages, "judged")
    _, _, address = address_parts(F.col("url"))
    distinct = pages.select(F.col(url).alias("url")).where(F.contains("url", F.lit("://"))).distinct()
    named = distinct.select("url", address.alias("address"))
    index = token_index(named, rules)
    always = any(not literal_tokens(r.pattern) for r in rules)
    fetched = named.select("*", F.explode(address_tokens(F.col("address"), always)).alias("token")).join(index, "token")
    lowered = F.translate("address", UPPER, LOWER)
    fits = fetched.where(F.rlike(F.when(F.col("listed"), F.col("address")).otherwise(lowered), F.col("regex")))
    weight = F.when(F.col("listed"), F.length("text")).otherwise((F.col("action") == "allow").cast("int"))
    best = fits.groupBy("url").agg(F.max(F.struct("listed", weight.alias("weight"), "text", "action")).alias("best"))
    fitted, chosen = spare_name(pages, "fitted"), spare_name(pages, "chosen")
    out = pages.join(best.select(F.col("url").alias(fitted), F.col("best").alias(chosen)), F.col(url) == F.col(fitted), "left")
    host, path, _ = address_parts(F.col(url))
    judged = F.struct(
        host.alias("host"), path.alias("path"), F.when(F.col(f"{chosen}.listed"), F.col(f"{chosen}.text")).alias("rule"),
        F.coalesce(F.col(f"{chosen}.action"), F.lit("allow")).alias("verdict"), F.when(~F.col(f"{chosen}.listed"), F.col(f"{chosen}.text")).alias("pattern"),
    )
    return out.select(*[pages[c] for c in pages.columns], judged.alias(name))
