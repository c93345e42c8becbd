"""URL filtering (operator 3): host/path rules before a weighted vocabulary found by Aho-Corasick.

Rules win over the vocabulary.  A rule ``host/path`` fits its host and all subdomains if the path starts
with the rule's; the longest fitting rule decides.  Else the whole url (A-Z lower-cased) is searched once
for all terms by an Aho-Corasick automaton; a hit counts only between boundaries (neither neighbour is a
letter a-z or a digit).  One strict term rejects, and so do ``soft_limit`` distinct soft terms.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; a null url has no
hits, so the verdict is ``allow``; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
STRICT = (
    "botnet", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "gambling", "hentai", "keygen", "malware",
    "nude", "nudes", "phishing", "porn", "porno", "ransomware", "sexcam", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "adult", "ads", "bet", "bets", "betting", "bingo", "cheap", "click", "clicks", "coupon", "coupons", "dating", "discount", "farm", "forex",
    "free", "jackpot", "loan", "loans", "lottery", "payday", "pills", "poker", "prize", "prizes", "roulette", "sex", "slot", "slots", "track", "win", "winner",
)
SOFT_LIMIT = 2


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in soft:
        out.add_word(term, (term, False))
    for term in strict:
        out.add_word(term, (term, True))
    out.make_automaton()
    return out


def hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the url between boundaries."""
    found: set[tuple[str, bool]] = set()
    inner = lambda k: 0 <= k < len(url) and (url[k].isascii() and url[k].isalnum())
    for end, (term, is_strict) in automaton(strict, soft).iter(url):
        if not inner(end + 1) and not inner(end - len(term)):
            found.add((term, is_strict))
    return sum(s for _, s in found), sum(not s for _, s in found)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    choice = F
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        choice = choice.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return choice


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hits(u or "", strict, soft) for u in b.column("_low").to_pylist()]
            counts = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *counts], ["page_id", "host", "path", "_rule", "strict_hits", "soft_hits"])

    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.translate("url", UPPER, LOWER).alias("_low"))
    judged = parts.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("_rule"), "_low")
    judged = judged.mapInArrow(run, "page_id long, host string, path string, _rule struct<rule:string,verdict:string>, strict_hits int, soft_hits int")
    bad = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit)
    method = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "strict_hits", "soft_hits")


def filter_sql(pages: str = "pages") -> str:
    """The same with the default rules and terms, as DuckDB SQL."""
    terms = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    count = lambda xs: f"len(list_filter({terms(xs)}, lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))::INTEGER"
    case = lambda value: "CASE " + " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{value(v, r)}'"
        for v, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
    ) + " END"
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    return f"""
WITH rests AS (
  SELECT page_id, coalesce({lower % 'url'}, '') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
parts AS (
  SELECT page_id, low, {lower % "regexp_extract(rest, '^([^/?#]*)', 1)"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
counted AS (SELECT *, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits, {case(lambda v, r: r)} AS rule FROM parts)
SELECT page_id, host, path, rule,
       coalesce({case(lambda v, r: v)}, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM counted
"""
