"""URL filter: a weighted vocabulary counted with Aho-Corasick, behind host and path rules.

A url's rule is the longest (host, path) rule that fits: its host is the rule's or a subdomain of
it, and its path starts with the rule's. Where none fits, the url's terms decide: matches count
only between boundaries (no ASCII letter or digit on either side). One strict term blocks; so do
SOFT_TERMS distinct soft ones or more whose weights add up to SOFT_WEIGHT.

The vocabulary is a parameter: a Vocabulary made of stems, of which the variants that urls write
(plurals, 0 for o, 3 for e) are made by rule and count as their stem, or one read from a file of
"term,weight" lines. It is configuration and its size is checked; the automaton is built once in
each Python worker. A url is judged alone, in one pass without any exchange; only the url column is
read.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and is
judged by its terms (null: none, so allowed); a url of any length is judged whole; repeated rows are judged alike; an empty table gives
an empty result; other columns are carried through by judge_urls unless a result takes their name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
STRICT = (
    "anal", "bdsm", "blowjob", "bukkake", "camgirl", "casino", "cialis", "creampie", "cumshot", "deepfake", "deepthroat", "escort", "fetish", "gangbang", "handjob", "hardcore", "hentai", "incest", "keylogger", "levitra", "malware", "masturbate", "milf", "nsfw", "onlyfans", "orgasm",
    "phishing", "porn", "pornhub", "ransomware", "redtube", "rootkit", "shemale", "slut", "spam", "striptease", "swinger", "threesome", "upskirt", "viagra", "voyeur", "warez", "xhamster", "xnxx", "xvideo", "xxx", "youporn",
)
#: Soft stems: those of weight 2 first, then those of weight 1.
STRONG = ("ads", "adult", "babe", "bet", "betting", "bingo", "blackjack", "busty", "crack", "dating", "erotic", "gambling", "hookup", "horny", "jackpot", "kamagra", "keygen", "kinky", "lingerie", "naked", "nude", "payday", "pills", "poker", "roulette", "serial", "sex", "sexy", "slot", "sportsbook", "torrent", "webcam")
WEAK = (
    "amateur", "ass", "bikini", "bonus", "boob", "cam", "cash", "cheap", "coupon", "cracked", "credit", "deal", "diet", "discount", "download", "earn", "enlarge", "forex", "free", "girl", "guy", "hack", "hot", "instant", "kiss", "loan", "lottery", "lucky", "massage", "mature", "model",
    "money", "nulled", "offer", "patch", "pharmacy", "pic", "prize", "promo", "replica", "rich", "single", "spin", "strip", "supplement", "teen", "track", "tracker", "video", "weightloss", "win", "winner", "wife",
)
SOFT_TERMS, SOFT_WEIGHT = 2, 3
MAX_TERMS = 200_000


def variants(stem: str) -> list[str]:
    """How urls write a stem: as it is, in the plural, and with digits for o and e."""
    forms = [stem, stem if stem.endswith("s") else stem + "s"]
    return sorted({f for form in forms for f in (form, form.replace("o", "0"), form.replace("e", "3"))})


@dataclass(frozen=True)
class Vocabulary:
    """(term, stem, weight) of soft terms, and strict terms, whose weight is 0."""

    terms: tuple

    @classmethod
    def of(cls, strict, soft: dict) -> Vocabulary:
        """From stems: strict ones, and soft ones with their weights. A term that two stems give is the first one's."""
        found: dict = {}
        for stem, weight in [*((s, 0) for s in strict), *soft.items()]:
            for term in variants(stem):
                found.setdefault(term, (term, stem, weight))
        return cls(tuple(found.values()))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Vocabulary:
        """From lines "term,weight", where the weight of strict terms is the word strict. Terms are lower-cased and count as stems of their own."""
        rows = spark.read.csv(path, schema="term string, weight string").where("term is not null").limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"a vocabulary of more than {MAX_TERMS} terms")
        found = {r["term"].strip().lower(): 0 if r["weight"].strip() == "strict" else int(r["weight"]) for r in rows}
        return cls(tuple((t, t, w) for t, w in sorted(found.items()) if t))


VOCABULARY = Vocabulary.of(STRICT, {s: 2 for s in STRONG} | {s: 1 for s in WEAK})


def split_url(url: Column) -> tuple[Column, Column]:
    part = lambda rx: F.coalesce(F.regexp_extract(url, rx, 1), F.lit(""))
    return ascii_lower(part(r"://([^/?#]*)")), part(r"://[^/?#]*([^?#]*)")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null for none. rules is configuration, so it is compiled into the expression."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(F.lit(None) if name is None else name)
        verdict = F.when(fits, v).otherwise(F.lit(None) if verdict is None else verdict)
    return name, verdict


@lru_cache(maxsize=4)
def _automaton(vocabulary: Vocabulary):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, stem, weight in vocabulary.terms:
        found.add_word(term, (len(term), stem, weight))
    if vocabulary.terms:
        found.make_automaton()
    return found


def count_terms(url: str, vocabulary: Vocabulary = VOCABULARY) -> tuple[int, int, int]:
    """Matches of strict terms, distinct soft stems, and those stems' weights, in an ASCII-lowered url."""
    n, seen = 0, {}
    edge = lambda i: not (0 <= i < len(url) and url[i].isascii() and url[i].isalnum())
    for end, (size, stem, weight) in _automaton(vocabulary).iter(url) if vocabulary.terms else ():
        if edge(end + 1) and edge(end - size):
            if weight:
                seen[stem] = weight
            else:
                n += 1
    return n, len(seen), sum(seen.values())


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: Vocabulary = VOCABULARY, soft_terms: int = SOFT_TERMS, soft_weight: int = SOFT_WEIGHT) -> DataFrame:
    """pages(url, ...) -> its other columns, host, path, rule, verdict, n_strict, n_soft, soft_weight."""

    @F.pandas_udf("struct<n_strict:int,n_soft:int,soft_weight:int>")
    def terms(url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_terms(u, vocabulary) for u in url], columns=["n_strict", "n_soft", "soft_weight"], dtype="int32")

    host, path = split_url(F.col("url"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    hits = terms(F.coalesce(ascii_lower(F.col("url")), F.lit("")))
    new = {"host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight", "__t"}
    out = pages.select(*[c for c in pages.columns if c not in new], host.alias("host"), path.alias("path"), hits.alias("__t"))
    by_terms = F.when((F.col("__t.n_strict") >= 1) | ((F.col("__t.n_soft") >= soft_terms) & (F.col("__t.soft_weight") >= soft_weight)), "block").otherwise("allow")
    return out.select(*[c for c in out.columns if c != "__t"], rule.alias("rule"), F.coalesce(said, by_terms).alias("verdict"), "__t.n_strict", "__t.n_soft", "__t.soft_weight")


def op6_url_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _fits(h: str, p: str) -> str:
    return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"


_LONGEST = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
#: Terms are letters and digits, so between boundaries they are what a url splits into.
ORACLE_SQL = rf"""
WITH terms(term, stem, weight) AS (VALUES {", ".join(f"('{t}', '{s}', {w})" for t, s, w in VOCABULARY.terms)}),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u, coalesce(url, '') AS url FROM pages),
p AS (SELECT rid, page_id, u, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT rid, stem, weight FROM (SELECT rid, unnest(string_split_regex(u, '[^a-z0-9]+')) AS term FROM u) JOIN terms USING (term)),
k AS (SELECT rid, CAST(count(*) FILTER (weight = 0) AS INTEGER) AS n_strict FROM h GROUP BY rid),
f AS (SELECT rid, CAST(count(*) AS INTEGER) AS n_soft, CAST(sum(weight) AS INTEGER) AS soft_weight FROM (SELECT DISTINCT rid, stem, weight FROM h WHERE weight > 0) GROUP BY rid),
t AS (SELECT p.*, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(soft_weight, 0) AS soft_weight FROM p LEFT JOIN k USING (rid) LEFT JOIN f USING (rid))
SELECT page_id, host, path, n_strict, n_soft, soft_weight,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _LONGEST)} WHEN n_strict >= 1 OR (n_soft >= {SOFT_TERMS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict
FROM t
"""
