"""URL filters: rules first, then a logistic regression on hashed character n-grams of host and path.

The hash of an n-gram is a polynomial in its characters' code points, one table for hosts and one
for paths, so SQL can compute it anywhere. Weights are whole numbers (millionths), so sums and
verdicts don't depend on the order of additions. Training reads a small labelled table, at most
`max_rows` rows of (url, label), on the driver; scoring is column expressions only.
"""
from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table

SLOTS = 8191  # a prime; each of host and path has so many weights
BASE = 257
GRAMS = (3, 4, 5)
UNIT = 1_000_000
SCALE = 8  # of counts in training
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A small labelled table, made by rule: hosts built around a word of either list with words of no
# kind before and after it, and pages of either kind.
BLOCKED_WORDS = "casino poker roulette blackjack jackpot slots gambling bets betting wager lottery bingo viagra cialis pharmacy pills steroids weightloss payday loans porn xxx sex adult nude escort webcam hentai spam malware trojan phishing virus ransomware exploit warez crack keygen serials torrents pirated proxy ads adserver advert adtech banners popup popunder tracker tracking clicks affiliate telemetry counterfeit replica".split()
ALLOWED_WORDS = "news journal library museum school college garden kitchen travel science history weather music health forum archive wiki docs research city market river flower reading picture farm train mountain bridge theatre gallery hospital church village harbour forest planet physics chemistry biology maths grammar dictionary recipes bakery tea coffee cycling football chess sailing climbing camping painting poetry novel letters cinema radio guitar piano orchestra dance fashion textile furniture carpentry plumbing masonry gardening pets horses birds fishing astronomy geology economy finance law parliament council police fire rescue charity volunteer jobs careers training university institute academy laboratory software hardware robotics electronics printing maps atlas thing theory thread thought other mother father brother clothing washing finishing publishing teaching learning building cooking driving writing station nation fiction motion option edition tradition kitten heather leather northern southern thistle earth health wealth youth month truth lantern intern pattern winter summer autumn spring shed harvest rivers oranges olives onions bread butter cheese".split()
_BEFORE = ("", "my-", "the-", "best-", "top", "new-", "all", "free-", "go-", "super")
_AFTER = ("", "-online", "24", "-world", "-shop", "s", "-now", "-hub", "-info", "land")
_DOMAINS = ("com", "net", "org", "de", "co.uk", "info", "io", "fr", "es", "example")
_SUBDOMAINS = ("", "www.", "m.", "blog.")
_PAGES = ("/", "/en/12", "/de/345.html", "/fr/6/", "/es/789", "/index.php", "/2021/03/a-title")  # pages of either kind
_BLOCKED_PAGES = ("/win-bonus", "/track/click", "/adult/3", "/download-crack", "/buy-pills")
_ALLOWED_PAGES = ("/articles/on-bread", "/lessons/4", "/about", "/opening-hours", "/papers/17.pdf")
HOSTS_OF_A_WORD = 12


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label), label 1 for what is to be blocked."""
    out = []
    for words, own, label in ((BLOCKED_WORDS, _BLOCKED_PAGES, 1), (ALLOWED_WORDS, _ALLOWED_PAGES, 0)):
        for k, word in enumerate(words):
            for i in range(HOSTS_OF_A_WORD):
                j = 7 * k + 3 * i
                host = f"{_SUBDOMAINS[j % 4]}{_BEFORE[j % 10]}{word}{_AFTER[(j // 3 + i) % 10]}.{_DOMAINS[(k + i) % 10]}"
                pages = _PAGES + own
                out.append((f"https://{host}{pages[(k + 5 * i) % len(pages)]}", label))
    return out


def held_out(url: str) -> bool:
    """Whether a host's registered name is in the held-out quarter."""
    name = split_url(url)[0].split(".")
    return zlib.crc32(max(name, key=len).encode()) % 4 == 2


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(PARTS, url or "")
    return (m[1].translate(str.maketrans(_UP, _LOW)), m[2]) if m else ("", "")


def _slots(host: str, path: str) -> list[int]:
    out = []
    for table_no, s in enumerate((f"^{host}$", f"{path}$")):
        for n in GRAMS:
            for i in range(len(s) - n + 1):
                h = n
                for c in s[i : i + n]:
                    h = (h * BASE + ord(c)) % SLOTS
                out.append(table_no * SLOTS + h)
    return out


@lru_cache(maxsize=8)
def train(rows: tuple[tuple[str, int], ...] | None = None, max_rows: int = 10_000, steps: int = 600, rate: float = 24.0, decay: float = 1e-4, prior: float = -2.0) -> tuple[int, tuple[int, ...]]:
    """(bias, weights) in millionths, by gradient descent on at most max_rows labelled rows; features count n-grams.

    The bias is the log-odds of a URL of which nothing is known, and isn't learned: the table doesn't
    show how rare blocked URLs are. They are weighted to be as rare as the bias says, so n-grams that
    both kinds share need no weight.
    """
    rows = (tuple(labelled_urls()) if rows is None else rows)[:max_rows]
    slots = [np.array(_slots(*split_url(url)), np.int64) for url, _ in rows]
    at = np.repeat(np.arange(len(rows)), list(map(len, slots)))
    slot = np.concatenate([*slots, np.zeros(0, np.int64)])
    y = np.array([label for _, label in rows], float)
    weight = np.where(y == 1, np.exp(prior) * max(1, (y == 0).sum()) / max(1, (y == 1).sum()), 1.0)
    w = np.zeros(2 * SLOTS)
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-(np.bincount(at, w[slot], len(rows)) / SCALE + prior)))
        w -= rate * (np.bincount(slot, (weight * (p - y))[at], 2 * SLOTS) / weight.sum() + decay * w)
    return round(prior * UNIT), tuple(int(v) for v in np.round(w / SCALE * UNIT))


def _sum_of_weights(s: Column, weights: tuple[int, ...]) -> Column:
    chars = F.split(s, "")
    n = F.length(s)
    table_of = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    total = F.lit(0).cast("long")
    codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c))

    def at(k: int):
        def slot(i: Column) -> Column:
            h = F.lit(k)
            for j in range(k):
                h = F.pmod(h * BASE + F.element_at(codes, (i + j).cast("int")), F.lit(SLOTS))
            return F.element_at(table_of, (h + 1).cast("int"))

        return slot

    for k in GRAMS:
        grams = F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), at(k))).otherwise(F.array().cast("array<bigint>"))
        total = total + F.aggregate(grams, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return total


def judge(urls: DataFrame, key: str = "page_id", column: str = "url", rules=tuple(RULES), model: tuple[int, tuple[int, ...]] | None = None) -> DataFrame:
    """key, host, path, rule, verdict, margin: one row for each input row.

    A null url, or one without `://`, has an empty host and path and is judged like any other. Of
    the rules that fit, the longest one decides; rules of one length keep the order of the list.
    Without a fitting rule the model's margin (millionths) decides: above 0 is block.
    """
    bias, weights = model or train()
    url = F.coalesce(F.col(column).cast("string"), F.lit(""))
    out = urls.select(F.col(key).alias(key), F.translate(F.regexp_extract(url, PARTS, 1), _UP, _LOW).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    margin = F.lit(bias).cast("long") + _sum_of_weights(F.concat(F.lit("^"), F.col("host"), F.lit("$")), weights[:SLOTS]) + _sum_of_weights(F.concat(F.col("path"), F.lit("$")), weights[SLOTS:])
    out = out.select("*", found.alias("rule"), verdict.alias("ruled"), margin.alias("margin"))
    return out.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def sql(rules=tuple(RULES)) -> str:
    bias, weights = train()
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule if what is None else verdict}'" for rule, verdict in sorted(rules, key=lambda r: -len(r[0])) for h, p in [rule.split("/", 1)]) + " END"

    def grams(s: str, w: tuple[int, ...]) -> str:
        parts = []
        for k in GRAMS:
            h = str(k)
            for j in range(k):
                h = f"(({h} * {BASE} + unicode(substr({s}, i + {j}, 1))) % {SLOTS})"
            parts.append(f"coalesce(list_sum(list_transform(range(1, length({s}) - {k - 2}), lambda i: [{', '.join(map(str, w))}][{h} + 1])), 0)")
        return " + ".join(parts)

    return f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
    m AS (SELECT *, '^' || host || '$' AS h, path || '$' AS p FROM u),
    s AS (SELECT page_id, host, path, {case(None)} AS rule, {case(1)} AS ruled, CAST({bias} + {grams('h', weights[:SLOTS])} + {grams('p', weights[SLOTS:])} AS BIGINT) AS margin FROM m)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict, margin FROM s
    """
