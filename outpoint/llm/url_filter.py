"""URL filter: rules for hosts and paths first, then a weighted vocabulary.

All terms are found in one pass over the lower-cased url by an Aho-Corasick
automaton. A hit counts only between boundaries (no letter or digit of a-z,
0-9 next to it). A strict term alone rejects the url, soft terms do so when
the weights of the distinct ones reach the limit.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

LIMIT = 6
STRICT = ("porn", "xxx", "hentai", "camgirls", "escorts", "warez", "malware", "phishing", "casino", "viagra")
SOFT = ("adult", "sex", "nude", "erotic", "betting", "poker", "jackpot", "torrent", "crack", "keygen", "pills", "payday", "loan", "lottery")
#: (term, weight); a strict term has none and counts as much as the limit, whatever that is.
VOCABULARY = tuple([(t, None) for t in STRICT] + [(t, 2) for t in SOFT])
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=4)
def automaton(vocabulary: tuple[tuple[str, int | None], ...]):
    """The automaton over the terms, None for an empty vocabulary."""
    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        if term:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found if len(found) else None


def weight_of(url: str, terms, limit: int = LIMIT) -> int:
    """Summed weight of the distinct terms of an automaton that stand in ``url`` between boundaries."""
    url = url.translate(_LOWER)
    hits = {}
    for end, (term, weight) in terms.iter(url) if terms else ():
        begin = end - len(term) + 1
        if (begin == 0 or url[begin - 1] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            hits[term] = limit if weight is None else weight
    return sum(hits.values())


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:end]


def rule_for(host: str, path: str, rules) -> tuple[str, str] | None:
    """Name and verdict of the longest rule that fits."""
    fitting = [(h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting, key=lambda r: (len(r[0]), r), default=None)


def judge(pages: DataFrame, rules=RULES, vocabulary=VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and term weight of pages (page_id, url), a row per row.

    A null url or one without ``://`` has an empty host and path; no rule fits
    it unless the rule's host is empty. Without a rule the vocabulary decides,
    on the whole url: ``block`` if the weights reach ``limit``, else ``allow``
    (so for null); a strict term alone blocks at any ``limit``. Other columns
    are ignored; the table of rules is small, the vocabulary may be large.
    """
    vocabulary = tuple(vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        terms = automaton(vocabulary)
        out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": [], "weight": []}
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule = rule_for(host, path, rules)
            weight = weight_of(url or "", terms, limit)
            verdict = rule[1] if rule else "block" if weight >= limit else "allow"
            for name, value in zip(out, (host, path, rule and rule[0], verdict, weight), strict=True):
                out[name].append(value)
        kinds = {"weight": pa.int64()}
        return {"page_id": batch.column(0)} | {n: pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()}

    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return map_batches(urls, run, "page_id long, host string, path string, rule string, verdict string, weight long")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))


def _sql() -> str:
    weights = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {LIMIT if w is None else w} ELSE 0 END" for t, w in VOCABULARY)
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in ordered]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for _, name, test in fits)
    verdict = " ".join(f"WHEN '{name}' THEN '{v}'" for v, name, _ in fits)
    return f"""
WITH cut AS (
    SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
parts AS (
    SELECT page_id, low,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
),
ruled AS (
    SELECT page_id, host, path, CASE {rule} END AS rule, CAST({weights} AS BIGINT) AS weight FROM parts
)
SELECT page_id, host, path, rule,
       CASE rule {verdict} ELSE CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict, weight
FROM ruled
"""


OP1_SQL = _sql()
