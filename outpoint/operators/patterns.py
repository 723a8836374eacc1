"""Many regular expressions over many scripts.

What a pattern cannot match without, a run of plain characters, goes into one
automaton for all patterns. One pass over a script finds the patterns whose
run it holds, and only these are tried on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter runs are in too many scripts to be of use.
LEAST_RUN = 4

_TOKEN = re.compile(
    r"""(?P<plain>[0-9A-Za-z])
      | (?P<class>\[\^?[^\[\]\\&]+\])
      | (?P<escape>\\[dDwWsSbB\W])
      | (?P<open>\((?:\?:)?(?!\?))
      | (?P<close>\))
      | (?P<either>\|)
      | (?P<other>[.^$])""",
    re.VERBOSE,
)
_TIMES = re.compile(r"(?:(?P<none>[?*]|\{0+(?:,\d*)?\})|(?P<some>\+|\{\d+(?:,\d*)?\}))[?+]?")


def required_run(pattern: str) -> str | None:
    """The longest run of plain characters in every match, None if none is certain.

    Groups count as unknown, and so does a pattern with alternatives outside of
    groups or with anything that is not read here (flags, look-around, quotes).
    """
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        if token is None:
            return None
        times = _TIMES.match(pattern, token.end())
        kind = token.lastgroup
        if kind == "either" and depth == 0:
            return None
        if kind == "plain" and depth == 0 and not (times and times["none"]):
            run += token[0]
        if kind != "plain" or times:
            runs.append(run)
            run = ""
        depth += (kind == "open") - (kind == "close")
        if depth < 0 or (kind in ("open", "either") and times):
            return None
        at = times.end() if times else token.end()
    best = max([*runs, run], key=len)
    return best if len(best) >= LEAST_RUN and depth == 0 else None


def candidates(script: Column, runs: dict[int, str]) -> Column:
    """Keys of ``runs`` whose run is in the script."""
    keys: dict[str, list[int]] = {}
    for key, run in runs.items():
        keys.setdefault(run, []).append(key)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for run, holders in keys.items():
            automaton.add_word(run, (run, holders))
        automaton.make_automaton()

        def of(text: str | None) -> list[int]:
            met = dict(hit for _, hit in automaton.iter(text or ""))
            return sorted(key for holders in met.values() for key in holders)

        for batch in batches:
            yield batch.map(of)

    return found(script)


def indexed_matches(outputs: DataFrame, rules: list[tuple[int, str, int, int]], at: Column) -> DataFrame:
    """(hash, priority) of scripts and (priority, pattern, since, until) rules active ``at``; each pattern has a run."""
    table = outputs.sparkSession.createDataFrame(rules, "priority int, pattern string, since long, until long")
    runs = {key: required_run(pattern) for key, pattern, _, _ in rules}
    held = outputs.select("hash", "script_hex", at.alias("_at"), candidates(F.col("script_hex"), runs).alias("found"))
    tried = held.select("hash", "script_hex", "_at", F.explode("found").alias("priority")).join(table, "priority")
    hit = F.regexp_like("script_hex", F.col("pattern")) & F.col("_at").between(F.col("since"), F.col("until"))
    return tried.filter(hit).select("hash", "priority")
