"""URL verdicts by a bit-parallel automaton over wildcard rules.

All rules are packed side by side into the bits of a few 64-bit words. One
pass over a canonical URL moves every rule's set of states at once: shift,
mask by the character, and keep the states at a `*`. The worker runs a whole
Arrow batch in step, one character position at a time, so that the inner loop
is numpy over (urls x words).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: (verdict, host, path): a host stands for itself and its subdomains, a path for what starts with it. Fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over host, MARK and path that block what no rule decides.
GLOBS = ("*casino*|*", "*bets.*|*", "*pills*|*", "*ads-track*|*", "*adserver*|*", "*.doubleclick.*|*", "*porn*|*", "*xxx*|*", "*|*/track/*", "*|*/ads/*")
#: Stands between host and path in the canonical form and in globs.
MARK = "|"


class ShiftAnd:
    """Glob patterns (`*`: any run, `?`: any character) as multiword Shift-And masks."""

    def __init__(self, patterns: Sequence[str]):
        states, start, final = 0, [], []
        # ASCII, then one code for all other letters, then those of them that patterns hold
        self.code = {c: 129 + i for i, c in enumerate(sorted({c for p in patterns for c in p if ord(c) > 127}))}
        char: dict[int, list[int]] = {}
        loops, anything = [], []
        for p in patterns:
            start.append(states)
            at = states
            for c in p:
                if c == "*":
                    loops.append(at)
                    continue
                at += 1
                if c == "?":
                    anything.append(at)
                else:
                    char.setdefault(self.code.get(c, ord(c)), []).append(at)
            final.append(at)
            states = at + 1
        self.words = states // 64 + 1
        bits = lambda on: self._mask(on)
        self.start, self.loop, self.ends = bits(start), bits(loops), bits(final)
        self.final = final
        # a state before a new pattern's start must not shift into it
        self.table = np.stack([bits(char.get(c, []) + anything) for c in range(129 + len(self.code))])

    def _mask(self, on: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in on:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean (texts x patterns): which patterns fit the whole text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        longest = int(lengths[0]) if len(order) else 0
        block = 256
        for begin in range(0, longest, block):
            live = int(np.searchsorted(-lengths, -begin, side="left"))  # texts longer than begin
            codes = np.full((live, block), 128, np.uint16)
            for row, i in enumerate(order[:live]):
                part = texts[i][begin : begin + block]
                codes[row, : len(part)] = np.frombuffer(part.encode(), np.uint8) if part.isascii() else [self.code.get(c, min(ord(c), 128)) for c in part]
            for k in range(min(block, longest - begin)):
                n = int(np.searchsorted(-lengths, -(begin + k), side="left"))
                if not n:
                    break
                s = state[:n]
                moved = s << one
                moved[:, 1:] |= s[:, :-1] >> top
                moved &= self.table[codes[:n, k]]
                moved |= s & self.loop
                state[:n] = moved
        hit = np.empty((len(texts), len(self.final)), bool)
        for j, f in enumerate(self.final):
            hit[order, j] = (state[:, f // 64] >> np.uint64(f % 64)) & one == one
        return hit


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty for null or no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules=RULES, globs: Sequence[str] = GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The longest rule that fits decides (ties: the first given); where none
    fits, rule is null and the verdict is block if any glob fits, else allow.
    A null url, or one without ://, has an empty host and path, fits no rule
    and is judged by the globs. Repeated rows each get their row; other
    columns are ignored; no rows give no rows.
    """
    patterns, owner = [], []
    for i, (_, host, path) in enumerate(rules):
        patterns += [f"{host}{MARK}{path}*", f"*.{host}{MARK}{path}*"]
        owner += [i, i]
    patterns += list(globs)
    names = [host + path for _, host, path in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    automaton = ShiftAnd(patterns)

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            # the mark may only stand between host and path
            texts = [h.replace(MARK, "\x7f") + MARK + p.replace(MARK, "\x7f") for h, p in zip(hosts, paths)]
            hit = automaton.match(texts)
            rule = np.full(len(texts), None, object)
            verdict = np.where(hit[:, len(owner) :].any(axis=1), "block", "allow").astype(object)
            for i in reversed(order):
                fits = hit[:, 2 * i] | hit[:, 2 * i + 1]
                rule[fits], verdict[fits] = names[i], rules[i][0]
            yield pd.DataFrame({"rule": rule, "verdict": verdict})

    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.withColumn("_j", judge("host", "path")).select("page_id", "host", "path", "_j.rule", "_j.verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, 'casino|bets\.|pills|ads-track|adserver|\.doubleclick\.|porn|xxx')
    OR path LIKE '%/track/%' OR path LIKE '%/ads/%' THEN 'block'
  ELSE 'allow' END AS verdict
FROM d
"""
