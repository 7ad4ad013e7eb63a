"""URL filter (operator 8): a trie over reversed host labels, then path segments, with allow and block entries.

A rule is (host, path, verdict).  It fits its host and all subdomains if the URL's path starts with the rule's path; of
the rules that fit, the one with the most host labels wins, then the one with the longest path; of rules for the same host and path
the last one by (rule, verdict), so that block goes before allow.  URLs that no rule fits get the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = {c: c + 32 for c in range(65, 91)}
#: Rules of more bytes than this are not sent to the executors; judge_urls_by_join takes any number.
MAX_RULE_BYTES = 32 << 20


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path goes
    on from there to ``?``, ``#`` or the end.  Both are empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class _Node:
    __slots__ = ("labels", "longest", "paths", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.segments: dict[str, _Node] = {}
        #: beginnings of a next segment at which rules end, and the longest one's length
        self.tails: dict[str, tuple[str, str]] = {}
        self.longest = 0


class RuleTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]], default: str = "allow"):
        self.root, self.default = _Node(), default
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = at = node.paths or _Node()
            *whole, tail = path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Node())
            at.tails[tail] = max(at.tails.get(tail, ("", "")), (f"{host}{path}", verdict))
            at.longest = max(at.longest, len(tail))

    @staticmethod
    def _by_path(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node.tails:
                for n in range(min(len(segment), node.longest), -1, -1):
                    if found := node.tails.get(segment[:n]):
                        best = found
                        break
            node = node.segments.get(segment)
            if node is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule or None, verdict)."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._by_path(node.paths, segments) or best
        return best or (None, self.default)


_OUT = "page_id long, host string, path string, rule string, verdict string"


def _judge(batches: Iterable[pa.RecordBatch], rules: list[tuple[str, str, str]], default: str) -> Iterator[pa.RecordBatch]:
    trie = RuleTrie(rules, default)
    for batch in batches:
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        found = [trie.judge(*p) for p in parts]
        columns = [[p[0] for p in parts], [p[1] for p in parts], [x[0] for x in found], [x[1] for x in found]]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict.

    Null and malformed URLs have an empty host and path and get the default verdict; URLs of any length are judged whole; repeated rows
    and null ids stay; no rows give none; of equal rules the last one by (rule, verdict) counts; other columns are not read.  The trie goes to the executors, so the rules may have MAX_RULE_BYTES at most.
    """
    if (size := sum(len(h) + len(p) + len(v) for h, p, v in rules)) > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules: use judge_urls_by_join")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(partial(_judge, rules=rules, default=default), _OUT)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for any number of rules(host, path, verdict): distinct URLs meet the rules by their hosts' suffixes."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    lower = F.translate(F.regexp_extract("url", "^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = rows.select("url").distinct().select("url", lower.alias("host"), F.regexp_extract("url", "^(?s:.*?)://[^/?#]*([^?#]*)", 1).alias("path"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"))
    own = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("suffix"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict")
    fits = asked.join(own, "suffix").filter(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("suffix"), F.length("rule_path"), F.col("rule"), F.col("verdict"))).alias("best"))
    out = urls.join(best.select("url", "best.rule", "best.verdict"), "url", "left")
    return rows.join(out, "url").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
