"""URL allow and block rules in a trie over reversed host labels and path segments.

Each rule is a path of keys in a trie: the host's labels from the last to the first, then
a mark, then the rest of the rule's path. A url walks the trie along its own labels and
collects the rules whose path its own path starts with; the deepest host wins, then the
longest path. The trie is broadcast: it holds one entry per rule, and `judge_urls`
refuses more than `most_rules` of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`; "" as host fits all."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:cut]


class RuleTrie:
    """Nodes are dicts keyed by host label; the key None holds the node's path trie."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            *segments, last = rule.path.split("/")
            place = node.setdefault(None, {})
            for segment in segments:
                place = place.setdefault(segment, {})
            # A rule may end inside a segment, so ends are kept per node, longest first.
            ends = place.setdefault(None, {})
            kept = ends.get(last)
            if kept is None or (kept.verdict, rule.verdict) == ("allow", "block"):
                ends[last] = rule

    @staticmethod
    def _in_path(place: dict, path: str) -> Rule | None:
        found, parts = None, path.split("/")
        for depth, part in enumerate(parts):
            ends = place.get(None, {})
            best = max((e for e in ends if part.startswith(e)), key=len, default=None)
            if best is not None:
                found = ends[best]
            if depth + 1 < len(parts):
                place = place.get(part)
                if place is None:
                    break
        return found

    def find(self, host: str, path: str) -> Rule | None:
        node, found = self.root, None
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            if None in node:
                found = self._in_path(node[None], path) or found
            label = next(labels, None)
            node = node.get(label) if label is not None else None
        return found


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url",
    default: str = "allow", most_rules: int = 1_000_000,
) -> DataFrame:
    """Per row: key, host, path, rule and verdict.

    A url that no rule fits, a null url and one without `://` get the default verdict and a
    null rule. Of two rules with the same host and path, block wins. Rows are kept one to one, so
    repeated rows stay repeated; a null key stays null; an empty table gives an empty table.
    """
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules; the broadcast trie holds at most {most_rules}")
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(RuleTrie(rules))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        find = lru_cache(maxsize=100_000)(trie.find)
        for batch in batches:
            parts = [split_url(x) for x in batch.column(1).to_pylist()]
            found = [find(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                pa.array([r.text if r else None for r in found], pa.string()),
                pa.array([r.verdict if r else default for r in found], pa.string()),
            ], names=[key, "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(key), F.col(url).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
