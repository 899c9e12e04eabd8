"""URL filters: a trie over reversed host labels, then path segments.

Each rule blocks or allows a host, its subdomains and the paths that start with the rule's
path.  Walking a host's labels from the right and then the path's segments meets every rule
that fits; the one deepest in the host, then longest in the path, decides, so an allow entry
may open part of a blocked site.  Rules come as a list from the driver and are at most
`MOST_RULES`, so the trie they make may be broadcast.

A null URL, or one without `://`, has an empty host and path, fits no rule and gets the
default verdict.  Rows are judged one by one: repeated rows repeat, an empty table stays
empty, extra columns are ignored.  Equal rules with different verdicts are refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules the broadcast trie takes.
MOST_RULES = 1_000_000
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: A node: `below` by label or by whole segment, `paths` the root of a host's paths, and
#: `ends` the (path length, name, verdict) of rules by their unfinished last segment.
Node = dict


def _node() -> Node:
    return {"below": {}, "paths": None, "ends": {}}


def trie(rules: Sequence[Rule]) -> Node:
    """The trie of the rules, of plain values; a segment counts as whole once a `/` ends it."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MOST_RULES}")
    root = _node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node["below"].setdefault(label, _node())
        node["paths"] = node["paths"] or _node()
        node = node["paths"]
        *segments, rest = rule.path.split("/")
        for segment in segments:
            node = node["below"].setdefault(segment, _node())
        end = (len(rule.path), rule.name, rule.verdict)
        if node["ends"].setdefault(rest, end) != end:
            raise ValueError(f"two verdicts for {rule.name}")
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    lowered = host.lower() if host.isascii() else "".join(c.lower() if c.isascii() else c for c in host)
    return lowered, slash + path


def _longest_path(node: Node, path: str) -> tuple[int, str, str] | None:
    found = None
    for segment in path.split("/"):
        fits = [end for rest, end in node["ends"].items() if segment.startswith(rest)]
        found = max(fits, default=found)
        if segment not in node["below"]:
            break
        node = node["below"][segment]
    return found


def deciding(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """Name and verdict of the rule deepest in the host, then longest in the path, that fits."""
    node, found = root, None
    for label in reversed(host.split(".")):
        if label not in node["below"]:
            break
        node = node["below"][label]
        if node["paths"] is not None:
            found = _longest_path(node["paths"], path) or found
    return found and found[1:]


def judged(pages: DataFrame, rules: Sequence[Rule], default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of `pages`."""
    shared = pages.sparkSession.sparkContext.broadcast(trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def verdicts(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        root = shared.value
        for batch in urls:
            rows = []
            for url in batch:
                host, path = split_url(url)
                rows.append((host, path, *(deciding(root, host, path) or (None, default))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    plain = pages.select("page_id", "url")
    return plain.withColumn("_v", verdicts("url")).select("page_id", "url", "_v.*")
