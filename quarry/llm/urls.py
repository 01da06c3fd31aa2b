"""URL filters as a sort-merge range join.

A host is keyed by its labels in reverse ("com, example, www"), so that a rule's host and all its
subdomains form one interval of keys, and intervals of rules are nested or disjoint. Urls are
range-partitioned and sorted by key; a sweep over each partition merges them with the sorted rules
and keeps a stack of the rules whose interval is open. A url is judged by the longest rule on the
stack whose path its own path starts with.

Rules come in blocks of bounded size; with more than one block the longest of their answers wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_az, map_arrow, materialize

SEPARATOR = "\x01"
#: Rules in a broadcast block.
BLOCK_RULES = 200_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def key_of(host: str) -> str:
    """Reversed labels, each followed by the separator: a host's key is a prefix of its subdomains' keys."""
    return SEPARATOR.join(reversed(host.split("."))) + SEPARATOR


def split_url(url):
    """(host, path) columns of a url column; both empty where it is null or has no ``://``."""
    after = url.substr(F.instr(url, "://") + F.lit(3), F.length(url))
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    raw = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, lower_az(raw)).otherwise(""), F.when(found, path).otherwise("")


def sweep(rows: Iterator[tuple[str, str, str]], rules: list[tuple[str, Rule]]) -> Iterator[Rule | None]:
    """The winning rule for each (key, host, path), keys in ascending order; rules sorted by key.

    The longest rule (host and path together) wins; of equally long ones the longer host, then allow.
    """
    stack: list[tuple[str, list[Rule]]] = []  # open intervals, outermost first; the rules of one host together
    at = 0
    last: tuple[str, str, str] | None = None
    won: Rule | None = None
    for row in rows:
        if row == last:
            yield won
            continue
        key, host, path = last = row
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        while at < len(rules) and rules[at][0] <= key:
            opened, rule = rules[at]
            at += 1
            if not key.startswith(opened):
                continue  # its interval ended before this key
            if stack and stack[-1][0] == opened:
                stack[-1][1].append(rule)
            else:
                stack.append((opened, [rule]))
        won, best = None, None
        for _, level in stack:
            for rule in level:
                if path.startswith(rule.path) and (host == rule.host or host.endswith("." + rule.host)):
                    rank = (len(rule.host) + len(rule.path), len(rule.host), rule.verdict == "allow")
                    if best is None or rank > best:
                        won, best = rule, rank
        yield won


def _pass(sorted_urls: DataFrame, rules: list[Rule]) -> DataFrame:
    held = sorted_urls.sparkSession.sparkContext.broadcast(sorted((key_of(r.host), r) for r in rules))
    fields = {f.name: f.dataType.simpleString() for f in sorted_urls.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rules = [(k, Rule(*r)) for k, r in held.value]
        kept: list[pa.RecordBatch] = []

        def rows():
            for batch in batches:
                if not batch.num_rows:
                    continue
                kept.append(batch)
                yield from zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)

        out: list[Rule | None] = []
        for rule in sweep(rows(), held_rules):
            out.append(rule)
            if len(out) == kept[0].num_rows:
                yield _answer(kept.pop(0), out)
                out = []

    return map_arrow(sorted_urls, run, f"page_id {fields['page_id']}, host string, path string, rule string, rule_verdict string, rank long")


def _answer(batch: pa.RecordBatch, won: list[Rule | None]) -> pa.RecordBatch:
    columns = [
        batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([r and r.host + r.path for r in won], pa.string()), pa.array([r and r.verdict for r in won], pa.string()),
        pa.array([0 if r is None else 1 + 2 * ((len(r.host) + len(r.path) << 31) + len(r.host)) + (r.verdict == "allow") for r in won], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "rule_verdict", "rank"])


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", block_rules: int = BLOCK_RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path, which no rule fits (a rule needs
    a host). Where no rule fits, rule is null and verdict is default. Equal urls, a host that holds
    a third of all rows included, are dealt over partitions by id as well. Rows with repeated or null
    ids are judged each. Without rules all urls get the default; without pages there is no row.
    """
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), SEPARATOR), F.lit(SEPARATOR)))
    tied = urls.withColumn("tie", F.xxhash64("page_id", "path"))
    dealt = tied.repartitionByRange("key", "tie").sortWithinPartitions("key", "path").drop("tie")
    rules = [r for r in dict.fromkeys(rules) if r.host]
    blocks = [rules[i : i + block_rules] for i in range(0, len(rules), block_rules)] or [[]]
    if len(blocks) == 1:
        best = _pass(dealt, blocks[0])
    else:
        dealt = materialize(dealt.withColumn("row", F.monotonically_increasing_id()), "urls")
        answers = [_pass(dealt.select(F.struct("row", "page_id").alias("page_id"), "host", "path", "key").sortWithinPartitions("key", "path"), b) for b in blocks]
        union = answers[0]
        for frame in answers[1:]:
            union = union.unionByName(frame)
        best = union.groupBy("page_id").agg(F.max_by(F.struct("host", "path", "rule", "rule_verdict"), "rank").alias("b")).select("page_id.page_id", "b.*")
    return best.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
