"""Secret scan: all rules as one deterministic byte automaton.

The rules' regexes are compiled by ordered subset construction, combined into one
minimal transition table and run over a text's UTF-8 bytes in a single pass that
finds where matches end; an automaton read backwards finds where each began.
Matches of one rule are leftmost and don't overlap; those that fail the rule's
length are dropped after that. Spans are in code points, end exclusive.

Defined results: null and empty texts have no spans; very long texts are scanned
whole; repeated rows are scanned each; an empty table gives no rows; other
columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import combine, compile_reverse, compile_rule, start_of
from .common import as_bytes, binary_values, fresh, tidy


@dataclass(frozen=True)
class Rule:
    """min_group: how many bytes the last group of a match has at least."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_group: int = 0


#: The base rules in their order, then the ones added here.
#: hex counts inside the automaton, as its runs are met in most words; the others
#: are rare, and measuring them afterwards keeps the combined automaton small.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True,
        min_group=6,
    ),
    Rule("access", r"AKIA([A-Z0-9]+)", min_group=16),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[oprsu]_([A-Za-z0-9]+)", min_group=36),
)
RULES = BASE_RULES + ADDED_RULES


class Scanner:
    """Rules compiled; scan() gives (rule, start, end) in bytes by start, then rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = combine([compile_rule(r.pattern, r.ignore_case) for r in rules])
        self.back = [compile_reverse(r.pattern, r.ignore_case) for r in rules]
        flags = {True: re.IGNORECASE | re.DOTALL, False: re.DOTALL}
        self.check = [re.compile(r.pattern.encode(), flags[r.ignore_case]) if r.min_group else None for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        found = []
        past = [0] * len(self.rules)
        for rule, end in self.all.ends(data):
            start = start_of(self.back[rule], data, end, past[rule])
            past[rule] = end
            check = self.check[rule]
            if check is not None:
                match = check.fullmatch(data, start, end)
                if match is None or len(match[match.re.groups]) < self.rules[rule].min_group:
                    continue
            found.append((start, rule, end))
        found.sort()
        return [(rule, start, end) for start, rule, end in found]

    def redacted(self, data: bytes) -> str:
        """The text with every span replaced by its kind; what overlaps goes with the first."""
        found = self.scan(data)
        if not found:
            return data.decode("utf-8", "replace")
        kept, at = [], 0
        for rule, start, end in found:
            if start >= at:
                kept += [data[at:start], f"[{self.rules[rule].kind}]".encode()]
            at = max(at, end)
        return b"".join([*kept, data[at:]]).decode("utf-8", "replace")

    def spans(self, data: bytes) -> list[dict]:
        """kind, start, end in code points."""
        found = self.scan(data)
        if not found:
            return []
        at = {0: 0}
        last = 0
        for place in sorted({p for _, start, end in found for p in (start, end)}):
            at[place] = at[last] + sum((b & 0xC0) != 0x80 for b in data[last:place])
            last = place
        return [{"kind": self.rules[rule].kind, "start": at[start], "end": at[end]} for rule, start, end in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with one more column: the secrets' spans, by start, then rule order."""
    scanner(tuple(rules))  # a faulty rule fails here, not on the executors
    own = tuple(rules)

    @F.arrow_udf(_SPANS)
    @tidy
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = scanner(own)
        for texts in batches:
            yield pa.array([machine.spans(value) for value in binary_values(texts)], _SPANS_ARROW)

    return docs.withColumn(spans, scan.asNondeterministic()(as_bytes(text)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def redact(docs: DataFrame, text: str = "text", length: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by [kind]; overlapping spans become one.

    length: a column that gets the new number of characters of texts that changed.
    Each text is scanned and cut on its own, so that a task holds one batch of texts and
    one text's spans. Null texts stay null; rows without secrets stay as they are.
    """
    scanner(tuple(rules))  # a faulty rule fails here, not on the executors
    own = tuple(rules)

    @F.arrow_udf("string")
    @tidy
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = scanner(own)
        for texts in batches:
            yield pa.array((None if value is None else machine.redacted(value) for value in (v.as_py() for v in texts)), pa.string())

    new = fresh(docs, "redacted")
    rows = docs.withColumn(new, cut.asNondeterministic()(F.col(f"`{text}`").cast("string").cast("binary")))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {text: F.col(new)}
    if length is not None and length in columns:
        kind = docs.schema[length].dataType
        columns[length] = F.when(F.col(new).eqNullSafe(F.col(f"`{text}`").cast("string")), columns[length]).otherwise(F.length(new).cast(kind))
    return rows.select(*[value.alias(c) for c, value in columns.items()])
