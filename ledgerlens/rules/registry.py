"""Rules by name, registered by decorator and evaluated together.

A row rule says with one Column expression whether a row gives a finding: a finding struct, or null. All row rules of
a table become one array, which is exploded, so that they cost one scan of the table together. A rule
that also needs to know of other rows names the facts it needs. Its expression then gives a candidate from the row
alone, and ``settle`` decides on it from the facts. Facts declare one key: rows are shuffled by it once, with the
candidates, the findings so far and the few columns that facts and rules carry, never with texts. Where rows are
evaluated apart, only what waits for facts is shuffled; all else comes from a scan of its own.

A table rule is a function of the inputs it names (any tables and thresholds) to findings; a rule that reads
``findings`` runs after all others.

    @RULES.row_rule("large_round_value")
    def large_round_value(t):
        return on_contract("large_round_value", F.col("eur") % 1000 == 0, F.lit("info"), F.lit("A round value"))
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..schemas import FLAGS, SOURCE
from ..storage import dealt, materialize
from .provenance import kinds_only

#: Bytes by Spark's estimate of rows with their candidates that one task sorts. The estimate follows the compressed files and
#: knows no lists: over the orders, 3 MB of it were 3.9 GB in the tasks' memory.
TASK_BYTES = 512 << 10
#: The same where sources don't travel: 40 MB of it were 1.6 GB in a task's memory.
BARE_TASK_BYTES = 4 << 20


@dataclass(frozen=True)
class Facts:
    """What rows learn of the other rows of their key: columns that travel, and a function that adds the facts to rows that lie together by ``key``."""

    key: str
    columns: Callable[[Thresholds], dict[str, Column]]
    add: Callable[[DataFrame, Thresholds], DataFrame]


@dataclass(frozen=True)
class RowRule:
    """Callable on (rows, thresholds), for this rule alone. at_once: where a rule with facts settles on its candidate whatever they are; never null."""

    name: str
    build: Callable[[Thresholds], Column]
    facts: Facts | None = None
    settle: Callable[[Column, Thresholds], Column] | None = None
    carries: Callable[[Thresholds], dict[str, Column]] = lambda t: {}
    at_once: Callable[[Thresholds], Column] | None = None

    def __call__(self, rows: DataFrame, t: Thresholds) -> DataFrame:
        return evaluate(rows, [self], t)


@dataclass(frozen=True)
class TableRule:
    names: tuple[str, ...]
    reads: tuple[str, ...]
    run: Callable[..., DataFrame]

    def __call__(self, *args: Any, **named: Any) -> DataFrame:
        return self.run(*args, **named)


def evaluate(rows: DataFrame, rules: Iterable[RowRule], t: Thresholds, *, apart: bool = False, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """The findings of row rules over one table: one scan, and one shuffle for each kind of facts that they need.

    apart: one scan more, so that findings which need no facts are not shuffled; for tables of any size. of: the struct that is
    asked of a finding, of its sources the kinds at most; what it leaves out is neither made nor moved.
    """
    rules = list(rules)
    kinds = list(dict.fromkeys(r.facts.key for r in rules if r.facts))
    if len(kinds) > 1:  # the findings without facts come with the first kind
        parts = [evaluate(rows, [r for r in rules if (r.facts and r.facts.key == k) or (r.facts is None and k == kinds[0])], t, apart=apart, of=of) for k in kinds]
        return reduce(DataFrame.unionByName, parts)
    later, cites = [r for r in rules if r.facts], of is None
    with kinds_only(not cites):
        found = [r.build(t) for r in rules if r.facts is None]
        candidates = [r.build(t) for r in later]
        settled = [r.settle(_struct(k, cites), t) for k, r in enumerate(later)]
    if not later:
        return _exploded(rows, found, of)
    first = []
    if apart:
        at_once = [r.at_once and r.at_once(t) for r in later]
        found += [F.when(where, c) for where, c in zip(at_once, candidates, strict=True) if where is not None]
        candidates = [c if where is None else F.when(~where, c) for where, c in zip(at_once, candidates, strict=True)]
        first, found = [_exploded(rows, found, of)] if found else [], []
    facts = later[0].facts
    carried = reduce(dict.__or__, (r.carries(t) for r in later), {}) | facts.columns(t)
    light = rows.select(*(c.alias(n) for n, c in carried.items()), *(x for k, c in enumerate(candidates) for x in _flat(c, k, cites)), *(f.alias(f"__found_{k}") for k, f in enumerate(found)))
    known = facts.add(dealt(light, facts.key, TASK_BYTES if cites else BARE_TASK_BYTES), t)
    return reduce(DataFrame.unionByName, [*first, _exploded(known, [*(F.col(f"__found_{k}") for k in range(len(found))), *settled], of)])


def _flat(candidate: Column, k: int, cites: bool) -> list[Column]:
    """What travels of a candidate: all of it, or columns with the kinds of its sources, of which those that nobody asks for are left out."""
    if cites:
        return [candidate.alias(f"__candidate_{k}")]
    parts = {n: candidate[n] for n in FLAGS.fieldNames()} | {"sources": candidate["sources"]["kind"]}
    return [candidate.isNotNull().alias(f"__is_{k}"), *(c.alias(f"__{n}_{k}") for n, c in parts.items())]


def _struct(k: int, cites: bool) -> Column:
    """A candidate after its travel."""
    if cites:
        return F.col(f"__candidate_{k}")
    parts = {n: F.col(f"__{n}_{k}") for n in FLAGS.fieldNames()}
    parts["sources"] = F.transform(parts["sources"], lambda kind: F.from_json(F.lit("{}"), SOURCE).withField("kind", kind))
    return F.when(F.col(f"__is_{k}"), F.struct(*(c.alias(n) for n, c in parts.items())))


def _exploded(rows: DataFrame, found: list[Column], of: Callable[[Column], Column] | None) -> DataFrame:
    """One row for each finding. A plain array of findings and nulls is compiled, which F.array_compact would not be, and in a projection
    of its own, since what stands inside an explode is interpreted. It is never empty; explode_outer only keeps Spark from testing that by making it twice.
    """
    if of is None:
        return rows.select(F.array(*found).alias("fs")).select(F.explode_outer("fs").alias("f")).where("f IS NOT NULL").select("f.*")
    # no struct is null here: conditions then stand outside of any branch, where Spark computes what several parts share once
    asked = F.array(*(F.struct(f["rule"].isNotNull().alias("is"), of(f).alias("of")) for f in found))
    return rows.select(asked.alias("fs")).select(F.explode_outer("fs").alias("f")).where("f.is").select("f.of.*")


@dataclass
class Registry:
    row_rules: dict[str, RowRule] = field(default_factory=dict)
    table_rules: list[TableRule] = field(default_factory=list)

    def row_rule(self, name: str, *, facts: Facts | None = None, settle=None, carries=lambda t: {}, at_once=None):
        """Register an expression of the thresholds as a rule on contracts."""

        def register(build: Callable[[Thresholds], Column]) -> RowRule:
            if name in self.row_rules:
                raise ValueError(f"there is a rule {name} already")
            if (facts is None) != (settle is None):
                raise ValueError("a rule on facts has both facts and settle")
            self.row_rules[name] = RowRule(name, build, facts, settle, carries, at_once)
            return self.row_rules[name]

        return register

    def table_rule(self, *names: str, reads: tuple[str, ...]):
        """Register a function of the inputs named by reads; it may give findings of several names."""

        def register(run: Callable[..., DataFrame]) -> TableRule:
            rule = TableRule(names, reads, run)
            self.table_rules.append(rule)
            return rule

        return register

    def names(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.row_rules, *(n for r in self.table_rules for n in r.names)]))

    def run(self, inputs: dict[str, Any], t: Thresholds, only: Iterable[str] | None = None, apart: bool = False) -> DataFrame:
        """The findings of all rules, or of those named, over inputs (``contracts``: the row rules' table; apart: as ``evaluate`` takes it)."""
        wanted = set(self.names() if only is None else only)
        rows = [r for n, r in self.row_rules.items() if n in wanted]
        tables = [r for r in self.table_rules if wanted & set(r.names)]
        parts = [evaluate(inputs["contracts"], rows, t, apart=apart)] if rows else []
        parts += [r.run(*(inputs[k] for k in r.reads), t) for r in tables if "findings" not in r.reads]
        flags = materialize(reduce(DataFrame.unionByName, parts), "findings")  # read again by the rules on findings
        after = [r.run(*((inputs | {"findings": flags})[k] for k in r.reads), t) for r in tables if "findings" in r.reads]
        return reduce(DataFrame.unionByName, after, flags).where(F.col("rule").isin(*wanted))


#: The rules of this package; modules that define rules register them here.
RULES = Registry()
