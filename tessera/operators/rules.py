"""Pattern-action rules: each is a condition and what a row that meets it puts out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.strings import matches


@dataclass(frozen=True)
class Rule:
    """Where ``when`` holds (always, if it is None), put out ``emit``; ``stop`` leaves the later rules out for that row."""

    when: Column | None = None
    emit: Column | None = None
    stop: bool = False


def apply_rules(df: DataFrame, rules: list[Rule], keep: list[str], name: str = "out") -> DataFrame:
    """A row for each rule that a row meets, in the rules' order: ``keep``, ``rule`` (from 0) and what it puts out.

    All rules are tested in one pass; the outputs need a common type.
    """
    alive, outputs = F.lit(True), []
    for i, rule in enumerate(rules):
        met = alive if rule.when is None else alive & F.coalesce(rule.when, F.lit(False))
        if rule.emit is not None:
            outputs.append(F.when(met, F.struct(F.lit(i).alias("rule"), rule.emit.alias(name))))
        if rule.stop:
            alive = alive & ~met
    one = F.explode(F.array_compact(F.array(*outputs))).alias("_o")
    return df.select(*keep, one).select(*keep, "_o.rule", f"_o.{name}")


def switch(value: Column, cases: list[tuple[object, Column]], default: Column | None = None) -> Column:
    """The result of the first case that the value meets; a case may be a list of values that fall through to one result.

    A label is a value, or ``Like`` a pattern that is found in the value.
    """
    out = None
    for case, result in cases:
        test = _meets(value, case)
        out = F.when(test, result) if out is None else out.when(test, result)
    if out is None:
        raise ValueError("a switch needs a case")
    return out if default is None else out.otherwise(default)


@dataclass(frozen=True)
class Like:
    """A label of a switch that is a pattern."""

    pattern: str


def _meets(value: Column, label: object) -> Column:
    if isinstance(label, list | tuple):
        tests = [_meets(value, x) for x in label]
        return reduce(or_, tests)
    if isinstance(label, Like):
        return matches(value.cast("string"), label.pattern)
    return F.coalesce(value == label, F.lit(False))


def switch_bodies(value: Column, cases: list[tuple[object, Column, bool]], default: int | None = None) -> Column:
    """Array of what the bodies put out that run: from the first case that is met, on to one that ends with a break.

    A case is (label, what its body puts out, whether it breaks). ``default`` is the number of the case that
    runs where no label is met; its own label counts too, unless it is None.
    """
    if not cases:
        raise ValueError("a switch needs a case")

    def run(first: int) -> Column:
        last = next((i for i in range(first, len(cases)) if cases[i][2]), len(cases) - 1)
        return F.array(*[cases[i][1] for i in range(first, last + 1)])

    chain = None
    for i, (label, _, _) in enumerate(cases):
        if label is None:
            continue
        test = _meets(value, label)
        chain = F.when(test, run(i)) if chain is None else chain.when(test, run(i))
    none = F.slice(run(0), 1, 0) if default is None else run(default)
    return none if chain is None else chain.otherwise(none)
