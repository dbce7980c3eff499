"""Recursion: semi-naive rounds until nothing new is found, and doubled steps where each place has one next place, or one before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Rounds


def closure(start: DataFrame, grow: Callable[[DataFrame], DataFrame], most: int = 1_000_000) -> DataFrame:
    """The least set that holds start and, with any rows, what grow makes of them. Each round sees only the rows that the last one added."""
    rounds = Rounds(start.sparkSession)
    names = ["r0"]
    delta = rounds.keep(start.distinct(), "r0")
    for k in range(1, most):
        known = rounds.read(delta, *names)
        new = grow(delta).distinct().subtract(known)
        new = rounds.keep(new.select(*delta.columns), f"r{k}")
        if new.isEmpty():
            return known
        names.append(f"r{k}")
        delta = new
    raise RuntimeError("the recursion did not end")


def single(step: DataFrame, froms: list[str], tos: list[str]) -> bool:
    """Whether no place has two next ones, or none has two before it. Then walks of any length have at most as many ends as there are steps."""
    return any(step.groupBy(*side).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty() for side in (froms, tos))


def walks(rounds: Rounds, name: str, start: DataFrame, step: DataFrame, places: dict[str, tuple[str, str]], own: bool) -> DataFrame:
    """start and all rows that come of it by steps: each row with other places instead of those that it has. places: a column of start, the columns of step where its value and the next one stand.
    start and step are distinct and kept already, step is single(), own tells that start holds the steps themselves.

    Walks of all lengths below 2^k and steps of length 2^k give walks of all lengths below 2^(k+1): a walk of n steps takes log2(n) rounds, and each of them reads at most twice what the one before it did.
    Steps that own all walks and never come to their own start lead from each place to another one in one way only, so that no row is found twice."""
    froms, tos = [f for f, _ in places.values()], [t for _, t in places.values()]

    def doubled(k: int, a: DataFrame) -> DataFrame:
        b = a.toDF(*[f"to_{c}" for c in a.columns])
        new = a.join(b, [a[t] == b[f"to_{f}"] for f, t in places.values()]).select(*froms, *[b[f"to_{t}"].alias(t) for t in tos])
        return rounds.keep(new, f"{name}_steps_{k}")

    powers, sizes = [step.select(*froms, *tos)], [step.count()] if own else []
    while own and sizes[-1] and sizes[-2:-1] != sizes[-1:]:  # as many walks of twice the length: they go on for ever
        powers.append(doubled(len(powers), powers[-1]))
        sizes.append(powers[-1].count())
    once = own and not sizes[-1]
    names = [name]
    for k in range(1, 1_000_000):
        known = rounds.read(start, *names)
        if len(powers) < k:
            powers.append(doubled(k - 1, powers[-1]))
        by = powers[k - 1]
        if by.isEmpty():
            return known
        new = known.join(by, [known[c] == by[f] for c, (f, _) in places.items()]).select(*[by[places[c][1]].alias(c) if c in places else known[c] for c in known.columns])
        if not once:
            new = unseen(new.distinct(), known)
        new = rounds.keep(new, f"{name}_{k}")
        if new.isEmpty():
            return known
        names.append(f"{name}_{k}")
    raise RuntimeError("the recursion did not end")


def unseen(new: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that are not known yet; nulls are equal."""
    return new.join(known.alias("known"), [new[c].eqNullSafe(F.col(f"known.{c}")) for c in new.columns], "left_anti")
