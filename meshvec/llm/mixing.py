"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import free_name, hash_unit


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """The first count k0 with a noticeable probability, and P(X <= k) for k = k0, k0+1, ... up to 1 - 2^-53.

    The table has about 16 * sqrt(rate) + 20 entries.
    """
    if rate <= 0:
        return 0, []
    spread = 9 * math.sqrt(rate) + 9
    k0 = max(0, int(rate - spread))
    total, table = 0.0, []
    for k in range(k0, int(rate + 2 * spread) + 20):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        table.append(total)
        if k > rate and total >= 1 - 2.0**-50:
            break
    return k0, table


def replication_rates(sizes: Mapping[str | None, int], weights: Mapping[str, float], other: float, epochs: float) -> dict[str | None, float]:
    """Mean repetitions by class. None stands for all sources that weights does not name.

    Weights of classes without text are left out and the rest are scaled up.
    """
    wanted = {c: (other if c is None else weights[c]) for c, n in sizes.items() if n > 0}
    total, mass = sum(sizes.values()), sum(wanted.values())
    return {c: epochs * total * (w / mass) / sizes[c] if mass > 0 else 0.0 for c, w in wanted.items()}


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    *,
    other: float,
    epochs: float = 1.0,
    seed: int = 17,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    copy_col: str = "copy",
    order_col: str = "shuffle_key",
) -> DataFrame:
    """Repeat every document so that sources reach their weights of the characters, in one global random order.

    A document of a class with mean rate r gets Poisson(r) copies: its own
    uniform number, an md5 hash of seed and id, is looked up in the
    distribution of r. The classes are the sources that `weights` names and one
    class of all others (null sources included) with weight `other`, so the
    rates are at most len(weights) + 1 numbers whatever the corpus holds; they
    enter the plan as literals and nothing is joined. The copies are dealt by a
    hash of (seed, id, copy) and sorted by it inside each partition: output
    files are random samples in random order, and a hot source is spread like
    any other. So are the rows of an id that comes very often, by their place
    in the input.

    Defined cases: a null text has length 0 and is drawn like others; a null id
    draws by its text; repeated rows draw the same count, each on its own; a
    class without characters is never drawn if all its texts are empty;
    an empty table gives an empty result. All columns of docs come back, then
    copy (from 0) and the hex key of the order; if docs has columns of those
    names, the new ones get leading underscores.
    """
    names = sorted(weights)
    label = F.when(F.col(source_col).isin(names), F.col(source_col)) if names else F.lit(None).cast("string")
    sized = docs.select(label.alias("c"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"))
    sizes = {r["c"]: r["n"] for r in sized.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # len(weights) + 1 rows at most
    rates = replication_rates(sizes, weights, other, epochs)

    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    u = hash_unit(seed, ident)
    count: Column = F.lit(0)
    for c, rate in rates.items():
        k0, table = poisson_table(rate)
        if not table:
            continue
        drawn = F.size(F.filter(F.array(*[F.lit(x) for x in table]), lambda x: x <= u)) + F.lit(k0)
        mine = ~F.col(source_col).isin(names) | F.col(source_col).isNull() if c is None and names else F.lit(True) if c is None else F.col(source_col) == c
        count = F.when(mine, drawn).otherwise(count)
    n_col, deal_col, copy_col = free_name(docs, "__n"), free_name(docs, "__deal"), free_name(docs, copy_col)
    order_col = free_name(docs, order_col)
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col(copy_col).cast("string")))
    return (
        docs.withColumn(n_col, count)
        .filter(F.col(n_col) > 0)
        .withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(n_col) - 1)))
        .drop(n_col)
        .withColumn(order_col, key)
        .withColumn(deal_col, F.xxhash64(order_col, F.monotonically_increasing_id()))
        .repartition(deal_col)
        .drop(deal_col)
        .sortWithinPartitions(order_col)
    )
