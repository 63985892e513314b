"""Insert-or-ignore under several unique keys: requests are taken in order, each if no key of it is stored or was taken before.

A refused request frees nothing and blocks nothing, so whether one is taken can
hang on a chain of earlier ones. It is settled in rounds. A request that comes
first at all of its keys among those that are open is taken; open requests that
share a key with it are refused; the others stay open. Each round takes at least
the first request of every group of requests that hang together. A chain of n
requests, each of which shares a key with the next alone, needs n / 2 rounds.

Before the rounds, keys that one open request alone has count no more, and of
requests that agree in the keys that are left only the first stays open: it is
taken, or what refuses it refuses them all. So a key that very many requests
share, each with other keys of its own, is one request. The rest is aggregates
and anti-joins whose frequent keys are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import met, written


def _by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key of a request that isn't null: which one, its value, and place and number of keys of the request."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys])
    live = F.filter(each, lambda x: x["value"].isNotNull())
    return rows.select("place", F.size(live).alias("n_keys"), F.explode(live).alias("k")).select("place", "n_keys", "k.kind", "k.value")


def taken(requests: DataFrame, stored: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """requests with `taken`. order: the column that they come in order of, those of one place, or all without it, as they lie in the input.

    A null key is no key, as in a unique index. stored has the columns in keys.
    """
    rows = written(requests.withColumn("no", F.monotonically_increasing_id()))
    text = [F.col(k).cast("string").alias(k) for k in keys]
    none = F.coalesce(*[F.col(k) for k in keys]).isNull()
    asked = rows.select(*text, F.struct(*[F.col(c) for c in (order, "no") if c]).alias("place"))
    free = asked.where(none).select("place")
    # of requests with the same keys the first alone can be taken, unless they have none
    first = written(asked.where(~none).groupBy(*keys).agg(F.min("place").alias("place")))
    total = first.count()
    in_store = _by_key(stored.select(*text, F.lit(0).alias("place")), keys).select("kind", "value").distinct().withColumn("known", F.lit(True))
    seen = _by_key(first, keys).groupBy("kind", "value").agg(F.count("*").alias("seen"))
    facts = written(seen.join(in_store, ["kind", "value"], "left").where("seen > 1 or known"))
    open_ = first
    for k in keys:
        of = facts.where(F.col("kind") == k).select(F.col("value").alias(k), "seen", F.coalesce("known", F.lit(False)).alias(f"known_{k}"))
        open_ = met(open_, of, [k], total)
    refused = F.lit(False)
    for k in keys:
        refused = refused | F.coalesce(f"known_{k}", F.lit(False))
    # a key without facts is the request's own
    open_ = open_.where(~refused).select("place", *[F.when(F.col(f"known_{k}").isNotNull(), F.col(k)).alias(k) for k in keys])
    open_ = written(open_)
    yes = free.union(open_.where(none).select("place"))
    open_ = written(open_.where(~none).groupBy(*keys).agg(F.min("place").alias("place")))
    while not open_.isEmpty():
        leads = _by_key(open_, keys).groupBy("kind", "value").agg(F.min(F.struct("place", "n_keys")).alias("first"))
        won = written(open_.join(leads.groupBy("first").agg(F.count("*").alias("n")).where("n = first.n_keys").select("first.place"), "place", "left_semi"))
        yes = yes.union(won.select("place"))
        # no two of them share a key; rows of a frequent one are split by the skew join
        for k in keys:
            open_ = open_.join(won.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        open_ = written(open_)
    marks = yes.select(F.col("place.no").alias("no"), F.lit(True).alias("yes"))
    return rows.join(marks, "no", "left").select(*requests.columns, F.col("yes").isNotNull().alias("taken"))
