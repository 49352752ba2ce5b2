"""Ordered folds per key: every row is judged by what the rows before it have made of its key's state.

The rows are dealt out by range of key and order, so that a key with very many rows is cut into blocks of about `block_rows`
in order, and blocks are folded at once.  A block begins without knowing what its first key's earlier rows have made, so it
is folded from no state first; then the states at the ends of blocks are handed on, and only blocks that were given another
state than they had begun with are folded again, as far as their first key goes.  That repeats until no block is given
anything new.  Folds that soon forget where they began (a guarded figure, open incidents of a few hours) are done after two
or three rounds; at worst a round settles one more block of a key.

`step(state, row)` gives (new state, result): states are JSON values, None before the first row; row and result are dicts.
It must be a function of its arguments alone.  A task holds one state and a batch of rows.

Defined results: rows with equal keys and order come in the order of a hash of all their columns; a null key is a key like
others, nulls in the order come first; repeated rows are folded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.lineage import cut

Step = Callable[[object, dict], tuple[object, dict]]


def _folder(step: Step, keys: list[str], kept: list[str], out: pa.Schema):
    """Folds rows (keys, ..., _block, _given) that come in order; the last row of a block carries the state it ends with."""

    def run(batches):
        block, key, state, waiting = None, None, None, None
        for batch in batches:
            rows, ends = batch.to_pylist(), []
            results = []
            for n, row in enumerate(rows):
                own = [row[k] for k in keys]
                if row["_block"] != block or own != key:
                    if block is not None and row["_block"] != block:
                        ends.append((n - 1, json.dumps(state, sort_keys=True)))
                    state, key, block = json.loads(row["_given"]) if row["_given"] is not None else None, own, row["_block"]
                state, result = step(state, row)
                results.append(result)
            if waiting is not None and rows:
                # Of the batch before only the last row may still wait for its state.
                before = [s for n, s in ends if n < 0]
                yield _with_states(*waiting, [(waiting[0].num_rows - 1, s) for s in before])
            if rows:
                ends = [(n, s) for n, s in ends if n >= 0]
                made = pa.RecordBatch.from_pylist(results, schema=out)
                waiting = (pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.columns], names=[*kept, *out.names]), ends)
        if waiting is not None:
            yield _with_states(*waiting, [(waiting[0].num_rows - 1, json.dumps(state, sort_keys=True))])

    return run


def _with_states(batch: pa.RecordBatch, ends: list, more: list) -> pa.RecordBatch:
    states: list = [None] * batch.num_rows
    for n, s in [*ends, *more]:
        states[n] = s
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], names=[*batch.schema.names, "_state"])


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], step: Step, out: str, *, initial: DataFrame | None = None, block_rows: int = 100_000) -> DataFrame:
    """rows with the columns of `out` (a schema) that step gives for each, and _state: a key's state after a row, as JSON,
    on its last row (and perhaps on some before).

    initial: (keys, _state) of states that keys begin with, one row a key at most."""
    spark = rows.sparkSession
    more = T._parse_datatype_string(out)
    names = [c for c in rows.columns if c not in more.names and c != "_state"]
    rows = rows.select(*(F.col(f"`{c}`") for c in names))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)] + [F.xxhash64(*(F.col(f"`{c}`") for c in names)).asc()]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // block_rows))
    # A block's first row, in which the number within the partition (the lower 33 bits) is 0, carries what the block is given.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    dealt = cut(rows.repartitionByRange(blocks, *by).sortWithinPartitions(*by).withColumns({"_block": F.spark_partition_id(), "_opens": first}))
    own = F.struct(*(F.col(k) for k in keys))
    ends = dealt.groupBy("_block").agg(F.min(own).alias("_first"), F.max(own).alias("_last"))  # a row a block
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [*names, "_block"]
    kind = T.StructType([*(f for f in dealt.schema if f.name in kept), *more, T.StructField("_state", T.StringType())])

    def folded(some: DataFrame) -> DataFrame:
        return cut(some.mapInArrow(_folder(step, keys, kept, to_arrow_schema(more)), kind))

    if initial is None:
        given = dealt.withColumn("_given", F.lit(None).cast("string"))
    else:
        known = initial.select(F.struct(*(F.col(k) for k in keys)).alias("_own"), F.col("_state").alias("_given"))
        given = dealt.join(known, own.eqNullSafe(F.col("_own")), "left").drop("_own").repartition(blocks, "_block").sortWithinPartitions("_block", *by)
        ends = ends.join(known, F.col("_first").eqNullSafe(F.col("_own")), "left").withColumnRenamed("_given", "_begin").drop("_own")
    if initial is None:
        ends = ends.withColumn("_begin", F.lit(None).cast("string"))
    done = [folded(given)]
    state = cut(ends.join(done[0].filter("_state is not null").select("_block", "_state"), "_block").withColumn("_with", F.col("_begin")))
    again: list[DataFrame] = []
    before = Window.orderBy("_block")  # over a row a block
    while True:
        goes_on = F.lag("_last").over(before).eqNullSafe(F.col("_first")) & (F.lag("_block").over(before).isNotNull())
        next_state = state.withColumn("_now", F.when(goes_on, F.lag("_state").over(before)).otherwise(F.col("_begin")))
        changed = cut(next_state.filter(~F.col("_now").eqNullSafe(F.col("_with"))).select("_block", "_first", "_now"))
        if changed.isEmpty():
            break
        heads = dealt.join(changed, "_block").filter(own.eqNullSafe(F.col("_first"))).withColumn("_given", F.when(F.col("_opens"), F.col("_now"))).drop("_first", "_now")
        fresh = folded(heads.repartition(blocks, "_block").sortWithinPartitions("_block", F.desc("_opens"), *by))
        done.append(fresh)
        again.append(changed.select("_block", F.col("_first").alias("_key")))
        new = fresh.filter("_state is not null").select("_block", F.col("_state").alias("_new"))
        state = state.join(new, "_block", "left").join(changed.select("_block", "_now"), "_block", "left")
        whole = F.col("_first").eqNullSafe(F.col("_last"))  # else the block's last key is another, whose state stays
        state = cut(state.select("_block", "_first", "_last", "_begin", F.when(F.col("_new").isNotNull() & whole, F.col("_new")).otherwise(F.col("_state")).alias("_state"), F.when(F.col("_new").isNotNull(), F.col("_now")).otherwise(F.col("_with")).alias("_with")))
    out_rows = []
    for n, some in enumerate(done):
        for later in again[n:]:  # rows that a later round has folded anew
            some = some.join(later, (some["_block"] == later["_block"]) & own.eqNullSafe(later["_key"]), "left_anti")
        out_rows.append(some.select(*names, *more.names, "_state"))
    return reduce(DataFrame.unionByName, out_rows)


# Guarded figures


def guarded(jump: int = 10, above: int = 50, unofficial_count: bool = False) -> Step:
    """A running figure of rows (value, issuer, official, stated): a row counts if its figure is stated in its text and, with
    unofficial_count off, comes from an official body; a figure falls only if its issuer or an unofficial body's figure is
    corrected; a figure over `above` never rises more than `jump` times at once. Null or negative values do not count."""

    def step(state, row):
        value, by, official = row["value"], row["issuer"], bool(row["official"])
        fits = value is not None and value >= 0 and bool(row["stated"]) and (official or unofficial_count)
        if fits and state is not None:
            falls = value < state["value"] and by != state["issuer"] and (state["official"] or unofficial_count)
            fits = not falls and not (state["value"] > above and value > state["value"] * jump)
        if fits:
            state = {"value": value, "issuer": by, "official": official}
        return state, {"accepted": fits, "standing": state and state["value"], "standing_issuer": state and state["issuer"]}

    return step


GUARDED = "accepted boolean, standing long, standing_issuer string"


def running_figures(updates: DataFrame, keys: list[str], order: list[str], *, jump: int = 10, above: int = 50, unofficial_count: bool = False, block_rows: int = 100_000) -> DataFrame:
    """updates (keys, order, value, issuer, official, stated) with whether each is accepted and the figure that stands after it."""
    return fold_in_order(updates, keys, order, guarded(jump, above, unofficial_count), GUARDED, block_rows=block_rows)


# Incident ledger


def ledger_step(days: int, order_of_harm: tuple[str, ...], soft: tuple[str, ...]) -> Step:
    """Incidents of a key from reports (day, harm, rank, facts...): a report joins the open incident if its day is within
    `days` of it, else it opens the next. Facts that the incident lacks are filled, a worse harm replaces a lesser one unless
    it is a soft one, a source of higher rank replaces the standing source."""

    def step(state, row):
        day = row["day"]
        new = state is None or day is None or abs(day - state["day"]) > days
        facts = {k: row[k] for k in ("flag", "weapon")}
        if new:
            state = {"no": 1 if state is None else state["no"] + 1, "day": day if day is not None else (state["day"] if state else 0), "harm": row["harm"], "rank": row["rank"], "source": row["source"], **facts}
        else:
            state = dict(state)
            for k, v in facts.items():
                state[k] = v if state[k] is None else state[k]
            if row["harm"] in order_of_harm and row["harm"] not in soft and (state["harm"] not in order_of_harm or order_of_harm.index(row["harm"]) > order_of_harm.index(state["harm"])):
                state["harm"] = row["harm"]
            if row["rank"] is not None and (state["rank"] is None or row["rank"] > state["rank"]):
                state["rank"], state["source"] = row["rank"], row["source"]
        return state, {"incident": state["no"], "opens": new, "harm_now": state["harm"], "source_now": state["source"], "flag_now": state["flag"], "weapon_now": state["weapon"]}

    return step


LEDGER = "incident long, opens boolean, harm_now string, source_now string, flag_now string, weapon_now string"
#: From least to worst, and those that never replace another.
HARMS, SOFT_HARMS = ("suspicious approach", "near miss", "attacked", "hit", "sunk"), ("suspicious approach", "near miss")


def incident_ledger(reports: DataFrame, keys: list[str], order: list[str], *, days: int = 1, block_rows: int = 100_000) -> DataFrame:
    """reports (keys, order, day as a number, harm, rank, source, flag, weapon) with the incident each belongs to and what is
    known of it after the report."""
    return fold_in_order(reports, keys, order, ledger_step(days, HARMS, SOFT_HARMS), LEDGER, block_rows=block_rows)


# One-to-one absorption


def absorbing(apart: int) -> Step:
    """Unnamed incidents are absorbed by named ones of the key, one by one: rows come by day and id, and a row takes the
    oldest one of the other sort that is not taken yet and at most `apart` days older."""

    def step(state, row):
        mine, others = ("named", "unnamed") if row["is_named"] else ("unnamed", "named")
        day = row["day"]
        if day is None:
            return state, {"partner": None}
        state = {k: [w for w in (state or {}).get(k, []) if day - w[0] <= apart] for k in ("named", "unnamed")}
        taken = state[others].pop(0) if state[others] else None
        if taken is None:
            state[mine].append([day, row["id"]])
        return state, {"partner": taken and taken[1]}

    return step


def absorb(incidents: DataFrame, key: str, *, apart: int = 1, block_rows: int = 100_000) -> DataFrame:
    """incidents (key, id, day as a number, is_named) with the partner that the later row of a pair takes. Rows without a
    key or day have none.

    The oldest go first, so of a key's day the rows of one sort that find a partner are the first ones, as many as there are
    rows of the other sort within `apart` days at most. Only those are folded: whatever a day has beyond them stays alone, and
    would be handed on from block to block as state."""
    rows = cut(incidents)
    named = F.coalesce("is_named", F.lit(False))
    per = rows.groupBy(F.col(key).alias("_key"), F.col("day").alias("_day")).agg(F.count_if(named).alias("_named"), F.count_if(~named).alias("_unnamed"))
    around = Window.partitionBy("_key").orderBy("_day").rangeBetween(-apart, apart)
    per = per.select("_key", "_day", F.sum("_named").over(around).alias("_named"), F.sum("_unnamed").over(around).alias("_unnamed"))
    of_day = Window.partitionBy(key, "day", named).orderBy(F.asc_nulls_first("id"), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    placed = rows.withColumn("_place", F.row_number().over(of_day)).join(per, F.col(key).eqNullSafe(F.col("_key")) & F.col("day").eqNullSafe(F.col("_day")))
    fits = F.col("day").isNotNull() & (F.col("_place") <= F.when(named, F.col("_unnamed")).otherwise(F.col("_named")))
    placed = cut(placed.select(*rows.columns, fits.alias("_fits")))
    folded = fold_in_order(placed.filter("_fits").drop("_fits"), [key], ["day", "id"], absorbing(apart), "partner long", block_rows=block_rows).drop("_state")
    return folded.unionByName(placed.filter("not _fits").drop("_fits").withColumn("partner", F.lit(None).cast("long")))
