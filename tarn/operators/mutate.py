"""Writes, as folds of ordered commands.

Where the order of commands only decides which one wins, built-in aggregates fold them map-side (`last_wins`, `first_wins`,
`keep_data`, `sums`). All else goes through `fold`, which replays the commands of each (key, member) in order, or where a command changes
several members or a bitmap, through `sequential`, which replays those of each key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.bitmap16 import decode_bits, encode_bits

#: Columns of commands: pos is the place among the pairs of one command; op is zadd, zincrby, zrem, del (of a key: member is null); merge is
#: null, sum, avg, bit, set, clear, invert. bm16 (a number that goes into the bitmap of the data), ch, add_to and add_from are for `sequential`.
COMMANDS = "seq long, pos int, key string, op string, member string, score double, data string, nx boolean, xx boolean, pd boolean, merge string, mask long, bit int, incrto boolean, dslt double, bm16 int, ch boolean, add_to string, add_from string"

_DEFAULTS = {"pos": "0", "bm16": "null", "ch": "false", "add_to": "null", "add_from": "null", "op": "'zadd'", "member": "null", "score": "0D", "data": "null", "nx": "false", "xx": "false", "pd": "false", "merge": "null", "mask": "null", "bit": "null", "incrto": "false", "dslt": "null"}


def commands(df: DataFrame) -> DataFrame:
    """`df` (seq, key and any of the columns above) with all of them."""
    kinds = dict(x.split() for x in COMMANDS.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.expr(_DEFAULTS[c])).cast(t).alias(c) for c, t in kinds.items()])


def last_wins(adds: DataFrame) -> DataFrame:
    """Plain upserts: the last of each member."""
    last = F.max_by(F.struct("score", "data"), "seq")
    return adds.groupBy("key", "member").agg(last.alias("r")).select("key", "member", "r.score", "r.data")


def first_wins(adds: DataFrame) -> DataFrame:
    """Upserts that only insert."""
    first = F.min_by(F.struct("score", "data"), "seq")
    return adds.groupBy("key", "member").agg(first.alias("r")).select("key", "member", "r.score", "r.data")


def only_existing(z: DataFrame, adds: DataFrame) -> DataFrame:
    """`z` after upserts that only update."""
    new = last_wins(adds).select("key", "member", F.col("score").alias("s"), F.col("data").alias("d"), F.lit(True).alias("hit"))
    return z.join(new, ["key", "member"], "left").select("key", "member", F.when(F.col("hit"), F.col("s")).otherwise(F.col("score")).alias("score"), F.when(F.col("hit"), F.col("d")).otherwise(F.col("data")).alias("data"))


def changed(adds: DataFrame) -> DataFrame:
    """key, added, updated: members that upserts in order have added, and the times that they gave a new score."""
    before = F.lag("score").over(W.partitionBy("key", "member").orderBy("seq"))
    out = adds.withColumn("before", before)
    return out.groupBy("key").agg(F.sum(F.col("before").isNull().cast("long")).alias("added"), F.sum((F.col("before").isNotNull() & (F.col("before") != F.col("score"))).cast("long")).alias("updated"))


def keep_data(adds: DataFrame) -> DataFrame:
    """Upserts that keep the old data where the new are empty."""
    some = F.coalesce(F.col("data"), F.lit("")) != ""
    return adds.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"), F.max_by(F.when(some, F.col("data")), F.when(some, F.col("seq"))).alias("data"))


def sums(incs: DataFrame) -> DataFrame:
    """Increments: the sum for each member."""
    return incs.groupBy("key", "member").agg(F.sum("score").alias("score"))


def deltas(sets: DataFrame) -> DataFrame:
    """Increments to a value: seq, key, member, score (the value), delta (what it adds to the one before)."""
    before = F.lag("score").over(W.partitionBy("key", "member").orderBy("seq"))
    return sets.select("seq", "key", "member", "score", (F.col("score") - F.coalesce(before, F.lit(0.0))).alias("delta"))


def _step(acc, x):
    old = F.coalesce(acc.score, F.lit(0.0))
    kept = F.coalesce(old.try_cast("bigint"), F.lit(0)).bitwiseAND(F.coalesce(x.mask, F.lit(-1)))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.coalesce(x.bit, F.lit(0)))
    own = F.coalesce(x.score.try_cast("bigint"), F.lit(0))
    merged = (
        F.when(x["merge"] == "sum", old + x.score)
        .when(x["merge"] == "avg", (old + x.score) / 2)
        .when(x["merge"] == "bit", kept.bitwiseOR(own).cast("double"))
        .when(x["merge"] == "set", kept.bitwiseOR(bit).bitwiseOR(own).cast("double"))
        .when(x["merge"] == "clear", kept.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(own).cast("double"))
        .when(x["merge"] == "invert", kept.bitwiseXOR(bit).bitwiseOR(own).cast("double"))
        .otherwise(x.score)
    )
    none = F.struct(F.lit(False).alias("there"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("data"))
    as_was = F.struct(acc.there.alias("there"), acc.score.alias("score"), acc.data.alias("data"))
    data = F.when(x.pd & (F.coalesce(x.data, F.lit("")) == ""), acc.data).otherwise(x.data)
    added = F.struct(F.lit(True).alias("there"), (merged + F.lit(0.0)).alias("score"), data.alias("data"))
    up = F.struct(F.lit(True).alias("there"), F.when(x.incrto, x.score).otherwise(old + x.score).alias("score"), F.coalesce(x.data, acc.data).alias("data"))
    # a score below the command's own threshold is left out before anything else, unless scores are merged
    skip = (x.nx & acc.there) | (x.xx & ~acc.there) | F.coalesce(x["merge"].isNull() & (x.score < x.dslt), F.lit(False))
    return (
        F.when(x.op.isin("zrem", "del"), none)
        .when(x.op == "expire", F.when(acc.there & (acc.score < x.dslt), none).otherwise(as_was))
        .when(x.op == "zincrby", up)
        .when(skip, as_was)
        .otherwise(added)
    )


def fold(z: DataFrame, cmds: DataFrame) -> DataFrame:
    """The sorted sets after all commands, in order of seq and pos: key, member, score, data.

    What comes before a key's last deletion is left out at once. Expiries (of what is below a command's threshold, after its own pairs) are
    attached to every member of their key. Rows that no command names are only passed through.
    """
    c = commands(cmds)
    last = c.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("_deleted"))
    z = z.join(last, "key", "left_anti")
    c = c.where("op != 'del' AND member IS NOT NULL").join(last, "key", "left").where("_deleted IS NULL OR seq > _deleted").drop("_deleted")
    fields = [x.split()[0] for x in COMMANDS.split(", ") if x.split()[0] not in ("key", "member", "seq", "pos")]
    event = F.struct("seq", "phase", "pos", *fields).alias("e")
    own = c.withColumn("phase", F.lit(0)).select("key", "member", event)
    expiries = c.where("op = 'zadd' AND dslt IS NOT NULL").groupBy("seq", "key", "dslt").agg(F.lit("expire").alias("op"))
    for_keys = commands(expiries).withColumn("phase", F.lit(1)).select("key", event)
    named = own.select("key", "member").union(z.join(for_keys.select("key").distinct(), "key", "left_semi").select("key", "member")).distinct()
    events = own.union(named.join(for_keys, "key").select("key", "member", "e")).groupBy("key", "member").agg(F.array_sort(F.collect_list("e")).alias("events"))
    state = z.select("key", "member", "score", "data", F.lit(True).alias("there")).join(events, ["key", "member"], "full")
    start = F.struct(F.coalesce("there", F.lit(False)).alias("there"), F.col("score").cast("double").alias("score"), F.col("data").cast("string").alias("data"))
    end = F.when(F.col("events").isNull(), start).otherwise(F.aggregate("events", start, _step))
    return state.select("key", "member", end.alias("r")).where("r.there").select("key", "member", "r.score", "r.data")


def _plain(cmd: dict) -> dict:
    """The command with None in place of what pandas writes for nulls."""
    return {k: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v for k, v in cmd.items()}


def _merged(cmd: dict, old: float) -> float:
    kind, new, mask = cmd["merge"], cmd["score"], -1 if cmd["mask"] is None else int(cmd["mask"])
    if kind == "sum":
        return old + new
    if kind == "avg":
        return (old + new) / 2
    if kind is None:
        return new
    kept, bit = int(old) & mask, 1 << int(cmd["bit"] or 0)
    return float({"bit": kept, "set": kept | bit, "clear": kept & ~bit, "invert": kept ^ bit}[kind] | int(new))


def _with_bit(data: str | None, bit) -> str:
    """Bitmaps are stored in hexadecimal, as data are text."""
    return encode_bits([*decode_bits(bytes.fromhex(data or "")), int(bit)]).hex()


def replay(members: dict, cmds: list[dict]) -> float:
    """Apply the pairs of one command to a key's {member: [score, data]}; returns what the command answers: of an increment its score (with INCRTO
    the change), else the number of members added (with CH, also of scores changed) or removed."""
    result = 0.0
    for c in cmds:
        m, old = c["member"], members.get(c["member"])
        if c["op"] == "del":
            result += len(members)
            members.clear()
        elif c["op"] == "zrem":
            result += members.pop(m, None) is not None
        elif c["op"] == "zincrby":
            was = old or [0.0, ""]
            data = _with_bit(was[1], c["bm16"]) if c["bm16"] is not None else was[1] if c["data"] is None else c["data"]
            result = c["score"] - was[0] if c["incrto"] else was[0] + c["score"]
            members[m] = [c["score"] if c["incrto"] else result, data]
            if c["add_to"]:
                by = {"result": result, "negresult": -result}.get(c["add_from"].lower())
                # the other member gets the data of the command as well
                replay(members, [c | {"member": c["add_to"], "add_to": None, "incrto": False, "score": float(c["add_from"]) if by is None else by}])
        else:
            skip = c["nx"] and old or c["xx"] and not old or (c["dslt"] is not None and c["merge"] is None and c["score"] < c["dslt"])
            if not skip:
                data = _with_bit(old and old[1], c["bm16"]) if c["bm16"] is not None else c["data"]
                score = _merged(c, old[0] if old else 0.0) + 0.0
                result += not old or bool(c["ch"] and old[0] != score)
                members[m] = [score, old[1] if old and c["pd"] and not data else data]
    if cmds and cmds[-1]["op"] == "zadd" and cmds[-1]["dslt"] is not None:
        for m in [m for m, x in members.items() if x[0] < cmds[-1]["dslt"]]:
            del members[m]
    return result


def _replayed(z: DataFrame, cmds: DataFrame, step, answers: bool) -> DataFrame:
    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        members, results = {m: [s, d] for m, s, d in zip(old["member"], old["score"], old["data"], strict=True)}, []
        for seq, rows in new.sort_values(["seq", "pos"]).groupby("seq"):
            results.append((key[0], seq, step(members, [_plain(r) for r in rows.to_dict("records")])))
        if answers:
            return pd.DataFrame(results, columns=["key", "seq", "result"])
        return pd.DataFrame({"key": [key[0]] * len(members), "member": list(members), "score": [float(x[0]) for x in members.values()], "data": [x[1] for x in members.values()]})

    schema = "key string, seq long, result double" if answers else "key string, member string, score double, data string"
    return z.groupBy("key").cogroup(commands(cmds).groupBy("key")).applyInPandas(run, schema)


def sequential(z: DataFrame, cmds: DataFrame, step: Callable[[dict, list[dict]], float] = replay) -> DataFrame:
    """The sorted sets after commands of which one may change several members: `step(members, pairs of a command)` replays a key's commands in order, in one task a key."""
    return _replayed(z, cmds, step, False)


def answers(z: DataFrame, cmds: DataFrame, step: Callable[[dict, list[dict]], float] = replay) -> DataFrame:
    """key, seq, result: what each command answers, in one task a key."""
    return _replayed(z, cmds, step, True)


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.join(gone.select("key", "member").distinct(), ["key", "member"], "left_anti")


def delete_keys(df: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Rows of all keys but first, or but first..last."""
    return df.where(~F.col("key").between(first, last if last is not None else first))


def sadd(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select("key", "member").union(new.select("key", "member")).distinct()


srem = zrem


def set_values(kv: DataFrame, sets: DataFrame, only_new: bool = False) -> DataFrame:
    """`kv` after sets (seq, key, value): the last wins, or with only_new the first, and what is there stays."""
    pick = F.min_by if only_new else F.max_by
    rows = kv.select("key", "value", F.lit(-1).cast("long").alias("seq")).unionByName(sets.select("key", "value", "seq"))
    return rows.groupBy("key").agg(pick("value", "seq").alias("value"))
