"""Command strings as lazy plans, over a session that holds the current version of each table."""

from __future__ import annotations

import base64
import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.bloom import bloom_agg
from tarn.functions.keys import bits_mask, concat_key
from tarn.model import HARD_LIMIT, KV, MOST_MEMBERS, SSET, ZSET
from tarn.operators import fts, joins, lookup, mutate, ranges
from tarn.operators import scan as catalog
from tarn.sources.tables import stored


@dataclass
class Flags:
    limit: int | None = None
    count: int = HARD_LIMIT
    match: str | None = None
    scores: bool = False
    data: bool = False
    intersect: list[str] = field(default_factory=list)
    notintersect: list[str] = field(default_factory=list)
    blooms: list[bytes] = field(default_factory=list)
    union: list[str] = field(default_factory=list)
    two_hops: str | None = None
    concat: tuple | None = None
    bloom: float | None = None


def parse_flags(words: list[str]) -> Flags:
    """Flags in any case; unknown words are passed over; TIMEOUT and WEAK are read and not used. INTBFDATA has a filter in base64."""
    f, i = Flags(), 0
    while i < len(words):
        word = words[i].upper()
        i += 1
        if word == "LIMIT":
            if words[i] != "0":
                raise ValueError("a limit must begin at 0")
            f.limit = min(int(words[i + 1]), HARD_LIMIT)
            i += 2
        elif word == "COUNT":
            f.count = min(int(words[i]), HARD_LIMIT)
            i += 1
        elif word == "MATCH":
            f.match = words[i]
            i += 1
        elif word == "WITHSCORES":
            f.scores = True
        elif word == "WITHDATA":
            f.scores = f.data = True
        elif word in ("INTERSECT", "NOTINTERSECT", "UNION"):
            getattr(f, word.lower()).append(words[i])
            i += 1
        elif word == "TWOHOPS":
            f.two_hops = words[i]
            i += 1
        elif word == "CONCATKEY":
            if words[i + 1] == "*":
                f.concat, i = (words[i],), i + 2
            else:
                f.concat, i = (words[i], int(words[i + 1]), int(words[i + 2]), words[i + 3]), i + 4
        elif word == "MEMBERBF":
            f.bloom, f.scores, f.data = float(words[i]), True, True
            i += 1
        elif word == "INTBFDATA":
            f.blooms.append(base64.b64decode(words[i]))
            i += 1
        elif word in ("TIMEOUT", "WEAK"):
            i += 1
    return f


#: Settings of all sessions: most rows of a range, most members of one write.
LIMITS = {"hard_limit": HARD_LIMIT, "most_members": MOST_MEMBERS}

#: Commands that a session keeps before it stores a new version of its tables.
KEPT = 100


class Session:
    """Tables z (sorted sets), s (sets) and kv, and what the commands say of them.

    Writes are kept and folded together when a table is read; after KEPT of them the tables are stored, so that no plan grows with the
    number of writes. Nothing else is computed until a result is used. A write answers with what it changed, as a DataFrame (result),
    but with --DEFER-- with no row, without any plan.
    """

    def __init__(self, spark: SparkSession, z: DataFrame | None = None, s: DataFrame | None = None, kv: DataFrame | None = None):
        self.spark = spark
        self._tables = {"z": spark.createDataFrame([], ZSET) if z is None else z, "s": spark.createDataFrame([], SSET) if s is None else s, "kv": spark.createDataFrame([], KV) if kv is None else kv}
        self._kept: dict[str, list[dict]] = {"z": [], "s": [], "kv": []}
        self._nothing = spark.createDataFrame([], "result double")
        self._deferred = False
        self.seq = 0

    def _frame(self, rows: list[dict], kinds: str) -> DataFrame:
        kinds = dict(x.split() for x in kinds.split(", "))
        names = sorted({k for r in rows for k in r})
        return self.spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"{k} {kinds[k]}" for k in names))

    @property
    def z(self) -> DataFrame:
        """What `fold` can't do, for its whole key, goes through `sequential`."""
        z, kept = self._tables["z"], self._kept["z"]
        hard = sorted({r["key"] for r in kept if r.get("bm16") is not None or r.get("add_to")})
        easy = [r for r in kept if r["key"] not in hard]
        if hard:
            here = F.col("key").isin(hard)
            there = mutate.sequential(z.where(here), self._frame([r for r in kept if r["key"] in hard], mutate.COMMANDS))
            z = z.where(~here).select(*there.columns).union(there)
        return mutate.fold(z, self._frame(easy, mutate.COMMANDS)) if easy else z

    @property
    def s(self) -> DataFrame:
        last = {(r["key"], r["member"]): r["add"] for r in self._kept["s"]}
        if not last:
            return self._tables["s"]
        new = self._frame([{"key": k, "member": m, "add": a} for (k, m), a in last.items()], "key string, member string, add boolean")
        return mutate.sadd(mutate.srem(self._tables["s"], new), new.where("add"))

    @property
    def kv(self) -> DataFrame:
        last: dict[str, dict] = {}
        for r in self._kept["kv"]:
            if not r["only_new"] or r["key"] not in last:
                last[r["key"]] = r
        if not last:
            return self._tables["kv"]
        new = self._frame([{k: r[k] for k in ("key", "value", "only_new", "seq")} for r in last.values()], "key string, value string, only_new boolean, seq long")
        return mutate.set_values(mutate.set_values(self._tables["kv"], new.where("NOT only_new")), new.where("only_new"), True)

    def _keep(self, name: str, rows: list[dict]) -> None:
        self._kept[name] += rows
        if len({r["seq"] for r in self._kept[name]}) >= KEPT:
            self._store(name, getattr(self, name))

    def _store(self, name: str, df: DataFrame) -> None:
        self._tables[name], self._kept[name] = stored(df, f"session-{name}"), []

    def _answer(self, result) -> DataFrame:
        return self.spark.createDataFrame([(float(result),)], "result double")

    def run(self, line: str) -> DataFrame:
        verb, *words = shlex.split(line)
        name = verb.upper().rstrip("!")
        if name in self._RANGES:
            return self._range(name, *words)
        method = getattr(self, f"_{name.lower()}", None)
        if method is None or name.lower() in ("of", "range", "keep", "store", "answer", "frame", "asked", "write", "count_of", "tables", "kept"):
            raise ValueError(f"unknown command {verb!r}")
        self._deferred = any(w.upper() == "--DEFER--" for w in words)
        return method(*[w for w in words if w.upper() not in ("--DEFER--", "--SYNC--", "--NORMAL--")])

    def _of(self, key: str) -> DataFrame:
        return self.z.where(F.col("key") == key)

    _RANGES = ("ZRANGE", "ZREVRANGE", "ZRANGEBYSCORE", "ZREVRANGEBYSCORE", "ZRANGEBYLEX", "ZREVRANGEBYLEX")

    def _range(self, name: str, key: str, a: str, b: str, *words: str) -> DataFrame:
        f, rev = parse_flags(list(words)), name.startswith("ZREV")
        own, lex = self._of(key), name.endswith("LEX")
        by = [F.col("rank")] if name.endswith("RANGE") else ranges.order(rev, lex)
        limit = LIMITS["hard_limit"] if f.limit is None else max(0, f.limit)
        if name.endswith("RANGE"):
            # filters come before the limit
            filtered = f.union or f.intersect or f.notintersect or f.blooms or f.two_hops is not None
            out = ranges.zrange(own, int(a), int(b), rev=rev, limit=None if filtered else limit, with_data=True)
        else:
            for k in f.union:
                own = own.unionByName(self._of(k))
            out = (ranges.zrangebylex if lex else ranges.zrangebyscore)(own, a, b, rev=rev, match=f.match, with_data=True)
        if f.bloom is not None and not f.union:
            return joins.members_bloom(out.orderBy(*by).limit(limit), f.bloom, limit, rev, lex)
        # one kind of filter at most, before the limit; a union has none
        if f.union:
            pass
        elif f.intersect or f.notintersect or f.blooms:
            out = joins.notintersect(joins.intersect(out, *[self._of(k) for k in f.intersect]), *[self._of(k) for k in f.notintersect])
            for blob in f.blooms:
                out = joins.in_bloom(out, blob)
        elif f.two_hops is not None:
            out = joins.two_hops(out, self.z, f.two_hops, concat_key(F.col("member"), *f.concat) if f.concat else None)
        return out.orderBy(*by).limit(limit).select("member", *["score"] * f.scores, *["data"] * f.data)

    def _count_of(self, key: str, n: DataFrame) -> DataFrame:
        """key, n: 0 where the key has no row."""
        one = self.spark.createDataFrame([(key,)], "key string")
        return one.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def _zcount(self, key, a, b, *words):
        return self._count_of(key, ranges.zcount(self._of(key), a, b, match=parse_flags(list(words)).match))

    def _zcountbylex(self, key, a, b, *words):
        return self._count_of(key, ranges.zcount(self._of(key), a, b, lex=True, match=parse_flags(list(words)).match))

    _zcountlex = _zcountbylex

    def _zcard(self, key):
        return self._count_of(key, ranges.zcard(self._of(key)))

    def _scard(self, key):
        return self._count_of(key, ranges.scard(self.s.where(F.col("key") == key)))

    def _zrank(self, key, member, *words, rev=False):
        asked = self.spark.createDataFrame([(key, member)], "key string, member string")
        return ranges.zrank_of(self._of(key), asked, rev=rev, max_rank=parse_flags(list(words)).count)

    def _zrevrank(self, key, member, *words):
        return self._zrank(key, member, *words, rev=True)

    def _asked(self, key, members):
        return self.spark.createDataFrame([(i, key, m) for i, m in enumerate(members)], "pos int, key string, member string")

    def _zmscore(self, key, *members):
        return lookup.zmscore(self._of(key), self._asked(key, members)).orderBy("pos")

    _zscore = _zmscore

    def _zmdata(self, key, *members):
        return lookup.zmdata(self._of(key), self._asked(key, members)).orderBy("pos")

    _zdata = _zmdata

    def _zdatabm16(self, key, member, low, high):
        """bit: the numbers from low to high (0 leaves a side open) of the bitmap in a member's data."""
        return lookup.zdata_bm16(lookup.with_bits(self._of(key)), self._asked(key, [member]), int(low), int(high)).select("bit").orderBy("bit")

    def _smismember(self, key, *members):
        return lookup.smismember(self.s, self._asked(key, members)).orderBy("pos")

    _sismember = _smismember

    def _smembers(self, key, *words):
        f, out = parse_flags(list(words)), lookup.smembers(self.s, [key])
        return out if f.bloom is None else bloom_agg(out, "key", "member", HARD_LIMIT if f.limit is None else f.limit, f.bloom).select("bloom")

    def _mget(self, *keys):
        return lookup.mget(self.kv, self.spark.createDataFrame(list(enumerate(keys)), "pos int, key string")).orderBy("pos")

    _get = _mget

    def _scan(self, cursor="", *words):
        f = parse_flags(list(words))
        kind, _, key = cursor.partition(":")
        return catalog.scan(catalog.catalog(self.z, self.s, self.kv, f.match), (kind, key) if cursor else None, f.count)

    def _sscan(self, key, cursor="", *words):
        f = parse_flags(list(words))
        return catalog.sscan(self.s, key, cursor, f.count, f.match)

    def _ssdisksize(self, *keys):
        return catalog.disk_size(self.z, self.s, self.kv, *keys)

    def _zri(self, n, *words):
        terms, rest = list(words[: int(n)]), list(words[int(n) :])
        return fts.ranked(self.z.select(F.col("key").alias("term"), F.col("member").alias("doc"), F.col("score").alias("tf")), terms, parse_flags(rest).count)

    def _zrangerangebyscore(self, key, a, b, a2, b2, n, *words, rev=False):
        f = parse_flags(list(words))
        outer = ranges.zrangebyscore(self._of(key), a, b, rev=rev, match=f.match)
        return joins.fanout(outer, self.z, a2, b2, int(n), concat_key(F.col("member"), *f.concat) if f.concat else None, f.limit)

    def _zrevrangerangebyscore(self, *words):
        return self._zrangerangebyscore(*words, rev=True)

    def _write(self, rows: list[dict]) -> DataFrame:
        if len(rows) > LIMITS["most_members"]:
            raise ValueError("too many members")
        self.seq += 1
        rows = [{"seq": self.seq, "pos": k} | r for k, r in enumerate(rows)]
        if self._deferred:
            self._keep("z", rows)
            return self._nothing
        # to what the members were before, so that the answer stays when other writes follow
        before = self._of(rows[0]["key"]).where(F.col("member").isin([r["member"] for r in rows]))
        out = mutate.answers(before, self._frame(rows, mutate.COMMANDS)).select("result")
        self._keep("z", rows)
        return out

    def _zadd(self, key, *words):
        if not key or "\0" in key:
            raise ValueError("bad key")
        base: dict = {"key": key, "op": "zadd"}
        words, width, kind = list(words), 2, None
        while words and (flag := words[0].upper()) in ("XX", "NX", "CH", "PD", "DATA", "BM16", "DSLT", "MSSUM", "MSAVG", "MSBIT", "MSBITSET", "MSBITCLR", "MSBITINV"):
            words.pop(0)
            if flag in ("XX", "NX", "PD", "CH"):
                base[flag.lower()] = True
            elif flag in ("DATA", "BM16"):
                width, kind = 3, flag.lower()
            elif flag == "DSLT":
                base["dslt"] = float(words.pop(0))
            elif flag.startswith("MS"):
                base["merge"] = {"MSSUM": "sum", "MSAVG": "avg", "MSBIT": "bit", "MSBITSET": "set", "MSBITCLR": "clear", "MSBITINV": "invert"}[flag]
                if flag.startswith("MSBIT"):
                    base["mask"] = bits_mask(int(words.pop(0)), int(words.pop(0)))
                if flag not in ("MSSUM", "MSAVG", "MSBIT"):
                    base["bit"] = int(words.pop(0))
                    if not base["mask"] >> base["bit"] & 1:
                        raise ValueError("the bit must be within the mask")
        if not words or len(words) % width:
            raise ValueError("scores and members must go together")
        rows = []
        for at in range(0, len(words), width):
            if not words[at + 1]:
                raise ValueError("empty member")
            score = float(words[at])
            if score != score:
                raise ValueError("score is not a number")
            rows.append(base | {"score": score, "member": words[at + 1]} | ({"data": words[at + 2]} if kind == "data" else {"bm16": int(float(words[at + 2])) & 0xFFFF} if kind else {}))
        return self._write(rows)

    def _zincrby(self, key, by, member, *words):
        """Flags: INCRTO, DATA d, BM16 n, ADD source member2 (source: result, negresult or a number), DF e, an SQL expression of data, score and by (before the increment) that gives the new data."""
        row: dict = {"key": key, "op": "zincrby", "score": float(by), "member": member}
        words, expression = list(words), None
        while words:
            flag = words.pop(0).upper()
            if flag == "INCRTO":
                row["incrto"] = True
            elif flag == "DATA":
                row["data"] = words.pop(0)
            elif flag == "BM16":
                row["bm16"] = int(words.pop(0)) & 0xFFFF
            elif flag == "ADD":
                row["add_from"], row["add_to"] = words.pop(0), words.pop(0)
                if row["add_from"].lower() not in ("result", "negresult"):
                    float(row["add_from"])
            elif flag == "DF":
                expression = words.pop(0)
            else:
                raise ValueError(f"unknown flag {flag}")
        if expression is None:
            return self._write([row])
        asked = self._asked(key, [member]).join(self._of(key), ["key", "member"], "left")
        found = asked.select(F.coalesce("data", F.lit("")).alias("data"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(float(by)).alias("by"))
        return self._write([row | {"data": str(found.select(F.expr(expression)).head()[0])}])

    def _zrem(self, key, *members):
        return self._write([{"key": key, "op": "zrem", "member": m} for m in dict.fromkeys(members)])

    def _member_write(self, key, members, add: bool) -> DataFrame:
        self.seq += 1
        members = list(dict.fromkeys(members))
        if self._deferred:
            self._keep("s", [{"seq": self.seq, "key": key, "member": m, "add": add} for m in members])
            return self._nothing
        there = self.s.where((F.col("key") == key) & F.col("member").isin(members)).select("member").distinct()
        n = there.agg((F.lit(len(members)) - F.count(F.lit(1)) if add else F.count(F.lit(1))).cast("double").alias("result"))
        self._keep("s", [{"seq": self.seq, "key": key, "member": m, "add": add} for m in members])
        return n

    def _sadd(self, key, *members):
        return self._member_write(key, members, True)

    def _srem(self, key, *members):
        return self._member_write(key, members, False)

    def _set(self, key, value, only_new=False):
        self.seq += 1
        if self._deferred:
            self._keep("kv", [{"seq": self.seq, "key": key, "value": value, "only_new": only_new}])
            return self._nothing
        there = self.kv.where(F.col("key") == key).agg(F.count(F.lit(1)).alias("n"))
        self._keep("kv", [{"seq": self.seq, "key": key, "value": value, "only_new": only_new}])
        return there.select((F.when(F.col("n") == 0, 1.0).otherwise(0.0) if only_new else F.lit(1.0)).alias("result"))

    def _setnx(self, key, value):
        return self._set(key, value, True)

    def _del(self, first, last=None):
        for name in ("z", "s", "kv"):
            self._store(name, mutate.delete_keys(getattr(self, name), first, last))
        return self._answer(1)

    def _config(self, what, name=None, value=None):
        """name, value: CONFIG GET pattern lists the session's limits (LIMITS), CONFIG SET name value changes one of them."""
        if what.upper() == "SET":
            if name not in LIMITS:
                raise ValueError(f"unknown setting {name!r}")
            LIMITS[name] = int(value)
        rows = [(k, str(v)) for k, v in sorted(LIMITS.items())]
        df = self.spark.createDataFrame(rows, "name string, value string")
        return df if what.upper() != "GET" or name in (None, "*") else df.where(F.col("name").like(name.replace("*", "%")))

    def _info(self):
        """name, value: numbers of keys and rows, and of commands that are kept for the next version."""
        parts = [df.agg(F.lit(k).alias("name"), F.countDistinct("key").alias("value")) for k, df in (("zsets", self.z), ("sets", self.s), ("strings", self.kv))]
        parts.append(self.z.agg(F.lit("zset_members"), F.count(F.lit(1))))
        parts.append(self.spark.createDataFrame([("commands_kept", sum(map(len, self._kept.values())))], "name string, value long"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
