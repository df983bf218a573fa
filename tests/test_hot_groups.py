"""Groups that hold most rows of a table."""

import random
from collections import defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from readloom.operators import dedup, order
from readloom.plans import prefix
from readloom.schema import CONTENT


def test_primary_of_a_hot_read(spark):
    rng = random.Random(2)
    rows = [(1 if i % 3 else i, i, b := rng.randrange(400_000), b + rng.choice([0, 0, 3, 40, 400, -2])) for i in range(30_000)]
    want, held = set(), {}
    for a, i, b, e in rows:
        if not any(b < y and x < e for x, y in held.setdefault(a, [])):
            held[a].append((b, e))
            want.add(i)
    rng.shuffle(rows)
    o = spark.createDataFrame(rows, "aread long, src_id long, abpos long, aepos long")
    got = order.mark_primary(o, ["src_id"], ["src_id", "aread"])
    assert "collect_list" not in got._jdf.queryExecution().toString()  # no read is one row
    marks = got.collect()
    assert len(marks) == len(rows) and {r.src_id for r in marks if r.is_primary} == want


def node(r):
    t = ",".join(f"{x['err']}:{x['blen']}" for x in r["trace"])
    return md5("|".join([*(str(r[c]).lower() for c in CONTENT), t]).encode()).hexdigest()


def points(r, ts):
    """Inner trace points (apos, bpos) -> tiles before them."""
    a, b, out = r["abpos"] // ts * ts, r["bbpos"], {}
    for i, t in enumerate(r["trace"][:-1]):
        a, b = a + ts, b + t["blen"]
        out[a, b] = i + 1
    return out


def plain_fusion(rows, ts):
    """The rounds of ``dedup.fuse`` over the rows of one group."""
    live, gone = {node(r): r for r in rows}, []
    while True:
        at = {n: points(r, ts) for n, r in live.items()}
        through = defaultdict(list)
        for n in live:
            for p in at[n]:
                through[p].append(n)
        key = lambda n: (live[n]["abpos"], -live[n]["aepos"], live[n]["bbpos"], live[n]["bepos"], live[n]["diffs"], n)
        dead = {n for line in through.values() for n in line for o in line if key(o) < key(n) and live[o]["aepos"] >= live[n]["aepos"]}
        edges = {}
        for (apos, _), line in through.items():
            left = sorted((n for n in line if n not in dead), key=key)
            for u, v in zip(left, left[1:]):
                edges[u, v] = min(apos, edges.get((u, v), apos))
        best = {}
        for u, v in edges:
            e = (md5((u + v).encode()).hexdigest(), u, v)
            for n in (u, v):
                best[n] = min(e, best.get(n, e))
        chosen = [(u, v) for u, v in edges if best[u] == best[v]]
        if not dead and not chosen:
            return list(live.values()), gone
        new = []
        for u, v in chosen:
            x, y, apos = live[u], live[v], edges[u, v]
            (i,), (j,) = ([k for p, k in at[n].items() if p[0] == apos] for n in (u, v))
            trace = [*x["trace"][:i], *y["trace"][j:]]
            new.append({**x, "aepos": y["aepos"], "bepos": y["bepos"], "trace": trace, "diffs": sum(t["err"] for t in trace)})
        ended = dead | {n for e in chosen for n in e}
        gone += [live[n] for n in ended]
        live = {n: r for n, r in live.items() if n not in ended} | {node(r): r for r in new}


def overlap(rng, n, reach, shifts, bread=2):
    a = rng.randrange(0, reach) * 10
    tiles = rng.randrange(1, 12)
    blens = [rng.choice([100, 100, 100, 90]) for _ in range(tiles)]
    b = a // 100 * 100 + rng.randrange(shifts) * 1000
    trace = [{"err": rng.randrange(4), "blen": x} for x in blens]
    return {"aread": 1, "bread": bread, "is_inverse": False, "abpos": a, "aepos": (a // 100 + tiles) * 100, "bbpos": b, "bepos": b + sum(blens), "diffs": n, "trace": trace}


SCHEMA = "aread long, bread long, is_inverse boolean, abpos long, aepos long, bbpos long, bepos long, diffs long, trace array<struct<err:int,blen:int>>"


def check(spark, rows):
    text = lambda r: (r["aread"], r["bread"], r["abpos"], r["aepos"], r["bbpos"], r["bepos"], r["diffs"], [(t["err"], t["blen"]) for t in r["trace"]])
    groups = defaultdict(list)
    for r in rows:
        groups[r["bread"]].append(r)
    want = [(text(r), flag) for g in groups.values() for flag, part in zip((False, True), plain_fusion(g, 100)) for r in part]
    got = dedup.fuse(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).collect()
    assert sorted((text(r), r["removed"]) for r in got) == sorted(want)
    return got


def test_fusion_like_a_plain_version(spark):
    rng = random.Random(7)
    rows = [overlap(rng, n % 5, 200, 1 + n % 3, 100 + n // 40) for n in range(600)]
    got = check(spark, rows + rows[:50])
    assert any(r.removed for r in got) and dedup.fuse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_chain_through_one_point(spark):
    """Thousands of rows share a point and none holds another: all become one, in few rounds."""
    row = lambda a, b: {"aread": 1, "bread": 2, "is_inverse": False, "abpos": a, "aepos": b, "bbpos": a, "bepos": b, "diffs": 0, "trace": [{"err": 0, "blen": min(b, t + 100) - max(a, t)} for t in range(a // 100 * 100, b, 100)]}
    rows = [row(i, 6000 + i) for i in range(0, 3000, 2)]
    out = dedup.fuse(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), rounds=40).where("not removed").collect()
    assert [(r.abpos, r.aepos) for r in out] == [(0, 8998)]


def test_running_sum_over_many_buckets(spark):
    """Buckets of several wide ones, negative and null ones too, against a plain sum; and only wide ones meet in one task."""
    rng = random.Random(8)
    rows = [(None, 5, 0), *((rng.randrange(-3 * prefix.WIDE, 9 * prefix.WIDE), rng.randrange(9), i) for i in range(1, 3000))]
    df = spark.createDataFrame(rows, "x long, v long, i long")
    got = {r.i: r.s for r in prefix.running_sum(df, F.floor(F.col("x") / 2), ["x", "i"], F.col("v"), "s").collect()}
    want, total = {}, 0
    for x, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        want[i], total = total, total + v
    assert got == want
