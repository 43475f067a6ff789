import random

from pyspark.sql import functions as F

from framekit.functions.scan import (
    int_block, last_before, last_upto, max_before, next_row, ordered, row_no, scan, sum_before, sum_upto,
)


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        total, top, last, prev = 0, None, None, None
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, (_, at, v) in enumerate(group):
            before = (total, top, last, prev)
            total += v or 0
            top = v if top is None else top if v is None else max(top, v)
            last = last if v is None else v
            nxt = group[i + 1][1] if i + 1 < len(group) else None
            out[(key, at)] = (before[0], total, before[1], before[2], last, before[3], nxt, i + 1)
            prev = at
    return out


def run(spark, rows, width, parts):
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint").repartition(parts)
    got = scan(df, ["k"], ["at"], {
        "sb": sum_before(F.coalesce("v", F.lit(0))), "su": sum_upto(F.coalesce("v", F.lit(0))), "mx": max_before(F.col("v")),
        "lb": last_before(F.col("v")), "lu": last_upto(F.col("v")), "pv": last_before(F.col("at")), "nx": next_row(F.col("at")),
        "rn": row_no(),
    }, block=int_block("at", width))
    assert got.columns[:3] == ["k", "at", "v"]
    return {(r.k, r.at): (r.sb, r.su, r.mx, r.lb, r.lu, r.pv, r.nx, r.rn) for r in got.collect()}


def test_scan_equals_brute_force_for_any_block_and_partition_count(spark):
    rng = random.Random(7)
    rows = [("hot", i * 3, None if rng.random() < 0.3 else rng.randint(-9, 9)) for i in range(200)]
    rows += [(k, i, rng.randint(0, 5)) for k in "abc" for i in rng.sample(range(50), 7)] + [(None, 4, 2), (None, 9, None)]
    want = brute(rows)
    for width, parts in ((1, 1), (7, 5), (1 << 16, 3)):
        assert run(spark, rows, width, parts) == want


def test_both_readers_share_one_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    out = scan(df, ["k"], ["at"], {"s": sum_before(F.col("at"))}, block=int_block("at", 100)).select("k", "s")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_second_scan_keeps_the_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"))
    one = scan(df, ["k"], ["at"], {"s": sum_before(F.col("at"))}, block=int_block("at", 64), keep_blocks=True)
    two = scan(one, ["k"], ["at"], {"t": last_upto(F.when(F.col("s") % 5 == 0, F.col("s")))})
    assert two.columns == ["k", "at", "s", "t"]
    seen, last = {}, {}
    for r in sorted(two.collect(), key=lambda r: r.at):
        assert r.s == seen.get(r.k, 0)
        seen[r.k] = r.s + r.at
        last[r.k] = r.s if r.s % 5 == 0 else last.get(r.k)
        assert r.t == last[r.k]


def test_short_groups_give_the_values_of_a_scan(spark):
    rng = random.Random(5)
    rows = [(k, i, None if rng.random() < 0.3 else rng.randint(0, 9)) for k in "abc" for i in rng.sample(range(90), 20)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    values = {
        "sb": sum_before(F.coalesce("v", F.lit(0))), "su": sum_upto(F.coalesce("v", F.lit(0))), "mx": max_before(F.col("v")),
        "lu": last_upto(F.col("v")), "pv": last_before(F.col("at")), "nx": next_row(F.col("at")), "rn": row_no(),
    }
    assert sorted(ordered(df, ["k"], ["at"], values).collect(), key=str) == sorted(scan(df, ["k"], ["at"], values).collect(), key=str)
