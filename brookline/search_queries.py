"""Queries of random numbers for every bin of a user, and of searches for every user."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import pcg
from .functions.rng import Pmf
from .model_queries import BY, expr, user_model
from .operators.summary import PROFILES, built_in_profile
from .plans import searches
from .queries import hours, query, r6, users

#: One step of the generator in SQL, and the number of a state x.
_NEXT = "(x * 6364136223846793005::hugeint + 1442695040888963407::hugeint) % 18446744073709551616::hugeint"
_OLD = "(xor(x >> 18, x) >> 27) & 4294967295::hugeint"
_OUT = f"((({_OLD}) >> (x >> 59)::int) | (({_OLD}) << ((32 - (x >> 59)::int) & 31))) & 4294967295::hugeint"


@query(f"with recursive $U, p as (select distinct user_id from u), r as (select user_id, -1 as bin, user_id::hugeint as x from p union all select user_id, bin + 1, {_NEXT} from r where bin < 29), v as (select user_id, bin, {_OUT} as v from r where bin >= 0) select user_id, bin::bigint as bin, v::bigint as number, round(v::double / 4294967296, 9) as uniform, case when v::double / 4294967296 <= 0.5 then 1.0 when v::double / 4294967296 <= 0.8 then 2.0 else 5.0 end::double as value, ((v::hugeint * 6) >> 32)::bigint as below from v")
def pcg_draws(spark, sf):
    """A number for every user and day, the user being the seed; no row knows another."""
    seed, n = F.col("user_id"), F.col("bin")
    df = users(spark, sf).select("user_id", "bin").withColumn("number", pcg.draw(seed, n))
    u = F.col("number") / float(1 << 32)
    return df.select("user_id", "bin", "number", (F.round(u, 9) + 0.0).alias("uniform"), pcg.sample(Pmf([1, 2, 5], [0.5, 0.3, 0.2]), u).alias("value"), F.shiftright(F.col("number") * 6, 32).alias("below"))


@query(f"with recursive $H, r as (select -1 as bin, 42::hugeint as x union all select bin + 1, {_NEXT} from r where bin < 719), v as (select bin, ({_OUT})::double / 4294967296 as u from r) select h.bin, case when u <= 0.5 then 1.0 when u <= 0.8 then 2.0 else 5.0 end::double as value, case when u <= 0.5 then 1.0 when u <= 0.8 then 2.0 else 5.0 end * arrivals as scaled from h join v using (bin)")
def pcg_sample(spark, sf):
    """Draws of a distribution over the hours' grid, and arrivals scaled by them."""
    value = pcg.sample(Pmf([1, 2, 5], [0.5, 0.3, 0.2]), pcg.uniform(F.lit(42), F.col("bin")))
    return hours(spark, sf).withColumn("value", value).select("bin", "value", (F.col("value") * F.col("arrivals")).alias("scaled"))


# --- searches -----------------------------------------------------------------------------------------------------------


def staffed() -> dict:
    """What a day's capacity leaves unserved, and what it costs."""
    constants = [{"id": i, "kind": "const", "values": [0.0] * 30} for i in ("capacity", "price")]
    return user_model(*constants, expr("unserved", "MAX(0, arrivals - capacity)"), expr("cost", "price * capacity + 4 * unserved"), expr("loss", "(arrivals - capacity) * (arrivals - capacity) + (errors - price) * (errors - price)"))


_LISTS = "g as materialized (select user_id, list(arrivals order by bin) as a, list(errors order by bin) as e, avg(arrivals) as ma, avg(errors) as me from u group by 1)"


@query(f"""with $U, {_LISTS}, b as (select *, ma / 2 as capacity, 1 + me as price from g),
    s as (select user_id, 'capacity' as parameter, capacity as base, list_avg(list_transform(a, lambda x: price * capacity * 1.05 + 4 * greatest(0, x - capacity * 1.05))) as up, list_avg(list_transform(a, lambda x: price * capacity * 0.95 + 4 * greatest(0, x - capacity * 0.95))) as down from b
    union all select user_id, 'price', price, list_avg(list_transform(a, lambda x: price * 1.05 * capacity + 4 * greatest(0, x - capacity))), list_avg(list_transform(a, lambda x: price * 0.95 * capacity + 4 * greatest(0, x - capacity))) from b)
    select user_id, parameter, round(base, 6) as base, round(case when base = 0 then 0 else (up - down) / (base * 1.05 - base * 0.95) end, 5) + 0.0 as gradient from s""")
def sensitivity(spark, sf):
    """How each user's cost changes with capacity and price."""
    data = users(spark, sf)
    bases = data.groupBy(*BY).agg((F.avg("arrivals") / 2).alias("capacity"), (1 + F.avg("errors")).alias("price"))
    got = searches.sensitivity_each(staffed(), data, BY, bases, "cost")
    return got.select("user_id", "parameter", r6("base").alias("base"), (F.round("gradient", 5) + 0.0).alias("gradient"))


@query(f"""with recursive $U, {_LISTS}, t as (select user_id, a, ma * 0.4 as target, 0.0::double as low, 8.0::double as high from g), f as (select *, list_avg(a) as fl, list_avg(list_transform(a, lambda x: greatest(0, x - 8.0))) as fh from t),
    q as (select user_id, a, target, low, high, sign(fl - target) as s, case when abs(fl - target) < 1e-3 then low when abs(fh - target) < 1e-3 then high when sign(fl - target) = sign(fh - target) and abs(fl - target) <= abs(fh - target) then low else high end as value,
        abs(fl - target) < 1e-3 or abs(fh - target) < 1e-3 as hit, abs(fl - target) < 1e-3 or abs(fh - target) < 1e-3 or sign(fl - target) = sign(fh - target) as settled, 0 as n from f
    union all select user_id, a, target, case when not h and sign(m - target) = s then mid else low end, case when not h and sign(m - target) <> s then mid else high end, s, mid, h, h or n + 1 >= 20, n + 1
        from (select *, abs(m - target) < 1e-3 as h from (select *, list_avg(list_transform(a, lambda x: greatest(0, x - (low + high) / 2))) as m, (low + high) / 2 as mid from q where not settled)))
    select user_id, round(value, 6) as value, hit as converged, n::bigint as iterations from q where settled""")
def goal_seek(spark, sf):
    """The capacity at which each user's unserved work is two fifths of what arrives."""
    data = users(spark, sf)
    goals = data.groupBy(*BY).agg((F.avg("arrivals") * 0.4).alias("target")).withColumns({"low": F.lit(0.0), "high": F.lit(8.0)})
    got = searches.goal_seek_each(staffed(), data, BY, goals, "capacity", "unserved", tolerance=1e-3, most=20, depth=4)
    return got.select("user_id", r6("value").alias("value"), "converged", F.col("iterations").cast("long").alias("iterations"))


_COST = "list_avg(list_transform(a, lambda x: 1.5 * ({0}) + 4 * greatest(0, x - ({0}))))"


@query(f"""with recursive $U, {_LISTS}, f as (select user_id, a, 5.0::double as x, 5.5::double as y, {_COST.format("5.0")} as fx, {_COST.format("5.5")} as fy from g),
    q as (select user_id, a, case when fy < fx then y else x end as x, case when fy < fx then x else y end as y, least(fx, fy) as fx, greatest(fx, fy) as fy, 0 as n from f
    union all select user_id, a, case when ft < fx then t else x end, case when ft < fx then x else t end, least(fx, ft), greatest(fx, ft), n + 1 from (
        select *, case when k = 1 then fr when k = 2 then fe when k = 3 then fo else fi end as ft, case when k = 1 then r when k = 2 then e when k = 3 then o else i end as t from (
        select *, case when fr < fx then case when fe < fr then 2 else 1 end when fr < fy then case when fo <= fr then 3 else 4 end else 4 end as k from (
        select *, {_COST.format("r")} as fr, {_COST.format("e")} as fe, {_COST.format("o")} as fo, {_COST.format("i")} as fi from (
        select *, least(greatest(x + (x - y), 0), 10) as r, least(greatest(x + 2 * (x - y), 0), 10) as e, least(greatest(x + 0.5 * (x - y), 0), 10) as o, least(greatest(x - 0.5 * (x - y), 0), 10) as i from q where fy - fx >= 1e-3 and n < 40)))))
    select user_id, round(x, 6) as capacity, round(fx, 5) as cost, fy - fx < 1e-3 as converged, n::bigint as iterations from q where fy - fx < 1e-3 or n >= 40""")
def optimize(spark, sf):
    """The capacity that costs each user least."""
    data = users(spark, sf).withColumn("price", F.lit(1.5))
    got = searches.optimise_each(staffed(), data, BY, data.select(*BY), {"capacity": (0.0, 10.0)}, "cost", tolerance=1e-3, most=40)
    return got.select("user_id", r6("capacity").alias("capacity"), (F.round("mean", 5) + 0.0).alias("cost"), "converged", F.col("iterations").cast("long").alias("iterations"))


_OFFICE = "[" + ", ".join(map(str, PROFILES["weekday-office"])) + "]::double[]"


@query(f"with $U, p as (select bin, bin / 30.0::double * 287 as pos, floor(bin / 30.0::double * 287)::int as lo from (select unnest(range(30)) as bin)), w as (select bin, ({_OFFICE})[lo // 12 + 1] as a, ({_OFFICE})[least(lo + 1, 287) // 12 + 1] as b, pos - lo as part from p), n as (select bin, (a + (b - a) * part) / (select avg(a + (b - a) * part) from w) as weight from w), m as (select user_id, avg(arrivals) as rate from u group by 1) select user_id, bin, round(weight * rate, 6) + 0.0 as rate from m, n")
def profiled_source(spark, sf):
    """Each user's mean arrivals spread over the grid by an office's day."""
    weights = built_in_profile(spark, "weekday-office", 30).select(F.col("bin").cast("long").alias("bin"), "weight")
    u = users(spark, sf).select("user_id", "bin", F.avg("arrivals").over(W.partitionBy("user_id")).alias("rate"))
    return u.join(weights, "bin").select("user_id", "bin", r6(F.col("weight") * F.col("rate")).alias("rate"))
