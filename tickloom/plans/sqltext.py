"""SQL of the oracle queries: the derived tables, and window expressions as text."""

from __future__ import annotations

BARS = {
    "hour": """select event_type as code, date_trunc('hour', e.ts) as ts, arg_min(value, e.ts) as open, max(value) as high, min(value) as low,
        arg_max(value, e.ts) as close, count(*)::double as volume, round(sum(value), 4) as amount from events e group by event_type, date_trunc('hour', e.ts)""",
    "day": """select o_orderpriority as code, o_orderdate::date as ts, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
        arg_max(o_totalprice, o_orderkey) as close, count(*)::double as volume, round(sum(o_totalprice), 2) as amount from orders group by 1, 2""",
    "user_day": """select user_id as code, e.ts::date as ts, arg_min(value, e.ts) as open, max(value) as high, min(value) as low,
        arg_max(value, e.ts) as close, count(*)::double as volume, round(sum(value), 4) as amount from events e group by user_id, e.ts::date""",
}
QUOTED = """select *, lag(close) over (partition by code order by ts) as prev_close, (close / lag(close) over (partition by code order by ts) - 1) * 100 as chg,
        (high - low) / lag(close) over (partition by code order by ts) * 100 as amplitude, volume / avg(volume) over (partition by code) as turnover, 10.0::double as limit_rate"""
VIEWS = {
    "ticks": "select event_type as code, event_id, ts, value as price, 1 as qty from events",
    "status_posts": "select user_id as code, ts, event_id, case event_type when 'error' then 'start' when 'signup' then 'end' else 'other' end as kind from events",
    "fund_ret": "select p_brand as code, l_shipdate::date as date, round((avg(l_discount) - 0.05) / 5, 6) as ret from lineitem join part on l_partkey = p_partkey group by 1, 2",
    "money_flow": """select o_orderpriority as code, o_orderdate::date as date,
        case when o_totalprice >= 400000 then 'xl' when o_totalprice >= 250000 then 'l' when o_totalprice >= 100000 then 'm' else 's' end as size,
        round(sum(case o_orderstatus when 'F' then o_totalprice when 'O' then -o_totalprice else 0 end), 2) as net from orders group by 1, 2, 3""",
    "votes": """select o_orderkey as vote_id, o_orderdate::date as date, o_custkey as code, 'm' || (o_orderkey % 12)::varchar as model,
        round(0.5 + (o_orderkey * 7919 % 500) / 1000.0::double, 3) as prob, o_orderstatus = 'F' as hit from orders""",
    "universe": """select s_suppkey as code, s_name as name, n_name as type, r_name as region from supplier
        join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
}

W = "(partition by code order by ts)"


def past(n: int) -> str:
    return f"(partition by code order by ts rows between {n - 1} preceding and current row)"


UPTO = "(partition by code order by ts rows between unbounded preceding and current row)"


def roll(fn: str, x: str, n: int) -> str:
    return f"(case when count({x}) over {past(n)} >= {n} then {fn}({x}) over {past(n)} end)"


def ma(x, n):
    return roll("avg", x, n)


def std(x, n):
    return roll("stddev_pop", x, n)


def total(x, n=0):
    return roll("sum", x, n) if n else f"(sum({x}) over {UPTO})"


def hhv(x, n):
    return roll("max", x, n)


def llv(x, n):
    return roll("min", x, n)


def ref(x, n=1):
    return f"(lag({x}, {n}) over {W})"


def div(a, b):
    return f"(({a}) / nullif(({b}), 0))"


def sig(c):
    return f"coalesce({c}, false)"


def smooth(x: str, alpha: float) -> str:
    """Exponential mean from the first value, over NULLs at the start."""
    return f"(case when count({x}) over {UPTO} > 0 then list_reduce(list_filter(list({x}) over {UPTO}, lambda q: q is not null), lambda a, b: a + {alpha!r}::double * (b - a)) end)"


def ema(x, n):
    return smooth(x, 2 / (n + 1))


def seeded(x: str, n: int, step: str) -> str:
    """The mean of the first n values, then ``step`` of a (last) and b (new)."""
    values = f"list_filter(list({x}) over {UPTO}, lambda q: q is not null)"
    return f"(case when {x} is not null and count({x}) over {UPTO} >= {n} then list_reduce(list_concat([list_avg(({values})[1:{n}])], ({values})[{n + 1}:]), lambda a, b: {step}) end)"


def wilder(x, n):
    return seeded(x, n, f"(a * {n - 1} + b) / {n}")


def ema_seeded(x, n):
    return seeded(x, n, f"a + {2 / (n + 1)!r}::double * (b - a)")


def base(bars: str = "hour", quoted: bool = True) -> str:
    return f"with b0 as ({BARS[bars]}), b as ({QUOTED if quoted else 'select *'}, row_number() over (partition by code order by ts) as rn from b0)"


def staged(stages: list[dict[str, str]], out: list[str], bars: str = "hour", rounded: bool = True, key: bool = True) -> str:
    """A query over bars with columns added stage by stage, and these columns as its result."""
    text, last = base(bars), "b"
    for i, stage in enumerate(stages):
        text += f", s{i} as (select *, " + ", ".join(f"{e} as {n}" for n, e in stage.items()) + f" from {last})"
        last = f"s{i}"
    cols = ", ".join(f"round({c} + 1e-9, 6) as {c}" if rounded else c for c in out)
    return f"{text} select code, cast(ts as varchar) as ts, {cols} from {last}"


def views(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
