"""Queries of the series functions, one for each function or pair of forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds
from ..functions import series as fn
from . import sqltext as q
from .build import S, steps

C = F.col


def one(name: str, column, sql: str, rounded: bool = True, before=None, before_sql=None) -> None:
    steps(f"series_{name}", [*(before or []), lambda: {"v": column()}], [*(before_sql or []), {"v": sql}], ["v"], rounded=rounded)


# element-wise
steps(
    "series_math",
    [lambda: {"rd": fn.half_even(C("close") * 3, 1), "ab": F.abs(C("chg")), "lg": F.ln("close"), "pw": F.pow("close", F.lit(1.5)), "sq": F.sqrt("volume"), "mx": fn.greatest("chg", "amplitude"), "mn": fn.least("chg", "open"), "iff": F.when(C("close") > C("open"), C("high")).otherwise(C("low"))}],
    [{"rd": "round_even(close * 3, 1)", "ab": "abs(chg)", "lg": "ln(close)", "pw": "pow(close, 1.5::double)", "sq": "sqrt(volume)", "mx": "case when chg is not null then greatest(chg, amplitude) end", "mn": "case when chg is not null then least(chg, open) end", "iff": "case when close > open then high else low end"}],
    ["rd", "ab", "lg", "pw", "sq", "mx", "mn", "iff"],
)
one("ret", lambda: S.ret("close", 3), "nth_value(close, 3) over (partition by code order by ts desc rows between unbounded preceding and unbounded following)")
one("const", lambda: S.const("close"), "last_value(close) over (partition by code order by ts rows between unbounded preceding and unbounded following)")
one("ref", lambda: S.ref("close", 5), q.ref("close", 5))
one("diff", lambda: S.diff("close", 2), f"close - {q.ref('close', 2)}")
one("std", lambda: S.std("close", 20), q.std("close", 20))
one("sum", lambda: S.total("volume", 10), q.total("volume", 10))
one("sum_all", lambda: S.total("volume"), q.total("volume"))
one("ma", lambda: S.ma("close", 10), q.ma("close", 10))
one("get_ma", lambda: S.ma("close", 20) - S.ma("close", 50), f"{q.ma('close', 20)} - {q.ma('close', 50)}")
one("hhv", lambda: S.hhv("high", 15), q.hhv("high", 15))
one("llv", lambda: S.llv("low", 15), q.llv("low", 15))
one("hhvbars", lambda: S.hhvbars("high", 12), f"case when rn >= 12 then rn - (max(struct_pack(v := high, rn := rn)) over {q.past(12)}).rn end")
one("llvbars", lambda: S.llvbars("low", 12), f"case when rn >= 12 then rn - (max(struct_pack(v := -low, rn := rn)) over {q.past(12)}).rn end")
one("wma", lambda: S.wma("close", 6), "(" + " + ".join(f"lag(close, {k}) over {q.W} * {6 - k}" for k in range(6)) + ") / 21")
one("avedev", lambda: S.avedev("close", 14), f"case when rn >= 14 then list_avg(list_transform(w, lambda x: abs(x - list_avg(w)))) end", before_sql=[{"w": f"list(close) over {q.past(14)}"}])
one("slope", lambda: S.slope("close", 10), f"case when rn >= 10 then regr_slope(close, rn) over {q.past(10)} end")
one("forecast", lambda: S.forecast("close", 10), f"case when rn >= 10 then regr_slope(close, rn) over {q.past(10)} * rn + regr_intercept(close, rn) over {q.past(10)} end")

UP, UP_SQL = [lambda: {"c": fn.sig(C("close") > C("open"))}], [{"c": q.sig("close > open")}]
one("count", lambda: S.count("c", 9), q.total("c::int", 9), before=UP, before_sql=UP_SQL)
one("every", lambda: S.every("c", 3), q.sig(f"{q.total('c::int', 3)} = 3"), False, UP, UP_SQL)
one("exist", lambda: S.exist("c", 4), q.sig(f"{q.total('c::int', 4)} > 0"), False, UP, UP_SQL)
one("last", lambda: S.lasting("c", 4, 2), q.sig("sum(c::int) over (partition by code order by ts rows between 4 preceding and 2 preceding) = 3"), False, UP, UP_SQL)
one("barslast", lambda: S.barslast("c"), f"rn - coalesce(max(case when c then rn end) over {q.UPTO}, 0)", True, UP, UP_SQL)
one("barslastcount", lambda: S.barslastcount("c"), f"rn - coalesce(max(case when not c then rn end) over {q.UPTO}, 0)", True, UP, UP_SQL)
one("barssincen", lambda: S.barssincen("c", 8), f"case when rn >= 8 then coalesce(rn - min(case when c then rn end) over {q.past(8)}, 0) else 0 end", True, UP, UP_SQL)
one("valuewhen", lambda: S.valuewhen("c", "close"), f"last_value(case when c then close end ignore nulls) over {q.UPTO}", True, UP, UP_SQL)
one("between", lambda: fn.between("close", "open", "prev_close"), q.sig("close > open and close < prev_close or close < open and close > prev_close"), False)

MAS, MAS_SQL = [lambda: {"a": S.ma("close", 5), "b": S.ma("close", 10)}], [{"a": q.ma("close", 5), "b": q.ma("close", 10)}]
for mode, sql in {
    "rise": f"{q.sig('a > b')} and not {q.sig(f'{q.ref('a')} > {q.ref('b')}')} and rn > 1",
    "either": f"{q.sig('a > b')} != {q.sig(f'{q.ref('a')} > {q.ref('b')}')} and rn > 1",
    "sign": q.sig(f"{q.ref('a')} - {q.ref('b')} < 0 and a - b > 0"),
    "touch": q.sig(f"a >= b and {q.ref('a')} < {q.ref('b')}"),
}.items():
    one(f"cross_{mode}", lambda mode=mode: S.cross("a", "b", mode), sql, False, MAS, MAS_SQL)
one("longcross", lambda: S.longcross("a", "b", 3), q.sig("sum((a < b)::int) over (partition by code order by ts rows between 3 preceding and 1 preceding) = 3 and a > b"), False, MAS, MAS_SQL)


def folded(name: str, make, sql: str, rounded: bool = True, before=None, before_sql=None) -> None:
    steps(f"series_{name}", [*(before or []), lambda: {"v": make()}], [*(before_sql or []), {"v": sql}], ["v"], rounded=rounded)


folded("ema", lambda: folds.ema("close", 12), q.ema("close", 12))
folded("ema_over_nulls", lambda: folds.ema("chg", 12), q.ema("chg", 12))
folded("sma_cn", lambda: folds.sma_cn("close", 9, 2), q.smooth("close", 2 / 9))
folded("sma_cn_seeded", lambda: folds.sma_cn_seeded("close", 9, 2), q.seeded("close", 9, "(2 * b + 7 * a) / 9"))
folded(
    "dma",
    lambda: folds.dma("close", "f"),
    "list_reduce(l, lambda a, b: struct_pack(x := b.f * b.x + (1 - b.f) * a.x, f := b.f)).x",
    before=[lambda: {"f": fn.div(C("volume"), C("volume") + 20)}],
    before_sql=[{"f": "volume / (volume + 20)"}, {"l": f"list(struct_pack(x := close, f := f)) over {q.UPTO}"}],
)
folded(
    "filter",
    lambda: folds.filtered("c", 4),
    "list_reduce(l, lambda a, b: case when a >= 1 and a <= 4 then (a + 1) % 5 when b = 5 then 1 else 0 end) = 1 or (rn = 1 and c)",
    False,
    UP,
    # a number: 1 just fired, 2..4 and 0 quiet bars; the first entry is the state before the series
    [*UP_SQL, {"l": f"list_concat([0], list(case when c then 5 else 6 end) over {q.UPTO})"}],
)
folded("toprange", lambda: folds.run_of_lower("high"), "coalesce((select rn - 1 - max(i) from (select unnest(range(1, len(l))) as i) where l[i] >= high), 0)", before_sql=[{"l": f"list(high) over {q.UPTO}"}])
folded("lowrange", lambda: folds.run_of_lower("low", -1), "coalesce((select rn - 1 - max(i) from (select unnest(range(1, len(l))) as i) where l[i] <= low), 0)", before_sql=[{"l": f"list(low) over {q.UPTO}"}])
