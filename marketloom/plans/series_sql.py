"""DuckDB SQL of recursions and regressions, for checks of the queries beside them.

A recursion along a symbol is a recursive query over its row numbers; a
regression is a Gram matrix from window or group sums, eliminated step by step.
"""

from __future__ import annotations

from marketloom.functions import hashed
from marketloom.sources import frames

EXPANDING = "partition by symbol order by day rows between unbounded preceding and 1 preceding"


def rolling(n: int | None) -> str:
    return EXPANDING if n is None else f"partition by symbol order by day rows between {n} preceding and 1 preceding"


def gram(x: list[str], y: str, over: str = "", ok: str = "true") -> str:
    """Select list of the sums of products of a constant, x and y."""
    names = ["1.0::double", *x]
    sums = [f"sum(case when {ok} then {a} * {b} end) {over} as a{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    sums += [f"sum(case when {ok} then {a} * {y} end) {over} as b{i}" for i, a in enumerate(names)]
    return ", ".join([*sums, f"sum(case when {ok} then {y} * {y} end) {over} as yy", f"count(case when {ok} then 1 end) {over} as n"])


def solved(name: str, source: str, k: int, keep: str, ridge: float = 0.0) -> str:
    """CTEs that end in `name`: keep, n, yy, x0 ... (solution) and ss (explained sum of squares)."""
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    extra = f" + {ridge!r}" if ridge else ""
    out = [f"{name}_0 as (select {keep}, n, yy, " + ", ".join([f"a{i}_{j}{extra if i == j else ''} as a{i}_{j}" for i, j in cells] + [f"b{i}" for i in range(k)]) + f" from {source})"]
    for p in range(k - 1):
        step = [f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} as a{i}_{j}" if i > p else f"a{i}_{j}" for i, j in cells]
        step += [f"b{i} - a{p}_{i} * b{p} / a{p}_{p} as b{i}" if i > p else f"b{i}" for i in range(k)]
        out.append(f"{name}_{p + 1} as (select {keep}, n, yy, {', '.join(step)} from {name}_{p})")
    last = f"{name}_{k - 1}"
    for i in range(k - 1, -1, -1):
        rest = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, k))
        out.append(f"{name}_x{i} as (select *, (b{i}{rest}) / a{i}_{i} as x{i} from {last})")
        last = f"{name}_x{i}"
    ss = " + ".join(f"b{i} * b{i} / a{i}_{i}" for i in range(k))
    out.append(f"{name} as (select *, {ss} as ss from {last})")
    return ", ".join(out)


def past_fit(name: str, source: str, x: list[str], y: str, window: int | None = None, least: int | None = None, ridge: float = 1e-8) -> str:
    """CTEs: `name` has symbol, day and x0 ... of the fit on the rows before; null until `least` rows count."""
    k = len(x) + 1
    ok = " and ".join(f"{c} is not null" for c in [*x, y])
    return f"{name}_g as (select symbol, day, {gram(x, y, f'over ({rolling(window)})', ok)} from {source}), " + solved(f"{name}_s", f"{name}_g", k, "symbol, day", ridge) + (
        f", {name} as (select symbol, day, " + ", ".join(f"case when n >= {least or 2 * k} then x{i} end as x{i}" for i in range(k)) + f" from {name}_s)"
    )


def fitted(fit: str, x: list[str]) -> str:
    return f"({fit}.x0" + "".join(f" + {fit}.x{i + 1} * {c}" for i, c in enumerate(x)) + ")"


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def along(name: str, source: str, columns: dict[str, str], first: dict[str, str]) -> str:
    """Recursive CTE over source (symbol, k from 1): columns of the row before are p.*, the row's own t.*."""
    start = ", ".join(f"{v} as {c}" for c, v in first.items())
    step = ", ".join(columns[c] for c in first)
    return f"{name} as (select symbol, k, {start} from {source} t where k = 1 union all select t.symbol, t.k, {step} from {name} p join {source} t on t.symbol = p.symbol and t.k = p.k + 1)"


def mean_along(name: str, source: str, value: str, alpha: str) -> str:
    return along(name, source, {"e": f"(1 - {alpha}) * p.e + {alpha} * t.{value}"}, {"e": f"t.{value}::double"})


HARX = ["lv", "lw", "lm"]


def expanding_har(lv: str) -> str:
    """CTEs that end in f: symbol, day, y, expanding, rolling, shrunk, combined."""
    panel = ", ".join(f"0.5 * x{i} + 0.5 * avg(x{i}) over (partition by day) as x{i}" for i in range(4))
    return f"""{lv}, {past_fit('e', 'h', HARX, 'y')}, {past_fit('r', 'h', HARX, 'y', 500)}, s as (select symbol, day, {panel} from r),
      f0 as (select h.symbol, h.day, y, {fitted('e', HARX)} as expanding, {fitted('r', HARX)} as rolling, {fitted('s', HARX)} as shrunk from h join e using (symbol, day) join r using (symbol, day) join s using (symbol, day)),
      f as (select *, exp((expanding + rolling + shrunk) / 3) as combined from f0)"""


def forecast_grid(lv: str) -> str:
    loss = lambda f: f"avg(exp(y - {f}) - (y - {f}) - 1)"
    ctes, parts = [f"{lv}, d as (select *, lead(day) over (partition by symbol order by day) - day as gap from h)"], []
    for w in (None, 250, 750):
        n = w or 0
        ctes.append(past_fit(f"e{n}", "d", HARX, "y", w))
        ctes.append(f"g{n} as (select d.symbol, d.day, y, gap, {fitted(f'e{n}', HARX)} as g from d join e{n} using (symbol, day))")
        o = f"over ({EXPANDING})"
        ctes.append(
            f"q{n} as (select *, case when count(case when g is not null and y is not null then 1 end) {o} >= 30 then regr_slope(y, g) {o} end as slope, regr_intercept(y, g) {o} as icpt, var_samp(y - g) {o} as s2 from g{n})"
        )
        parts.append(
            f"select symbol, round({loss('g')}, 5) as plain, round({loss('(icpt + slope * g)')}, 5) as recalibrated, round(avg(exp(g + 0.5 * s2)), 5) as mean_level, count(*) as n, {n}::integer as window from q{n} where gap <= 4 and y is not null and g is not null and slope is not null group by 1"
        )
    return ", ".join(ctes) + " " + " union all ".join(parts)


def jump_model(ret2: str) -> str:
    x = ["lv", "lw", "jump"]
    return f"""with {frames.HOURLY}, {ret2}, m as (select symbol, day, sum(r * r) as rv, pi() / 2 * sum(abs(r) * abs(r1)) as bpv from ret2 group by 1, 2 having count(r) > 0),
      v as (select symbol, day, ln(greatest(rv, 1e-12)) as lv, ln(1 + greatest(rv - bpv, 0)) as jump from m),
      h as (select *, case when count(lv) over a = 5 then avg(lv) over a end as lw, lead(lv) over (partition by symbol order by day) as y from v window a as (partition by symbol order by day rows between 4 preceding and current row)),
      {past_fit('e', 'h', x, 'y', least=9)} select h.symbol, h.day, round(y, 6) as y, round({fitted('e', x)}, 4) as forecast from h join e using (symbol, day)"""


def full_design(ret2: str) -> str:
    return f"""with {frames.HOURLY}, {ret2}, m as (select symbol, day, sum(r * r) as rv, count(r) / 3 * sum(r * r * r * r) as rq, pi() / 2 * sum(abs(r) * abs(r1)) as bpv,
      sum(case when r > 0 then r * r when r is not null then 0 end) as rsp, sum(case when r < 0 then r * r when r is not null then 0 end) as rsn, count(r) as n from ret2 group by 1, 2 having count(r) > 0),
      v as (select *, ln(greatest(rv, 1e-12)) as lv, ln(greatest(sqrt(greatest(rq, 1e-12)) / greatest(rv, 1e-12), 1e-12)) as lq, ln(greatest(rsp, 1e-12)) as lp, ln(greatest(rsn, 1e-12)) as ln from m),
      z as (select *, case when count(lv) over a = 5 then avg(lv) over a end as lw, case when count(lv) over t = 10 then avg(lv) over t end as lm, lead(lv) over (partition by symbol order by day) as y,
        case when count(lv) over p = 10 then 1 / (1 + exp(-1.5 * (lv - avg(lv) over p) / greatest(stddev_samp(lv) over p, 1e-8))) end as regime from v
        window a as (partition by symbol order by day rows between 4 preceding and current row), t as (partition by symbol order by day rows between 9 preceding and current row), p as (partition by symbol order by day rows between 10 preceding and 1 preceding))
      select symbol, day, n, {', '.join(f'round({c}, 6) as {c}' for c in ('rv', 'rq', 'bpv', 'rsp', 'rsn', 'lv', 'lq', 'lp', 'ln', 'lw', 'lm', 'regime', 'y'))}, round(lq * lv, 6) as lqv from z"""


def seasonal_ewma(ret: str) -> str:
    return recursive(f"""with {frames.HOURLY}, {ret}, s as (select symbol, hour(ts) as hour, stddev_samp(r) as s from ret where r is not null group by 1, 2 having count(r) >= 2), f as (select symbol, hour, s / avg(s) over (partition by symbol) as factor from s),
      a as (select symbol, ts, case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as r from hourly window w as (partition by symbol order by ts)),
      x as (select a.symbol, ts, factor, (r / greatest(factor, 1e-6)) ** 2 as x, row_number() over (partition by a.symbol order by ts) as k from a join f on a.symbol = f.symbol and hour(ts) = f.hour where r is not null),
      {mean_along('v', 'x', 'x', '0.06::double')} select x.symbol, ts, round(sqrt(e) * factor, 5) as sigma from x join v using (symbol, k)""")


def weighted_models(returns: str) -> str:
    loss = lambda m: f"ln(p.{m}) + p.p / p.{m}"
    least = "least(" + ", ".join(map(loss, "abc")) + ")"
    g = {m: f"p.w{m} * exp(-0.1 * ({loss(m)} - {least}))" for m in "abc"}
    total = "(" + " + ".join(g.values()) + ")"
    columns = {c: f"t.{c}" for c in "pabc"} | {f"w{m}": f"{v} / {total}" for m, v in g.items()}
    first = {c: f"t.{c}" for c in "pabc"} | {f"w{m}": "1 / 3::double" for m in "abc"}
    o = lambda n: f"avg(p) over (partition by symbol order by day rows between {n} preceding and 1 preceding)"
    return recursive(f"""{returns}, q as (select symbol, day, greatest(r * r, 1e-8) as p from ret where r is not null), x as (select symbol, day, p, {o(5)} as a, {o(20)} as b, {o(100)} as c, row_number() over (partition by symbol order by day) - 100 as k from q),
      y as (select * from x where k >= 1), {along('w', 'y', columns, first)} select y.symbol, y.day, round(wa * w.a + wb * w.b + wc * w.c, 6) as mixed from y join w using (symbol, k)""")


def online_mixture(bins: str) -> str:
    experts = ((0.34, 0.33, 0.33), (0.6, 0.2, 0.2), (0.2, 0.2, 0.6))
    loss = [f"-ln(case t.late when 0 then {e[0]}::double when 1 then {e[1]}::double else {e[2]}::double end)" for e in experts]
    g = [f"p.w{i} * exp(-0.5 * ({x} - least({', '.join(loss)})))" for i, x in enumerate(loss)]
    total = "(" + " + ".join(g) + ")"
    columns = {f"w{i}": f"case when t.late is null then p.w{i} else 0.99::double * {x} / {total} + 0.01::double / 3 end" for i, x in enumerate(g)}
    mixed = lambda c: " + ".join(f"w{i} * {e[c]}::double" for i, e in enumerate(experts))
    total_p = "(" + " + ".join(mixed(c) for c in range(3)) + ")"
    return recursive(f"""{bins}, x as (select symbol, day, row_number() over w as k, lag(bin, 5) over w as late from b window w as (partition by symbol order by day)),
      {along('m', 'x', columns, {f'w{i}': '1 / 3::double' for i in range(3)})} select symbol, day, {', '.join(f'round(({mixed(c)}) / {total_p}, 6) as p{c}' for c in range(3))}, round(w0, 6) as w0 from x join m using (symbol, k)""")


def quantile_of(held: str, level: str) -> str:
    """Linear quantile of a sorted list."""
    at = f"((len({held}) - 1) * ({level}))"
    return f"({held}[floor({at})::integer + 1] + ({at} - floor({at})) * ({held}[least(floor({at})::integer + 2, len({held}))] - {held}[floor({at})::integer + 1]))"


def held_before(value: str, n: int) -> str:
    return f"list_sort(list({value}) over (partition by symbol order by day rows between {n} preceding and 1 preceding))"


def adaptive_tails(returns: str) -> str:
    clip = lambda v: f"least(greatest({v}, 1e-4), 1 - 1e-4)"
    hit = lambda level: f"(t.z <= {quantile_of('t.held', level)})::integer"
    # The row's level is known from the row before; its hit moves the next one.
    x = "x as (select symbol, day, z, held, row_number() over (partition by symbol order by day) as k from held where n >= 250)"
    move_a, miss = "t.level + 0.005 * (0.05 - t.hit)", "(0.05 - t.hit)"
    aci = f"""aci as (select symbol, k, level, {hit('level')} as hit from (select *, 0.05::double as level from x where k = 1) t
      union all select symbol, k, level, {hit('level')} from (select n.*, {clip(move_a)} as level from aci t join x n on n.symbol = t.symbol and n.k = t.k + 1) t)"""
    integral = f"(0.98 * t.integral + {miss})"
    pid = f"""pid as (select symbol, k, level, integral, last, {hit('level')} as hit from (select *, 0.05::double as level, 0.0::double as integral, 0.0::double as last from x where k = 1) t
      union all select symbol, k, level, integral, last, {hit('level')} from (select n.*, {clip(f't.level + 0.01 * {miss} + 0.001 * {integral} + 0.002 * (t.last - t.hit)')} as level, {integral} as integral, t.hit::double as last from pid t join x n on n.symbol = t.symbol and n.k = t.k + 1) t)"""
    tail = lambda n: f"round({n}, 6) as {n}, round({quantile_of('held', n)}, 6) as {n[:3]}_q, round(list_avg(list_filter(held, lambda v: v <= {quantile_of('held', n)})), 6) as {n[:3]}_es"
    return recursive(f"""{returns}, zs as (select symbol, day, r as z from ret where r is not null), held as (select symbol, day, z, {held_before('z', 500)} as held, row_number() over (partition by symbol order by day) - 1 as n from zs),
      {x}, {aci}, {pid}, m as (select x.symbol, x.day, x.held, aci.level as aci_level, pid.level as pid_level from x join aci using (symbol, k) join pid using (symbol, k)), o as (select symbol, day, {tail('aci_level')}, {tail('pid_level')} from m)
      select zs.symbol, zs.day, aci_level, aci_q, aci_es, pid_level, pid_q, pid_es from zs left join o using (symbol, day)""")


def tracking(returns: str) -> str:
    gammas = {"a": 0.01, "b": 0.05, "c": 0.2}
    loss = {m: f"greatest(0.05 * (p.z - p.{m}), (0.05 - 1) * (p.z - p.{m}))" for m in gammas}
    columns = {m: f"p.{m} + {g} * t.spread * (0.05 - (p.z <= p.{m})::integer)" for m, g in gammas.items()} | {f"w{m}": f"p.w{m} - 2 * {x}" for m, x in loss.items()} | {"z": "t.z"}
    first = {m: "t.q0" for m in gammas} | {f"w{m}": "0.0::double" for m in gammas} | {"z": "t.z"}
    share = {m: f"exp(w{m} - greatest(wa, wb, wc))" for m in gammas}
    mixed = "(" + " + ".join(f"{v} * {m}" for m, v in share.items()) + ") / (" + " + ".join(share.values()) + ")"
    return recursive(f"""{returns}, zs as (select symbol, day, r as z, row_number() over (partition by symbol order by day) as i from ret where r is not null), s as (select symbol, quantile_cont(z, 0.05) as q0, stddev_pop(z) as spread from zs where i <= 100 group by 1),
      x as (select zs.symbol, day, z, i - 100 as k, q0, spread from zs join s using (symbol) where i > 100), {along('m', 'x', columns, first)},
      o as (select m.symbol, day, m.b as tracked, {mixed} as mixed from m join x using (symbol, k)) select zs.symbol, zs.day, round(tracked, 6) as tracked, round(mixed, 6) as mixed from zs left join o using (symbol, day)""")


def online_sets(three: str) -> str:
    cut = "coalesce(t.held[ceil((len(t.held) + 1) * (1 - level))::integer], 'inf'::double)"
    own = "case t.y when 0 then 1 - t.p0 when 1 then 1 - t.p1 else 1 - t.p2 end"
    size = f"(1 - t.p0 <= {cut})::integer + (1 - t.p1 <= {cut})::integer + (1 - t.p2 <= {cut})::integer"
    row = f"select symbol, k, level, {size} as size, ({own} <= {cut})::integer as covered from"
    return recursive(f"""{three}, s as (select *, case y when 0 then 1 - p0 when 1 then 1 - p1 else 1 - p2 end as score from p), h as (select *, {held_before('score', 500)} as held, row_number() over (partition by symbol order by day) - 100 as k from s), x as (select * from h where k >= 1),
      m as ({row} (select *, 0.1::double as level from x where k = 1) t union all {row} (select n.*, least(greatest(t.level + 0.01 * (0.1 - (1 - t.covered)), 1e-4), 0.999) as level from m t join x n on n.symbol = t.symbol and n.k = t.k + 1) t)
      select symbol, count(*) as n, round(avg(covered), 6) as coverage, round(avg(size), 6) as mean_size, round(avg(level), 6) as level from m group by 1""")


def trend(daily: str) -> str:
    """Supertrend (10, 3), directional lines (14) and Keltner (20)."""
    fourteen, ten, twenty = "(1.0::double / 14)", "(1.0::double / 10)", "(1.0::double / 20)"
    eps = "1e-12"
    top, bottom = "t.top", "t.bottom"
    ceiling = f"case when {top} < p.ceiling or p.c > p.ceiling then {top} else p.ceiling end"
    floor_ = f"case when {bottom} > p.floor or p.c < p.floor then {bottom} else p.floor end"
    side = f"case when p.side = 1 and t.close < {floor_} then -1 when p.side = -1 and t.close > {ceiling} then 1 else p.side end"
    band = along("st", "bands", {"ceiling": ceiling, "floor": floor_, "side": side, "c": "t.close"}, {"ceiling": top, "floor": bottom, "side": "1", "c": "t.close"})
    return recursive(f"""{daily}, src as (select symbol, day, high, low, close, row_number() over w as k, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr, high - lag(high) over w as up, lag(low) over w - low as down from daily window w as (partition by symbol order by day)),
      dm as (select *, case when up > down and up > 0 then up else 0 end as plus, case when down > up and down > 0 then down else 0 end as minus from src),
      {mean_along('a14', 'dm', 'tr', fourteen)}, {mean_along('p14', 'dm', 'plus', fourteen)}, {mean_along('m14', 'dm', 'minus', fourteen)}, {mean_along('a10', 'dm', 'tr', ten)}, {mean_along('a20', 'dm', 'tr', twenty)}, {mean_along('e20', 'dm', 'close', '(2.0::double / 21)')},
      di as (select dm.symbol, dm.day, dm.k, 100 * p14.e / greatest(a14.e, {eps}) as p, 100 * m14.e / greatest(a14.e, {eps}) as m from dm join a14 using (symbol, k) join p14 using (symbol, k) join m14 using (symbol, k)),
      dx as (select *, 100 * abs(p - m) / greatest(p + m, {eps}) as dx from di), {mean_along('x14', 'dx', 'dx', fourteen)},
      bands as (select symbol, k - 10 as k, close, (high + low) / 2 + 3 * e as top, (high + low) / 2 - 3 * e as bottom from dm join a10 using (symbol, k) where k > 10), {band}
      select s.symbol, s.day, round(case st.side when 1 then st.floor when -1 then st.ceiling end, 5) as supertrend, coalesce(st.side, 0)::integer as side, round(case when s.k > 28 then x14.e end, 5) as adx, round(case when s.k > 14 then di.p end, 5) as di_plus, round(case when s.k > 14 then di.m end, 5) as di_minus,
      round(e20.e, 5) as keltner_mid, round(case when s.k > 20 then e20.e - 2 * a20.e end, 5) as keltner_low, round(case when s.k > 20 then e20.e + 2 * a20.e end, 5) as keltner_high
      from src s join di using (symbol, k) join x14 using (symbol, k) join e20 using (symbol, k) join a20 using (symbol, k) left join st on st.symbol = s.symbol and st.k = s.k - 10""")


def levels(swing: str) -> str:
    near = "abs(x.level - t.p) <= 0.0015 * greatest(t.p, 1e-12)"
    place = f"list_position(list_transform(p.held, lambda x: {near}), true)"
    moved = "list_transform(p.held, lambda x, i: case when i = t_place then {'level': (x.level * x.n + t.p) / (x.n + 1), 'n': x.n + 1, 'last': t.t} else x end)".replace("t_place", place)
    start = "[{'level': t.p::double, 'n': 1::bigint, 'last': t.t::bigint}]"
    held = along("m", "x", {"held": f"case when {place} > 0 then {moved} else list_append(p.held, {start}[1]) end"}, {"held": start})
    return recursive(f"""{swing}, hit as (select symbol, (day - date '1970-01-01')::bigint as t, high as p from sw where sh union all select symbol, (day - date '1970-01-01')::bigint, low from sw where sl),
      x as (select *, row_number() over (partition by symbol order by t, p) as k from hit), {held}, l as (select symbol, unnest(held) as l from (select symbol, arg_max(held, k) as held from m group by 1)),
      r as (select symbol, row_number() over (partition by symbol order by l.n desc, l.last desc, l.level) as rank, l.level as level, l.n as touches, l.last as last from l) select symbol, rank, round(level, 5) as level, touches, last from r where rank <= 6""")


def causal_bundle(daily: str) -> str:
    """Indicators of all rows and of all but the last 40, compared."""
    parts = []
    for n, source in (("f", "daily"), ("c", "(select * from (select *, row_number() over (partition by symbol order by day desc) as back from daily) where back > 40)")):
        parts.append(f"{n}s as (select symbol, day, close, row_number() over w as k, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr, greatest(close - coalesce(lag(close) over w, close), 0) as up, greatest(coalesce(lag(close) over w, close) - close, 0) as down from {source} window w as (partition by symbol order by day))")
        for e, (v, a) in {"e20": ("close", "(2.0::double / 21)"), "e12": ("close", "(2.0::double / 13)"), "e26": ("close", "(2.0::double / 27)"), "a14": ("tr", "(1.0::double / 14)"), "u14": ("up", "(1.0::double / 14)"), "d14": ("down", "(1.0::double / 14)")}.items():
            parts.append(mean_along(n + e, n + "s", v, a))
        parts.append(f"{n}l as (select symbol, k, x.e - y.e as line from {n}e12 x join {n}e26 y using (symbol, k))")
        parts.append(mean_along(n + "s9", n + "l", "line", "(2.0::double / 10)"))
        joins = " ".join(f"join {n}{e} {e} using (symbol, k)" for e in ("e20", "a14", "u14", "d14", "s9"))
        parts.append(f"{n}o as (select s.symbol, s.day, e20.e as ema20, case when s.k > 14 then 100 - 100 / (1 + u14.e / greatest(d14.e, 1e-12)) end as rsi14, case when s.k > 14 then a14.e end as atr14, l.line as macd, s9.e as macd_signal, l.line - s9.e as macd_rest from {n}s s {joins} join {n}l l using (symbol, k))")
    out = ", ".join(f"round(max(abs(a.{c} - b.{c})), 6) as {c}" for c in ("ema20", "rsi14", "atr14", "macd", "macd_signal", "macd_rest"))
    return recursive(f"{daily}, {', '.join(parts)} select a.symbol, {out} from fo a join co b using (symbol, day) group by 1")


def exponential_sums(returns: str) -> str:
    column = lambda rate: f"p.{{}} * exp(-{rate}::double) + {rate}::double * t.r"
    return recursive(f"""{returns}, x as (select symbol, day, r, row_number() over (partition by symbol order by day) as k from ret where r is not null),
      {along('m', 'x', {'a': column(0.1).format('a'), 'b': column(0.01).format('b')}, {'a': '0.1::double * t.r', 'b': '0.01::double * t.r'})} select symbol, day, round(a, 6) as k10, round(b, 6) as k100 from x join m using (symbol, k)""")


def sign_backtest(returns: str) -> str:
    return recursive(f"""{returns}, x as (select symbol, day, r, row_number() over (partition by symbol order by day) as k from ret where r is not null), {mean_along('e', 'x', 'r', '(2.0::double / 21)')},
      s as (select symbol, k, r, lag(sign(e)) over (partition by symbol order by k) as held from x join e using (symbol, k)), t as (select *, abs(held - lag(held) over (partition by symbol order by k)) as turn from s)
      select symbol, round(avg(held * r), 6) as gross, round(avg(held * r - 0.001 * coalesce(turn, 0)), 6) as net, round(avg(turn), 6) as turnover from t group by 1""")


def normal_cdf(z: str) -> str:
    """By the series of the density's integral."""
    return f"(0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5::double) + ln(pi()) / 2))))"


def t6_cdf(x: str) -> str:
    """Student t with 6 degrees of freedom, in closed form."""
    s, c2 = f"(({x}) / sqrt(6 + ({x}) ** 2))", f"(6 / (6 + ({x}) ** 2))"
    return f"(0.5 + {s} / 2 * (1 + {c2} / 2 + 0.375::double * {c2} ** 2))"


def beta_tail(y: str, a: str, b: str) -> str:
    """1 - I_y(b, a) by its series; y small."""
    terms = f"list_sum(list_transform(range(0, 400), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({b} + 1 + k) + lgamma({b} + 1) + k * ln(greatest({y}, 1e-300)))))"
    return f"(1 - exp({b} * ln(greatest({y}, 1e-300)) + {a} * ln(1 - {y}) - ln({b}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * {terms})"


def dynamic_quantile(tail: str) -> str:
    x = ["d1", "d2", "d3", "d4", "q"]
    return f"""{tail}, d as (select symbol, q, hit - 0.05 as y, {', '.join(f'lag(hit - 0.05, {k}) over w as d{k}' for k in range(1, 5))} from h window w as (partition by symbol order by day)),
      g as (select symbol, {gram(x, 'y')} from d where d4 is not null group by 1), {solved('s', 'g', 6, 'symbol')}, e as (select symbol, ss / (0.05 * 0.95) as dq from s)
      select symbol, round(dq, 4) as dq, round(exp(-dq / 2) * (1 + dq / 2 + dq * dq / 8), 5) as p from e"""


def granger(returns: str) -> str:
    own, both = [f"y{k}" for k in (1, 2, 3)], [f"{v}{k}" for v in "yx" for k in (1, 2, 3)]
    lags = ", ".join(f"lag({v}, {k}) over w as {v}{k}" for v in "yx" for k in (1, 2, 3))
    return f"""{returns}, o as (select symbol, day, r from ret where r is not null), p as (select a.symbol as cause, b.symbol as effect, day, a.r as x, b.r as y from o a join o b using (day) where a.symbol <> b.symbol),
      l as (select *, {lags} from p window w as (partition by cause, effect order by day)), u as (select * from l where x3 is not null and y3 is not null),
      gs as (select cause, effect, {gram(own, 'y')} from u group by 1, 2), gl as (select cause, effect, {gram(both, 'y')} from u group by 1, 2), {solved('s', 'gs', 4, 'cause, effect')}, {solved('l2', 'gl', 7, 'cause, effect')},
      f as (select cause, effect, (l2.n - 7)::double as d2, ((s.yy - s.ss) - (l2.yy - l2.ss)) / 3 / ((l2.yy - l2.ss) / (l2.n - 7)) as f from s join l2 using (cause, effect))
      select cause, effect, round(f, 4) as f, round({beta_tail('(3 * f / (d2 + 3 * f))', '(d2 / 2)', '1.5::double')}, 5) as p from f"""


def clustered(bins: str) -> str:
    return f"""{bins}, w as (select b.symbol, day, lag(bin) over (partition by b.symbol order by day) as l1, bin, n_bars as nb from b join daily using (symbol, day)),
      v as (select symbol, year(day) * 100 + month(day) as month, (l1 = 0)::integer::double as x, (bin = 2)::integer::double as y, nb::double as c from w where l1 is not null and bin is not null),
      s as (select symbol, regr_slope(x, c) as sx, regr_intercept(x, c) as ix, regr_slope(y, c) as sy, regr_intercept(y, c) as iy, sum(x * x) - count(*) * avg(x) ** 2 as spread from v group by 1),
      r as (select symbol, month, x - ix - sx * c as x, y - iy - sy * c as y, spread from v join s using (symbol)), b0 as (select symbol, sum(x * y) / sum(x * x) as b, sum(x * x) as xx, any_value(spread) as spread from r group by 1),
      k as (select symbol, month, sum(x * (y - b * x)) as s from r join b0 using (symbol) group by 1, 2), q as (select symbol, sum(s * s) as ss, count(*) as g from k group by 1)
      select symbol, round(case when xx > 0.01 * greatest(spread, 1e-12) then b end, 6) as b, round(case when xx > 0.01 * greatest(spread, 1e-12) then b / sqrt(greatest(ss / xx / xx * g / greatest(g - 1, 1), 1e-12)) end, 4) as t from b0 join q using (symbol)"""


def overfitting(returns: str) -> str:
    lags = range(1, 7)
    return f"""{returns}, o as (select symbol, day, r, ntile(8) over (partition by symbol order by day) as block, {', '.join(f'lag(r, {k}) over (partition by symbol order by day) as l{k}' for k in lags)} from ret where r is not null),
      g as (select block, unnest([{', '.join(f'avg(sign(l{k}) * r)' for k in lags)}]) as m, unnest([{', '.join(map(str, lags))}]) as s from o group by 1),
      h as (select half, s, avg(m) filter ((half >> (block - 1)::integer) & 1 = 1) as inside, avg(m) filter ((half >> (block - 1)::integer) & 1 = 0) as outside from g, (select range::integer as half from range(256)) where bit_count(half) = 4 group by 1, 2),
      b as (select half, arg_max(outside, inside) as best from h group by 1), c as (select half, count(*) filter (outside < best) + 1 as place from h join b using (half) group by 1) select round(avg((place <= 3.5)::integer), 6) as pbo from c"""


ISOTONIC = """, f as (select p, sum(y)::double as s, count(*)::double as n from b2 group by 1), k as (select p, n, row_number() over (order by p) as i, sum(s) over (order by p) as cs, sum(n) over (order by p) as cn from f),
  a as (select x.i as i, y.i as j, (y.cs - coalesce(w.cs, 0)) / (y.cn - coalesce(w.cn, 0)) as m from k x join k y on x.i <= y.i left join k w on w.i = x.i - 1), m as (select i, j, min(m) over (partition by i order by j desc) as m from a),
  z as (select j, max(m) as v from m group by 1) select floor(p * 10)::bigint as bin, round(sum(v * n) / sum(n), 6) as calibrated, sum(n)::bigint as n from k join z on k.i = z.j group by 1"""


def optimal_stopping(returns: str) -> str:
    q = ", ".join(repr((i + 0.5) / 40) for i in range(40))
    at = "((greatest(least(g + s, 3), -3) + 3) / 0.05)"
    lo = f"least(floor({at} + 1e-9)::integer, 119)"
    inner = f"(v[{lo} + 1] + ({at} - {lo}) * (v[{lo} + 2] - v[{lo} + 1]))"
    ahead = f"list_transform(grid, lambda g: list_avg(list_transform(q, lambda s: {inner})) - 0.002)"
    step = f"select symbol, left_ + 1 as left_, q, grid, {ahead} as ahead from m where left_ < 10"
    return recursive(f"""{returns}, s as (select symbol, quantile_cont(r, [{q}]) as q from ret where r is not null group by 1), g as (select symbol, q, list_transform(range(0, 121), lambda i: -3 + 0.05::double * i) as grid from s),
      m as (select symbol, 0 as left_, q, grid, list_transform(grid, lambda g: least(g, 1.5)) as v, grid as ahead union all select symbol, left_, q, grid, list_transform(range(1, 122), lambda i: greatest(least(grid[i], 1.5), ahead[i])), ahead from ({step})),
      o as (select symbol, left_, v[61] as value, list_filter(range(1, 122), lambda i: least(grid[i], 1.5) >= ahead[i]) as stops, grid from m where left_ > 0)
      select symbol, left_::integer as days_left, round(value, 6) as value, round(grid[stops[1]], 6) as stop_at from o""".replace("grid as ahead union", "grid as ahead from g union"))


TFIDF = r"""with w as (select doc_id, regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+') as w from documents where regexp_matches(text, '\S')),
  t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w), n as (select count(*)::double as n from w),
  f as (select doc_id, term, count(*)::double as tf from t group by 1, 2), d as (select term, ln((1 + (select n from n)) / (1 + count(*))) + 1 as idf from f group by 1),
  v as (select doc_id, term, tf * idf as v from f join d using (term)), s as (select doc_id, sqrt(sum(v * v)) as norm from v group by 1), l as (select doc_id, lag(doc_id) over (order by doc_id) as before from w),
  dots as (select l.doc_id, sum(a.v * b.v) as dot from l join v a on a.doc_id = l.doc_id join v b on b.doc_id = l.before and b.term = a.term group by 1)
  select l.doc_id, round(case when before is not null then 1 - coalesce(dot, 0) / x.norm / y.norm end, 6) as change from l left join dots using (doc_id) left join s x on x.doc_id = l.doc_id left join s y on y.doc_id = l.before"""


def bootstrapped(rows: str, value: str, statistic: str, replicates: int, block: int, seed: int = 5) -> str:
    """CTEs from rows (symbol, i from 0, n, value) to a 95 % interval of the statistic over replicates."""
    return f"""st as (select symbol, n, b, k, floor({hashed.half_sql(f"md5('{seed}|' || b || '|' || k)")} * n)::bigint as start from (select symbol, any_value(n) as n from {rows} group by 1), (select unnest(range({replicates})) as b), (select unnest(range(100000)) as k) where k < ceil(n / {block}::double)),
      picked as (select symbol, b, (start + j) % n as i from st, (select unnest(range({block})) as j) where k * {block} + j < n), bs as (select symbol, b, {statistic.format(f'r.{value}')} as v from picked join {rows} r using (symbol, i) group by symbol, b)
      select symbol, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(*) as replicates from bs group by 1"""


def equity_paths(returns: str) -> str:
    u = hashed.half_sql("md5('9|' || b || '|' || k)")
    return f"""{returns}, x as (select symbol, r / 100 as r, row_number() over (partition by symbol order by day) - 1 as i, count(*) over (partition by symbol) as n from ret where r is not null),
      st as (select symbol, n, b, k, floor({u} * n)::bigint as start from (select symbol, any_value(n) as n from x group by 1), (select unnest(range(200)) as b), (select unnest(range(25)) as k)),
      p as (select st.symbol, b, k * 10 + j as t, 5 * r as r from st, (select unnest(range(10)) as j), x where x.symbol = st.symbol and x.i = (start + j) % st.n),
      e as (select symbol, b, t, exp(sum(r) over (partition by symbol, b order by t)) as v from p), f as (select *, 1 - v / max(v) over (partition by symbol, b order by t) as dd from e),
      g as (select symbol, b, arg_max(v, t) as final, max(dd) as drawdown, sqrt(avg(dd * dd)) as ulcer, max((v <= 0.5)::integer) as ruin, max((v <= 0.8)::integer) as was_low from f group by 1, 2)
      select symbol, count(*) as paths, round(avg(final), 6) as final, round(avg(drawdown), 6) as drawdown, round(avg(ulcer), 6) as ulcer, round(avg(ruin), 6) as ruin, round(avg((final <= 0.8)::integer), 6) as ended_low, round(avg(was_low), 6) as was_low from g group by 1"""


def step_down(returns: str, draws: int) -> str:
    """Rotations of each symbol's series against its weekdays; p from the running maximum from the weakest up."""
    u = hashed.half_sql("md5('1|' || b)")
    stat = "abs(avg(r)) / (stddev_pop(r) / sqrt(count(*)))"
    return f"""{returns}, x as (select symbol, r, (isodow(day) % 7 + 1)::integer as dow, row_number() over (partition by symbol order by day) - 1 as i, count(*) over (partition by symbol) as n from ret where r is not null),
      o as (select symbol, dow, {stat} as s from x group by 1, 2), d as (select symbol, b, n, 30 + floor({u} * (n - 60))::bigint as shift from (select symbol, any_value(n) as n from x group by 1), (select unnest(range({draws})) as b)),
      z as (select a.symbol, b, a.dow, {stat.replace('(r)', '(y.r)')} as s from d join x a using (symbol) join x y on y.symbol = a.symbol and y.i = (a.i - shift + d.n) % d.n group by 1, 2, 3),
      k as (select symbol, dow, s, row_number() over (partition by symbol order by s) as place from o), w as (select z.symbol, b, z.dow, place, max(z.s) over (partition by z.symbol, b order by place) as worst, k.s from z join k on k.symbol = z.symbol and k.dow = z.dow),
      p as (select symbol, dow, any_value(place) as place, (1 + count(*) filter (worst >= s)) / ({draws} + 1)::double as p from w group by 1, 2) select symbol, dow, round(max(p) over (partition by symbol order by place desc), 6) as p from p"""


def simulated_garch() -> str:
    z = hashed.normal_sql("md5('garch|' || (k - 1))")
    return recursive(f"with x as (select 'sim' as symbol, unnest(range(1, 2001)) as k), y as (select symbol, k, {z} as z from x), " + along("m", "y", {"v": "1e-6 + 0.08 * p.v * p.z * p.z + 0.91 * p.v", "z": "t.z"}, {"v": "1e-4::double", "z": "t.z"}) + " select symbol, (k - 1)::bigint as day, round(v, 9) as variance, round(sqrt(v) * z, 8) as r from m")


def simulated_bars() -> str:
    z = hashed.normal_sql("md5('bars|' || id)")
    return f"""with n as (select unnest(range({64 * 390})) as id), r as (select id, id // 390 as day, {z} * 0.01 / sqrt(390) as r from n), p as (select id, day, exp(sum(r) over (partition by day order by id)) as p from r),
      b as (select day, arg_min(p, id) as open, max(p) as high, min(p) as low, arg_max(p, id) as close from p group by 1)
      select 'sim' as symbol, round(sqrt(avg((ln(high) - ln(low)) ** 2 / (4 * ln(2)))), 8) as parkinson, round(sqrt(avg(0.5 * (ln(high) - ln(low)) ** 2 - (2 * ln(2) - 1) * (ln(close) - ln(open)) ** 2)), 8) as gk, 0.01::double as truth from b"""


def detectable() -> str:
    u = hashed.half_sql("md5('power|' || draw || '|' || k)")
    return f"""with d as (select draw, draw % 5 as step, unnest(range(2000)) as k from (select unnest(range({5 * 64})) as draw)), m as (select draw, step, avg(({u} < 1 / 3::double * (1 + 0.05 * step))::integer) as m from d group by 1, 2)
      select round(1 + 0.05 * step, 2) as lift, round(avg(((m - 1 / 3::double) / sqrt(2 / 9::double / 2000) > 1.96)::integer), 6) as power, count(*) as samples from m group by step"""


def score_scale(returns: str, responses: list[float], memories: list[float]) -> str:
    """Grid of responses and memories; the likeliest over the first 800 rows gives the path of scales."""
    nu, log_c = 6, "(lgamma(3.5::double) - lgamma(3::double) - ln(6 * pi()) / 2)"
    u = "(7 * (p.z * p.z) / (6 * exp(2 * (t.level + p.away)) + p.z * p.z + 1e-12) - 1)"
    density = "({c} - 3.5 * ln(1 + t.z * t.z / exp(2 * (t.level + {a})) / 6) - (t.level + {a}))"
    away = f"(t.memory * p.away + t.response * {u})"
    grid = "(select unnest([" + ", ".join(f"{{'a': {a!r}::double, 'm': {m!r}::double}}" for m in memories for a in responses) + "]) as g)"
    step = f"m as (select symbol, g, k, 0.0::double as away, z, {density.format(c=log_c, a='0')} as ll from y t where k = 1 union all select t.symbol, t.g, t.k, {away}, t.z, p.ll + case when t.k <= 800 then {density.format(c=log_c, a=away)} else 0 end from m p join y t on t.symbol = p.symbol and t.g = p.g and t.k = p.k + 1)"
    q = -1.9431802805153022  # the 5 % quantile of a t with 6 degrees of freedom
    return recursive(f"""{returns}, x as (select symbol, r as z, row_number() over (partition by symbol order by day) as k from ret where r is not null), l as (select symbol, ln(greatest(stddev_pop(z) * sqrt({nu - 2} / {nu}::double), 1e-12)) as level from x where k <= 800 group by 1),
      y as (select x.symbol, k, z, level, row_number() over (partition by x.symbol, k order by g.m, g.a) as g, g.a as response, g.m as memory from x join l using (symbol), {grid}), {step},
      best as (select symbol, arg_max(g, ll) as g from (select symbol, g, max(ll) filter (k = least(800, n)) as ll from (select *, max(k) over (partition by symbol) as n from m) group by 1, 2) group by 1)
      select y.symbol, any_value(response) as response, any_value(memory) as memory, round(any_value(level), 6) as level, round(avg((y.z <= {q} * exp(level + away))::integer), 6) as rate from y join best using (symbol, g) join m using (symbol, g, k) group by 1""")


def spillover(lv: str, names: tuple[str, ...] = ("A", "N", "R"), block: str = "year(day)", among: str = "v") -> str:
    """CTEs that end in share (year, to, from, share): VAR(1) by block (of the day and its place k) and its generalised decomposition over ten steps."""
    m = range(len(names))
    x = [f"l{j}" for j in m]
    wide = ", ".join(f"max(lv) filter (symbol = '{s}') as v{i}" for i, s in enumerate(names))
    fits = ", ".join(f"g{i} as (select upto, {gram(x, f'v{i}')} from r group by 1), {solved(f's{i}', f'g{i}', len(names) + 1, 'upto', 1e-8)}" for i in m)
    joined = " ".join(f"join s{i} using (upto)" for i in m)
    error = lambda i: f"(v{i} - s{i}.x0 - " + " - ".join(f"s{i}.x{j + 1} * l{j}" for j in m) + ")"
    own = ", ".join([f"any_value(s{i}.x{j + 1}) as a{i}{j}" for i in m for j in m] + [f"avg({error(i)} * {error(j)}) as s{i}{j}" for i in m for j in m])
    dot = lambda i, j: "(" + " + ".join(f"t{i}{k} * s{k}{j}" for k in m) + ")"
    step = [" + ".join(f"a{i}{k} * t{k}{j}" for k in m) + f" as t{i}{j}" for i in m for j in m]
    step += [f"n{i}{j} + {dot(i, j)} ** 2 / s{j}{j} as n{i}{j}" for i in m for j in m]
    step += [f"d{i} + " + " + ".join(f"t{i}{k} * s{k}{l} * t{i}{l}" for k in m for l in m) + f" as d{i}" for i in m]
    first = [f"{float(i == j)}::double as t{i}{j}" for i in m for j in m] + [f"0.0::double as n{i}{j}" for i in m for j in m] + [f"0.0::double as d{i}" for i in m]
    rows = " union all ".join(f"select upto as year, '{names[i]}' as to_, '{names[j]}' as from_, n{i}{j} / d{i} / (" + " + ".join(f"n{i}{k} / d{i}" for k in m) + ") as share from w where k = 10" for i in m for j in m)
    return recursive(f"""{lv}, p as (select day, {wide} from v group by 1), f as (select *, row_number() over (order by day) - 1 as k from p where {' and '.join(f'v{i} is not null' for i in m)}), o as (select *, {block} as block, {', '.join(f'lag(v{i}) over (order by day) as l{i}' for i in m)} from f),
      u as (select distinct {block} as y from {among}), r as (select u.y as upto, o.* from o join u on o.block < u.y where l0 is not null), {fits},
      c as (select upto, count(*) as rows_, {own} from r {joined} group by 1), w as (select upto, 0 as k, {', '.join(first)} from c where rows_ + 1 >= {2 * (len(names) + 1)} union all select upto, k + 1, {', '.join(step)} from w join c using (upto) where k < 10), share as ({rows})""")


def weighted_spillover(lv: str) -> str:
    return spillover(lv) + f""", z as (select symbol, day, case when count(lv) over ({EXPANDING}) >= 60 then (lv - avg(lv) over ({EXPANDING})) / greatest(stddev_samp(lv) over ({EXPANDING}), 1e-12) end as z from v),
      q as (select year, to_, from_, share / greatest(sum(share) over (partition by year, to_), 1e-12) as share from share where to_ <> from_)
      select to_ as symbol, day, round(sum(share * z), 5) as weighted from z join q on q.from_ = z.symbol and q.year = year(day) where z is not null group by 1, 2"""


def hac_wald(returns: str) -> str:
    """Wald statistics of the other's lags: own lags are taken out of them first, so the sandwich has three rows."""
    own, other = ["y1", "y2", "y3"], ["x1", "x2", "x3"]
    keys = "cause, effect"
    lags = ", ".join(f"lag({v}, {k}) over w as {v}{k}" for v in "yx" for k in (1, 2, 3))
    fits = ", ".join(f"g{i} as (select {keys}, {gram(own, f'x{i}')} from u group by 1, 2), {solved(f'f{i}', f'g{i}', 4, keys)}" for i in (1, 2, 3))
    clean = ", ".join(f"u.x{i} - {fitted(f'f{i}', own)} as z{i}" for i in (1, 2, 3))
    lagged = ", ".join(f"sum((1 - l / (a.lags + 1)) * a.s{i + 1} * b.s{j + 1}) as p{i}_{j}, sum(case when l = 0 then a.s{i + 1} * b.s{j + 1} end) as o{i}_{j}" for i in range(3) for j in range(3))
    sums = ", ".join(f"p{i}_{j} + p{j}_{i} - o{i}_{j} as a{i}_{j}" for i in range(3) for j in range(i, 3))
    return f"""{returns}, o as (select symbol, day, r from ret where r is not null), p as (select a.symbol as cause, b.symbol as effect, day, a.r as x, b.r as y from o a join o b using (day) where a.symbol <> b.symbol),
      l as (select *, {lags} from p window w as (partition by {keys} order by day)), u as (select * from l where x3 is not null and y3 is not null), {fits},
      gl as (select {keys}, {gram(own + other, 'y')} from u group by 1, 2), {solved('fl', 'gl', 7, keys)},
      e as (select u.cause, u.effect, u.y, row_number() over (partition by u.cause, u.effect order by day) as k, {clean}, u.y - {fitted('fl', [f'u.{c}' for c in own + other])} as e, ceil(1.5 * fl.n ** (1 / 3::double))::integer as lags
        from u join f1 using ({keys}) join f2 using ({keys}) join f3 using ({keys}) join fl using ({keys})),
      s as (select {keys}, k, lags, z1 * e as s1, z2 * e as s2, z3 * e as s3 from e), c as (select *, unnest(range(0, lags + 1)) as l from s),
      q as (select a.cause, a.effect, {lagged} from c a join s b on a.cause = b.cause and a.effect = b.effect and b.k = a.k - a.l group by 1, 2),
      b as (select {keys}, any_value(lags) as lags, count(*) as n, {', '.join(f'sum(z{i + 1} * y) as b{i}' for i in range(3))} from e group by 1, 2),
      m as (select q.cause, q.effect, lags, n, 0.0::double as yy, b0, b1, b2, {sums} from q join b using ({keys})), {solved('w', 'm', 3, keys + ', lags')}
      select {keys}, n, lags, round(ss, 4) as wald, round(2 * (1 - {normal_cdf('sqrt(ss)')}) + sqrt(2 * ss / pi()) * exp(-ss / 2), 5) as p from w"""


def partialled_out(folds: str) -> str:
    """Both sides freed of lw and lm by fits on the other folds, then the ratio of their products."""
    x = ["lw", "lm"]
    cells = [f"a{i}_{j}" for i in range(3) for j in range(i, 3)] + ["b0", "b1", "b2", "yy", "n"]
    rest = lambda g: f"{g}r as (select symbol, fold, {', '.join(f'sum({c}) over (partition by symbol) - {c} as {c}' for c in cells)} from {g})"
    return f"""{folds}, gy as (select symbol, fold, {gram(x, 'y')} from f group by 1, 2), gd as (select symbol, fold, {gram(x, 'lv')} from f group by 1, 2), {rest('gy')}, {rest('gd')},
      {solved('fy', 'gyr', 3, 'symbol, fold')}, {solved('fd', 'gdr', 3, 'symbol, fold')},
      r as (select symbol, y - {fitted('fy', x)} as a, lv - {fitted('fd', x)} as d from f join fy using (symbol, fold) join fd using (symbol, fold)),
      ratio as (select symbol, count(*) as n, sum(a * d) / sum(d * d) as effect, sum(d * d) as dd from r group by 1), error as (select symbol, sqrt(sum(((a - effect * d) * d) ** 2)) / any_value(dd) as se from r join ratio using (symbol) group by 1)
      select symbol, n, round(effect, 5) as effect, round(se, 5) as se, round(effect / se, 4) as t from ratio join error using (symbol)"""


def poolability(rows: str, x: list[str]) -> str:
    k = len(x) + 1
    return f"""{rows}, own_g as (select symbol, {gram(x, 'y')} from harq group by 1), {solved('own', 'own_g', k, 'symbol')}, all_g as (select 0 as one, {gram(x, 'y')} from harq), {solved('every', 'all_g', k, 'one')},
      t as (select sum(yy - ss) as free, sum(n)::bigint as n, count(*) as groups from own)
      select round((every.yy - every.ss - free) / ({k} * (groups - 1)) / (free / (t.n - {k} * groups)), 4) as f, ({k} * (groups - 1))::bigint as df1, (t.n - {k} * groups)::bigint as df2 from t, every"""


def peaks_over_threshold(losses: str, points: int = 65, span: float = 8.0, rounds: int = 3) -> str:
    """Weighted generalised Pareto fit of `a` (symbol, day, loss, w): the grid is drawn closer round by round."""
    tried = """case when v = 0 then mean else shape / ((exp(v) - 1) / top) end"""
    fit = f"case when shape > -1 then -ln({tried}) - shape - 1 end"
    ctes = [f"b0 as (select *, {-span}::double as low, {span}::double as high from base)"]
    for k in range(rounds):
        ctes.append(f"g{k} as (select *, low + g * ((high - low) / {points - 1}) as v, (high - low) / {points - 1} as step from b{k}, (select unnest(range({points})) as g))")
        ctes.append(f"s{k} as (select g.symbol, g.g, any_value(g.v) as v, any_value(step) as step, any_value(top) as top, any_value(mean) as mean, sum(x.w * ln(1 + (exp(v) - 1) / top * x.x)) / any_value(mass) as shape from g{k} g join x on x.symbol = g.symbol group by 1, 2)")
        ctes.append(f"f{k} as (select *, {fit} as fit from s{k}), n{k} as (select *, lag(fit) over w as before, lead(fit) over w as after from f{k} window w as (partition by symbol order by g))")
        ctes.append(f"t{k} as (select symbol, arg_max({{'v': v, 'step': step, 'fit': fit, 'before': before, 'after': after}}, fit) as t from n{k} where fit is not null group by 1)")
        ctes.append(f"b{k + 1} as (select base.*, t.t.v - t.t.step as low, t.t.v + t.t.step as high, t.t as t from base join t{k} t using (symbol))")
    move = "case when t.before - 2 * t.fit + t.after < 0 then (t.before - t.after) / (t.before - 2 * t.fit + t.after) * t.step / 2 else 0 end"
    return f"""{losses}, c as (select *, sum(w) over (partition by symbol order by loss, day) / sum(w) over (partition by symbol) as upto from a), u as (select symbol, coalesce(min(loss) filter (upto >= 0.9), max(loss)) as threshold, count(*) as n from c group by 1),
      h as (select a.symbol, sum(case when loss > threshold then w else 0 end) / sum(w) as share from a join u using (symbol) group by 1), x as (select a.symbol, loss - threshold as x, w from a join u using (symbol) where loss > threshold),
      base as (select symbol, count(*) as n_excess, max(x) as top, sum(w) as mass, sum(w * x) / sum(w) as mean from x group by 1 having count(*) >= 30), {', '.join(ctes)},
      last_ as (select symbol, n_excess, top, mean, mass, t.v + {move} as v from b{rounds}), z1 as (select l.symbol, any_value(n_excess) as n_excess, any_value(v) as v, any_value(top) as top, any_value(mean) as mean, sum(x.w * ln(1 + (exp(v) - 1) / top * x.x)) / any_value(mass) as shape from last_ l join x on x.symbol = l.symbol group by 1),
      p as (select z1.symbol, n, threshold, n_excess, shape, {tried} as scale, share from z1 join u using (symbol) join h using (symbol)),
      q as (select *, threshold + case when abs(shape) < 1e-6 then scale * ln(share / 0.01) else scale / shape * (exp(shape * ln(share / 0.01)) - 1) end as quantile from p)
      select symbol, n, round(threshold, 5) as threshold, n_excess, round(shape, 5) as shape, round(scale, 5) as scale, round(quantile, 5) as quantile, round(case when shape < 1 then greatest((quantile + scale - shape * threshold) / (1 - shape), quantile) end, 5) as shortfall from q"""


def distribution_shift(rows: str, x: list[str]) -> str:
    k = len(x) + 1
    cells = [f"a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"b{i}" for i in range(k)] + ["yy", "n"]
    return f"""{rows}, g as (select symbol, fold, {gram(x, 'after')} from x group by 1, 2), o as (select symbol, fold, {', '.join(f'sum({c}) over (partition by symbol) - {c} as {c}' for c in cells)} from g),
      {solved('b', 'o', k, 'symbol, fold', 1e-8)}, y as (select symbol, fold, b0 / (n - b0) as odds from o),
      s as (select x.symbol, day, size, after, {fitted('b', [f'x.{c}' for c in x])} as score, odds from x join b on b.symbol = x.symbol and b.fold = x.fold join y on y.symbol = x.symbol and y.fold = x.fold),
      r as (select *, least(greatest(score, 0.02::double), 0.98::double) as p, rank() over (partition by symbol order by score) + (count(*) over (partition by symbol, score) - 1) / 2::double as rank from s),
      n as (select symbol, count(*) filter (after = 0) as n_before, count(*) filter (after = 1) as n_after, sum(rank) filter (after = 1) as ranks, quantile_cont(size, 0.95) filter (after = 1) as q_after, quantile_cont(size, 0.95) filter (after = 0) as q_before from r group by 1),
      a as (select *, (ranks - n_after * (n_after + 1) / 2::double) / (n_before * n_after) as auc from n), w as (select symbol, day, size, p / (1 - p) / odds as w from r where after = 0),
      c as (select symbol, size, sum(w) over (partition by symbol order by size, day) / sum(w) over (partition by symbol) as upto from w), q as (select symbol, coalesce(min(size) filter (upto >= 0.95), max(size)) as reweighted from c group by 1)
      select symbol, n_before, n_after, round(auc, 5) as auc, round((auc - 0.5) / sqrt((n_before + n_after + 1) / (12.0::double * n_before * n_after)), 5) as z, round(reweighted, 5) as reweighted, round(q_before, 5) as q_before, round(q_after, 5) as q_after from a join q using (symbol)"""


def configuration_grid(lv: str, windows: tuple[int, ...] = (0, 500), weights: tuple[float, ...] = (0.0, 0.5)) -> str:
    """Every configuration by itself: fits, panel means, recalibration and loss."""
    full = lambda n, w: f"case when count(x) over {w} = {n} then avg(x) over {w} end"
    by = "partition by symbol order by day"
    ctes, parts = [], []
    for d in (0, 1):
        x, back = ("lv", "0.0::double") if d == 0 else ("lv - factor", "next_factor")
        ctes.append(f"d{d} as (select symbol, day, gap, event, {x} as x, {'next_lv' if d == 0 else 'next_lv - next_factor'} as y, {back} as back from base)")
        ctes.append(
            f"c{d} as (select *, {full(5, 'a')} as lw, {full(22, 'b')} as lm, case when count(x) over e > 1 then (sum(x) over e - x) / (count(x) over e - 1) end as others from d{d} window a as ({by} rows between 4 preceding and current row), b as ({by} rows between 21 preceding and current row), e as (partition by day)), "
            f"h{d} as (select *, case when x is not null and lw is not null and lm is not null and others is not null and event is not null and y is not null then y end as known_y from c{d})"
        )
        for n in windows:
            for choice in range(4):
                design = ["x", "lw", "lm", *(["others"] if choice % 2 else []), *(["event"] if choice // 2 else [])]
                ok = "known_y is not null"
                fit = f"e{d}_{n}_{choice}"
                k = len(design) + 1
                ctes.append(f"{fit}_g as (select symbol, day, {gram(design, 'y', f'over ({rolling(n or None)})', ok)} from h{d})")
                ctes.append(solved(f"{fit}_s", f"{fit}_g", k, "symbol, day", 1e-8))
                ctes.append(f"{fit} as (select symbol, day, {', '.join(f'x{i} as b{i}, avg(x{i}) over (partition by day) as m{i}' for i in range(k))} from {fit}_s where n >= 60)")
                for w in weights:
                    draw = lambda i, w=w: f"({1 - w!r} * b{i} + {w!r} * m{i})"
                    g = draw(0) + "".join(f" + {draw(i + 1)} * {c}" for i, c in enumerate(design))
                    parts.append(f"select {d} as deseason, {n} as span, {choice % 2} as others_in, {choice // 2} as event_in, {w!r}::double as shrink, h.symbol, h.day, gap, y, back, {g} as g from h{d} h join {fit} e on e.symbol = h.symbol and e.day = h.day")
    keys = "deseason, span, others_in, event_in, shrink"
    over = f"over (partition by {keys}, symbol order by day rows between unbounded preceding and 1 preceding)"
    loss = lambda f: f"avg(exp(y + back - ({f})) - (y + back - ({f})) - 1)"
    rows = " union all ".join(f"select {keys}, {r} as recalibrated, symbol, count(*) as n, round({loss(f'{f} + back + 0.5 * s2')}, 5) as loss from r where g is not null and y is not null and back is not null and gap <= 4 and n >= 30 group by {keys}, symbol" for r, f in ((0, "g"), (1, "icpt + slope * g")))
    return f"""{lv}, dow as (select symbol, isodow(day) as dow, quantile_cont(lv, 0.5) as m from v where day < date '1999-10-13' group by 1, 2), fac as (select symbol, dow, m - avg(m) over (partition by symbol) as factor from dow),
      own as (select v.symbol, day, lv, factor, (isodow(day) = 5 and day(day) <= 7)::integer::double as own_event from v left join fac on fac.symbol = v.symbol and fac.dow = isodow(day)),
      base as (select *, lead(day) over w - day as gap, lead(lv) over w as next_lv, lead(factor) over w as next_factor, lead(own_event) over w as event from own window w as ({by})), {', '.join(ctes)}, every as ({' union all '.join(parts)}),
      r as (select *, count(case when g is not null and y is not null then 1 end) {over} as n, regr_slope(y, g) {over} as slope, regr_intercept(y, g) {over} as icpt, var_samp(y - g) {over} as s2 from every) {rows}"""


def expert_table(s: str, label: str, edge: str, horizon: int) -> str:
    """CTEs that end in experts: forecasts of the class of the next days from outcomes seen before the row's block."""
    rates = []
    for name, by in (("climate", None), ("persist", "prev"), ("regime", "regime")):
        same = f" and l.{by} is not distinct from q.{by}" if by else ""
        cols = f"q.symbol, q.block{f', q.{by}' if by else ''}"
        asked = f"select distinct symbol, block{f', {by}' if by else ''} from xb where block > 0"
        rates.append(f"r_{name} as (select {cols}, " + ", ".join(f"(count(*) filter (l.y = {k}) + 1) / (count(l.y) + 3)::double as {name}{k}" for k in range(3)) + f" from ({asked}) q left join xb l on l.symbol = q.symbol and l.known < q.block and l.y is not null{same} group by {cols})")
    block = lambda p: f"case when {p} >= 250 then ({p} - 250) // 21 + 1 else 0 end"
    names = ", ".join(f"{n}{k}" for n in ("climate", "persist", "student", "regime") for k in range(3))
    return f"""{s}, xs as (select symbol, day, sigma, regime::integer as regime, {label} as y, {t6_cdf('-' + edge)} as student0, {t6_cdf(edge)} - {t6_cdf('-' + edge)} as student1, 1 - {t6_cdf(edge)} as student2 from d where band is not null and sigma is not null),
      xp as (select *, coalesce(lag(y, {horizon}) over w, -1) as prev, row_number() over w - 1 as place from xs window w as (partition by symbol order by day)),
      xb as (select *, {block('place')} as block, {block(f'(place + {horizon})')} as known from xp), {', '.join(rates)},
      experts as (select symbol, day, y, {names} from xb join r_climate using (symbol, block) join r_persist using (symbol, block, prev) join r_regime using (symbol, block, regime) where block > 0)"""


def expert_mixture(table: str, names: tuple[str, ...], horizon: int) -> str:
    m = range(len(names))
    loss = ", ".join(f"-ln(greatest(case y when 0 then {n}0 when 1 then {n}1 when 2 then {n}2 end, 1e-9)) as loss{i}" for i, n in enumerate(names))
    late = ", ".join(f"lag(loss{i}, {horizon}) over w as late{i}" for i in m)
    g = [f"p.w{i} * exp(-0.5 * (t.late{i} - least({', '.join(f't.late{j}' for j in m)})))" for i in m]
    total = "(" + " + ".join(g) + ")"
    columns = {f"w{i}": f"case when t.late0 is null then p.w{i} else 0.99::double * {x} / {total} + 0.01::double / {len(names)} end" for i, x in enumerate(g)}
    mixed = lambda k: "(" + " + ".join(f"w{i} * {n}{k}" for i, n in enumerate(names)) + ")"
    every = "(" + " + ".join(mixed(k) for k in range(3)) + ")"
    return recursive(f"""{table}, z as (select *, {loss} from experts), x as (select *, row_number() over w as k, {late} from z window w as (partition by symbol order by day)), {along('m', 'x', columns, {f'w{i}': f'1 / {len(names)}::double' for i in m})}
      select symbol, day, {', '.join(f'round({mixed(k)} / {every}, 6) as p{k}' for k in range(3))}, {', '.join(f'round(w{i}, 6) as w_{n}' for i, n in enumerate(names))} from x join m using (symbol, k)""")


def bootstrapped_skill(table: str, replicates: int = 200, block: int = 20, seed: int = 5) -> str:
    brier = lambda n: f"(({n}0 - (y = 0)::integer) ** 2 + ({n}1 - (y = 1)::integer) ** 2 + ({n}2 - (y = 2)::integer) ** 2)"
    u = hashed.half_sql(f"md5('{seed}|' || b || '|' || k)")
    interval = lambda name, v: f"select symbol, round(quantile_cont({v}, 0.025), 6) as low, round(quantile_cont({v}, 0.975), 6) as high, count({v}) as replicates, '{name}' as measure from v group by 1"
    return f"""{table}, e as (select symbol, day, {brier('climate')} as base, {brier('regime')} as own, {brier('student')} as other, persist2 - persist0 + regime2 - regime0 as up, y from experts where y is not null),
      rows_ as (select *, row_number() over (partition by symbol order by day) - 1 as i, count(*) over (partition by symbol) as n from e),
      st as (select symbol, n, b, k, floor({u} * n)::bigint as start from (select symbol, any_value(n) as n from rows_ group by 1), (select unnest(range({replicates})) as b), (select unnest(range(100000)) as k) where k < ceil(n / {block}::double)),
      picked as (select symbol, b, (start + j) % n as i from st, (select unnest(range({block})) as j) where k * {block} + j < n), drawn as (select p.b, r.* from picked p join rows_ r using (symbol, i)),
      a as (select symbol, b, y, rank() over w + (count(*) over (partition by symbol, b, up) - 1) / 2::double as rank from drawn where y <> 1 window w as (partition by symbol, b order by up)),
      areas as (select symbol, b, (sum(rank) filter (y = 2) - count(*) filter (y = 2) * (count(*) filter (y = 2) + 1) / 2::double) / nullif(count(*) filter (y = 2) * count(*) filter (y = 0), 0) as area from a group by 1, 2),
      v as (select drawn.symbol, drawn.b, 1 - avg(own) / avg(base) as skill, (avg(other) - avg(own)) / avg(base) as gain, any_value(area) as area from drawn left join areas on areas.symbol = drawn.symbol and areas.b = drawn.b group by 1, 2)
      {interval('skill', 'skill')} union all {interval('gain', 'gain')} union all {interval('area', 'area')}"""


def confidence_and_superiority(losses: str, models: int, replicates: int = 500, block: int = 10, seed: int = 3) -> str:
    """From ls (day, m0, ...): a stationary bootstrap's means, then the elimination round by round."""
    m = range(models)
    u = hashed.half_sql("h")
    jump = f"(t = 0 or {u} < {1 / block!r}::double)"
    rounds, last = [], "a0"
    for r in range(models - 1):
        rounds.append(
            f"t{r} as (select max(abs(d / sd)) as t from pr where i in (select i from a{r}) and j in (select i from a{r})), u{r} as (select b, max(abs(e / sd)) as tb from pb join pr using (i, j) where i in (select i from a{r}) and j in (select i from a{r}) group by 1), "
            f"p{r} as (select avg((tb >= t)::integer) as p from u{r}, t{r}), w{r} as (select arg_max(i, s) as i from (select i, max(d / sd) as s from pr where i in (select i from a{r}) and j in (select i from a{r}) group by 1)), a{r + 1} as (select i from a{r} where i not in (select i from w{r}))"
        )
        last = f"a{r + 1}"
    worst = " union all ".join([f"select w{r}.i, greatest({', '.join(f'p{k}.p' for k in range(r + 1))}) as p from w{r}, {', '.join(f'p{k}' for k in range(r + 1))}" for r in range(models - 1)] + [f"select i, 1.0::double from {last}"])
    others = [i for i in m if i]
    return f"""{losses}, k as (select *, row_number() over (order by day) - 1 as k, count(*) over () as n from ls), hs as (select b, k as t, n, md5('{seed}|' || b || '|' || k) as h from k, (select unnest(range({replicates})) as b)),
      js as (select b, t, n, case when {jump} then floor({hashed.half_sql('h', 14)} * n)::bigint end as start, case when {jump} then t end as t0 from hs),
      ds as (select b, (last_value(start ignore nulls) over w + t - last_value(t0 ignore nulls) over w) % n as k from js window w as (partition by b order by t rows between unbounded preceding and current row)),
      bs as (select b, {', '.join(f'avg(m{i}) as m{i}' for i in m)} from ds join k using (k) group by 1), mean as (select {', '.join(f'avg(m{i}) as m{i}' for i in m)}, any_value(n) as n from k),
      bi as (select b, unnest({list(m)}) as i, unnest([{', '.join(f'm{i}' for i in m)}]) as v from bs), mi as (select unnest({list(m)}) as i, unnest([{', '.join(f'm{i}' for i in m)}]) as v from mean),
      dd as (select x.i, y.i as j, x.v - y.v as d from mi x, mi y), pb as (select x.b, x.i, y.i as j, x.v - y.v - d as e from bi x join bi y using (b) join dd on dd.i = x.i and dd.j = y.i),
      pr as (select i, j, any_value(d) as d, sqrt(avg(e * e)) + 1e-12 as sd from pb join dd using (i, j) group by 1, 2), a0 as (select i from mi), {', '.join(rounds)}, mcs as ({worst}),
      sp as ({' union all '.join(f'select {i} as i, mean.m0 - mean.m{i} as mean, b, bs.m0 - bs.m{i} as boot, n from bs, mean' for i in others)}),
      sq as (select i, any_value(mean) as mean, any_value(n) as n, sqrt(avg((boot - mean) ** 2) * any_value(n)) + 1e-12 as sd from sp group by 1), st as (select greatest(0, max(sqrt(n) * mean / sd)) as t from sq),
      sb as (select b, greatest(0, max(sqrt(sp.n) * (boot - case when sq.mean >= -sd * sqrt(2 * ln(ln(sp.n)) / sp.n) then sq.mean else 0 end) / sd)) as tb from sp join sq using (i) group by 1), spa as (select (1 + count(*) filter (tb >= t)) / ({replicates} + 1)::double as p from sb, st)
      select 'm' || i as model, round(mcs.p, 6) as mcs_p, round(spa.p, 6) as spa_p from mcs, spa"""


def four_gates(bins: str, draws: int, run: int, least: int = 100) -> str:
    """Every conjunction of back, busy, dow and two, and what each gate says of it."""
    z = lambda h, n, p: f"({h} - {n} * {p}) / sqrt({n} * {p} * (1 - {p}))"
    return f"""{bins}, f as (select symbol, day, bin as y, n_bars::double as c, day < date '1999-10-13' as train, 'back=' || lag(bin) over w as fa, 'busy=' || (n_bars >= 8)::integer as fb, 'dow=' || isodow(day) as fc, 'two=' || lag(bin, 2) over w as fd from b join daily using (symbol, day) window w as (partition by symbol order by day)),
      l as (select symbol, day, y, c, train, row_number() over (partition by symbol, train order by day) - 1 as place, list_filter([fa, fb, fc, fd], lambda x: x is not null) as lit from f where y is not null),
      r as (select symbol, place, y, c, train, unnest(list_concat(lit, flatten(list_transform(range(1, len(lit) + 1), lambda i: list_transform(lit[i + 1:], lambda z: lit[i] || ' & ' || z))))) as rule from l), k as (select unnest([0, 1, 2]) as k),
      tt as (select symbol, k, train, count(*)::double as n, sum((y = k)::integer)::double as hits, sum(c) as c, sum(c * c) as cc, sum(c * (y = k)::integer) as cy from l, k group by 1, 2, 3),
      ta as (select k, train, sum(n) as n, sum(hits) as hits, sum(c) as c, sum(cc) as cc, sum(cy) as cy from tt group by 1, 2),
      rs as (select rule, symbol, train, k, count(*)::double as n, sum((y = k)::integer)::double as hits, sum(c) as mc from r, k group by 1, 2, 3, 4),
      ra as (select rule, k, train, sum(n) as n, sum(hits) as hits, sum(mc) as mc from rs group by 1, 2, 3),
      rz as (select ra.rule, ra.k, ra.train, ra.n, ra.hits, ra.mc, ta.n as nn, ta.hits as yy, ta.c, ta.cc, ta.cy, ta.hits / ta.n as base, {z('ra.hits', 'ra.n', '(ta.hits / ta.n)')} as z from ra join ta on ta.k = ra.k and ta.train = ra.train),
      hy as (select *, n - n * n / nn as smm, mc - n * c / nn as smc, cc - c * c / nn as scc, hits - n * yy / nn as smy, cy - c * yy / nn as scy, yy - yy * yy / nn as syy from rz where train and n >= {least} and z is not null),
      hr as (select *, smm - smc * smc / scc as rest from hy), hb as (select *, (smy - scy * smc / scc) / rest as b from hr), ht as (select *, case when rest > 0.01 * smm then b / sqrt((syy - scy * scy / scc - b * b * rest) / (nn - 3) / rest) end as t from hb),
      dr as (select symbol, draw, place, y, md5(symbol || '|' || draw || '|' || (place // {run})) as h from l, (select unnest(range(1, {draws + 1})) as draw) where train),
      dp as (select symbol, draw, y, row_number() over (partition by symbol, draw order by h, place) - 1 as place from dr),
      nk as (select r.rule, draw, k, sum((dp.y = k)::integer)::double as hits from r join dp on dp.symbol = r.symbol and dp.place = r.place, k where r.train group by 1, 2, 3),
      nz as (select ht.rule, ht.k, draw, abs(ht.z) as a, abs({z('nk.hits', 'ht.n', 'ht.base')}) as zn from nk join ht on ht.rule = nk.rule and ht.k = nk.k),
      wo as (select rule, k, a, max(zn) over (partition by draw order by a, rule, k rows between unbounded preceding and current row) as worst from nz),
      pr as (select rule, k, any_value(a) as a, (1 + count(*) filter (worst >= a)) / {draws + 1}::double as p from wo group by 1, 2), pm as (select rule, k, max(p) over (order by a desc, rule desc, k desc rows between unbounded preceding and current row) as p from pr),
      lo as (select ht.rule, ht.k, ((ht.hits - coalesce(rs.hits, 0)) / nullif(ht.n - coalesce(rs.n, 0), 0)) / nullif((ht.yy - tt.hits) / (ht.nn - tt.n), 0) as lift from ht join tt on tt.k = ht.k and tt.train left join rs on rs.rule = ht.rule and rs.k = ht.k and rs.symbol = tt.symbol and rs.train),
      li as (select rule, k, min(coalesce(lift, 0)) as low, max(coalesce(lift, 9e9)) as high from lo group by 1, 2), la as (select rule, k, z from rz where not train),
      o as (select ht.rule, ht.k, ht.n, hits / ht.n / base as lift, ht.z, p, len(list_filter(string_split(ht.rule, ' & '), lambda x: not starts_with(x, 'busy='))) = 0 as is_base, t, case when ht.z > 0 then low > 1 else high < 1 end as everywhere, la.z as z_later
        from ht join pm on pm.rule = ht.rule and pm.k = ht.k join li on li.rule = ht.rule and li.k = ht.k left join la on la.rule = ht.rule and la.k = ht.k),
      g as (select *, p < 0.05 as g1, p < 0.05 and not is_base and coalesce(abs(t) > 2, false) as g2 from o), gg as (select *, g2 and everywhere as g3, g2 and everywhere and coalesce(sign(z) * z_later >= 1, false) as g4 from g)
      select rule, k as y, n::bigint as n, round(lift, 6) as lift, round(z, 5) as z, round(p, 6) as p, is_base, round(t, 4) as t, everywhere, round(z_later, 5) as z_later, g1::integer + g2::integer + g3::integer + g4::integer as passed from gg"""
