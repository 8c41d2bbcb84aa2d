"""DuckDB SQL for the registered queries: an independent statement of the same results, from named common table expressions."""

from __future__ import annotations

import itertools
import math

from .. import schema as S
from ..functions.pricing import TAIL_CUT, TAIL_DEN, TAIL_NUM
from . import queries as Q

A = [c[-1] for c in S.ASSETS]


def lit(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _horner(cs, z):
    out = lit(cs[0])
    for c in cs[1:]:
        out = f"({out}*{z}+{lit(c)})"
    return out


def cdf(x: str) -> str:
    """The normal distribution function of a column name."""
    z = f"abs({x})"
    e = f"exp(-{z}*{z}/2)"
    far = f"{e}/({z}+1e0/({z}+2e0/({z}+3e0/({z}+4e0/({z}+0.65e0)))))/2.506628274631e0"
    tail = f"(case when {z}<{lit(TAIL_CUT)} then {e}*{_horner(TAIL_NUM, z)}/{_horner(TAIL_DEN, z)} else {far} end)"
    return f"(case when {x}>0 then 1-{tail} else {tail} end)"


def annuity(r: str, n: int = 10, m: int = 1) -> str:
    v = f"(1/(1+({r})/{m}))"
    out = "1e0"
    for _ in range(n * m - 1):
        out = f"(1+{v}*{out})"
    return f"({v}*{out})"


def irs(r: str) -> str:
    return f"(1e6*(({r})-0.03e0)*{annuity(r)})"


def straddle(name: str, src: str, s: str, k: str, t: str, r: str, v: str, extra: str = "*") -> dict[str, str]:
    """Three steps that add the straddle's price as column `name` to src; the last is called {name}_ok."""
    n = name
    return {
        f"{n}_1": f"select {extra}, {s} as {n}_s, {k} as {n}_k, {t} as {n}_t, {r} as {n}_r, greatest({v}, 1e-6) as {n}_v from {src}",
        f"{n}_2": f"select *, case when {n}_t>0 then {n}_v*sqrt({n}_t) end as {n}_w, case when {n}_t>0 then {n}_k*exp(-{n}_r*{n}_t) end as {n}_f from {n}_1",
        f"{n}_3": f"select *, (ln({n}_s/{n}_k)+({n}_r+{n}_v*{n}_v/2)*{n}_t)/{n}_w as {n}_d1 from {n}_2",
        f"{n}_4": f"select *, {n}_d1-{n}_w as {n}_d2 from {n}_3",
        f"{n}_5": f"select *, {cdf(f'{n}_d1')} as {n}_n1, {cdf(f'{n}_d2')} as {n}_n2 from {n}_4",
        f"{n}_ok": f"select *, case when {n}_t>0 then {n}_s*(2*{n}_n1-1)-{n}_f*(2*{n}_n2-1) else abs({n}_s-{n}_k) end as {n} from {n}_5",
    }


CTES: dict[str, str] = {
    "raw": """select cast(l_shipdate as date) as d,
        avg(l_extendedprice) filter (where l_returnflag='A' and l_linestatus='F') as a, avg(l_extendedprice) filter (where l_returnflag='A' and l_linestatus='O') as b,
        avg(l_extendedprice) filter (where l_returnflag='N' and l_linestatus='F') as c, avg(l_extendedprice) filter (where l_returnflag='N' and l_linestatus='O') as s,
        avg(l_quantity) as v, 100*avg(l_discount) as r from lineitem group by 1""",
    "filled": """select d, last_value(a ignore nulls) over w as px_a, last_value(b ignore nulls) over w as px_b, last_value(c ignore nulls) over w as px_c,
        last_value(s ignore nulls) over w as px_d, v as vol_idx, r as rate_idx from raw window w as (order by d rows between 3 preceding and current row)""",
    "lv": "select 'main' as book, *, row_number() over (order by d)-1 as i from filled where px_a is not null and px_b is not null and px_c is not null and px_d is not null and vol_idx is not null and rate_idx is not null",
    "ret": f"select book, d, i, {', '.join(f'ln(px_{x}/lag(px_{x}) over (order by i)) as r_{x}' for x in A)} from lv qualify i>0",
    "port": "select *, 0.25e0*r_a+0.25e0*r_b+0.25e0*r_c+0.25e0*r_d as x from ret",
    "loss": "select book, d, i, pnl_total as pnl, -pnl_total as loss from tot",
    "shock": f"select book, d, i, {', '.join(f'ln(px_{x}/lag(px_{x}) over (order by i)) as s_{x}' for x in A)}, ln(vol_idx/lag(vol_idx) over (order by i)) as s_vol, rate_idx-lag(rate_idx) over (order by i) as s_rate from lv qualify i>0",
    "state": f"""select *, first_value(px_d) over (partition by i//30 order by i) as strike, greatest((30-i%30)/252e0, 1e0/252e0) as tenor, i%30 as days_held, (i>0 and i%30=0) as rolled,
        {', '.join(f'1e6*0.25e0/first_value(px_{x}) over (order by i) as sh_{x}' for x in A)}, greatest(rate_idx/100, 0e0) as rate from lv""",
    **straddle("vs", "state", "px_d", "strike", "tenor", "rate", "vol_idx/100"),
    "val": f"select *, {'+'.join(f'sh_{x}*px_{x}' for x in A)} as v_linear, {irs('rate')} as v_irs, vs*2000e0 as v_straddle, {irs('rate_idx/100')} as v_irs_raw from vs_ok",
    "pnl": "select book, d, i, v_linear-lag(v_linear) over w as pnl_linear, v_irs_raw-lag(v_irs_raw) over w as pnl_irs, v_straddle-lag(v_straddle) over w as pnl_straddle from val window w as (order by i) qualify i>0",
    "tot": "select *, pnl_linear+pnl_irs+pnl_straddle as pnl_total from pnl",
    # snapshots and the next day
    "snap0": f"""select *, lead(d) over w as n_d, {', '.join(f'lead(px_{x}) over w as n_{x}' for x in A)}, lead(vol_idx) over w as n_vol, lead(rate_idx) over w as n_rate, i+1 as f,
        tenor<=1e0/252e0+1e-12 as rolls from val window w as (order by i)""",
    **straddle("rs", "snap0", "n_d_px", "case when rolls then n_d_px else strike end", "case when rolls then 30/252e0 else greatest(tenor-1e0/252e0, 0e0) end", "greatest(n_rate/100, 0e0)", "n_vol/100"),
    "snap": f"select *, {'+'.join(f'sh_{x}*n_{x}' for x in A)} as real_linear, {irs('rs_r')} as real_irs, rs*2000e0 as real_straddle from rs_ok where n_day is not null",
}
# the next day's columns: n_d is the date there, so the underlying's next level is called n_d_px
CTES["snap0"] = CTES["snap0"].replace("lead(d) over w as n_d,", "lead(d) over w as n_day,").replace("lead(px_d) over w as n_d,", "lead(px_d) over w as n_d_px,")
CTES["snap"] = CTES["snap"].replace("sh_d*n_d ", "sh_d*n_d_px ").replace("+sh_d*n_d as", "+sh_d*n_d_px as")

_COLS = "book, snap_d, d, f, v_linear, v_irs, v_straddle, real_linear, real_irs, real_straddle, tenor, strike, rolls, vol_idx, rate_idx, " + ", ".join(f"px_{x}, sh_{x}" for x in A)


def scenario(w: int, vol: bool = False) -> dict[str, str]:
    """The scenarios of every forecast, as CTE scen; vol: shocks scaled by volatility."""
    shocks = ", ".join(f"s_{x}" for x in [*A, "vol", "rate"])
    out = {}
    if vol:
        names = [f"s_{x}" for x in [*A, "vol", "rate"]]
        out["vol0"] = "select *, " + ", ".join(f"case when i>=60 then nullif(stddev_samp({n}) over (order by i rows between 59 preceding and current row), 0) end as o_{n}" for n in names) + " from shock"
        out["vol1"] = "select * exclude (" + ", ".join(f"o_{n}" for n in names) + "), " + ", ".join(f"last_value(o_{n} ignore nulls) over (order by i rows between unbounded preceding and current row) as p_{n}" for n in names) + " from vol0"
        out["vol2"] = "select *, " + ", ".join(f"first_value(p_{n} ignore nulls) over (order by i rows between current row and unbounded following) as vol_{n}" for n in names) + " from vol1"
        moved = ", ".join(f"h.{n}*coalesce(c.vol_{n}/nullif(h.vol_{n},0), 1) as {n}" for n in names) + ", " + ", ".join(f"c.vol_{n} as now_{n}, h.vol_{n} as own_{n}" for n in names)
        out["pair"] = f"select n.*, h.d as shock_d, h.i as shock_i, {moved} from sn n join vol2 h on h.i between n.f-{w} and n.f-1 join vol2 c on c.i=n.f-1 where n.f>={w}+1"
    else:
        out["pair"] = f"select n.*, h.d as shock_d, h.i as shock_i, {shocks} from sn n join shock h on h.i between n.f-{w} and n.f-1 where n.f>={w}+1"
    first = {"sn": f"select {_COLS.replace('snap_d, d', 'd as snap_d, n_day as d')} from snap"}
    priced = straddle("xs", "pair", "px_d*exp(s_d)", "case when rolls then px_d*exp(s_d) else strike end", "case when rolls then 30/252e0 else greatest(tenor-1e0/252e0, 0e0) end", "greatest((rate_idx+s_rate)/100, 0e0)", "vol_idx*exp(s_vol)/100")
    last = f"select *, {'+'.join(f'sh_{x}*px_{x}*exp(s_{x})' for x in A)}-v_linear as pnl_linear, {irs('xs_r')}-v_irs as pnl_irs, xs*2000e0-v_straddle as pnl_straddle from xs_ok"
    total = "select *, -(pnl_linear+pnl_irs+pnl_straddle) as loss, v_linear+v_irs+v_straddle as value, real_linear+real_irs+real_straddle-(v_linear+v_irs+v_straddle) as realised from scen0"
    return first | out | priced | {"scen0": last, "scen": total}


def _needs(text: str, have: dict[str, str]) -> list[str]:
    import re

    words = set(re.findall(r"\w+", text))
    return [k for k in have if k in words]


def build(final: str, more: dict[str, str] | None = None, n: int | None = None, doubles: str = "") -> str:
    """The SQL of `final` with the CTEs that it needs; the doubles (names, space-separated) are rounded to n digits."""
    have = CTES | (more or {})
    todo, wanted = [final], set()
    while todo:
        for k in _needs(todo.pop(), have):
            if k not in wanted:
                wanted.add(k)
                todo.append(have[k])
    # a CTE may need one that stands later in the dictionary: order by need
    order: list[str] = []

    def place(k):
        if k in order:
            return
        for x in _needs(have[k], have):
            if x in wanted and x != k:
                place(x)
        order.append(k)

    for k in have:
        if k in wanted:
            place(k)
    head = "with " + ",\n".join(f"{k} as ({have[k]})" for k in order) if order else ""
    if n is None:
        return f"{head}\n{final}"
    rounds = ", ".join(f"round({c}, {n})+0e0 as {c}" for c in doubles.split())
    return f"{head}, final_ as ({final})\nselect * replace ({rounds}) from final_"


def hs(w: int, vol: bool = False, k: int = 5) -> dict[str, str]:
    """CTE hs: historical simulation's rows, from scen."""
    ratio = ""
    if vol:
        names = [f"s_{x}" for x in [*A, "vol", "rate"]]
        ratio = ", (" + "+".join(f"any_value(now_{n})/avg(own_{n})" for n in names) + ")/6 as avg_vol_ratio"
    g = f"""select book, f, any_value(d) as d, any_value(snap_d) as snapshot_d, any_value(value) as value, any_value(realised) as realised_pnl, avg(loss) as mean_loss, stddev_samp(loss) as vol_loss,
        list_sort(list(loss), 'DESC') as l{ratio} from scen group by book, f"""
    return scenario(w, vol) | {
        "hs0": g,
        "hs": f"select * exclude (l), greatest(l[{k}], 0e0) as var, greatest(list_sum(l[1:{k}])/{k}, 0e0) as es, {k} as tail_scenarios, -realised_pnl as realised_loss, cast(realised_pnl < -greatest(l[{k}], 0e0) as int) as exception from hs0",
    }


def comp(w: int = 500, k: int = 5) -> dict[str, str]:
    parts = " union all ".join(
        f"select f, any_value(d) as d, any_value(snap_d) as snapshot_d, '{c}' as component, any_value(real_{c}-v_{c}) as realised_pnl, list_sort(list(-pnl_{c}), 'DESC') as l from scen group by f" for c in S.COMPONENTS
    )
    return scenario(w) | {
        "comp0": parts,
        "comp": f"select * exclude (l), greatest(l[{k}], 0e0) as var, greatest(list_sum(l[1:{k}])/{k}, 0e0) as es, {k} as tail_scenarios, -realised_pnl as realised_loss, cast(realised_pnl < -greatest(l[{k}], 0e0) as int) as exception from comp0",
    }


def usage(w: int = 500, k: int = 5) -> dict[str, str]:
    return scenario(w) | {"usage": f"select book, d, shock_d, row_number() over (partition by f order by loss desc, shock_i desc) as tail_rank, loss as scenario_loss, -realised as realised_loss from scen qualify tail_rank<={k}"}


def dn(w: int = 500, name: str = "dn") -> dict[str, str]:
    z, e = lit(S.Z_ALPHA), lit(S.PHI_ALPHA) + "/(1-0.99e0)"
    return {
        f"{name}0": f"select *, 1e6*avg(x) over w as m, 1e6*sqrt(var_samp(x) over w) as s from port window w as (order by i rows between {w} preceding and 1 preceding) qualify i>{w}",
        name: f"select n.book, n.d, n.i, x, {z}*s-m as var_full, {z}*s as var_nodrift, {e}*s-m as es_full, {e}*s as es_nodrift, m as mu, s as sigma, t.pnl_total as pnl, t.pnl_linear, {z}*s-m as var, {e}*s-m as es, cast(t.pnl_total < -({z}*s-m) as int) as exception from {name}0 n join tot t on n.i=t.i",
    }


def tests(src: str, by: str, conf: str = "0.99e0") -> dict[str, str]:
    """CTE bt: all tests of rows (by, d, pnl, var, exception) of src."""
    p = f"(1-{conf})"
    ln = lambda x: f"ln(least(greatest({x}, 1e-10), 1-1e-10))"
    share = lambda a, b: f"(case when {b}>0 then ({a})/({b}) else 1e-10 end)"
    p01, p11, pi = share("n01", "(n00+n01)"), share("n11", "(n10+n11)"), share("(n01+n11)", "(n00+n01+n10+n11)")
    return {
        "bt0": f"select *, lag(exception) over (partition by {by} order by d) as was from {src}",
        "bt1": f"""select {by}, count(*) as t, cast(sum(exception) as bigint) as n, cast(count(*) filter (where was=0 and exception=0) as bigint) as n00, count(*) filter (where was=0 and exception=1) as n01,
            count(*) filter (where was=1 and exception=0) as n10, count(*) filter (where was=1 and exception=1) as n11 from bt0 group by {by}""",
        "bt2": f"""select *, greatest(-2*(n*ln({p})+(t-n)*ln(1-{p})-(n*{ln('n/t')}+(t-n)*{ln('1-n/t')})), 0e0) as lr_uc,
            greatest(-2*((n00+n10)*{ln(f'1-{pi}')}+(n01+n11)*{ln(pi)}-(n00*{ln(f'1-{p01}')}+n01*{ln(p01)}+n10*{ln(f'1-{p11}')}+n11*{ln(p11)})), 0e0) as lr_ind from bt1""",
        "bt3": "select *, lr_uc+lr_ind as lr_cc, sqrt(lr_uc) as q_uc, sqrt(lr_ind) as q_ind from bt2",
        "bt4": f"select * exclude (q_uc, q_ind), 2*(1-{cdf('q_uc')}) as p_uc, 2*(1-{cdf('q_ind')}) as p_ind, exp(-lr_cc/2) as p_cc, round(t*{p}, 1) as expected_n, n/t as rate from bt3",
        "pm0": f"select {by}, t, n, unnest(range(0, t+1)) as k from bt4",
        "pm1": f"select *, exp(sum(case when k>0 then ln((t-k+1)/k) else 0e0 end) over (partition by {by} order by k)+k*ln({p})+(t-k)*ln(1-{p})) as pmf from pm0",
        "pm2": f"select *, sum(pmf) over (partition by {by} order by k) as c, max(case when k=n then pmf end) over (partition by {by}) as own from pm1",
        "pm3": f"select {by}, min(k) filter (where c>=0.025e0) as lower, min(k) filter (where c>=1-0.025e0) as upper, least(1e0, sum(pmf) filter (where pmf<=own*(1+1e-7))) as binomial_p from pm2 group by {by}",
        "bt": f"select a.*, p_uc<0.05 as reject_uc, p_ind<0.05 as reject_ind, p_cc<0.05 as reject_cc, b.lower, b.upper, b.binomial_p, (n<b.lower or n>b.upper) as binomial_reject from bt4 a join pm3 b on {' and '.join(f'a.{x.strip()} is not distinct from b.{x.strip()}' for x in by.split(','))}",
    }


def summary(src: str, by: str) -> dict[str, str]:
    """CTE sm: bt with severity and mean VaR and ES."""
    on = " and ".join(f"a.{x.strip()} is not distinct from g.{x.strip()}" for x in by.split(","))
    return tests(src, by) | {
        "sm0": f"select {by}, min(d) as first_d, max(d) as last_d, avg(-pnl-var) filter (where exception=1) as severity, avg(var) as mean_var, avg(es) as mean_es, max(var) as max_var from {src} group by {by}",
        "sm": f"select a.*, g.* exclude ({by}) from bt a join sm0 g on {on}",
    }


def labelled(src: str, others: bool) -> dict[str, str]:
    rows = ", ".join(f"('{a}', date '{b}', date '{c}')" for a, b, c in S.STRESS)
    out = f"select 'full' as label, * from {src} union all select w.label, s.* from {src} s join (values {rows}) w(label, a, z) on s.d between w.a and w.z"
    if others:
        out += f" union all select 'outside', s.* from {src} s where not exists (select 1 from (values {rows}) w(label, a, z) where s.d between w.a and w.z)"
    return {"lab": out}


TESTS = ", ".join(Q.TESTS)
TEST_DOUBLES = "lr_uc lr_ind lr_cc p_uc p_ind p_cc expected_n rate binomial_p"
GF = {
    "gf0": "select book, d, i-1 as i, (pnl_total/1e6)/stddev_samp(pnl_total/1e6) over () as r, (i-1)//50 as refit from tot",
    "gf1": f"select *, list((r-{lit(Q.G_MU)})*(r-{lit(Q.G_MU)})) over (partition by refit order by i rows between unbounded preceding and 1 preceding) as e2 from gf0",
    "gf2": f"select *, sqrt(list_reduce(list_prepend({lit(Q.OMEGA)}/(1-{lit(Q.G_ALPHA)}-{lit(Q.G_BETA)}), coalesce(e2, [])), lambda s, e: greatest({lit(Q.OMEGA)}+{lit(Q.G_ALPHA)}*e+{lit(Q.G_BETA)}*s, 1e-10))) as sigma from gf1",
    "gf": f"select book, d, i, cast(refit as int) as refit, r, sigma, (r-{lit(Q.G_MU)})/sigma as z from gf2",
}
_FOLD = {
    "garch": "sqrt(greatest({o}+{a}*e*e+{b}*greatest(s*s, 1e-12), 1e-12))",
    "gjr": "sqrt(greatest({o}+({a}+case when e<0 then {g} else 0e0 end)*e*e+{b}*greatest(s*s, 1e-12), 1e-12))",
    "aparch": "greatest(pow(greatest({o}+{a}*pow(greatest(abs(e)-{g}*e, 1e-12), {d})+{b}*pow(greatest(s, 1e-6), {d}), 1e-12), 1/{d}), 1e-6)",
}
VR = {
    "vr0": "select *, list(r) over (partition by refit order by i rows between unbounded preceding and 1 preceding) as es from gf0",
    "vr": "select book, d, i, cast(refit as int) as refit, " + ", ".join(f"list_reduce(list_prepend(1e0, coalesce(es, [])), lambda s, e: {f.format(**dict(zip('oabgd', map(lit, Q.RECURSIONS[m]))))}) as sigma_{m}" for m, f in _FOLD.items()) + " from vr0",
}
FP = {
    "fp0": """select book, d, i, ln(px_d/lag(px_d) over w) as d_log, ln(px_b/lag(px_b) over w) as b_log, ln(px_a/lag(px_a) over w) as a_log, rate_idx-lag(rate_idx) over w as rate_chg, vol_idx-lag(vol_idx) over w as vol_chg,
        lag(px_d) over w as f_s, lag(strike) over w as f_k, greatest(lag(tenor) over w-1e0/252e0, 1e0/252e0) as f_t, lag(rate_idx) over w/100 as f_r, lag(vol_idx) over w as f_v from state window w as (order by i) qualify i>0""",
    **straddle("fa", "fp0", "f_s", "f_k", "f_t", "f_r", "f_v/100"),
    **straddle("fb", "fa_ok", "f_s*exp(d_log)", "f_k", "f_t", "f_r+rate_chg/100", "(f_v+vol_chg)/100"),
    "fp1": f"select book, d, i, 2.5e5*(d_log+b_log+a_log) as pnl_linear, {irs('fb_r')}-{irs('f_r')} as pnl_irs, 2000e0*(fb-fa) as pnl_straddle from fb_ok",
    "fp": "select *, pnl_linear+pnl_irs+pnl_straddle as pnl_total from fp1",
}
TC = {
    "tc0": "select *, quantile_cont(loss, 0.9) over w as u, list(loss) over w as l from loss window w as (order by i rows between 500 preceding and 1 preceding) qualify i>500",
    "tc": "select book, d, i, u, cast(len(list_filter(l, lambda v: v>u)) as int) as n_u, 1-len(list_filter(l, lambda v: v>u))/500e0 as f_u from tc0",
}
PO = {
    "po": "select book, d, i, " + ", ".join(f"(rank() over (order by r_{x})+(count(*) over (partition by r_{x})-1)/2e0)/(count(*) over ()+1) as u_r_{x}" for x in A) + " from ret",
}


def _pairs(src: str, cols, f) -> str:
    return " union all ".join(f"select 'main' as book, '{a}' as a, '{b}' as b, {f(a, b)} as value from {src}" for a, b in itertools.combinations(cols, 2))


def ewma(lam: float) -> str:
    z, e = lit(S.Z_ALPHA), lit(S.PHI_ALPHA) + "/(1-0.99e0)"
    s = f"1e6*sqrt(list_reduce(list_prepend(0e0, list_transform(l, lambda v: (v-m)*(v-m))), lambda a, v: a*{lit(lam)}+v)/((1-pow({lit(lam)}, 500))/(1-{lit(lam)})))"
    return f"select book, d, i, {lit(lam)} as lam, x, {z}*sg-1e6*m as var_full, {z}*sg as var_nodrift, {e}*sg-1e6*m as es_full, {e}*sg as es_nodrift, 1e6*m as mu, sg as sigma from (select *, {s} as sg from ew0)"


EW = {"ew0": "select *, avg(x) over w as m, list(x) over w as l from port window w as (order by i rows between 500 preceding and 1 preceding) qualify i>500"}
_SB = {"one": "1e0", "neg": "neg", "negsize": "neg*b", "possize": "(1-neg)*b"}


def oracle_sql() -> dict[str, str]:
    z = lit(S.Z_ALPHA)
    e = lit(S.PHI_ALPHA) + "/(1-0.99e0)"
    greeks = f"""select book, d, strike, tenor, vs as price, 2*vs_n1-1 as price_delta, 2*ph/(vs_s*vs_w) as price_gamma, 2*vs_s*ph*sqrt(vs_t) as price_vega,
        (-vs_s*ph*vs_v/sqrt(vs_t)-vs_r*vs_f*(2*vs_n2-1))/252 as price_theta from (select *, exp(-vs_d1*vs_d1/2)/sqrt(2*pi()) as ph from vs_ok)"""
    hs_cols = "d, snapshot_d, value, var, es, mean_loss, vol_loss, tail_scenarios, realised_loss, realised_pnl, exception"
    hs_doubles = "value var es mean_loss vol_loss realised_loss realised_pnl"
    cdoubles = "p_uc p_ind p_cc severity mean_var mean_es"
    dnw = dn(250, "dnx") | dn(500, "dny") | dn(750, "dnz") | {"dw": " union all ".join(f"select {w} as \"window\", d, pnl, var, es, exception from {k}" for w, k in ((250, "dnx"), (500, "dny"), (750, "dnz")))}
    hsx = lambda w, k: f"select {w} as \"window\", d, realised_pnl as pnl, var, es, exception from {k}"

    def named(w: int, k: int, prefix: str) -> dict[str, str]:
        """hs(w, k) with the CTEs that depend on w under names of their own."""
        own = lambda x: x in ("pair", "hs0", "hs", "scen", "scen0") or x.startswith("xs")
        out = {prefix + x if own(x) else x: v for x, v in hs(w, k=k).items()}
        for old in ("xs_1", "xs_2", "xs_3", "xs_4", "xs_5", "xs_ok", "pair", "scen0", "scen", "hs0"):
            out = {x: v.replace(f"from {old}", f"from {prefix}{old}") for x, v in out.items()}
        return out

    hw = named(250, 3, "h") | named(750, 8, "g") | hs(500) | {"hw": " union all ".join((hsx(250, "hhs"), hsx(500, "hs"), hsx(750, "ghs")))}
    hb = {"hb": "select d, realised_pnl as pnl, var, es, exception from hs"}
    cm = {"cm": "select 'delta_normal' as method, d, pnl, var, es, exception from dn union all select 'hist_sim', h.d, t.pnl_total, h.var, h.es, cast(t.pnl_total < -h.var as int) from hs h join tot t on h.d=t.d"}
    q9 = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
    mom = " union all ".join(
        f"""select '{c}' as component, avg(v) as mean, sqrt(avg((v-m)*(v-m))) as std, avg(pow(v-m, 3))/pow(avg(pow(v-m, 2)), 1.5) as skew, avg(pow(v-m, 4))/pow(avg(pow(v-m, 2)), 2)-3 as kurt,
        {', '.join(f'quantile_cont(v, {q}) as q{i}' for i, q in enumerate(q9))} from (select pnl_{c} as v, avg(pnl_{c}) over () as m from tot)"""
        for c in (*S.COMPONENTS, "total")
    )
    stab = lambda c, of="tc": f"select '{c}' as parameter, avg(v) as mean, stddev_samp(v) as std, min(v) as least, max(v) as most, max(abs(v-w)) as max_change from (select cast({c} as double) as v, lag(cast({c} as double)) over (order by d) as w from {of})"
    sb = {"sb": "select z*z as y, b, cast(b<0 as int)*1e0 as neg from (select z, lag(z) over (order by i) as b from gf) where b is not null"}
    sbc = "count(*) as n, sum(y*y) as yy, " + ", ".join(f"sum(y*({v})) as xy_{k}" for k, v in _SB.items()) + ", " + ", ".join(f"sum(({_SB[a]})*({_SB[b]})) as xx_{a}_{b}" for a, b in itertools.combinations_with_replacement(_SB, 2))
    sbd = "yy " + " ".join(f"xy_{k}" for k in _SB) + " " + " ".join(f"xx_{a}_{b}" for a, b in itertools.combinations_with_replacement(_SB, 2))
    lb = ", ".join(f"sum(c*lag{k}) as s{k}" for k in range(1, 11))
    rho = "+".join(f"pow(s{k}/v, 2)/(n-{k})" for k in range(1, 11))
    lags = ", ".join(f"lag(c, {k}) over (order by i) as lag{k}" for k in range(1, 11))
    snap_last = {"sl": f"select {_COLS.replace('snap_d, d', 'd as snap_d, n_day as d')} from snap qualify f=max(f) over ()", "pair": "select n.*, h.d as shock_d, h.i as shock_i, s_a, s_b, s_c, s_d, s_vol, s_rate from sl n cross join shock h"}
    worst = {k: v for k, v in scenario(500).items() if k not in ("sn", "pair")} | snap_last
    u = "(1-0.99e0)"
    sp = f"(1-{lit(S.ALPHA)})"
    sn = {"p01": "n01/(n00+n01)", "p11": "n11/(n10+n11)", "q": "(n01+n11)/(n00+n01+n10+n11)"}
    safe = lambda x: f"(case when {x}>0 then ln({x}) else 0e0 end)"
    held = lambda x: f"ln(case when {x}>0 then {x} else 1e-10 end)"
    strict = f"""select book, case when n>0 and n<t then -2*(n*ln({sp}/(n/t))+(t-n)*ln((1-{sp})/(1-n/t))) end as lr_uc_strict,
        case when n00+n01>0 and n10+n11>0 then -2*((n00+n10)*{safe('1-' + sn['q'])}+(n01+n11)*{safe(sn['q'])}-n00*{safe('1-' + sn['p01'])}-n01*{held(sn['p01'])}-n10*{safe('1-' + sn['p11'])}-n11*{held(sn['p11'])}) end as lr_ind_strict from bt1"""
    bad = lambda src, cols: f"select book, d, 'duplicate' as problem from {src} group by book, d having count(*)>1 union all select book, d, 'not finite' from {src} where " + " or ".join(f"{c} is null or isnan({c})" for c in cols)
    tail = lambda x, m: f"exp(-{x}/2)*(" + "+".join(f"pow({x}/2, {k})/{math.factorial(k)}" for k in range(m // 2)) + ")"
    pm = {
        "lj0": "select book, i, 'r' as series, r as v from gf union all select book, i, 'z', z from gf union all select book, i, 'z2', z*z from gf",
        "lj1": "select *, v-avg(v) over (partition by series) as c from lj0",
        "lj2": "select *, " + ", ".join(f"lag(c, {k}) over (partition by series order by i) as l{k}" for k in range(1, 21)) + " from lj1",
        "lj3": "select book, series, count(*) as n, sum(c*c) as s0, " + ", ".join(f"sum(c*l{k}) as s{k}" for k in range(1, 21)) + " from lj2 group by book, series",
        "lj4": "select book, series, n, " + ", ".join(f"n*(n+2)*({'+'.join(f'pow(s{k}/s0, 2)/(n-{k})' for k in range(1, m + 1))}) as q{m}" for m in (10, 20)) + " from lj3",
    }
    half = lambda k, on: ", ".join(f"{f}(y, b) filter (where {on}) as {c}_{k}" for c, f in (("cnt", "regr_count"), ("slope", "regr_slope"), ("cst", "regr_intercept"), ("sxx", "regr_sxx"), ("syy", "regr_syy"), ("sxy", "regr_sxy"), ("mx", "regr_avgx")))
    st = sb | {
        "st0": f"select count(*) as n, regr_syy(y, b) as yy, {half('n', 'b<0')}, {half('p', 'b>=0')} from sb",
        "st1": "select *, syy_n-sxy_n*sxy_n/sxx_n+syy_p-sxy_p*sxy_p/sxx_p as rss from st0",
        "st2": "select *, rss/(n-4) as s2 from st1",
    }
    t8 = " union all ".join(
        f"select 'main' as book, {lit(x)} as u, max(z) filter (where k=j)+coalesce((max(h)-max(j))*(max(z) filter (where k=j+1)-max(z) filter (where k=j)), 0e0) as q from (select *, floor(h) as j from (select z, row_number() over (order by z) as k, least(greatest((count(*) over ()+1/3e0)*{lit(x)}+1/3e0, 1e0), count(*) over ()) as h from gf))"
        for x in Q.US
    )
    static = " union all ".join(
        f"select 'main' as book, {lit(c)} as confidence, v as var, -avg(pnl_total) filter (where pnl_total<=-v) as es, any_value({lit(zz)}*s-m) as var_normal from (select pnl_total, -quantile_cont(pnl_total, 1-{lit(c)}) over () as v, avg(pnl_total) over () as m, stddev_samp(pnl_total) over () as s from tot) group by v"
        for c, zz in ((0.95, Q.Z_95), (S.ALPHA, S.Z_ALPHA))
    )
    moving = """select book, d, i, case when count(*) over b=30 then stddev_samp(x) over b end*sqrt(252e0) as vol, case when count(*) over a=60 then avg(x) over a end as mean, sqrt(case when count(*) over a=60 then avg(c*c) over a end) as sd
        from (select *, x-avg(x) over () as c from port) window b as (order by i rows between 29 preceding and current row), a as (order by i rows between 29 preceding and 30 following)"""
    stats = f"""select 'main' as book, count(*) as n, any_value(m) as mean, any_value(s) as std, min(x) as least, max(x) as most, avg(pow(x-m, 3))/pow(avg(pow(x-m, 2)), 1.5) as skew, avg(pow(x-m, 4))/pow(avg(pow(x-m, 2)), 2)-3 as kurt,
        avg(pow(x-m, 4))/pow(avg(pow(x-m, 2)), 2)-3>1 as fat_tailed, max(greatest(k/n_-p, p-(k-1)/n_)) as ks from (select *, {cdf('zz')} as p from (select *, (x-m)/s as zz, row_number() over (order by x) as k, count(*) over () as n_ from (select x, avg(x) over () as m, stddev_samp(x) over () as s from port)))"""
    fp = lambda c: f"case when {c}<1e-4 then '< 0.0001' else printf('%.4f', {c}) end as {c}"
    table = f"select method, t, n, printf('%.1f', expected_n) as expected, printf('%.2f%%', 100*rate) as rate, {fp('p_uc')}, {fp('p_ind')}, {fp('p_cc')}, '['||lower||', '||upper||']' as accepted from bt"
    rb = {
        "rb0": """select r_name as book, cast(l_shipdate as date) as d, avg(l_extendedprice) filter (where l_returnflag='A' and l_linestatus='F') as a, avg(l_extendedprice) filter (where l_returnflag='A' and l_linestatus='O') as b,
            avg(l_extendedprice) filter (where l_returnflag='N' and l_linestatus='F') as c, avg(l_extendedprice) filter (where l_returnflag='N' and l_linestatus='O') as s, avg(l_quantity) as v, 100*avg(l_discount) as r
            from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1, 2""",
        "rb1": "select book, d, v, r, " + ", ".join(f"last_value({c} ignore nulls) over w as {c}" for c in "abcs") + " from rb0 window w as (partition by book order by d rows between 3 preceding and current row)",
        "rb2": "select *, row_number() over (partition by book order by d)-1 as i from rb1 where a is not null and b is not null and c is not null and s is not null and v is not null and r is not null",
        "rb3": "select book, d, i, " + "+".join(f"0.25e0*ln({c}/lag({c}) over w)" for c in "abcs") + " as x from rb2 window w as (partition by book order by d) qualify i>0",
        "rb4": "select *, 1e6*avg(x) over w as mu, 1e6*sqrt(var_samp(x) over w) as sigma from rb3 window w as (partition by book order by i rows between 250 preceding and 1 preceding) qualify i>250",
    }
    moves = {"mv": "select book, i, ln(px_d/lag(px_d) over w) as d_log, rate_idx-lag(rate_idx) over w as rate_chg, ln(px_b/lag(px_b) over w) as b_log, ln(px_a/lag(px_a) over w) as a_log, vol_idx-lag(vol_idx) over w as vol_chg from lv window w as (order by i) qualify i>0"}
    names = sorted(("d_log", "rate_chg", "b_log", "a_log", "vol_chg"))
    tau = lambda a, b: f"select '{a}' as a, '{b}' as b, sum(sign(x.{a}-y.{a})*sign(x.{b}-y.{b}))/sqrt(sum(abs(sign(x.{a}-y.{a})))*sum(abs(sign(x.{b}-y.{b})))) as tau from mv x join mv y on x.i<y.i"
    kt = moves | {"kt": " union all ".join(tau(a, b) for a, b in itertools.combinations(names, 2))}
    # an edge is of the tree unless a path of greater edges joins its ends: four steps reach all five names
    steps = {"sp0": "select a as ea, b as eb, abs(tau) as w, a as place from kt"}
    for k in range(1, 5):
        steps[f"sp{k}"] = f"select ea, eb, w, place from sp{k - 1} union select s.ea, s.eb, s.w, case when e.a=s.place then e.b else e.a end from sp{k - 1} s join kt e on abs(e.tau)>s.w and (e.a=s.place or e.b=s.place)"
    wl = lambda k: f"pow(s{k}/s0, 2)/(n-{k})"
    td = " union all ".join(
        f"select 'main' as book, '{a}' as a, '{b}' as b, {lit(q)} as q, avg(cast({a}<={lit(q)} and {b}<={lit(q)} as int))/{lit(q)} as lower, avg(cast({a}>1-{lit(q)} and {b}>1-{lit(q)} as int))/{lit(q)} as upper from po"
        for a, b in itertools.combinations([f"u_r_{x}" for x in A], 2) for q in (0.01, 0.025, 0.05, 0.1, 0.2)
    )
    days = "cast(o_orderdate as date) as d from orders"
    dg = f"select book, d, i, x, {z}*sf-m as var_full, {e}*sf-m as es_full, {z}*sd-m as var_diagonal, {e}*sd-m as es_diagonal, sf as sigma_full, sd as sigma_diagonal, ({z}*sd-m)-({z}*sf-m) as benefit from (select *, 1e6*avg(x) over w as m, 1e6*sqrt(var_samp(x) over w) as sf, 1e6*sqrt({'+'.join(f'0.0625e0*var_samp(r_{x}) over w' for x in A)}) as sd from port window w as (order by i rows between 500 preceding and 1 preceding) qualify i>500)"
    sens, sens_doubles = ", ".join(Q.SENSITIVITY), "rate p_uc p_cc mean_var mean_es max_var"
    return {
        "factor_taus": build("select 'main' as book, a, b, tau from kt", kt, 8, "tau"),
        "vine_first_tree": build("select 'main' as book, a, b, tau from kt k where not exists (select 1 from sp4 s where s.ea=k.a and s.eb=k.b and s.place=k.b)", kt | steps, 8, "tau"),
        "tail_dependence": build(td, PO, 8, "q lower upper"),
        "weighted_portmanteau": build(f"select book, series, n, n*(n+2)*({'+'.join(wl(k) for k in range(1, 11))}) as plain, n*(n+2)*({'+'.join(f'{11 - k}/10e0*{wl(k)}' for k in range(1, 11))}) as weighted from lj3 where series<>'r'", GF | pm, 6, "plain weighted"),
        "strict_backtest": build(strict, dn() | tests("dn", "book"), 8, "lr_uc_strict lr_ind_strict"),
        "panel_violations": build(bad("lv", ("px_a", "px_b", "px_c", "px_d", "vol_idx", "rate_idx"))),
        "raw_panel_violations": build(bad("rw", "abcsvr"), {"rw": "select 'main' as book, * from raw"}),
        "adequacy_ljung_box": build(f"select *, {tail('q10', 10)} as p10, {tail('q20', 20)} as p20 from lj4", GF | pm, 6, "q10 q20 p10 p20"),
        "sign_bias_test": build(
            "select 'main' as book, n, cst_p as c0, cst_n-cst_p as sign, slope_n as neg_size, slope_p as pos_size, (cst_n-cst_p)/sqrt(s2*(1/cnt_n+mx_n*mx_n/sxx_n+1/cnt_p+mx_p*mx_p/sxx_p)) as t_sign, slope_n/sqrt(s2/sxx_n) as t_neg, slope_p/sqrt(s2/sxx_p) as t_pos, (yy-rss)/3/s2 as f from st2",
            GF | st, 6, "c0 sign neg_size pos_size t_sign t_neg t_pos f"),
        "innovation_quantiles": build(t8, GF, 8, "q"),
        "static_var_es": build(static, None, 3, "var es var_normal"),
        "rolling_moments": build(moving, None, 8, "vol mean sd"),
        "summary_stats": build(stats, None, 6, "mean std least most skew kurt ks"),
        "compare_table": build(table, dn() | hs(500) | cm | tests("cm", "method")),
        "registry_backtest": build(f"select method, {TESTS} from bt", dn() | hs(500) | cm | tests("cm", "method"), 6, TEST_DOUBLES),
        "region_books": build(f"select book, d, i, x, {z}*sigma-mu as var_full, {e}*sigma-mu as es_full, mu, sigma from rb4", rb, 4, "x var_full es_full mu sigma"),
        "dates_in_both": build(f"select book, d from lv intersect select 'main' as book, {days}"),
        "dates_in_panel_only": build(f"select book, d from lv except select 'main' as book, {days}"),
        "delta_normal_var": build("select book, d, i, x, var_full, var_nodrift, es_full, es_nodrift, mu, sigma from dn", dn(), 4, "x var_full var_nodrift es_full es_nodrift mu sigma"),
        "panel_ffill_limit": build("select * from lv", None, 6, "px_a px_b px_c px_d vol_idx rate_idx"),
        "asof_levels": build("select l.book, l.d, l.i, o.order_idx from lv l asof left join (select cast(o_orderdate as date) as d, sum(cast(round(100*o_totalprice) as bigint))/(100e0*count(o_totalprice)) as order_idx from orders group by 1) o on l.d>=o.d", None, 4, "order_idx"),
        "log_returns": build("select * from ret", None, 8, "r_a r_b r_c r_d"),
        "factor_shocks_hist": build("select * from shock", None, 8, "s_a s_b s_c s_d s_vol s_rate"),
        "factor_shocks_mc": build("select * replace (s_rate/100 as s_rate) from shock", None, 8, "s_a s_b s_c s_d s_vol s_rate"),
        "risk_factors": build("select book, d, i, ln(px_d/lag(px_d) over w) as d_log, rate_idx-lag(rate_idx) over w as rate_chg, ln(px_b/lag(px_b) over w) as b_log, ln(px_a/lag(px_a) over w) as a_log, px_d-lag(px_d) over w as d_level_chg, vol_idx-lag(vol_idx) over w as vol_chg from lv window w as (order by i) qualify i>0", None, 6, "d_log rate_chg b_log a_log d_level_chg vol_chg"),
        "portfolio_return": build("select book, d, x from port", None, 8, "x"),
        "price_index": build("select book, d, i, " + ", ".join(f"100*px_{x}/first_value(px_{x}) over (order by i) as idx_{x}" for x in A) + " from lv", None, 6, "idx_a idx_b idx_c idx_d"),
        "straddle_state": build("select book, d, i, strike, tenor, days_held, rolled from state", None, 8, "strike tenor"),
        "inception_shares": build("select book, d, sh_a, sh_b, sh_c, sh_d from state", None, 8, "sh_a sh_b sh_c sh_d"),
        "irs_price_dv01": build(f"select book, d, {irs('rate')} as value, 1e6*{annuity('rate')}*1e-4 as dv01, {annuity('rate', 10, 2)} as annuity_semi from state", None, 4, "value dv01 annuity_semi"),
        "straddle_price_greeks": build(greeks, None, 6, "strike tenor price price_delta price_gamma price_vega price_theta"),
        "instrument_pnl": build("select book, d, pnl_irs, pnl_straddle from pnl", None, 3, "pnl_irs pnl_straddle"),
        "total_pnl": build("select * from tot", None, 3, "pnl_linear pnl_irs pnl_straddle pnl_total"),
        "delta_normal_windows": build('select "window", t, n, p_uc, p_cc, mean_var, mean_es, max_var from sm', dnw | summary("dw", '"window"'), 6, "p_uc p_cc mean_var mean_es max_var"),
        "delta_normal_violations": build("select book, d, var_full, es_full, sigma from dn where coalesce(es_full<var_full or es_nodrift<var_nodrift or sigma<=0 or var_full<0, true)", dn(), 4, "var_full es_full sigma"),
        "delta_normal_linear": build(f"select book, {TESTS} from bt", dn() | {"dl": "select book, d, pnl_linear as pnl, var, es, cast(pnl_linear < -var as int) as exception from dn"} | tests("dl", "book"), 8, TEST_DOUBLES),
        "delta_normal_ewma_tests": build(f"select lam, {sens} from sm", dn() | EW | {"ex": f"select 1e0 as lam, d, pnl, var, es, exception from dn union all select w.lam, w.d, t.pnl_total, w.var_full, w.es_full, cast(t.pnl_total < -w.var_full as int) from ({ewma(0.94)} union all {ewma(0.97)}) w join tot t on w.i=t.i"} | summary("ex", "lam"), 5, "lam " + sens_doubles),
        "delta_normal_diag_tests": build(f"select covariance, {sens} from sm", {"dg": dg} | {"dx": " union all ".join(f"select '{k}' as covariance, g.d, t.pnl_total as pnl, var_{k} as var, es_{k} as es, cast(t.pnl_total < -var_{k} as int) as exception from dg g join tot t on g.i=t.i" for k in ("full", "diagonal"))} | summary("dx", "covariance"), 5, sens_doubles),
        "delta_normal_ewma": build(f"{ewma(0.94)} union all {ewma(0.97)}", EW, 4, "lam x var_full var_nodrift es_full es_nodrift mu sigma"),
        "delta_normal_diag": build(
            dg,
            None, 4, "x var_full es_full var_diagonal es_diagonal sigma_full sigma_diagonal benefit",
        ),
        "delta_normal_crisis": build(f"select label, t, n, expected_n, {', '.join(cdoubles.split())} from sm", dn() | labelled("dn", True) | summary("lab", "label"), 6, "expected_n " + cdoubles),
        "crisis_table": build(
            f"""select p.method, p.label, first_d, last_d, coalesce(t, 0) as t, coalesce(n, 0) as n, coalesce(t, 0)*(1-0.99e0) as expected_n, rate, {', '.join(f'round({c}, 2) as {c}' for c in Q.MONEY)},
            case when t>=50 then p_uc end as p_uc, case when t>=50 then p_cc end as p_cc,
            concat_ws('; ', case when t is null then 'no days' when t<50 then 'under 50 days: descriptive' end, case when p.label='outside' and t is not null then 'not contiguous: p_cc is descriptive' end) as note
            from ct1 p left join sm s on p.method=s.method and p.label=s.label left join ct0 c on p.method=c.method and p.label=c.label""",
            dn() | hs(500) | cm | labelled("cm", True) | summary("lab", "method, label") | {"ct0": "select method, label, max(es) as max_es, avg(-pnl) as mean_loss, max(-pnl) as max_loss, avg(-pnl) filter (where exception=1) as mean_exception_loss, max(-pnl) filter (where exception=1) as max_exception_loss from lab group by method, label",
                "ct1": f"select distinct method, unnest(['full', {', '.join(repr(w[0]) for w in S.STRESS)}, 'outside']) as label from cm"},
            5, "expected_n rate mean_var mean_es max_var max_es mean_loss max_loss mean_exception_loss max_exception_loss p_uc p_cc"),
        "hist_sim_var": build(f"select {hs_cols} from hs", hs(500), 3, hs_doubles),
        "hist_sim_components": build("select d, snapshot_d, component, var, es, tail_scenarios, realised_pnl, realised_loss, exception from comp", comp(), 3, "var es realised_pnl realised_loss"),
        "hist_sim_component_summary": build(f"select component, t, n, expected_n, {', '.join(cdoubles.split())} from sm", comp() | {"cx": "select component, d, realised_pnl as pnl, var, es, exception from comp"} | summary("cx", "component"), 5, "expected_n " + cdoubles),
        "hist_sim_tail_usage": build("select * from usage", usage(), 3, "scenario_loss realised_loss"),
        "hist_sim_tail_summary": build(
            "select shock_d, count(*) as times_in_tail, cast(sum(cast(tail_rank=1 as int)) as bigint) as times_worst, avg(tail_rank) as mean_rank, max(scenario_loss) as max_loss, avg(scenario_loss) as mean_loss, avg(realised_loss) as mean_realised from usage group by 1 order by 2 desc, 3 desc, 5 desc limit 15",
            usage(), 3, "mean_rank max_loss mean_loss mean_realised",
        ),
        "hist_sim_extreme_days": build(
            "select t.d, t.realised_loss, t.var, linear, irs, straddle, case when linear>=greatest(linear, irs, straddle) then 'linear' when irs>=greatest(linear, irs, straddle) then 'irs' else 'straddle' end as driver from (select * from hs order by realised_loss desc, d limit 15) t join (select f, "
            + ", ".join(f"max(realised_loss) filter (where component='{c}') as {c}" for c in S.COMPONENTS) + " from comp group by f) c on t.f=c.f",
            hs(500) | comp(), 3, "realised_loss var linear irs straddle",
        ),
        "hist_sim_subperiods": build(f"select label, first_d, last_d, t, n, expected_n, {', '.join(cdoubles.split())} from sm", hs(500) | hb | labelled("hb", False) | summary("lab", "label"), 5, "expected_n " + cdoubles),
        "hist_sim_windows": build(f'select "window", t, n, {", ".join(cdoubles.split())}, max_var from sm', hw | summary("hw", '"window"'), 5, cdoubles + " max_var"),
        "vol_adjusted_hs": build(f"select {hs_cols}, avg_vol_ratio from hs", hs(500, vol=True), 3, hs_doubles + " avg_vol_ratio"),
        "rolling_quantile_var": build("select book, d, quantile_cont(loss, 0.99) over (order by i rows between 500 preceding and 1 preceding) as q from loss qualify i>500", None, 3, "q"),
        "empirical_es": build(
            "select book, d, i, greatest(qq, 0e0) as q, greatest(list_avg(list_filter(l, lambda v: v>=qq)), qq, 0e0) as es from (select *, quantile_cont(loss, 0.99) over w as qq, list(loss) over w as l from loss window w as (order by i rows between 500 preceding and 1 preceding) qualify i>500)", None, 3, "q es"),
        "pot_threshold_counts": build("select * from tc", TC, 3, "u f_u"),
        "pot_formula_fixed_params": build(
            f"select book, d, u, n_u, f_u, var, (var+{lit(Q.SIGMA)}-{lit(Q.XI)}*u)/(1-{lit(Q.XI)}) as es from (select *, u+{lit(Q.SIGMA)}/{lit(Q.XI)}*(pow((500/n_u)*{u}, -{lit(Q.XI)})-1) as var from tc)", TC, 3, "u f_u var es"),
        "garch_recursion_fixed_params": build("select * from gf", GF, 8, "r sigma z"),
        "volatility_recursions": build("select * from vr", GF | VR, 8, "sigma_garch sigma_gjr sigma_aparch"),
        "factor_pnl": build("select * from fp", FP, 3, "pnl_linear pnl_irs pnl_straddle pnl_total"),
        "factor_reconstruction": build("select f.book, count(*) as n, corr(f.pnl_total, t.pnl_total) as corr, corr(f.pnl_total, t.pnl_total)>=0.95e0 as passed from fp f join tot t on f.i=t.i group by f.book", FP, 6, "corr"),
        "fhs_fixed_params": build("select book, d, i, sigma, -1e6*sigma*q as var from (select *, quantile_cont(z, 0.01) over (order by i rows between 500 preceding and 1 preceding) as q from gf qualify i>=500)", GF, 3, "sigma var"),
        "ewma_corr_fixed": build(
            "select book, d, i, fold(0) as corr from x".replace("fold(0)", "bd/sqrt(bb*dd)").replace("from x", "from (select book, d, i, "
            + ", ".join(f"list_reduce(list_prepend(0e0, list({p}) over w), lambda a, v: a*0.94e0+v) as {n}" for n, p in (("bd", "r_b*r_d"), ("bb", "r_b*r_b"), ("dd", "r_d*r_d"))) + " from ret window w as (order by i rows between 250 preceding and 1 preceding) qualify i>250)"), None, 8, "corr"),
        "exceptions": build("select book, d, pnl, var, exception from dn", dn(), 4, "pnl var"),
        "kupiec": build("select book, t, n, lr_uc, p_uc from bt", dn() | tests("dn", "book"), 8, "lr_uc p_uc"),
        "christoffersen": build("select book, n00, n01, n10, n11, lr_ind, p_ind from bt", dn() | tests("dn", "book"), 8, "lr_ind p_ind"),
        "binomial_range": build("select book, t, n, lower, upper, binomial_p, binomial_reject from bt", dn() | tests("dn", "book"), 8, "binomial_p"),
        "run_backtest": build(f"select book, {TESTS} from bt", dn() | tests("dn", "book"), 8, TEST_DOUBLES),
        "compare_methods": build(f"select method, {TESTS} from bt", dn() | hs(500) | cm | tests("cm", "method"), 6, TEST_DOUBLES),
        "exceptions_by_year": build("select cast(year(d) as int) as year, count(*) as observations, cast(sum(exception) as bigint) as exceptions, avg(exception) as rate from dn group by grouping sets ((year(d)), ())", dn(), 8, "rate"),
        "cumulative_exceptions": build(f"select book, d, exception, cast(sum(exception) over (order by d) as bigint) as observed, {u}*count(*) over (order by d) as expected from dn", dn(), 6, "expected"),
        "exception_severity": build("select book, avg(-pnl-var) filter (where exception=1) as severity from dn group by book", dn(), 4, "severity"),
        "moments_quantiles": build(mom, None, 4, "mean std skew kurt " + " ".join(f"q{i}" for i in range(9))),
        "mean_excess_curve": build(
            " union all ".join(f"select 'main' as book, {k} as pos, u, count(*) as n, avg(loss-u) as excess from loss, (select quantile_cont(loss, {k}/20e0) as u from loss) where loss>u group by u" for k in range(20)), None, 3, "u excess"),
        "hill_curve": build("select book, cast(rk-1 as int) as k, before-ln(loss) as xi from (select *, row_number() over (order by loss desc, i) as rk, avg(ln(loss)) over (order by loss desc, i rows between unbounded preceding and 1 preceding) as before from loss where loss>0) where rk between 2 and 301", None, 8, "xi"),
        "pseudo_observations": build("select * from po", PO, 8, "u_r_a u_r_b u_r_c u_r_d"),
        "copula_corr": build(_pairs("po", [f"u_r_{x}" for x in A], lambda a, b: f"corr({a}, {b})"), PO, 8, "value"),
        "joint_tail_prob": build(_pairs("po", [f"u_r_{x}" for x in A], lambda a, b: f"avg(cast({a}<=0.05 and {b}<=0.05 as int))"), PO, 8, "value"),
        "ljung_box_stat": build(f"select book, n, 10 as lags, n*(n+2)*({rho}) as q from (select book, count(*) as n, sum(c*c) as v, {lb} from (select *, {lags} from (select book, i, x-avg(x) over () as c from port)) group by book)", None, 6, "q"),
        "ks_normal_stat": build(f"select book, count(*) as n, max(greatest(k/n_-p, p-(k-1)/n_)) as ks from (select book, k, n_, {cdf('zz')} as p from (select book, zz, row_number() over (order by zz) as k, count(*) over () as n_ from (select book, (x-avg(x) over ())/stddev_samp(x) over () as zz from port))) group by book", None, 8, "ks"),
        "ks_two_sample_stat": build("select book, cast(max(na) as bigint) as n_a, cast(max(n_)-max(na) as bigint) as n_b, max(abs(ca/na-(c-ca)/(n_-na))) as ks from (select book, sum(cast(i%2=0 as int)) over () as na, count(*) over () as n_, sum(cast(i%2=0 as int)) over (order by x) as ca, count(*) over (order by x) as c from port) group by book", None, 8, "ks"),
        "sign_bias_ols": build(f"select 'main' as book, {sbc} from sb", GF | sb, 4, sbd),
        "pnl_component_corr": build(_pairs("tot", [f"pnl_{c}" for c in S.COMPONENTS], lambda a, b: f"corr({a}, {b})"), None, 8, "value"),
        "param_stability": build(" union all ".join(stab(c) for c in ("u", "n_u", "f_u")), TC, 3, "mean std least most max_change"),
        "parameter_stability_counts": build(" union all ".join([*(stab(c, "calm") for c in ("u", "n_u", "f_u")), *(f"select '_meta_n_{k}', cast(count(*) as double), null, null, null, null from {t}" for k, t in (("clean_windows", "calm"), ("total_windows", "tc")))]), TC | {"calm": "select * from tc where u<=(select avg(u) from tc)"}, 3, "mean std least most max_change"),
        "pricing_validation": build(" union all ".join(f"select book, d, '{p}' as part, pnl_{p} as own, pnl_{p} as again, 0e0 as abs_err from tot" for p in (*S.COMPONENTS, "total")), None, 3, "own again abs_err"),
        "found_estimates": build("select d, pnl, var, exception from dn", dn(), 4, "pnl var"),
        "stress_worst_n": build("select book, cast(row_number() over (order by loss desc, shock_d) as int) as rank, shock_d, loss, pnl_linear, pnl_irs, pnl_straddle from scen qualify rank<=10", worst, 3, "loss pnl_linear pnl_irs pnl_straddle"),
    }
