"""DuckDB SQL that recomputes each catalogue query from the raw tables.

The SQL re-derives the same keyed random numbers (``hashing`` emits the same text for both
dialects) and replaces the engine's numerics with closed forms: sums for sketches, Cramer's
rule and the adjugate inverse of a 3x3 Gram matrix for solves, factors and leverages.
Results are rounded with the same digits as the Spark side (``round(v, d) + 0.0``).
"""

from __future__ import annotations

from tallsketch.functions import hashing as H
from tallsketch.operators.generate import HEAVY_SCALE, LIGHT_SCALE, NOISE_RATIO, normal_sql, true_x
from tallsketch.operators.leverage import _coin_sql
from tallsketch.operators.sketch import cw_bucket_sign_sql

D = "duckdb"


def rnd(expr: str, d: int) -> str:
    return f"(round({expr}, {d}) + 0.0)"


# ----------------------------------------------------------------------------- views

OM = """li AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_items, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty
              FROM lineitem GROUP BY l_orderkey),
om AS (SELECT CAST(o.o_orderkey AS BIGINT) AS key, CAST(1.0 AS DOUBLE) AS a0,
              coalesce(li.n_items, CAST(0 AS DOUBLE)) AS a1, coalesce(li.sum_qty, CAST(0 AS DOUBLE)) AS a2,
              CAST(o.o_totalprice AS DOUBLE) AS b
       FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey)"""

EV = """ev AS (SELECT CAST(event_id AS BIGINT) AS key, CAST(1.0 AS DOUBLE) AS a0, CAST(user_id AS DOUBLE) AS a1,
              CAST(value AS DOUBLE) AS b FROM events)"""

EVD = """evd AS (SELECT CAST(event_id AS BIGINT) AS key, CAST(user_id AS DOUBLE) AS a0,
               CASE WHEN event_id % 10 <> 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS a1,
               CAST(value AS DOUBLE) AS b FROM events)"""

EMB = """emb AS (SELECT CAST(vec_id AS BIGINT) AS key, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS a,
               CAST(label AS DOUBLE) AS b FROM embeddings)"""


def cols(n: int) -> list[str]:
    return [f"a{i}" for i in range(n)] + ["b"]


# ----------------------------------------------------------------------------- sketches

def cw_sketch(name: str, src: str, n: int, c: int, k: int, seed: int) -> str:
    parts = []
    for t in range(k):
        bucket, sign = cw_bucket_sign_sql(c, seed, t, "key", D)
        parts.append(f"SELECT CAST({t} AS INTEGER) AS trial, {bucket} AS bucket, {sign} AS sgn, {', '.join(cols(n))} FROM {src}")
    sums = ", ".join(f"sum(sgn * {x}) AS v{i}" for i, x in enumerate(cols(n)))
    return f"{name} AS (SELECT trial, bucket, {sums} FROM ({' UNION ALL '.join(parts)}) GROUP BY trial, bucket)"


def dense_sketch(name: str, src: str, n: int, c: int, k: int, seed: int, kind: str) -> str:
    parts = []
    for t in range(k):
        if kind == "gaussian":
            z = H.sql_gaussian("s.key", "bk.bucket", seed, t, D)
        else:
            z = H.sql_rademacher("s.key", "bk.bucket", seed, t, D)
        parts.append(f"SELECT CAST({t} AS INTEGER) AS trial, CAST(bk.bucket AS INTEGER) AS bucket, "
                     f"({z} / sqrt(CAST({c} AS DOUBLE))) AS w, {', '.join('s.' + x for x in cols(n))} "
                     f"FROM {src} s CROSS JOIN (SELECT range AS bucket FROM range({c})) bk")
    sums = ", ".join(f"sum(w * {x}) AS v{i}" for i, x in enumerate(cols(n)))
    return f"{name} AS (SELECT trial, bucket, {sums} FROM ({' UNION ALL '.join(parts)}) GROUP BY trial, bucket)"


def srdht_sketch(name: str, src: str, n: int, c: int, k: int, seed: int) -> str:
    """Keys re-indexed 0..m-1 by key order; frequencies = the c indices of smallest hash."""
    ctes = [f"{name}_idx AS (SELECT row_number() OVER (ORDER BY key) - 1 AS j, {', '.join(cols(n))} FROM {src})",
            f"{name}_m AS (SELECT CAST(count(*) AS BIGINT) AS m FROM {src})"]
    parts = []
    for t in range(k):
        h = H.sql_hash_key("j", H.srdht_freq_poly(seed, t), D)
        ctes.append(f"{name}_f{t} AS (SELECT f, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS bucket FROM "
                    f"(SELECT j AS f FROM {name}_idx ORDER BY {h}, j LIMIT {c}))")
        sign = H.sql_sign(H.sql_hash_key("x.j", H.srdht_sign_poly(seed, t), D))
        theta = (f"(CAST(2.0 AS DOUBLE) * pi() * CAST((fr.f * x.j) % mm.m AS DOUBLE) / CAST(mm.m AS DOUBLE) "
                 f"- pi() / CAST(4.0 AS DOUBLE))")
        w = f"(sqrt(CAST(2.0 AS DOUBLE) / CAST({c} AS DOUBLE)) * cos({theta}) * {sign})"
        parts.append(f"SELECT CAST({t} AS INTEGER) AS trial, fr.bucket AS bucket, {w} AS w, "
                     f"{', '.join('x.' + v for v in cols(n))} FROM {name}_idx x CROSS JOIN {name}_f{t} fr "
                     f"CROSS JOIN {name}_m mm")
    sums = ", ".join(f"sum(w * {x}) AS v{i}" for i, x in enumerate(cols(n)))
    ctes.append(f"{name} AS (SELECT trial, bucket, {sums} FROM ({' UNION ALL '.join(parts)}) GROUP BY trial, bucket)")
    return ",\n".join(ctes)


def array_sketch(name: str, src: str, n: int, kind: str, c: int, seed: int) -> str:
    """One-trial sketch of an array matrix in long form (trial, bucket, pos, val); pos n = b."""
    if kind == "cw":
        bucket, sign = cw_bucket_sign_sql(c, seed, 0, "s.key", D)
        rows = f"SELECT {bucket} AS bucket, {sign} AS w, s.a, s.b FROM {src} s"
    else:
        z = H.sql_gaussian("s.key", "bk.bucket", seed, 0, D)
        rows = (f"SELECT CAST(bk.bucket AS INTEGER) AS bucket, ({z} / sqrt(CAST({c} AS DOUBLE))) AS w, s.a, s.b "
                f"FROM {src} s CROSS JOIN (SELECT range AS bucket FROM range({c})) bk")
    return (f"{name} AS (SELECT CAST(0 AS INTEGER) AS trial, bucket, CAST(p.pos - 1 AS INTEGER) AS pos, "
            f"sum(w * CASE WHEN p.pos <= {n} THEN r.a[p.pos] ELSE r.b END) AS val "
            f"FROM ({rows}) r CROSS JOIN (SELECT range AS pos FROM range(1, {n + 2})) p GROUP BY bucket, p.pos)")


def sketch(name: str, src: str, n: int, kind: str, c: int, k: int, seed: int) -> str:
    if kind == "cw":
        return cw_sketch(name, src, n, c, k, seed)
    if kind == "srdht":
        return srdht_sketch(name, src, n, c, k, seed)
    return dense_sketch(name, src, n, c, k, seed, kind)


# ----------------------------------------------------------------------------- 3x3 closed forms

def gram(name: str, src: str, group: str = "trial", weight: str | None = None,
         cols3: tuple[str, str, str, str] = ("v0", "v1", "v2", "v3")) -> str:
    """g_ij = Σ w c_i c_j and h_i = Σ w c_i y for three columns and a response."""
    a, b_, c_, y = cols3
    w = f"{weight} * " if weight else ""
    return (f"{name} AS (SELECT {group}, sum({w}{a}*{a}) AS g00, sum({w}{a}*{b_}) AS g01, sum({w}{a}*{c_}) AS g02, "
            f"sum({w}{b_}*{b_}) AS g11, sum({w}{b_}*{c_}) AS g12, sum({w}{c_}*{c_}) AS g22, "
            f"sum({w}{a}*{y}) AS h0, sum({w}{b_}*{y}) AS h1, sum({w}{c_}*{y}) AS h2 FROM {src} GROUP BY {group})")


DET = "(g00*(g11*g22 - g12*g12) - g01*(g01*g22 - g12*g02) + g02*(g01*g12 - g11*g02))"
X0 = f"((h0*(g11*g22 - g12*g12) - g01*(h1*g22 - g12*h2) + g02*(h1*g12 - g11*h2)) / {DET})"
X1 = f"((g00*(h1*g22 - g12*h2) - h0*(g01*g22 - g12*g02) + g02*(g01*h2 - h1*g02)) / {DET})"
X2 = f"((g00*(g11*h2 - h1*g12) - g01*(g01*h2 - h1*g02) + h0*(g01*g12 - g11*g02)) / {DET})"
INV = {
    (0, 0): f"((g11*g22 - g12*g12) / {DET})", (0, 1): f"((g02*g12 - g01*g22) / {DET})",
    (0, 2): f"((g01*g12 - g11*g02) / {DET})", (1, 1): f"((g00*g22 - g02*g02) / {DET})",
    (1, 2): f"((g01*g02 - g00*g12) / {DET})", (2, 2): f"((g00*g11 - g01*g01) / {DET})",
}


def inv(i: int, j: int) -> str:
    return INV[(min(i, j), max(i, j))]


def cramer(name: str, gram_name: str, group: str = "trial") -> str:
    return f"{name} AS (SELECT {group}, {X0} AS x0, {X1} AS x1, {X2} AS x2 FROM {gram_name})"


def inverse(name: str, gram_name: str) -> str:
    entries = ", ".join(f"{inv(i, j)} AS i{i}{j}" for i in range(3) for j in range(3) if i <= j)
    return f"{name} AS (SELECT trial, {entries}, g00, g11, g22 FROM {gram_name})"


def lev_expr(inv_alias: str, row_alias: str) -> str:
    r, q = row_alias, inv_alias
    return (f"({q}.i00*{r}.a0*{r}.a0 + {q}.i11*{r}.a1*{r}.a1 + {q}.i22*{r}.a2*{r}.a2 + "
            f"2.0*({q}.i01*{r}.a0*{r}.a1 + {q}.i02*{r}.a0*{r}.a2 + {q}.i12*{r}.a1*{r}.a2))")


def leverage_chain(prefix: str, src: str, kind: str, c: int, k: int, seed: int, s: float) -> list[str]:
    """CTEs: sketch -> gram -> inverse -> lev -> lev_sum -> p -> sampled rows (w = 1/sqrt p)."""
    return [
        sketch(f"{prefix}_sk", src, 3, kind, c, k, seed),
        gram(f"{prefix}_g", f"{prefix}_sk"),
        inverse(f"{prefix}_inv", f"{prefix}_g"),
        f"{prefix}_lev AS (SELECT q.trial, r.key, r.a0, r.a1, r.a2, r.b, {lev_expr('q', 'r')} AS lev "
        f"FROM {src} r CROSS JOIN {prefix}_inv q)",
        f"{prefix}_ls AS (SELECT trial, sum(lev) AS lev_sum FROM {prefix}_lev GROUP BY trial)",
        f"{prefix}_p AS (SELECT l.*, least(CAST(1.0 AS DOUBLE), CAST({float(s)!r} AS DOUBLE) * l.lev / t.lev_sum) AS p "
        f"FROM {prefix}_lev l JOIN {prefix}_ls t ON l.trial = t.trial)",
        f"{prefix}_smp AS (SELECT * FROM {prefix}_p WHERE "
        + " OR ".join(f"(trial = {t} AND {_coin_sql(t, seed, D)} < p)" for t in range(k)) + ")",
    ]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def x_select(src: str, digits: int = 2, group: str = "trial") -> str:
    return f"SELECT {group}, {rnd('x0', digits)} AS x0, {rnd('x1', digits)} AS x1, {rnd('x2', digits)} AS x2 FROM {src}"


def gen_matrix_sql(n: int, seed: int, digits: list[int]) -> str:
    h = n // 2
    x = true_x(n, seed)
    lines = [
        "g_keys AS (SELECT CAST(o_orderkey AS BIGINT) AS key FROM orders)",
        f"g_special AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS r FROM "
        f"(SELECT key FROM g_keys ORDER BY key DESC LIMIT {h}))",
    ]
    acols = []
    for j in range(n):
        z = normal_sql("k.key", j, seed, "gen-a", D)
        scale = repr(HEAVY_SCALE if j < h else LIGHT_SCALE)
        ident = "CAST(0.0 AS DOUBLE)" if j < h else f"CASE WHEN sp.r = {j - h} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
        acols.append(f"CASE WHEN sp.key IS NOT NULL THEN {ident} ELSE CAST({scale} AS DOUBLE) * {z} END AS a{j}")
    e = normal_sql("k.key", n, seed, "gen-e", D)
    lines.append(f"g_rows AS (SELECT k.key, {', '.join(acols)}, {e} AS e FROM g_keys k LEFT JOIN g_special sp ON k.key = sp.key)")
    ax = " + ".join(f"CAST({float(x[j])!r} AS DOUBLE) * a{j}" for j in range(n))
    lines.append(f"g_ax AS (SELECT *, ({ax}) AS ax FROM g_rows)")
    lines.append(f"g_scale AS (SELECT CAST({NOISE_RATIO!r} AS DOUBLE) * sqrt(sum(ax*ax)) / sqrt(sum(e*e)) AS sc FROM g_ax)")
    sel = ", ".join(f"{rnd(f'a{j}', digits[j])} AS a{j}" for j in range(n))
    return with_(*lines) + f"SELECT key, {sel}, {rnd('ax + sc * e', digits[n])} AS b FROM g_ax CROSS JOIN g_scale"


def krylov_ctes(k: int, c: int, seed: int) -> tuple[list[str], list[str], list[str]]:
    """CTEs for the closed-form preconditioned LSQR iterates (n = 3), and the SQL of
    iterate 1 and iterate 2 (columns of ``ks``).

    In exact arithmetic iterate j minimizes ||Ax - b|| over x in span{d, (MT)d, ..., (MT)^j d}
    with T = AᵀA, M = ((SA)ᵀSA)^-1 = N Nᵀ and d = M Aᵀb: a 1-D fit, a 2-D fit, then (n = 3
    directions) the exact solution.  Only M enters, not the sign-ambiguous N itself."""
    def mv(mat, vec, i):  # row i of a symmetric 3x3 times a 3-vector, names mat(i,j) / vec(j)
        return " + ".join(f"{mat(i, j)}*{vec(j)}" for j in range(3))

    m = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    # T = AᵀA of the whole matrix (SQL names are case-insensitive: keep clear of the g_ij of kinv)
    g = lambda i, j: f"T{min(i, j)}{max(i, j)}"
    full = ("kfull AS (SELECT " + ", ".join(f"sum(a{i}*a{j}) AS T{i}{j}" for i in range(3) for j in range(3) if i <= j)
            + ", " + ", ".join(f"sum(a{i}*b) AS H{i}" for i in range(3)) + " FROM om)")
    d1 = "kd AS (SELECT q.*, f.*, " + ", ".join(f"({mv(m, lambda j: f'H{j}', i)}) AS d{i}" for i in range(3)) + \
         " FROM kinv q CROSS JOIN kfull f)"
    u = "ku AS (SELECT *, " + ", ".join(f"({mv(g, lambda j: f'd{j}', i)}) AS u{i}" for i in range(3)) + " FROM kd)"
    d2 = "ke AS (SELECT *, " + ", ".join(f"({mv(m, lambda j: f'u{j}', i)}) AS e{i}" for i in range(3)) + " FROM ku)"
    w = "kw AS (SELECT *, " + ", ".join(f"({mv(g, lambda j: f'e{j}', i)}) AS w{i}" for i in range(3)) + " FROM ke)"
    dot = lambda x, y: " + ".join(f"{x}{i}*{y}{i}" for i in range(3))
    sc = (f"ks AS (SELECT *, ({dot('d', 'u')}) AS a11, ({dot('e', 'u')}) AS a12, ({dot('e', 'w')}) AS a22, "
          f"({dot('d', 'H')}) AS r1, ({dot('e', 'H')}) AS r2 FROM kw)")
    det2 = "(a11*a22 - a12*a12)"
    x1 = [f"(r1 / a11) * d{i}" for i in range(3)]
    x2 = [f"((r1*a22 - r2*a12) / {det2}) * d{i} + ((a11*r2 - a12*r1) / {det2}) * e{i}" for i in range(3)]
    ctes = [OM, sketch("ksk", "om", 3, "cw", c, k, seed), gram("kg", "ksk"), inverse("kinv", "kg"), full, d1, u, d2, w, sc,
            gram("eg", "(SELECT 0 AS trial, * FROM om)", cols3=("a0", "a1", "a2", "b")), cramer("ex", "eg")]
    return ctes, x1, x2


def krylov_history_sql(k: int, c: int, seed: int, iters: int, digits: int) -> str:
    """LSQR history (trial, iter, x0..x2): iterate 1, iterate 2, then the exact solution."""
    ctes, x1, x2 = krylov_ctes(k, c, seed)
    sel = lambda it, xs: (f"SELECT trial, CAST({it} AS INTEGER) AS iter, "
                          + ", ".join(f"{rnd(x, digits)} AS x{i}" for i, x in enumerate(xs)) + " FROM ks")
    exact = ("SELECT q.trial, CAST(r.it AS INTEGER) AS iter, " + ", ".join(f"{rnd(f'ex.x{i}', digits)} AS x{i}" for i in range(3))
             + f" FROM kinv q CROSS JOIN ex CROSS JOIN (SELECT range AS it FROM range(2, {iters})) r")
    return with_(*ctes) + " UNION ALL ".join([sel(0, x1), sel(1, x2), exact])


def krylov_median_trial_sql(k: int, c: int, seed: int, digits: int) -> str:
    """E4 for a 2-iteration LSQR with k trials: errors of every iterate against the exact
    optimum, then the history of the trial whose final f error has rank floor((k-1)/2)."""
    ctes, x1, x2 = krylov_ctes(k, c, seed)
    cands = ("kc AS (SELECT trial, 0 AS iter, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(x1)) + " FROM ks "
             "UNION ALL SELECT trial, 1 AS iter, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(x2)) + " FROM ks)")
    res = lambda x: f"(({x}.x0*o.a0 + {x}.x1*o.a1 + {x}.x2*o.a2 - o.b) * ({x}.x0*o.a0 + {x}.x1*o.a1 + {x}.x2*o.a2 - o.b))"
    fopt = f"kfopt AS (SELECT sqrt(sum({res('e')})) AS f FROM om o CROSS JOIN ex e)"
    fx = f"kfx AS (SELECT c.trial, c.iter, sqrt(sum({res('c')})) AS f FROM om o CROSS JOIN kc c GROUP BY c.trial, c.iter)"
    errs = ("kerr AS (SELECT c.trial, c.iter, sqrt((c.x0-ex.x0)*(c.x0-ex.x0) + (c.x1-ex.x1)*(c.x1-ex.x1) + "
            "(c.x2-ex.x2)*(c.x2-ex.x2)) / sqrt(ex.x0*ex.x0 + ex.x1*ex.x1 + ex.x2*ex.x2) AS x_relerr, "
            "abs(kfopt.f - kfx.f) / kfopt.f AS f_relerr FROM kc c CROSS JOIN ex CROSS JOIN kfopt "
            "JOIN kfx ON kfx.trial = c.trial AND kfx.iter = c.iter)")
    pick = (f"kpick AS (SELECT trial FROM (SELECT trial, row_number() OVER (ORDER BY f_relerr, trial) - 1 AS rk "
            f"FROM kerr WHERE iter = 1) WHERE rk = {(k - 1) // 2})")
    return with_(*ctes, cands, fopt, fx, errs, pick) + (
        f"SELECT iter, {rnd('x_relerr', digits)} AS x_relerr, {rnd('f_relerr', digits)} AS f_relerr "
        "FROM kerr WHERE trial = (SELECT trial FROM kpick)")


def krylov_residuals_sql(k: int, c: int, seed: int, iters: int, digits: int) -> str:
    """LSQR's residual estimate (phibar) per iterate: ||A x_j - b|| of the 1-D and 2-D fits,
    then the optimal residual norm once the n = 3 directions are exhausted."""
    ctes, x1, x2 = krylov_ctes(k, c, seed)
    cands = ("kc AS (SELECT trial, 0 AS iter, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(x1)) + " FROM ks "
             "UNION ALL SELECT trial, 1 AS iter, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(x2)) + " FROM ks)")
    res = lambda x: f"(({x}.x0*o.a0 + {x}.x1*o.a1 + {x}.x2*o.a2 - o.b) * ({x}.x0*o.a0 + {x}.x1*o.a1 + {x}.x2*o.a2 - o.b))"
    fx = f"kfx AS (SELECT c.trial, c.iter, sqrt(sum({res('c')})) AS f FROM om o CROSS JOIN kc c GROUP BY c.trial, c.iter)"
    fopt = f"kfopt AS (SELECT sqrt(sum({res('e')})) AS f FROM om o CROSS JOIN ex e)"
    return with_(*ctes, cands, fx, fopt) + (
        f"SELECT trial, CAST(iter AS INTEGER) AS iter, {rnd('f', digits)} AS nrm_r FROM kfx UNION ALL "
        f"SELECT q.trial, CAST(r.it AS INTEGER) AS iter, {rnd('kfopt.f', digits)} AS nrm_r FROM kinv q CROSS JOIN kfopt "
        f"CROSS JOIN (SELECT range AS it FROM range(2, {iters})) r")


def krylov_monitors_sql(k: int, c: int, seed: int, tol: float, digits: dict[str, int]) -> str:
    """LSQR's monitors after its first two iterations, from the entries of the bidiagonal matrix.

    With the vectors of ``krylov_ctes`` (d = M A'b, u = T d, e = M u, w = T e) and p = d'A'b:
    alpha1^2 = p / b'b, alpha1^2 + beta2^2 = d'u / p, and the next entries follow from the norms of
    A'A v and A v, written in d, e and w.  The residual, the norms of B and of its pseudo-inverse
    and the solution are those of the 2 x 1 and 3 x 2 least-squares problems."""
    ctes, _, _ = krylov_ctes(k, c, seed)
    row = lambda i: " + ".join(f"i{min(i, j)}{max(i, j)}*w{j}" for j in range(3))
    steps = [
        "k0 AS (SELECT trial, r1 AS p, a11, a12, a22, " + " + ".join(f"w{i}*({row(i)})" for i in range(3))
        + " AS a33, (SELECT sum(b*b) FROM om) AS bb FROM ks)",
        "k1 AS (SELECT *, sqrt(bb) AS be1, sqrt(p / bb) AS al1, a11 / p AS rho, a12 / p AS sigma FROM k0)",
        "k2 AS (SELECT *, rho - al1*al1 AS be2q, (sigma - rho*rho) / (rho - al1*al1) AS al2q FROM k1)",
        "k3 AS (SELECT *, (a22 - 2*rho*a12 + rho*rho*a11) / (p*be2q*al2q) - al2q AS be3q, "
        "(a33 - 2*rho*a22 + rho*rho*a12) / (p*be2q*al2q) AS nu FROM k2)",
        "k4 AS (SELECT *, (nu - (al2q + be3q)*(al2q + be3q) - al2q*be2q) / be3q AS al3q, "
        "rho * (al2q + be3q) - al2q*be2q AS det FROM k3)",
        # the solutions z of the two small problems
        "k5 AS (SELECT *, be1*al1 / rho AS z, be1*al1*(al2q + be3q) / det AS z1, -be1*al1*sqrt(al2q*be2q) / det AS z2 FROM k4)",
        "km AS (SELECT trial, 0 AS iter, be1*sqrt(be2q) / sqrt(rho) AS nrm_r, sqrt(al2q*be2q)*abs(z) AS nrm_ar, sqrt(rho) AS nrm_a, "
        "CAST(1.0 AS DOUBLE) AS cnd_a, abs(z) AS nrm_x, al1*be1 AS first FROM k5 UNION ALL "
        "SELECT trial, 1, sqrt(bb - al1*be1*z1), sqrt(al3q*be3q)*abs(z2), sqrt(rho + al2q + be3q), (rho + al2q + be3q) / sqrt(det), "
        "sqrt(z1*z1 + z2*z2), al1*be1 FROM k5)",
    ]
    names = ["nrm_r", "nrm_ar", "nrm_a", "cnd_a", "nrm_x"]
    return with_(*ctes, *steps) + ("SELECT trial, CAST(iter AS INTEGER) AS iter, " + ", ".join(
        f"{rnd(n, digits[n])} AS {n}" for n in names) + ", CAST(0 AS INTEGER) AS stag, "
        f"CAST(CASE WHEN nrm_ar < {tol!r} * first THEN 0 ELSE -1 END AS INTEGER) AS flag FROM km")


def condition_sql(name: str, factor_gram: str, label: str, digits: int) -> str:
    """Extreme singular values of A N from the grams of the sketch (``factor_gram``) and of A (``kgram``):
    the eigenvalues of ((SA)'SA)^-1 A'A, the roots of a cubic with three real ones."""
    p = lambda i, j: " + ".join(f"i{min(i, m)}{max(i, m)}*E{min(m, j)}{max(m, j)}" for m in range(3))
    entries = ", ".join(f"{p(i, j)} AS P{i}{j}" for i in range(3) for j in range(3))
    trace = "P00 + P11 + P22"
    square = " + ".join(f"P{i}{j}*P{j}{i}" for i in range(3) for j in range(3))
    det = "P00*(P11*P22 - P12*P21) - P01*(P10*P22 - P12*P20) + P02*(P10*P21 - P11*P20)"
    return ",\n".join([
        inverse(f"{name}_i", factor_gram),
        f"{name}_p AS (SELECT trial, {entries} FROM {name}_i CROSS JOIN kgram)",
        f"{name}_c AS (SELECT trial, {trace} AS c1, (({trace})*({trace}) - ({square})) / 2 AS c2, {det} AS c3 FROM {name}_p)",
        f"{name}_d AS (SELECT *, c1*c1 - 3*c2 AS dd FROM {name}_c)",
        f"{name}_a AS (SELECT *, acos(greatest(-1.0, least(1.0, (2*c1*c1*c1 - 9*c1*c2 + 27*c3) / (2*dd*sqrt(dd))))) / 3 AS phi FROM {name}_d)",
        f"{name}_e AS (SELECT trial, sqrt(c1/3 + 2*sqrt(dd)/3*cos(phi)) AS hi, sqrt(c1/3 + 2*sqrt(dd)/3*cos(phi + 2*pi()/3)) AS lo FROM {name}_a)",
        f"{name} AS (SELECT '{label}' AS factor, trial, {rnd('lo', digits)} AS sv_min, {rnd('hi', digits)} AS sv_max, "
        f"{rnd('hi/lo', digits)} AS cond FROM {name}_e)",
    ])


def conditions_sql(kinds: dict[str, int], trials: int, seed: int, s: float, digits: int) -> str:
    """``preconditioner_cond``: every projection kind, and the leverage sample that starts from ``cw``."""
    full = ("kgram AS (SELECT " + ", ".join(f"sum(a{i}*a{j}) AS E{i}{j}" for i in range(3) for j in range(3) if i <= j) + " FROM om)")
    ctes, names = [OM, full], []
    for kind, c in kinds.items():
        ctes += [sketch(f"c_{kind}", "om", 3, kind, c, trials, seed), gram(f"g_{kind}", f"c_{kind}"),
                 condition_sql(f"q_{kind}", f"g_{kind}", kind, digits)]
        names.append(f"q_{kind}")
    ctes += [*leverage_chain("L", "om", "cw", kinds["cw"], trials, seed, s),
             gram("g_sampling", "L_smp", weight="(1.0 / p)", cols3=("a0", "a1", "a2", "b")),
             condition_sql("q_sampling", "g_sampling", "sampling", digits)]
    return with_(*ctes) + " UNION ALL ".join(f"SELECT * FROM {n}" for n in [*names, "q_sampling"])
