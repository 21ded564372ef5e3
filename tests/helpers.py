"""Small hand-built inputs and brute-force references written independently of the library."""
import math
import random

from fillwatch.schemas import SCORES_DDL, TRADES_DDL

T0 = 1_700_000_000


def trades(spark, rows):
    """rows: (market, wallet, ts, price, size, side, tx_hash)"""
    return spark.createDataFrame(rows, TRADES_DDL)


def random_trades(seed=0, markets=("a", "b"), n=120, wallets=7, span=200_000):
    rnd = random.Random(seed)
    rows = []
    for m in markets:
        for k in range(n):
            ts = T0 + rnd.randrange(span)
            rows.append((m, f"w{rnd.randrange(wallets)}", ts - ts % rnd.choice([1, 1, 600]), round(rnd.uniform(0.05, 0.95), 3),
                         round(rnd.lognormvariate(2, 1), 2), rnd.choice(["BUY", "SELL", ""]), f"{m}-{k:04d}"))
    return rows


def by_market(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    for m in out:
        out[m].sort(key=lambda r: (r[2], r[6]))
    return out


def logit(p):
    return math.log(p / (1 - p))


def brute_features(rows):
    out = {}
    for m, rs in by_market(rows).items():
        s_bar = sum(r[4] for r in rs) / len(rs)
        prev = None
        for i, r in enumerate(rs):
            out[r[6]] = (i, 0.0 if prev is None else float(r[2] - prev[2]), math.log(r[4] / s_bar), logit(r[3]))
            prev = r
    return out


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES_DDL)


def mixture_filter(seq, p, level, m_s=0.0, s_s=1.0, m_z=0.0):
    """Textbook four-state filter on one market; seq of (y, delta, lsr), level(i) -> log-odds."""
    mu, var, v = 0.0, p.s0_2, [0.0, 0.0]
    z, out = 0.0, []
    for i, (y, d, ls) in enumerate(seq):
        if i == 0:
            rho = p.q_01 / (p.q_01 + p.q_10)
            pv, pz = [1 - rho, rho], [1.0, math.exp(-500)]
        else:
            pv = [v[0] * (1 - p.q_01) + v[1] * p.q_10, v[0] * p.q_01 + v[1] * (1 - p.q_10)]
            eta = level(i) + p.beta_S * (ls - m_s) * 0.5 / s_s + p.beta_Z * (z - m_z)
            one = 1 / (1 + math.exp(-eta))
            pz = [1 - one, one]
        parts = []
        for a in (0, 1):
            for b in (0, 1):
                w = var + (p.sigma2_1 if a else p.sigma2_0) * d
                rr = (p.tau2_1 if b else p.tau2_0) / max(1 + p.gamma * ls, 0.1)
                s = w + rr
                dens = math.exp(max(-0.5 * (math.log(2 * math.pi * s) + (y - mu) ** 2 / s), -500))
                parts.append((pv[a] * pz[b] * dens, mu + w / s * (y - mu), (1 - w / s) * w))
        tot = sum(x[0] for x in parts)
        q = [x[0] / tot for x in parts]
        new = sum(a * x[1] for a, x in zip(q, parts))
        var = sum(a * (x[2] + (x[1] - new) ** 2) for a, x in zip(q, parts))
        prev = (mu, var, v[1], z)
        mu, v, z = new, [q[0] + q[1], q[2] + q[3]], q[1] + q[3]
        out.append(dict(q=q, p_z=z, p_v=v[1], x=mu, var=var, ev=math.log(tot), prev=prev))
    return out
