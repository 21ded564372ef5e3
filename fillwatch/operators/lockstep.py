"""The filter over many segments at once.

A segment is a run of one market's trades with a known or guessed start. All segments of a block advance together: step t moves
the t-th trade of every segment that is at least as long, as one set of array operations with a leading axis for
parameter sets. Rows are laid out by step, longest segments first, so that each step reads and writes slices. Where few
segments are left, the rest of each is walked with plain floats by the same formulas, which is faster for a handful.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from fillwatch.config import DENOM_FLOOR, FIRST_TRADE_LOG_P, LOG_LIK_FLOOR, PRICE_EPS, PROB_FLOOR, SIZE_SCALE_FLOOR, ModelParams

_LOG_2PI = math.log(2.0 * math.pi)
#: Segments times parameter sets below which plain floats are faster.
FEW = 48
STATE = ("mu", "var", "v1", "z1")
#: Trades of a piece of a long segment, how many of them give the next piece's first start, and the rounds that pieces may take.
PIECE, LEAD, ROUNDS = 1000, 250, 5
#: Difference of a piece's start from its predecessor's end that is let stand, a tenth of what segments are allowed.
TOL = 1e-13


@dataclass
class Filtered:
    """Results, one row per parameter set: probabilities over (V, Z), moments after each trade, evidence, and the moments before it."""

    q: np.ndarray  # (4, sets, rows)
    mu: np.ndarray
    var: np.ndarray
    ev: np.ndarray
    before: np.ndarray  # (4, sets, rows): mu, var, v1, z1; NaN at a market's first trade
    ends: np.ndarray  # (4, sets, segments)

    @property
    def p_z(self) -> np.ndarray:
        return self.q[1] + self.q[3]

    @property
    def p_v(self) -> np.ndarray:
        return self.q[2] + self.q[3]


def stationary(p: ModelParams) -> float:
    q = p.q_01 + p.q_10
    return p.q_01 / q if q > 0 else 0.5


def log_odds(params: Sequence[ModelParams], theta: np.ndarray) -> np.ndarray:
    """Insider level per set and trade: the pooled intercept, the wallet's propensity, or the prior mean where that is NaN."""
    out = np.empty((len(params), len(theta)))
    for k, p in enumerate(params):
        t = np.clip(np.where(np.isnan(theta), p.prior_mean, theta), PRICE_EPS, 1.0 - PRICE_EPS)
        out[k] = p.alpha if p.anonymous else np.log(t / (1.0 - t))
    return out


class _Layout:
    """Rows of segments laid end to end, and the same rows by step."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.start = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        n, top = int(lengths.sum()), int(lengths.max(initial=0))
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), side="right")  # segments longer than t
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = np.arange(n) - np.repeat(self.start, lengths)
        at = np.concatenate([[0], np.cumsum(self.active)])
        self.perm = np.empty(n, dtype=np.int64)
        self.perm[at[step] + np.repeat(rank, lengths)] = np.arange(n)
        self.at = at


def run(params: Sequence[ModelParams], const: tuple[float, float, float], lengths: np.ndarray, fresh: np.ndarray, y: np.ndarray,
        delta: np.ndarray, lsr: np.ndarray, level: np.ndarray, init: np.ndarray) -> Filtered:
    """Filter segments of ``lengths`` trades laid end to end; ``fresh`` ones begin a market, others at ``init`` (4, sets, segments)."""
    n, sets = len(y), len(params)
    wide = n * sets >= 4 * FEW * lengths.max(initial=1)
    if wide or n * sets < 2 * FEW * PIECE or not lengths.all():
        return _run(params, const, lengths, fresh, y, delta, lsr, level, init)
    start = np.cumsum(lengths) - lengths
    parts = -(-lengths // PIECE)
    whole = np.repeat(np.arange(len(lengths)), parts)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
    at, size = start[whole] + place * PIECE, np.minimum(PIECE, lengths[whole] - place * PIECE)
    later = np.flatnonzero(place)
    states = init[:, :, whole].astype(float)

    def part(a, size, states, begins):
        rows = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return rows, _run(params, const, size, begins, y[rows], delta[rows], lsr[rows], level[:, rows], states)

    lead = at[later] - LEAD  # a piece with a successor is a full one
    guess = np.array([[[p.tau2_0] for p in params], [[stationary(p)] for p in params], [[p.prior_mean] for p in params]])
    guess = np.concatenate([np.broadcast_to(y[lead], (1, sets, len(later))), np.broadcast_to(guess, (3, sets, len(later)))])
    none = np.zeros(len(whole), dtype=bool)
    first, other = (part(lead, np.full(len(later), LEAD), g, none[later])[1].ends for g in (guess, guess + [[[1.0]], [[0.0]], [[0.0]], [[0.0]]]))
    if np.mean(np.abs(first - other).max(axis=(0, 1)) > TOL) > 0.25:  # another start is still felt at the end
        return _run(params, const, lengths, fresh, y, delta, lsr, level, init)
    states[:, :, later] = first
    begins = fresh[whole] & (place == 0)
    out = Filtered(np.empty((4, sets, n)), np.empty((sets, n)), np.empty((sets, n)), np.empty((sets, n)), np.empty((4, sets, n)), states.copy())
    todo = np.arange(len(whole))
    for _ in range(ROUNDS):
        rows, f = part(at[todo], size[todo], states[:, :, todo], begins[todo])
        out.q[:, :, rows], out.mu[:, rows], out.var[:, rows], out.ev[:, rows], out.before[:, :, rows] = f.q, f.mu, f.var, f.ev, f.before
        out.ends[:, :, todo] = f.ends
        ends = out.ends[:, :, later - 1]
        moved = np.abs(ends - states[:, :, later]).max(axis=(0, 1)) > TOL
        if not moved.any():
            out.ends = out.ends[:, :, np.cumsum(parts) - 1]
            return out
        todo = later[moved]
        states[:, :, todo] = ends[:, :, moved]
    return _run(params, const, lengths, fresh, y, delta, lsr, level, init)


def _run(params: Sequence[ModelParams], const: tuple[float, float, float], lengths: np.ndarray, fresh: np.ndarray, y: np.ndarray,
         delta: np.ndarray, lsr: np.ndarray, level: np.ndarray, init: np.ndarray) -> Filtered:
    """``run`` without cutting."""
    m_s, s_s, m_z = const
    n, sets = len(y), len(params)
    col = lambda f: np.array([[f(p)] for p in params], dtype=float)
    size = (lsr - m_s) * (0.5 / s_s) if s_s > SIZE_SCALE_FLOOR else lsr - m_s
    beta_z = col(lambda p: p.beta_Z)
    eta = level + col(lambda p: p.beta_S) * size
    if beta_z.any():
        soft = None
    else:
        soft = np.where(eta > 35.0, eta, np.log1p(np.exp(np.minimum(eta, 35.0))))
    shrink = np.maximum(1.0 + col(lambda p: p.gamma) * lsr, DENOM_FLOOR)
    q01, q10, sv0, sv1 = col(lambda p: p.q_01), col(lambda p: p.q_10), col(lambda p: p.sigma2_0), col(lambda p: p.sigma2_1)
    r0, r1 = col(lambda p: p.tau2_0) / shrink, col(lambda p: p.tau2_1) / shrink
    lay = _Layout(lengths)
    state = np.where(fresh, np.array([[[0.0]] * sets, [[p.s0_2] for p in params], [[stationary(p)] for p in params], [[0.0]] * sets]), init)
    q, mus, vars_, ev = np.empty((4, sets, n)), np.empty((sets, n)), np.empty((sets, n)), np.empty((sets, n))
    few = np.flatnonzero(lay.active * sets < FEW)
    steps = int(few[0]) if len(few) else len(lay.active)
    ends = state.copy()
    if steps:
        head = lay.perm[:lay.at[steps]]
        made = np.empty((7, sets, len(head)))
        by_step = [np.ascontiguousarray(np.broadcast_to(x, (sets, n))[:, head]) for x in (y, delta, eta, r0, r1)]
        softs = None if soft is None else soft[:, head]
        now = state[:, :, lay.order]
        w, r, prior = (np.empty((4, sets, lay.active[0])) for _ in range(3))
        for t in range(steps):
            a, b = lay.at[t], lay.at[t + 1]
            k = b - a
            mu, var, v1, z1 = (x[:, :k] for x in now)
            yt, dt, et, r0t, r1t = (x[:, a:b] for x in by_step)
            if beta_z.any():
                et = et + beta_z * (z1 - m_z)
                st = np.where(et > 35.0, et, np.log1p(np.exp(np.minimum(et, 35.0))))
            else:
                st = softs[:, a:b]
            stay = 1.0 - v1
            pv0, pv1 = stay * (1.0 - q01) + v1 * q10, stay * q01 + v1 * (1.0 - q10)
            lz0, lz1 = -st, et - st
            if not t and fresh.any():
                new = fresh[lay.order][:k]
                begin = col(stationary)
                pv0, pv1 = np.where(new, 1.0 - begin, pv0), np.where(new, begin, pv1)
                lz0, lz1 = np.where(new, 0.0, lz0), np.where(new, FIRST_TRADE_LOG_P, lz1)
            lv0, lv1 = np.log(np.maximum(pv0, PROB_FLOOR)), np.log(np.maximum(pv1, PROB_FLOOR))
            wt, rt, pt = w[:, :, :k], r[:, :, :k], prior[:, :, :k]
            wt[0] = wt[1] = var + sv0 * dt
            wt[2] = wt[3] = var + sv1 * dt
            rt[0] = rt[2] = r0t
            rt[1] = rt[3] = r1t
            pt[0], pt[1], pt[2], pt[3] = lv0 + lz0, lv0 + lz1, lv1 + lz0, lv1 + lz1
            err = yt - mu
            s = wt + rt
            gain = wt / s
            score = pt + np.maximum(-0.5 * (_LOG_2PI + np.log(s) + err * err / s), LOG_LIK_FLOOR)
            top = score.max(0)
            e = np.exp(score - top)
            total = e.sum(0)
            share = e / total
            move = gain * err
            shift = (share * move).sum(0)
            out = made[:, :, a:b]
            out[:4] = share
            out[4] = mu + shift
            out[5] = (share * ((1.0 - gain) * wt + (move - shift) ** 2)).sum(0)
            out[6] = top + np.log(total)
            now = np.stack([out[4], out[5], share[2] + share[3], share[1] + share[3]])
            over = k - (lay.active[t + 1] if t + 1 < len(lay.active) else 0)
            if over:
                ends[:, :, lay.order[k - over:k]] = now[:, :, k - over:]
        q[:, :, head], mus[:, head], vars_[:, head], ev[:, head] = made[:4], made[4], made[5], made[6]
        if steps < len(lay.active):
            state[:, :, lay.order[:lay.active[steps]]] = now[:, :, :lay.active[steps]]
    for g in lay.order[:lay.active[steps]] if steps < len(lay.active) else ():
        a, b = int(lay.start[g]) + steps, int(lay.start[g] + lay.lengths[g])
        for k, p in enumerate(params):
            rows = _walk(p, m_z, state[:, k, g].tolist(), bool(fresh[g]) and not steps, y[a:b].tolist(), delta[a:b].tolist(),
                         shrink[k, a:b].tolist(), eta[k, a:b].tolist())
            made = np.array(rows).T
            q[:, k, a:b], mus[k, a:b], vars_[k, a:b], ev[k, a:b] = made[:4], made[4], made[5], made[6]
            ends[:, k, g] = made[4, -1], made[5, -1], made[2, -1] + made[3, -1], made[1, -1] + made[3, -1]
    before = np.empty((4, sets, n))
    before[:, :, 1:] = np.stack([mus, vars_, q[2] + q[3], q[1] + q[3]])[:, :, :-1]
    heads = lay.start[lengths > 0]
    before[:, :, heads] = np.where(fresh, np.nan, init)[:, :, lengths > 0]
    return Filtered(q, mus, vars_, ev, before, ends)


def _walk(p: ModelParams, m_z: float, state, first: bool, ys, deltas, shrinks, etas) -> list[tuple]:
    """One segment under one set, with plain floats; rows ``q00, q01, q10, q11, mu, var, evidence``."""
    exp, log, log1p = math.exp, math.log, math.log1p
    mu, var, v1, z1 = state
    q01, q10, sv0, sv1, t0, t1, beta_z = p.q_01, p.q_10, p.sigma2_0, p.sigma2_1, p.tau2_0, p.tau2_1, p.beta_Z
    floor, least = LOG_LIK_FLOOR, PROB_FLOOR
    out = []
    for y, delta, shrink, eta in zip(ys, deltas, shrinks, etas):
        if first:
            first, pv1 = False, stationary(p)
            pv0, lz0, lz1 = 1.0 - pv1, 0.0, FIRST_TRADE_LOG_P
        else:
            stay = 1.0 - v1
            pv0, pv1 = stay * (1.0 - q01) + v1 * q10, stay * q01 + v1 * (1.0 - q10)
            if beta_z:
                eta += beta_z * (z1 - m_z)
            soft = eta if eta > 35.0 else log1p(exp(eta))
            lz0, lz1 = -soft, eta - soft
        lv0, lv1 = log(pv0 if pv0 > least else least), log(pv1 if pv1 > least else least)
        err = y - mu
        err2, w0, w1, r0, r1 = err * err, var + sv0 * delta, var + sv1 * delta, t0 / shrink, t1 / shrink
        s0, s1, s2, s3 = w0 + r0, w0 + r1, w1 + r0, w1 + r1
        a0, a1 = -0.5 * (_LOG_2PI + log(s0) + err2 / s0), -0.5 * (_LOG_2PI + log(s1) + err2 / s1)
        a2, a3 = -0.5 * (_LOG_2PI + log(s2) + err2 / s2), -0.5 * (_LOG_2PI + log(s3) + err2 / s3)
        a0 = lv0 + lz0 + (a0 if a0 > floor else floor)
        a1 = lv0 + lz1 + (a1 if a1 > floor else floor)
        a2 = lv1 + lz0 + (a2 if a2 > floor else floor)
        a3 = lv1 + lz1 + (a3 if a3 > floor else floor)
        top = max(a0, a1, a2, a3)
        e0, e1, e2, e3 = exp(a0 - top), exp(a1 - top), exp(a2 - top), exp(a3 - top)
        total = e0 + e1 + e2 + e3
        e0, e1, e2, e3 = e0 / total, e1 / total, e2 / total, e3 / total
        k0, k1, k2, k3 = w0 / s0, w0 / s1, w1 / s2, w1 / s3
        d0, d1, d2, d3 = k0 * err, k1 * err, k2 * err, k3 * err
        shift = e0 * d0 + e1 * d1 + e2 * d2 + e3 * d3
        var = (e0 * ((1.0 - k0) * w0 + (d0 - shift) ** 2) + e1 * ((1.0 - k1) * w0 + (d1 - shift) ** 2)
               + e2 * ((1.0 - k2) * w1 + (d2 - shift) ** 2) + e3 * ((1.0 - k3) * w1 + (d3 - shift) ** 2))
        mu += shift
        v1, z1 = e2 + e3, e1 + e3
        out.append((e0, e1, e2, e3, mu, var, top + log(total)))
    return out


def run_known_path(p: ModelParams, lengths: np.ndarray, y, delta, lsr, v, z, init: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kalman filter over segments when regimes and flags are given: ``mu, var, log likelihood`` per trade, and the ends (2, segments)."""
    lay = _Layout(lengths)
    grow = np.where(v.astype(bool), p.sigma2_1, p.sigma2_0) * delta
    noise = np.where(z.astype(bool), p.tau2_1, p.tau2_0) / np.maximum(1.0 + p.gamma * lsr, DENOM_FLOOR)
    out, ends = np.empty((3, len(y))), init.copy()
    few = np.flatnonzero(lay.active < FEW)
    steps = int(few[0]) if len(few) else len(lay.active)
    mu, var = init[:, lay.order]
    for t in range(steps):
        rows = lay.perm[lay.at[t]:lay.at[t + 1]]
        k = len(rows)
        w = var[:k] + grow[rows]
        s, err = w + noise[rows], y[rows] - mu[:k]
        gain = w / s
        mu, var = mu[:k] + gain * err, (1.0 - gain) * w
        out[:, rows] = mu, var, np.maximum(-0.5 * (_LOG_2PI + np.log(s) + err * err / s), LOG_LIK_FLOOR)
        ends[:, lay.order[:k]] = mu, var
    for g in lay.order[:lay.active[steps]] if steps < len(lay.active) else ():
        m, x = ends[:, g].tolist()
        a, b = int(lay.start[g]) + steps, int(lay.start[g] + lay.lengths[g])
        rows = []
        for yt, gt, nt in zip(y[a:b].tolist(), grow[a:b].tolist(), noise[a:b].tolist()):
            w = x + gt
            s, err = w + nt, yt - m
            m, x = m + w / s * err, (1.0 - w / s) * w
            rows.append((m, x, max(-0.5 * (_LOG_2PI + math.log(s) + err * err / s), LOG_LIK_FLOOR)))
        out[:, a:b] = np.array(rows).T
        ends[:, g] = m, x
    return out[0], out[1], out[2], ends
