"""Changepoints, hidden states and parsing complexity.

Changepoints run over whole series of any length: ``frames.carried`` reads a series in order,
batch by batch, and hands a small state on, so that no task holds a series and nothing depends on
where batches or months end. Hidden states are fitted once per key from chunks of bounded
size whose transfer matrices are chained (``hmm_fit``, ``hmm_path``). Row labels are
numbered afterwards with a distributed scan.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..frames import carried, cols, exact_quantiles, floor_div, match, running_count, scan
from ..session import checkpoint
from ..sources.tables import stage

WAVES = 64  # random waves that stand for the kernel of the cost "rbf"


def sums_of(x: np.ndarray, model: str, scale: float = 1.0) -> np.ndarray:
    """What the cost of a segment needs of its readings in sum, one row per reading."""
    if model == "l2":
        return np.stack([x, x * x], axis=1)
    if model == "poisson":
        return x[:, None]
    if model == "rbf":
        speed, shift = waves()
        return math.sqrt(2 / WAVES) * np.cos(x[:, None] * (speed * math.sqrt(2 * scale)) + shift)
    raise ValueError(f"unknown cost {model}")


@cache
def waves() -> tuple[np.ndarray, np.ndarray]:
    """Fixed random waves: the mean product of two readings' waves is about exp(-scale (x - y)^2)."""
    random = np.random.default_rng(5)
    return random.normal(size=WAVES), random.uniform(0, 2 * math.pi, WAVES)


def segment_cost(total: np.ndarray, n: np.ndarray, model: str) -> np.ndarray:
    """Costs of segments of ``n`` readings with these sums (along the last axis)."""
    if model == "l2":
        return total[..., 1] - total[..., 0] ** 2 / n
    if model == "poisson":
        t = total[..., 0]
        return np.where(t > 0, t - t * np.log(np.maximum(t, 1e-300) / n), 0.0)
    return n - (total ** 2).sum(axis=-1) / n


class Pelt:
    """Optimal partitioning with pruning, reading by reading.

    Kept are the candidates for the start of the last segment: where they are, the best cost up to
    there, and the running sums. A candidate that is beaten at t is out for every
    end at which a segment may begin at t, that is from t + ``min_size`` on; it goes only
    then, so the result is the optimum. Each reading gives the start of the best last segment, and its number.
    Without changes few candidates are beaten, and their number grows with the series. A start is a
    candidate only ``min_size`` readings later, so as many readings are looked at together.
    """

    NEVER = np.iinfo(np.int64).max
    MOST = 1 << 18  # numbers of a table of readings by candidates

    def __init__(self, model: str, penalty: float, min_size: int):
        self.model, self.penalty, self.size = model, penalty, max(min_size, 1)
        self.t, self.run = 0, None

    def __call__(self, x: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if self.run is None:
            self.first = float(x[0]) if self.model == "l2" else 0.0  # costs do not depend on it, rounding does
            self.scale = 1.0 if scale is None else float(scale[0])
            self.run = np.zeros(sums_of(np.zeros(1), self.model).shape[1])
            self.at, self.best, self.sums = np.zeros(1, np.int64), np.array([-self.penalty]), self.run[None, :].copy()
            self.beaten = np.full(1, self.NEVER)
            # the last min_size readings: number, best cost, sums
            self.waiting = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(self.run)))
        cuts = np.zeros(len(x), np.int64)
        runs = np.cumsum(np.vstack([self.run, sums_of(x - self.first, self.model, self.scale)]), axis=0)[1:]
        k = 0
        while k < len(x):
            several = max(1, self.MOST // ((len(self.at) + self.size) * runs.shape[1]))
            m = min(self.size, len(x) - k, several)
            cuts[k:k + m] = self.block(runs[k:k + m])
            k += m
        self.run = runs[-1]
        return cuts, np.arange(self.t - len(x) + 1, self.t + 1)

    def block(self, run: np.ndarray) -> np.ndarray:
        """Starts of the best last segments of at most ``min_size`` readings with these running sums."""
        m, size = len(run), self.size
        t = np.arange(self.t + 1, self.t + m + 1)
        newest = t - size  # the latest start of a segment that ends at t
        number, cost, sums = self.waiting
        stay = self.beaten > newest[0]  # those beaten at or before this start are out now
        enter = (number >= max(size, newest[0])) & (number <= newest[-1])
        if enter.any() or not stay.all():
            self.at, self.best = np.concatenate([self.at[stay], number[enter]]), np.concatenate([self.best[stay], cost[enter]])
            self.sums = np.concatenate([self.sums[stay], sums[enter]])
            self.beaten = np.concatenate([self.beaten[stay], np.full(enter.sum(), self.NEVER)])
        best, cut = np.full(m, math.inf), np.zeros(m, np.int64)
        can = max(0, -int(newest[0]))  # readings before the first possible end
        if can < m:
            out = (self.at > newest[can:, None]) | (self.beaten <= newest[can:, None])
            length = np.where(out, 1, t[can:, None] - self.at)
            reach = self.best + segment_cost(run[can:, None] - self.sums, length, self.model)
            reach[out] = math.inf
            i = np.argmin(reach, axis=1)
            best[can:], cut[can:] = reach[np.arange(len(i)), i] + self.penalty, self.at[i]
            over = (reach > best[can:, None]) & ~out
            first = np.where(over.any(axis=0), t[can:][np.argmax(over, axis=0)], self.NEVER)
            self.beaten = np.minimum(self.beaten, first)
        self.t += m
        self.waiting = tuple(np.concatenate(z)[-size:] for z in zip(self.waiting, (t, best, run)))
        return cut


class Breaks:
    """Follows the starts of last segments from the end of a series back; gives whether a row opens a segment."""

    def __init__(self):
        self.next = None

    def __call__(self, number: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray]:
        flag = np.zeros(len(number), bool)
        if self.next is None:
            self.next = int(cut[0])
        top = int(number[0])  # rows come with falling numbers, from 1
        while self.next > 0 and self.next >= int(number[-1]):
            # a segment that starts after ``next`` readings opens with the reading after them
            opener = top - (self.next + 1)
            if 0 <= opener < len(number):
                flag[opener] = True
            self.next = int(cut[top - self.next])
        # the reading after the last one of the batch
        if 0 < self.next == int(number[-1]) - 1:
            flag[-1] = True
        return (flag,)


def pelt(df: DataFrame, value: str, keys, order: str = "ts", model: str = "rbf", penalty: float = 10.0, min_size: int = 48) -> DataFrame:
    """Rows (keys, order, value, is_break); ``is_break`` marks the first row of every new segment of the whole series.

    ``model``: squared error ``l2``, ``poisson`` counts, or ``rbf``, a Gaussian kernel given by ``WAVES`` random waves, whose width is
    the median squared difference between the percentiles of the series. Rows without a value are left out.
    """
    k = cols(keys)
    base = df.where(F.col(value).isNotNull()).select(*k, order, F.col(value).cast("double").alias(value))
    given = [value]
    if model == "rbf":
        ends = exact_quantiles(base, k, value, {f"q{i}": i / 100 for i in range(101)}, chunk=None)
        several = F.array(*[F.pow(F.col(f"q{i}") - F.col(f"q{j}"), 2) for i in range(0, 101, 5) for j in range(0, i, 5)])
        middle = F.array_sort(F.filter(several, lambda d: d > 0))
        scale = F.when(F.size(middle) > 0, 1 / F.element_at(middle, ((F.size(middle) + 1) / 2).cast("int"))).otherwise(F.lit(1.0))
        base, given = match(base, ends.select(*k, scale.alias("_scale")), k), [value, "_scale"]
    found = checkpoint(carried(base, k, order, given, "_cut long, _number long", lambda: Pelt(model, penalty, min_size)).select(*k, order, value, "_cut", "_number"))
    return carried(found, k, order, ["_number", "_cut"], "is_break boolean", Breaks, back=True).select(*k, order, value, "is_break")


@cache
def gamma_ratios(n: int) -> np.ndarray:
    """ln Gamma(1.5 + r / 2) - ln Gamma(1 + r / 2) for run lengths r."""
    return np.array([math.lgamma(1.5 + r / 2) - math.lgamma(1 + r / 2) for r in range(n)])


def gamma_ratio(run: np.ndarray) -> np.ndarray:
    """The same for any run length, by its asymptotic series for long ones."""
    a = np.maximum(1 + run / 2, 500.0)
    return np.where(run < 1000, gamma_ratios(1000)[np.minimum(run, 999).astype(int)], 0.5 * np.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3))


class RunLengths:
    """P(a new run starts at t | data up to t) under a Normal-Gamma(0, 1, 1, 1) prior and hazard 1 / lam.

    Run lengths whose probability falls below ``tolerance`` are dropped and the others carried on, so the
    state stays as long as the plausible runs. The first reading of a series carries no information (0).
    """

    def __init__(self, lam: float, tolerance: float, numbers=None):
        self.hazard, self.tolerance, self.started = 1.0 / lam, tolerance, numbers is not None
        if self.started:
            self.run, self.mu, self.kappa, self.alpha, self.beta, self.mass = np.array(numbers, float).reshape(6, -1)

    def numbers(self) -> list[float]:
        """The state, from which another instance can go on."""
        return np.concatenate([self.run, self.mu, self.kappa, self.alpha, self.beta, self.mass]).tolist()

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray]:
        if not self.started:
            self.run = np.zeros(1, np.int64)
            self.mu, self.kappa, self.alpha, self.beta = (np.array([v]) for v in (0.0, 1.0, 1.0, 1.0))
            self.mass = np.array([1.0])
        out = np.empty(len(x))
        for k, v in enumerate(x):
            run, mu, kappa, alpha, beta = self.run, self.mu, self.kappa, self.alpha, self.beta
            scale = beta * (kappa + 1) / (alpha * kappa)
            z = (v - mu) ** 2 / (2 * alpha * scale)
            like = np.exp(gamma_ratio(run) - 0.5 * np.log(2 * np.pi * alpha * scale) - (alpha + 0.5) * np.log1p(z))
            # run length 0 is the prior: v as the first value of a new run
            new = self.mass * like * np.where(run == 0, 1.0, 1.0 - self.hazard) if self.started else self.mass * like
            new = new / new.sum()
            out[k] = new[0] if self.started else 0.0
            kept = new >= self.tolerance
            post = lambda p, q: np.concatenate([[p], q[kept]])
            self.run = post(0, run + 1)
            self.mu, self.kappa = post(0.0, (kappa * mu + v) / (kappa + 1)), post(1.0, kappa + 1)
            self.alpha, self.beta = post(1.0, alpha + 0.5), post(1.0, beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1)))
            self.mass = post(self.hazard, new)
            self.started = True
        return (out,)


def bocpd(df: DataFrame, value: str, keys, lam: float = 200.0, order: str = "ts", tolerance: float = 1e-12) -> DataFrame:
    """Rows (keys, order, value, cp_prob): online changepoint probability over the whole series. Rows without a value are left out."""
    k = cols(keys)
    base = df.where(F.col(value).isNotNull()).select(*k, order, F.col(value).cast("double").alias(value))
    return carried(base, k, order, [value], "cp_prob double", lambda: RunLengths(lam, tolerance))


# ------------------------------------------------------------------ hidden states


@cache
def start_parameters(states: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions that mostly stay, emissions centred on equal parts of the symbols, equal first states."""
    a = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(a, 0.9 if states > 1 else 1.0)
    centre = (np.arange(states) + 0.5) * symbols / states
    b = np.exp(-np.abs(np.arange(symbols)[None, :] + 0.5 - centre[:, None])) + 1e-3
    return a, b / b.sum(1, keepdims=True), np.full(states, 1 / states)


def hmm_chunks(df: DataFrame, symbol: str, keys, order: str = "ts", size: int = 4096, chunk="1 day") -> DataFrame:
    """Rows (keys, part, times, symbols): each series cut into numbered parts of ``size`` symbols, one byte each. Rows without a symbol are left out."""
    k = cols(keys)
    numbered = scan(df.where(F.col(symbol).isNotNull()).select(*k, order, F.col(symbol).cast("int").alias(symbol)), k, order, {"_no": running_count()}, chunk=chunk)
    row = F.struct(F.col("_no").alias("n"), F.col(order).alias("t"), F.col(symbol).alias("s"))
    parts = numbered.groupBy(*k, floor_div(F.col("_no") - 1, size).alias("part")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    symbols = F.unhex(F.array_join(F.transform("r", lambda r: F.lpad(F.hex(r["s"].cast("long")), 2, "0")), ""))
    return checkpoint(parts.select(*k, "part", F.transform("r", lambda r: r["t"]).alias("times"), symbols.alias("symbols")))


def _parts(batch, states: int):
    """Symbols of the parts of a batch side by side, which of them are there, and their parameters."""
    raw = [np.frombuffer(s, np.uint8) for s in batch.column("symbols").to_pylist()]
    size = np.array([len(r) for r in raw])
    seen = np.zeros((len(raw), size.max()), np.int64)
    for row, r in zip(seen, raw):
        row[:len(r)] = r
    a, b, pi = (np.array(batch.column(c).to_pylist(), float) for c in ("a", "b", "pi"))
    first = batch.column("part").to_numpy() == 0
    a = a.reshape(len(raw), states, states)
    # the step into the first symbol of a series is no transition
    into = np.where(first[:, None, None], np.eye(states), a)
    return seen, size, a, b.reshape(len(raw), states, -1), pi, into


def _over_parts(df: DataFrame, keys, fields: str, states: int, fn) -> DataFrame:
    """Append to (keys, part) what ``fn`` makes of the parts of a batch, a dict of one list per field."""
    k = cols(keys)
    schema = StructType([*(df.schema[c] for c in [*k, "part"]), *StructType.fromDDL(fields)])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                made = fn(batch, states)
                columns = [*(batch.column(c) for c in [*k, "part"]), *(pa.array(made[f.name], f.type) for f in list(out)[len(k) + 1:])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def _transfer(batch, states: int) -> dict:
    """The product of the steps of each part, scaled to a sum of one."""
    seen, size, a, b, pi, into = _parts(batch, states)
    rows = np.arange(len(size))
    m = into * b[rows, :, seen[:, 0]][:, None, :]
    for t in range(1, seen.shape[1]):
        m = np.where((t < size)[:, None, None], np.matmul(m, a) * b[rows, :, seen[:, t]][:, None, :], m)
        m = m / m.sum(axis=(1, 2), keepdims=True)
    return {"m": m.reshape(len(m), -1).tolist(), "pi": pi.tolist()}


class Forward:
    """Probabilities of the states before each part, given all symbols before it."""

    def __init__(self):
        self.alpha = None

    def __call__(self, m: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray]:
        out = np.empty(len(m), object)
        for k, (x, p) in enumerate(zip(m, pi)):
            self.alpha = np.asarray(p) if self.alpha is None else self.alpha
            out[k] = self.alpha.tolist()
            self.alpha = self.alpha @ np.asarray(x).reshape(len(p), -1)
            self.alpha = self.alpha / self.alpha.sum()
        return (out,)


class Backward:
    """How likely the symbols after each part are from each state."""

    def __init__(self):
        self.beta = None

    def __call__(self, m: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray]:
        out = np.empty(len(m), object)
        for k, (x, p) in enumerate(zip(m, pi)):
            self.beta = np.ones(len(p)) if self.beta is None else self.beta
            out[k] = self.beta.tolist()
            self.beta = np.asarray(x).reshape(len(p), -1) @ self.beta
            self.beta = self.beta / self.beta.sum()
        return (out,)


def _counts(batch, states: int) -> dict:
    """Expected transitions, emissions and first states of each part."""
    seen, size, a, b, pi, into = _parts(batch, states)
    alpha, beta = (np.array(batch.column(c).to_pylist(), float) for c in ("alpha", "beta"))
    rows, n, symbols = np.arange(len(size)), seen.shape[1], b.shape[2]
    fwd = np.empty((n, len(rows), states))
    now = alpha
    for t in range(n):
        now = np.einsum("ci,cij->cj", now, into if t == 0 else a) * b[rows, :, seen[:, t]]
        now = now / now.sum(axis=1, keepdims=True)
        fwd[t] = now
    steps, emitted, first = np.zeros((len(rows), states, states)), np.zeros((len(rows), states, symbols)), np.zeros((len(rows), states))
    begins = batch.column("part").to_numpy() == 0
    back = beta
    for t in range(n - 1, -1, -1):
        there = (t < size)[:, None]
        gamma = fwd[t] * back
        gamma = np.where(there, gamma / gamma.sum(axis=1, keepdims=True), 0.0)
        emitted[rows, :, seen[:, t]] += gamma
        ahead = b[rows, :, seen[:, t]] * back
        if t == 0:
            first += np.where(begins[:, None], gamma, 0.0)
        before = fwd[t - 1] if t else alpha
        step = before[:, :, None] * a * ahead[:, None, :]
        step = step / step.sum(axis=(1, 2), keepdims=True)
        steps += np.where(there[:, :, None] & ((t > 0) | ~begins)[:, None, None], step, 0.0)
        into_now = np.einsum("cij,cj->ci", a, ahead)
        back = np.where(there, into_now / into_now.sum(axis=1, keepdims=True), back)
    return {"steps": steps.reshape(len(rows), -1).tolist(), "emitted": emitted.reshape(len(rows), -1).tolist(), "first": first.tolist()}


def hmm_fit(parts: DataFrame, keys, states: int, symbols: int, iterations: int = 20, start=None) -> DataFrame:
    """One row per key with the transitions ``a``, emissions ``b`` (row by row) and first states ``pi``, by Baum-Welch over whole series.

    Each iteration multiplies the steps of every part to one matrix, chains these small matrices along a
    series from both ends, counts within the parts, and adds the counts up per key.
    """
    k = cols(keys)
    given = dict(zip(("a", "b", "pi"), start or start_parameters(states, symbols)))
    params = parts.select(*k).distinct().select(*k, *[F.array(*[F.lit(float(x)) for x in np.ravel(v)]).alias(n) for n, v in given.items()])

    def shares(x: Column, width: int, extra: float) -> Column:
        total = [sum((x[i * width + j] for j in range(1, width)), x[i * width]) + width * extra for i in range(states)]
        return F.array(*[(x[i * width + j] + extra) / total[i] for i in range(states) for j in range(width)])

    for _ in range(iterations):
        whole = match(parts.select(*k, "part", "symbols"), params, k)
        chained = _over_parts(whole, k, "m array<double>, pi array<double>", states, _transfer)
        alpha = carried(chained, k, "part", ["m", "pi"], "alpha array<double>", Forward).select(*k, "part", "alpha")
        beta = carried(chained, k, "part", ["m", "pi"], "beta array<double>", Backward, back=True).select(*k, "part", "beta")
        both = match(match(whole, alpha, [*k, "part"]), beta, [*k, "part"])
        counts = _over_parts(both, k, "steps array<double>, emitted array<double>, first array<double>", states, _counts)
        size = {"steps": states * states, "emitted": states * symbols, "first": states}
        sums = counts.groupBy(*k).agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c, n in size.items()])
        # a written table: a checkpoint would hand on what the optimizer knows of the old plan, which grows with every iteration
        params = stage(sums.select(*k, shares(F.col("steps"), states, 1e-9).alias("a"), shares(F.col("emitted"), symbols, 1e-6).alias("b"), F.col("first").alias("pi")), "params")
    return params


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def _best(batch, states: int) -> dict:
    """The best log probability through each part from every state before it to every last state."""
    seen, size, a, b, pi, into = _parts(batch, states)
    rows = np.arange(len(size))
    step, emit = _log(a), _log(b)
    m = _log(into) + emit[rows, :, seen[:, 0]][:, None, :]
    for t in range(1, seen.shape[1]):
        on = (m[:, :, :, None] + step[:, None]).max(axis=2) + emit[rows, :, seen[:, t]][:, None, :]
        m = np.where((t < size)[:, None, None], on, m)
    return {"m": m.reshape(len(m), -1).tolist(), "pi": _log(pi).tolist()}


class BestSoFar:
    """The best log probability of every state before each part."""

    def __init__(self):
        self.score = None

    def __call__(self, m: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray]:
        out = np.empty(len(m), object)
        for k, (x, p) in enumerate(zip(m, pi)):
            self.score = np.asarray(p) if self.score is None else self.score
            out[k] = self.score.tolist()
            self.score = (self.score[:, None] + np.asarray(x).reshape(len(p), -1)).max(axis=0)
            self.score = self.score - self.score.max()
        return (out,)


class LastState:
    """The state at the end of each part on the best path, and before it, from the end of a series back."""

    def __init__(self):
        self.state = None

    def __call__(self, m: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, before = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
        for k, (x, s) in enumerate(zip(m, score)):
            through = np.asarray(s)[:, None] + np.asarray(x).reshape(len(s), -1)
            out[k] = int(through.max(axis=0).argmax()) if self.state is None else self.state
            before[k] = self.state = int(through[:, out[k]].argmax())
        return out, before


def _decoded(batch, states: int) -> dict:
    """The best path through each part between the states before it and at its end."""
    seen, size, a, b, pi, into = _parts(batch, states)
    last, before = (batch.column(c).to_numpy() for c in ("last", "before"))
    rows, n = np.arange(len(size)), seen.shape[1]
    step, emit, begins = _log(a), _log(b), batch.column("part").to_numpy() == 0
    from_before = np.where(begins[:, None], _log(pi), step[rows, before])
    score = from_before + emit[rows, :, seen[:, 0]]
    came = np.zeros((n, len(rows), states), np.int8)
    for t in range(1, n):
        on = score[:, :, None] + step
        came[t] = on.argmax(axis=1)
        score = np.where((t < size)[:, None], on.max(axis=1) + emit[rows, :, seen[:, t]], score)
    path, now = np.zeros((len(rows), n), np.int64), last.copy()
    for t in range(n - 1, -1, -1):
        here = t < size
        path[here, t] = now[here]
        if t:
            now = np.where(here, came[t, rows, now], now)
    return {"path": [p[:s].tolist() for p, s in zip(path, size)]}


def hmm_path(parts: DataFrame, params: DataFrame, keys, states: int, symbol: str = "symbol", order: str = "ts") -> DataFrame:
    """Rows (keys, order, symbol, state): the most likely states over whole series, of equal ones the smallest at the latest difference.

    The best scores through the parts are chained forwards, the states at their ends found backwards, and each part is decoded between them.
    """
    k = cols(keys)
    whole = match(parts.select(*k, "part", "symbols"), params.select(*k, "a", "b", "pi"), k)
    chained = _over_parts(whole, k, "m array<double>, pi array<double>", states, _best)
    scored = carried(chained, k, "part", ["m", "pi"], "score array<double>", BestSoFar)
    ends = carried(scored, k, "part", ["m", "score"], "last long, before long", LastState, back=True).select(*k, "part", "last", "before")
    paths = _over_parts(match(whole, ends, [*k, "part"]), k, "path array<int>", states, _decoded)
    rows = match(parts, paths, [*k, "part"])
    codes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.conv(F.hex(F.substring(F.col("symbols"), i, F.lit(1))), 16, 10).cast("int"))
    return (rows.select(*k, F.explode(F.arrays_zip(F.col("times").alias("t"), codes.alias("s"), F.col("path").alias("p"))).alias("r"))
            .select(*k, F.col("r.t").alias(order), F.col("r.s").alias(symbol), F.col("r.p").alias("state")))


def hmm_states(df: DataFrame, symbol: str, keys, states: int, symbols: int, order: str = "ts", iterations: int = 20, size: int = 4096, chunk="1 day") -> DataFrame:
    """Hidden state per row of a quantised series (symbols 0 to ``symbols`` - 1), fitted and decoded once per key. ``chunk`` as in ``scan``."""
    parts = hmm_chunks(df, symbol, keys, order, size, chunk)
    return hmm_path(parts, hmm_fit(parts, keys, states, symbols, iterations), keys, states, symbol, order)


# ------------------------------------------------------------------------ parsing


def lz_phrases(bits: str) -> int:
    """Number of phrases of the exhaustive Lempel-Ziv (1976) parsing, by a suffix automaton of what has been read: linear in the length.

    A phrase ends with the first symbol after which it has not occurred from an earlier start.
    """
    step, link, size = [{}], [-1], [0]
    whole = here = length = phrases = 0  # state of all that was read; state and length of the open phrase
    for c in bits:
        if c in step[here]:
            here, length = step[here][c], length + 1
        else:
            phrases, here, length = phrases + 1, 0, 0
        new, at = len(step), whole
        step.append({})
        link.append(0)
        size.append(size[whole] + 1)
        while at != -1 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at != -1:
            to = step[at][c]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                while at != -1 and step[at].get(c) == to:
                    step[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        whole = new
        while here and size[link[here]] >= length:  # the open phrase may belong to the copy now
            here = link[here]
    return phrases + (length > 0)


def lz_complexity(blocked: DataFrame, threshold: Column, x: str = "x") -> DataFrame:
    """Lempel-Ziv complexity of each block, binarised at the threshold."""
    bits = F.array_join(F.transform(F.col(x), lambda v: F.when(v > threshold, "1").otherwise("0")), "")

    @F.pandas_udf("int")
    def phrases(s: pd.Series) -> pd.Series:
        return s.map(lz_phrases).astype("int32")

    return blocked.withColumn("lz_complexity", phrases(bits))
