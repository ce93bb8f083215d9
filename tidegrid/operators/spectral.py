"""Fourier and wavelet features of complete blocks held as arrays (column ``x``)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cols, prev, row_frames, scan
from .complexity import _total

# Daubechies filter with four taps, orthonormal.
_S3 = math.sqrt(3)
LOW = tuple(c / (4 * math.sqrt(2)) for c in (1 + _S3, 3 + _S3, 3 - _S3, 1 - _S3))
HIGH = (LOW[3], -LOW[2], LOW[1], -LOW[0])
LARGEST = 31  # prime factor that a transform takes directly


def factors(n: int) -> list[int]:
    """Prime factors in rising order."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _times(a: Column, re: Column, im: Column) -> Column:
    return _complex(a["re"] * re - a["im"] * im, a["re"] * im + a["im"] * re)


def _table(values) -> Column:
    return F.lit(np.array([float(v) for v in values]))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda a: use(a)), 1)


def _mixed_radix(x: Column, n: int) -> Column:
    """Fourier transform of an array of n complex numbers: one pass per prime factor, n times the sum of the factors in all.

    After factors with product l the array holds, for every residue k of l and every offset j below n / l, the
    transform of the values at j, j + n / l, j + 2 n / l, ...; a factor p joins p of these with their turns.
    """
    turns = [2 * math.pi * i / n for i in range(n)]
    cos, sin = _table(map(math.cos, turns)), _table(-math.sin(t) for t in turns)
    done = 1
    for p in factors(n):
        here, m = done * p, n // (done * p)

        def joined(a: Column, i: Column, done=done, p=p, here=here, m=m) -> Column:
            k, j = F.floor(i / m).cast("int"), i % m
            start = (k % done) * (n // done) + j + 1

            def term(r) -> tuple[Column, Column]:
                v, turn = F.element_at(a, start + m * r), (k * r % here) * (n // here) + 1
                c, d = F.element_at(cos, turn), F.element_at(sin, turn)
                return v["re"] * c - v["im"] * d, v["re"] * d + v["im"] * c

            if p <= 5:
                parts = [term(r) for r in range(p)]
                return _complex(sum((q[0] for q in parts[1:]), parts[0][0]), sum((q[1] for q in parts[1:]), parts[0][1]))
            return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), _complex(F.lit(0.0), F.lit(0.0)), lambda t, r: _complex(t["re"] + term(r)[0], t["im"] + term(r)[1]))

        x = _once(x, lambda a, joined=joined: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: joined(a, i)))
        done = here
    return x


def fourier(x: Column, n: int) -> Column:
    """The discrete Fourier transform of an array of n doubles, as an array of structs (re, im); NULL for arrays of another length.

    Lengths with a prime factor above ``LARGEST`` go through a convolution whose length is a power of two.
    """
    whole = F.transform(x, lambda v: _complex(v, F.lit(0.0)))
    fits = F.size(x) == n  # also guards the look-ups below where a plan computes the array before it filters
    if max(factors(n), default=1) <= LARGEST:
        return F.when(fits, _mixed_radix(whole, n))
    size = 1 << (2 * n - 2).bit_length()
    turns = [math.pi * (i * i % (2 * n)) / n for i in range(n)]
    chirp_re, chirp_im = _table(map(math.cos, turns)), _table(-math.sin(t) for t in turns)
    kernel = np.zeros(size, complex)
    kernel[:n] = np.exp(1j * np.array(turns))
    kernel[size - n + 1:] = kernel[1:n][::-1]
    spectrum = np.fft.fft(kernel) / size
    kernel_re, kernel_im = _table(spectrum.real), _table(-spectrum.imag)
    bent = F.transform(whole, lambda v, i: _times(v, F.element_at(chirp_re, i + 1), F.element_at(chirp_im, i + 1)))
    padded = F.concat(bent, F.array_repeat(_complex(F.lit(0.0), F.lit(0.0)), size - n))
    # the conjugate of the product, whose transform is the conjugate of the convolution
    product = F.transform(_mixed_radix(padded, size), lambda v, i: _times(_complex(v["re"], -v["im"]), F.element_at(kernel_re, i + 1), F.element_at(kernel_im, i + 1)))
    back = F.slice(_mixed_radix(product, size), 1, n)
    return F.when(fits, F.transform(back, lambda v, i: _times(_complex(v["re"], -v["im"]), F.element_at(chirp_re, i + 1), F.element_at(chirp_im, i + 1))))


def magnitudes(blocked: DataFrame, n: int, x: str = "x") -> DataFrame:
    """Magnitudes of the bins 0 .. n/2 - 1 of the discrete Fourier transform."""
    bins = F.slice(fourier(F.col(x), n), 1, n // 2)
    return blocked.withColumn("mag", F.transform(bins, lambda v: F.hypot(v["re"], v["im"])))


def spectral_features(mags: DataFrame, n: int, rate: float, bands: Sequence[tuple[int, int]], rolloff: float = 0.85,
                      min_bin: int = 1) -> DataFrame:
    """Band powers, centroid, peak, entropy and rolloff of the magnitudes."""
    m, step = F.col("mag"), rate / n
    d = mags.withColumn("_t", _total(m))
    total = F.nullif(F.col("_t"), F.lit(0.0))
    out = {f"band_{i}": _total(F.slice(m, lo + 1, hi - lo)) for i, (lo, hi) in enumerate(bands)}
    out["centroid"] = F.coalesce(_total(F.transform(m, lambda v, b: v * b * step)) / total, F.lit(0.0))
    best = F.array_max(F.transform(m, lambda v, b: F.when(b >= min_bin, F.struct(v.alias("v"), (-b).alias("b")))))
    out["peak_frequency"], out["peak_magnitude"] = -best["b"] * step, best["v"]
    share = F.transform(m, lambda v: v / total)
    out["spectral_entropy"] = F.coalesce(_total(F.transform(share, lambda p: F.when(p > 1e-10, -p * F.log2(p)).otherwise(0.0))), F.lit(0.0))
    # first bin at which the running total reaches the wanted part
    running = F.aggregate(m, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("b")), lambda s, v: F.struct(
        (s["s"] + v).alias("s"), F.when(s["s"] + v < F.col("_t") * rolloff, s["b"] + 1).otherwise(s["b"]).alias("b")))
    out["rolloff"] = running["b"] * step
    return d.withColumns(out).drop("_t")


def spectral_flux(mags: DataFrame, keys, block: str, chunk=None) -> DataFrame:
    """Root of summed squared increases against the previous block."""
    d = scan(mags, keys, block, {"_p": prev("mag")}, chunk=chunk)
    rise = F.zip_with("mag", "_p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return d.withColumn("flux", F.sqrt(_total(F.transform(rise, lambda v: v * v)))).drop("_p")


def _filter(x: Column, taps: Sequence[float], half: int, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: sum(
        (F.element_at(x, (i * 2 + s) % n + 1) * c for s, c in enumerate(taps)), F.lit(0.0)))


def dwt(blocked: DataFrame, n: int, levels: int, x: str = "x") -> DataFrame:
    """Periodic wavelet decomposition: details ``d1 .. dL`` and the last approximation ``a``."""
    if n % (1 << levels):
        raise ValueError("block length must be divisible by 2 ** levels")
    out, a, size = blocked, x, n
    for level in range(1, levels + 1):
        out = out.withColumns({f"d{level}": _filter(F.col(a), HIGH, size // 2, size), f"a{level}": _filter(F.col(a), LOW, size // 2, size)})
        a, size = f"a{level}", size // 2
    return out.withColumn("a", F.col(a)).drop(*[f"a{i}" for i in range(1, levels + 1)])


def energy(x: str) -> Column:
    return F.aggregate(F.col(x), F.lit(0.0), lambda s, v: s + v * v)


def wavelet_features(dec: DataFrame, levels: int) -> DataFrame:
    """Energy per level and its entropy."""
    names = [*[f"d{i}" for i in range(1, levels + 1)], "a"]
    out = dec.withColumns({f"energy_{c}": energy(c) for c in names})
    total = sum((F.col(f"energy_{c}") for c in names), F.lit(0.0))
    ent = sum((F.when(F.col(f"energy_{c}") > 0, -F.col(f"energy_{c}") / total * F.log2(F.col(f"energy_{c}") / total)).otherwise(0.0) for c in names), F.lit(0.0))
    return out.withColumn("wavelet_entropy", ent)


def packet_energy(blocked: DataFrame, n: int, depth: int, x: str = "x") -> DataFrame:
    """Norm of every node of the full wavelet-packet tree at ``depth``, left to right."""
    out, nodes, size = blocked, [x], n
    for level in range(depth):
        made, nxt = {}, []
        for i, node in enumerate(nodes):
            for taps in (LOW, HIGH):
                name = f"_n{level}_{len(nxt)}"
                made[name] = _filter(F.col(node), taps, size // 2, size)
                nxt.append(name)
        out, nodes, size = out.withColumns(made), nxt, size // 2
    keep = blocked.columns
    return out.withColumn("packet_norms", F.array(*[F.sqrt(energy(c)) for c in nodes])).select(*keep, "packet_norms")


def soft_threshold(x: str, t: float) -> Column:
    return F.transform(F.col(x), lambda v: F.when(F.abs(v) > t, F.signum(v) * (F.abs(v) - t)).otherwise(0.0))


def idwt(approx: Column, detail: Column, half: int) -> Column:
    """One synthesis step: every sample collects the two coefficients of each band that reach it."""
    def sample(i):
        j, odd = F.floor(i / 2).cast("int"), i % 2
        before = (j - 1 + half) % half
        near = lambda c: F.element_at(c, j + 1)
        far = lambda c: F.element_at(c, before + 1)
        even_v = LOW[0] * near(approx) + HIGH[0] * near(detail) + LOW[2] * far(approx) + HIGH[2] * far(detail)
        odd_v = LOW[1] * near(approx) + HIGH[1] * near(detail) + LOW[3] * far(approx) + HIGH[3] * far(detail)
        return F.when(odd == 0, even_v).otherwise(odd_v)

    return F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), sample)


def denoise(blocked: DataFrame, n: int, levels: int, threshold: float, x: str = "x", name: str = "denoised") -> DataFrame:
    """Shrink the details and rebuild the block."""
    out = dwt(blocked, n, levels, x)
    out = out.withColumns({f"d{i}": soft_threshold(f"d{i}", threshold) for i in range(1, levels + 1)})
    for i in range(levels, 0, -1):
        out = out.withColumn("a", idwt(F.col("a"), F.col(f"d{i}"), n >> i))
    return out.withColumn(name, F.col("a")).drop("a", *[f"d{i}" for i in range(1, levels + 1)])


def cwt(df: DataFrame, value: str, scales: Sequence[float], keys, order="ts", omega: float = 6.0, chunk="1 day",
        envelope: float = 9.0) -> DataFrame:
    """Morlet transform per row and scale (``re_i``, ``im_i``, ``cwt_i``).

    Beyond ``envelope`` scales a weight is below exp(-envelope ** 2 / 2): with the default under rounding.
    """
    x, d = F.col(value).cast("double"), df
    for i, s in enumerate(scales):
        r = int(math.ceil(envelope * s))
        names = {o: f"_at_{o + r}" for o in range(-r, r + 1)}

        def build(w, names=names):  # rows before the first and after the last add nothing
            return {n: (F.lag(x, -o, 0.0) if o < 0 else F.lead(x, o, 0.0)).over(w) for o, n in names.items()}

        # one projection per scale, as one for all would be too long to be compiled
        near, made = row_frames(d, keys, order, r, r, build, chunk=chunk), {}
        for part, fn in (("re", math.cos), ("im", math.sin)):
            weight = {o: math.exp(-0.5 * (o / s) ** 2) / math.sqrt(s) * fn(omega * -o / s) for o in names}
            made[f"{part}_{i}"] = sum((F.col(n) * weight[o] for o, n in names.items()), F.lit(0.0))
        d = near.select(*d.columns, *[c.alias(n) for n, c in made.items()])
    return d.withColumns({f"cwt_{i}": F.hypot(f"re_{i}", f"im_{i}") for i in range(len(scales))})


def coherence(df: DataFrame, x: str, y: str, scales: Sequence[float], half: int, keys, order="ts", omega: float = 6.0,
              chunk="1 day") -> DataFrame:
    """Wavelet coherence: smoothed cross spectrum over the smoothed own spectra, per row and scale."""
    def renamed(d, tag):
        return d.withColumnsRenamed({f"{p}_{i}": f"_{tag}{p}_{i}" for p in ("re", "im", "cwt") for i in range(len(scales))})

    d = renamed(cwt(df, x, scales, keys, order, omega, chunk), "x")
    d = renamed(cwt(d, y, scales, keys, order, omega, chunk), "y")

    def build(w):
        f, out = w.rowsBetween(-half, half), {}
        for i in range(len(scales)):
            a, b, c, e = (F.col(f"_{t}{p}_{i}") for t in "xy" for p in ("re", "im"))
            cross = F.hypot(F.sum(a * c + b * e).over(f), F.sum(b * c - a * e).over(f))
            own = F.sum(a * a + b * b).over(f) * F.sum(c * c + e * e).over(f)
            out[f"coherence_{i}"] = F.when(own > 0, cross / F.sqrt(F.nullif(own, F.lit(0.0)))).otherwise(0.0)
        return out

    out = row_frames(d, keys, order, half, half, build, chunk=chunk)
    return out.select(*df.columns, *[f"coherence_{i}" for i in range(len(scales))])


def explode_block(df: DataFrame, keys, name: str) -> DataFrame:
    """One row per array element with its position.

    The outer form keeps Catalyst from copying the array's whole expression into
    an inferred not-empty filter; complete blocks are never empty.
    """
    return df.select(*cols(keys), F.posexplode_outer(name).alias("pos", name))
