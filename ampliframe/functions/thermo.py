"""Thermodynamics: nearest-neighbour melting temperature and annealing as columns, dimers and hairpins as numpy models.

Nearest-neighbour parameters are SantaLucia's unified set (PNAS 95:1460, 1998) with the monovalent equivalent of divalent
salt of von Ahsen et al. (2001). Dimer and hairpin scores are stacking models over ungapped alignments; they are models
of this library's own and are labelled approximate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

#: dH (kcal/mol) and dS (cal/mol K) of stacked pairs; published fixed values.
NEAREST = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "TT": (-7.9, -22.2), "TG": (-8.5, -22.7),
    "AC": (-8.4, -22.4), "AG": (-7.8, -21.0), "TC": (-8.2, -22.2), "CC": (-8.0, -19.9),
}
END_AT, END_GC = (2.3, 4.1), (0.1, -2.8)
SYMMETRY = -1.4
GAS = 1.987


def salt(c: Config) -> float:
    """Monovalent equivalent, in mol/l."""
    return (c.mv_conc + 120 * math.sqrt(max(c.dv_conc - c.dntp_conc, 0.0))) / 1000


def _table(k: int) -> Column:
    return F.create_map(*(F.lit(x) for s, v in NEAREST.items() for x in (s, v[k])))


def enthalpy_entropy(s: Column) -> tuple[Column, Column]:
    """dH and dS of a duplex with its complement, without the salt term; null if s has other characters than ACGT."""
    steps = F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    own = s == F.translate(F.reverse(s), "ACGT", "TGCA")
    out = []
    for k in (0, 1):
        ends = sum((F.when(end.isin("A", "T"), END_AT[k]).otherwise(END_GC[k]) for end in (F.substring(s, 1, 1), F.substring(s, -1, 1))), F.lit(0.0))
        total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.try_element_at(_table(k), x)) + ends
        out.append(total + F.when(own, SYMMETRY).otherwise(0.0) if k else total)
    return out[0], out[1]


def melting(s: Column, c: Config = Config()) -> Column:
    """Melting temperature in degrees Celsius."""
    dh, ds = enthalpy_entropy(s)
    own = s == F.translate(F.reverse(s), "ACGT", "TGCA")
    ds = ds + 0.368 * (F.length(s) - 1) * math.log(salt(c))
    conc = F.when(own, math.log(c.dna_conc * 1e-9)).otherwise(math.log(c.dna_conc * 1e-9 / 4))
    return 1000 * dh / (ds + GAS * conc) - 273.15


def pair_melting(s: Column, c: Config = Config(), strict_fix: bool = False) -> Column:
    """Melting temperature as pairs report it: with the DNA's concentration in the place of dNTP's, unless strict_fix."""
    return melting(s, c if strict_fix else c.with_(dntp_conc=c.dna_conc))


def annealed(dg: Column, temperature: Column, c: Config = Config()) -> Column:
    """Per cent of the primer that is bound, from a duplex's free energy (cal/mol) at a temperature."""
    ka = F.exp(-dg / (GAS * (temperature + 273.15)))
    return 100 / (1 + F.sqrt(1 / ((c.dna_conc / 4e9) * ka)))


def annealing_profile(s: Column, c: Config = Config()) -> Column:
    """Rounded per cents at 40 to 80 degrees."""
    dh, ds = enthalpy_entropy(s)
    ds = ds + 0.368 * (F.length(s) - 1) * math.log(salt(c))
    return F.transform(F.sequence(F.lit(40), F.lit(80)), lambda t: F.round(annealed(1000 * dh - (t + 273.15) * ds, t, c), 4))


def status(s: Column, gc: Column, tm: Column, homopolymer: Column, c: Config = Config()) -> Column:
    """The first check that a primer fails, or PASS; hairpins, the costly check, come in a later projection."""
    checks = F.when(gc > c.primer_gc_max, "HIGH_GC").when(gc < c.primer_gc_min, "LOW_GC").when(F.length(s) > c.primer_size_max, "TO_LONG")
    if c.use_annealing:
        dh, ds = enthalpy_entropy(s)
        ds = ds + 0.368 * (F.length(s) - 1) * math.log(salt(c))
        t = c.primer_annealing_tempc
        bound = annealed(1000 * dh - (t + 273.15) * ds, F.lit(t), c)
        checks = checks.when(bound > c.primer_annealing_prop + 5, "HIGH_ANNEALING").when(bound < c.primer_annealing_prop - 5, "LOW_ANNEALING")
    else:
        checks = checks.when(tm > c.primer_tm_max + 2, "HIGH_TM").when(tm < c.primer_tm_min, "LOW_TM")
    return checks.when(homopolymer > c.primer_homopolymer_max, "MAX_HOMOPOLY").otherwise("PASS")


# numpy models, for pandas UDFs, walks and solvers

CODE = np.full(256, 4, np.int8)
CODE[[65, 67, 71, 84]] = range(4)
STACK_H, STACK_S = np.zeros((5, 5)), np.zeros((5, 5))
for _pair, (_h, _s) in NEAREST.items():
    STACK_H["ACGT".index(_pair[0]), "ACGT".index(_pair[1])] = _h
    STACK_S["ACGT".index(_pair[0]), "ACGT".index(_pair[1])] = _s


def codes(s: str) -> np.ndarray:
    return CODE[np.frombuffer(s.encode(), np.uint8)]


def tm_of(s: str, c: Config = Config()) -> float:
    dh, ds = duplex_of(s, c)
    own = s == s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return 1000 * dh / (ds + GAS * math.log(c.dna_conc * 1e-9 / (1 if own else 4))) - 273.15


def duplex_of(s: str, c: Config = Config()) -> tuple[float, float]:
    """dH and dS of a sequence's duplex with its complement, at the run's salt."""
    dh = ds = 0.0
    for pair in map("".join, zip(s, s[1:])):
        h, e = NEAREST[pair]
        dh, ds = dh + h, ds + e
    for end in (s[0], s[-1]):
        h, e = END_AT if end in "AT" else END_GC
        dh, ds = dh + h, ds + e
    own = s == s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return dh, ds + (SYMMETRY if own else 0.0) + 0.368 * (len(s) - 1) * math.log(salt(c))


def annealed_of(s: str, c: Config = Config()) -> float:
    """Per cent of a primer that is bound at the run's annealing temperature."""
    dh, ds = duplex_of(s, c)
    t = c.primer_annealing_tempc + 273.15
    ka = math.exp(min(-(1000 * dh - t * ds) / (GAS * t), 700.0))
    return 100 / (1 + math.sqrt(1 / (c.dna_conc / 4e9 * ka)))


#: Weights of a pair and of a mismatch in the dimer score. With these the known dimers lie under -26, the known clean pair
#: and the pools of a published scheme above.
PAIR_GC, PAIR_AT, MISMATCH = -4.0, -2.4, 4.0


_PAIR = np.full((5, 5), MISMATCH, np.float32)
_PAIR[0, 3] = _PAIR[3, 0] = PAIR_AT
_PAIR[1, 2] = _PAIR[2, 1] = PAIR_GC
_PAIR = _PAIR.ravel()
CHUNK = 4096


def dimer_profiles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores (pairs x offsets) of all ungapped offsets of codes a (pairs x n) against b (pairs x m) reversed: pairs lower
    them and mismatches raise them. Only stretches that start at a 3' end inside the overlap count, as only these are
    extended."""
    n, m, y = a.shape[1], b.shape[1], b[:, ::-1]
    out = np.zeros((len(a), max(n + m - 3, 1)), np.float32)
    left = a.astype(np.intp) * 5
    for k, off in enumerate(range(-(n - 2), m - 1)):
        lo, hi = max(0, -off), min(n, m - off)
        value = _PAIR[left[:, lo:hi] + y[:, lo + off : hi + off]]
        if hi == n:  # a's 3' end
            np.minimum(out[:, k], np.cumsum(value[:, ::-1], 1).min(1), out=out[:, k])
        if lo + off == 0:  # b's 3' end
            np.minimum(out[:, k], np.cumsum(value, 1).min(1), out=out[:, k])
    return out


def dimer_scores(a: str, b: str) -> np.ndarray:
    """dimer_profiles of two sequences; offset k is k - (len(a) - 2)."""
    return dimer_profiles(codes(a)[None], codes(b)[None])[0].astype(float)


def lowest_scores(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest dimer score of sequences i[k] and j[k], where sequence x is flat[start[x] : start[x] + size[x]] of codes.

    Pairs of equal lengths are scored together."""
    out = np.zeros(len(i), np.float32)
    kind = size[i] * (int(size.max(initial=0)) + 1) + size[j]
    order = np.argsort(kind, kind="stable")
    edges = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:]):
        for at in range(lo, hi, CHUNK):
            own = order[at : min(at + CHUNK, hi)]
            n, m = int(size[i[own[0]]]), int(size[j[own[0]]])
            a, b = flat[start[i[own]][:, None] + np.arange(n)], flat[start[j[own]][:, None] + np.arange(m)]
            out[own] = dimer_profiles(a, b).min(1)
    return out


def coded(seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all sequences in one array, each one's start and size."""
    size = np.array([len(s) for s in seqs], np.int64)
    return codes("".join(seqs)), np.cumsum(size) - size, size


def interacts(ones, others, limit: float) -> bool:
    """Whether any sequence of one pool binds one of the other at the limit or under."""
    ones, others = list(ones), list(others)
    if not ones or not others:
        return False
    i, j = np.divmod(np.arange(len(ones) * len(others)), len(others))
    return bool((lowest_scores(*coded(ones + others), i, j + len(ones)) <= limit).any())


def clouds_bind(f, r, limit: float) -> np.ndarray:
    """For Arrow lists of sequences f and r, row by row: whether a sequence of f binds one of r at the limit or under."""
    parts, nf, nr = [], *(x.value_lengths().to_numpy() for x in (f, r))
    for x in (f, r):
        flat = x.flatten()
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
        parts.append((CODE[np.frombuffer(flat.buffers()[2], np.uint8)] if len(flat) else np.zeros(0, np.int8), offsets[:-1], np.diff(offsets)))
    (fa, fs, fn), (ra, rs, rn) = parts
    many = nf * nr
    row = np.repeat(np.arange(len(many)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    i = np.repeat(np.cumsum(nf) - nf, many) + k // np.maximum(nr[row], 1)
    j = np.repeat(np.cumsum(nr) - nr, many) + k % np.maximum(nr[row], 1) + len(fs)
    low = lowest_scores(np.concatenate([fa, ra]), np.concatenate([fs, rs + len(fa)]), np.concatenate([fn, rn]), i, j)
    return np.bincount(row, low <= limit, len(many)) > 0


def hairpins(x: np.ndarray, c: Config = Config()) -> tuple[np.ndarray, np.ndarray]:
    """Melting temperature of the best stem of 3 pairs or more with a loop of 3 or more for each row of codes x (of one
    length), -273.15 if there is none; and where that stem is: first base, last base, pairs."""
    rows, n = x.shape
    best, where = np.full(rows, -273.15), np.zeros((rows, 3), np.int64)
    shift = 0.368 * math.log(salt(c))
    inner = np.minimum(x, 4)
    ph, ps = (np.concatenate([np.zeros((rows, 1)), np.cumsum(t[inner[:, :-1], inner[:, 1:]], 1)], 1) for t in (STACK_H, STACK_S))
    run = np.zeros((rows, n, n), np.int8)  # pairs of a stem from i and j inwards, by the distance of i and j
    for d in range(1, n):
        i = np.arange(n - d)
        pair = (x[:, : n - d] + x[:, d:] == 3) & (x[:, : n - d] < 4)
        run[:, i, i + d] = pair * (1 + (run[:, i + 1, i + d - 1] if d > 1 else 0))
        most = -(-(d - 3) // 2)  # what leaves a loop
        k = np.minimum(run[:, i, i + d], max(most, 0)).astype(np.int64)
        r, at = np.nonzero(k >= 3)
        if len(r):
            k = k[r, at]
            h = ph[r, at + k - 1] - ph[r, at]
            e = ps[r, at + k - 1] - ps[r, at] + shift * (k - 1)
            e = e - 1000 * (3.5 + 1.75 * GAS * 310.15 / 1000 * np.log(np.maximum(d + 1 - 2 * k, 3) / 3)) / 310.15
            t = np.where(e < 0, 1000 * h / np.where(e < 0, e, 1) - 273.15, -273.15)
            order = np.argsort(t, kind="stable")  # the best of a row is written last
            better = t[order] > best[r[order]]
            order = order[better]
            best[r[order]] = t[order]
            where[r[order]] = np.stack([at[order], at[order] + d, k[order]], 1)
    return best, where


def hairpin_tms(seqs: list[str], c: Config = Config()) -> np.ndarray:
    """hairpins of sequences of any lengths, those of one length together."""
    out = np.full(len(seqs), -273.15)
    size = np.array([len(s) for s in seqs], np.int64)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for lo in range(0, len(own), 1024):
            part = own[lo : lo + 1024]
            out[part] = hairpins(codes("".join(seqs[k] for k in part)).reshape(len(part), n), c)[0] if n > 1 else -273.15
    return out


def hairpin_tm(s: str, c: Config = Config()) -> float:
    return float(hairpin_tms([s], c)[0])


def hairpin_structure(s: str, c: Config = Config()) -> str:
    """The sequence's best stem in brackets, its other bases as dots; empty if it folds nowhere."""
    tm, ((first, last, pairs),) = hairpins(codes(s)[None], c) if len(s) > 1 else ([-273.15], [(0, 0, 0)])
    return "".join("(" if first <= k < first + pairs else ")" if last - pairs < k <= last else "." for k in range(len(s))) if pairs else ""
