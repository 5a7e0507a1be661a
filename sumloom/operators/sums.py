"""Iterated sums, the core operator: nested running aggregates over the words of a trie.

Two physical forms of one definition. *Window*: on long series, one window a level of the trie,
with every sum of a level in the same Window node; all levels use the partitioning by series, so
depth adds no exchange. *Array*: on cubes [series, dimension, step] inside an Arrow batch, for tries
of hundreds of nodes that would make plans too wide.

With a weighting g and word weights a_j, neighbours i < j carry exp(a_j (g(i) - g(j))). Where the
range of a g is below ``SPAN``, both forms sum exp(a g) z and divide it out again. Beyond that the
array form folds step by step, S(i) = S(i - 1) exp(a (g(i - 1) - g(i))) + z(i), and the window form sums
in strips of a g of width ``SPAN / 2``, with the sums of the two strips before: what lies further back
counts less than exp(-SPAN / 2) of itself. The latter needs a g that rises (:attr:`Weighting.rising`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import comb

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sumloom.functions.arrays import like, running
from sumloom.functions.paths import Weighting
from sumloom.functions.semiring import Reals, Semiring
from sumloom.functions.words import Trie, Word, array_value, column_value, word
from sumloom.series import Series

#: Largest range of a g that exp() is formed over; doubles end at about exp(709).
SPAN = 600.0


@dataclass(frozen=True)
class IteratedSums:
    """``prefixes``: a sum for every distinct prefix of the words (EXTENDED), else for every word
    (SINGLE). ``positions``: for semirings of maxima, for each prefix of length k of each word its sums
    and then k dimensions with the positions i_1 .. i_k that reach them; see :meth:`argmax`."""

    words: tuple[Word, ...]
    prefixes: bool = False
    semiring: Semiring = None
    weighting: Weighting | None = None
    positions: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", tuple(word(w) if isinstance(w, str) else w for w in self.words))
        object.__setattr__(self, "semiring", self.semiring or Reals())
        if self.positions:
            if not self.prefixes or self.semiring.strict:
                raise ValueError("positions are traced for all prefixes, and for maxima only")
            if self.weighting is not None and not self.semiring.additive:
                raise ValueError("positions under weights need a semiring that multiplies by adding")

    @property
    def trie(self) -> Trie:
        return Trie.of(self.words, self.prefixes)

    @property
    def labels(self) -> list[str]:
        if self.positions:
            return [f"{w.prefix(k)}{at}" for w in self.words for k in range(1, len(w) + 1) for at in ("", *(f" at {j}" for j in range(1, k + 1)))]
        return list(self.trie.labels)

    def __len__(self) -> int:
        if self.positions:
            return sum(len(w) * (len(w) + 3) // 2 for w in self.words)
        return len(self.trie.emit)

    def _wide(self, alpha: float) -> bool:
        """Does the range of alpha g pass what exp() can hold (as far as the parameters tell)?"""
        return self.weighting.rising and self.semiring.plus is not None and not self.semiring.additive and alpha * self.weighting.scale > SPAN

    # ------------------------------------------------------------------ window form

    def series(self, s: Series) -> Series:
        """Long series with one dimension a sum, s1, s2, ...; columns besides the dimensions stay."""
        if self.positions:
            return self.argmax(s)
        ring, trie, g = self.semiring, self.trie, None
        s = replace(s, df=s.df)
        if self.weighting is not None:
            s, g = self.weighting.column(s), F.col("__g")
        dims = [F.col(d) for d in s.dims]
        strips = sorted({n.alpha for n in trie.nodes if g is not None and self._wide(n.alpha)})
        place = {a: f"__strip{i}" for i, a in enumerate(strips)}
        # Alpha g from the beginning of its strip.
        s = s.add({c: F.floor(F.lit(a / (SPAN / 2)) * g).cast("long") for a, c in place.items()}) if strips else s
        rise = lambda a: F.lit(a) * g - (F.col(place[a]) * F.lit(SPAN / 2) if a in place else F.lit(0.0))
        swing = {n: F.exp(rise(n.alpha)) if not ring.additive else F.lit(n.alpha) * g for n in set(trie.nodes)} if g is not None else {}
        undo = (lambda x, w: x - w) if ring.additive else (lambda x, w: x / w)

        def running(i: int, upto: bool) -> Column:
            """The sum of __w{i} up to the step, or to the one before, relative to the strip of the step."""
            a, c = trie.nodes[i].alpha, F.col(f"__w{i}")
            if g is None or a not in place:
                return ring.running(c).over(s.upto if upto else s.before)
            here = Window.partitionBy(s.key, place[a]).orderBy(s.t).rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
            total = F.coalesce(ring.running(c).over(here), F.lit(ring.zero))
            for back in (1, 2):
                strip = Window.partitionBy(s.key).orderBy(place[a]).rangeBetween(-back, -back)
                total = ring.plus[0](total, F.coalesce(ring.running(c).over(strip) * F.lit(float(np.exp(-back * SPAN / 2))), F.lit(ring.zero)))
            return total

        for depth in range(1, max(n.depth for n in trie.nodes) + 1):
            at = [i for i, n in enumerate(trie.nodes) if n.depth == depth]
            z = {}
            for i in at:
                n = trie.nodes[i]
                value = column_value(n.bracket, dims, ring.additive)
                if n.parent >= 0:
                    back = running(n.parent, not ring.strict)
                    if ring.strict:
                        back = F.coalesce(back, F.lit(ring.zero))
                    if g is not None:
                        back = undo(back, swing[trie.nodes[n.parent]])
                    value = ring.times(back, value)
                z[f"__z{i}"] = value
            s = s.add(z)
            s = s.add({f"__w{i}": ring.times(F.col(f"__z{i}"), swing[trie.nodes[i]]) if g is not None else F.col(f"__z{i}") for i in at})
        out = {}
        for k, i in enumerate(trie.emit):
            if g is not None and self.weighting.total:
                out[f"s{k + 1}"] = undo(running(i, True), swing[trie.nodes[i]])
            else:
                out[f"s{k + 1}"] = ring.running(F.col(f"__z{i}")).over(s.upto)
        s = s.swap(out)
        return replace(s, df=s.df.drop("__g", *place.values(), *[f"__{c}{i}" for c in "zw" for i in range(len(trie.nodes))]))

    def argmax(self, s: Series) -> Series:
        """For semirings of maxima: for each prefix of length k, its sums and then k dimensions with the
        positions i_1 .. i_k that reach them at each step, the earliest ones where several do. Words are
        taken one by one (a prefix that several share comes with each). Under a weighting the positions
        are those of the weighted maximum."""
        if self.semiring.strict:
            raise ValueError("positions are traced for maxima only")
        g = None
        if self.weighting is not None:
            s, g = self.weighting.column(s), F.col("__g")
        ring, dims, out = self.semiring, [F.col(d) for d in s.dims], {}
        for w, one in enumerate(self.words):
            best = None
            for k, b in enumerate(one):
                value, t = column_value(b, dims, ring.additive), F.col(s.t).cast("int")
                path = F.array(t) if best is None else F.concat(f"{best}.path", F.array(t))
                lift = lambda i, one=one: F.lit(one.alpha[i]) * g if g is not None else F.lit(0.0)
                if best is not None:
                    value = ring.times(F.col(f"{best}.value") - lift(k - 1) if g is not None else F.col(f"{best}.value"), value)
                # The larger value, then the earlier positions: negated, so that max() finds them.
                def pick(v: Column, s: Series, path=path) -> Series:
                    return s.add({"__c": F.struct(v.alias("value"), F.transform(path, lambda i: -i).alias("early"), path.alias("path"))})

                plain = f"__b{w}_{k}"
                s = pick(value, s)
                if g is None:
                    best = plain
                    s = s.add({plain: F.max("__c").over(s.upto)})
                    shown = F.col(f"{plain}.value")
                else:  # the next letter needs the weighted maximum, the output only with ``total``
                    best = f"__b{w}_{k}w"
                    s = s.add({plain: F.max("__c").over(s.upto)})
                    s = pick(value + lift(k), s)
                    s = s.add({best: F.max("__c").over(s.upto)})
                    shown, plain = (F.col(f"{best}.value") - lift(k), best) if self.weighting.total else (F.col(f"{plain}.value"), plain)
                out[f"s{len(out) + 1}"] = shown
                for j in range(k + 1):
                    out[f"s{len(out) + 1}"] = F.col(f"{plain}.path")[j].cast("double")
        s = s.swap(out)
        return replace(s, df=s.df.drop("__c", "__g", *[c for c in s.df.columns if c.startswith("__b")]))

    # ------------------------------------------------------------------ array form

    def arrays(self, x: np.ndarray, raw: np.ndarray | None = None, only: range | None = None) -> Iterator[np.ndarray]:
        """[series, step] for each output, or for a range of them. A node's running sum is kept while it
        has children to come; nodes that no output needs are left out."""
        if self.positions:
            yield from self._argmax_arrays(x, raw, only)
            return
        ring, trie = self.semiring, self.trie
        only = range(len(trie.emit)) if only is None else only
        needed = set()
        for k in only:
            i = trie.emit[k]
            while i >= 0 and i not in needed:
                needed.add(i)
                i = trie.nodes[i].parent
        g = None if self.weighting is None else self.weighting.array(x if raw is None else raw, x)
        if g is not None and (g == g[:1]).all():
            g = g[:1]
        turns: dict = {}
        falls: dict = {}
        last_use = {trie.nodes[i].parent: i for i in sorted(needed)}
        wanted: dict[int, list[int]] = {}
        for k in only:
            wanted.setdefault(trie.emit[k], []).append(k)
        held: dict[int, np.ndarray] = {}
        ready: dict[int, np.ndarray] = {}
        letters: dict = {}
        nxt = only.start
        for i, n in enumerate(trie.nodes):
            if i not in needed:
                continue
            if n.bracket not in letters:
                letters[n.bracket] = array_value(n.bracket, x, ring.additive)
            z = letters[n.bracket]
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                if n.parent >= 0:
                    z = ring.times(held[n.parent], z)
                # p: the weighted running sum as seen from each step; seen from the next one, it carries one more increment.
                p = ring.accumulate(z) if g is None else self._weighted(z, n.alpha, g, turns)
            if last_use.get(n.parent) == i:
                held.pop(n.parent, None)
            if i in last_use:
                held[i] = ring.before_array(p)
                if g is not None and ring.strict and i in last_use:
                    with np.errstate(over="ignore", invalid="ignore"):
                        if n.alpha not in falls:
                            step = n.alpha * np.diff(g, axis=1)
                            falls[n.alpha] = like(step if ring.additive else np.exp(-step), z)
                        (np.subtract if ring.additive else np.multiply)(held[i][:, 1:], falls[n.alpha], out=held[i][:, 1:])
            if i in wanted:
                if g is None:
                    out = p
                elif self.weighting.total:
                    out = p
                else:
                    out = ring.accumulate(z)
                for k in wanted[i]:
                    ready[k] = out
            while nxt in ready:
                yield ready.pop(nxt)
                nxt += 1

    def _weighted(self, z: np.ndarray, alpha: float, g: np.ndarray, turns: dict) -> np.ndarray:
        """At each step the sum of z(i) carried there: times exp(turn(i) - turn(step)), or plus, with
        turn = alpha g. ``turns``: what nodes of one alpha share."""
        ring = self.semiring
        if alpha not in turns:
            turn = alpha * g
            if ring.additive:
                turns[alpha] = like(turn, z), None
            else:
                turn = turn - turn[:, :1]
                near = ring.plus is None or np.abs(turn).max(initial=0.0) <= SPAN
                turns[alpha] = (like(np.exp(turn), z), None) if near else (None, np.exp(-np.diff(turn, axis=1)))
        up, decay = turns[alpha]
        if ring.additive:
            return ring.accumulate(z + up) - up
        if decay is None:
            out = ring.accumulate(z * up)
            out /= up
            return out
        out = z.copy(order="K")
        for i in range(1, z.shape[1]):
            out[:, i] = ring.plus[1](out[:, i - 1] * decay[:, i - 1], z[:, i])
        return out

    def _argmax_arrays(self, x: np.ndarray, raw: np.ndarray | None, only: range | None) -> Iterator[np.ndarray]:
        ring, length, k_out = self.semiring, x.shape[2], 0
        g = None if self.weighting is None else self.weighting.array(x if raw is None else raw, x)
        wanted = range(len(self)) if only is None else only

        def maxima(v: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Running maxima of v [series, step] with the paths [series, step, letter] that reach them, earliest first."""
            v, path = v.copy(), path.copy()
            for t in range(1, length):
                a, b = path[:, t - 1], path[:, t]
                differ = a != b
                at = differ.argmax(axis=1)[:, None]
                earlier = np.take_along_axis(a, at, 1)[:, 0] <= np.take_along_axis(b, at, 1)[:, 0]
                stay = (v[:, t - 1] > v[:, t]) | ((v[:, t - 1] == v[:, t]) & earlier)
                v[stay, t], path[stay, t] = v[stay, t - 1], a[stay]
            return v, path

        steps = np.broadcast_to(np.arange(length)[None, :, None], (x.shape[0], length, 1))
        for one in self.words:
            best = path = None
            for k, b in enumerate(one):
                v = array_value(b, x, ring.additive)
                if best is not None:
                    v = ring.times(best if g is None else best - one.alpha[k - 1] * g, v)
                own = steps if path is None else np.concatenate([path, steps], axis=2)
                best, path = maxima(v if g is None else v + one.alpha[k] * g, own)
                if g is None or self.weighting.total:
                    shown, at = (best if g is None else best - one.alpha[k] * g), path
                else:
                    shown, at = maxima(v, own)
                for out in (shown, *(at[:, :, j].astype(float) for j in range(k + 1))):
                    if k_out in wanted:
                        yield out
                    k_out += 1


@dataclass(frozen=True)
class CosineSums:
    """Sums in the Reals with the factor cos(g(i) - g(j))^exponent between neighbours i < j of a word,
    g(i) = pi i / (f (L - 1)); with ``total`` also between the last one and the step of the output.
    One output for each word and frequency f, frequencies fastest.

    cos(a - b)^s expands into s + 1 products of powers of sines and cosines of a and b, so each level
    keeps s + 1 running sums. ``net``: for each output the weights (w1 [hidden, dims], b1, w2
    [dims, hidden]) of a two-layer net over the dimensions; the letters of the word are of its outputs.
    ``dropped``: for each output and level, steps that count as 0 (as shares of the length). Both
    come from :meth:`drawn`. ``dropped`` has no effect beside ``net``.
    """

    words: tuple[Word, ...]
    freqs: tuple[float, ...]
    exponent: int = 1
    total: bool = False
    net: tuple | None = None
    dropped: tuple | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", tuple(word(w) if isinstance(w, str) else w for w in self.words))
        object.__setattr__(self, "freqs", tuple(float(np.float32(f)) for f in self.freqs))

    @property
    def labels(self) -> list[str]:
        return [f"{w} f={f:.4g}" for w in self.words for f in self.freqs]

    def __len__(self) -> int:
        return len(self.words) * len(self.freqs)

    def drawn(self, dims: int, seed: int, hidden: int | None = None, dropout: float | None = None) -> CosineSums:
        """With random nets of ``hidden`` units (uniform weights), or with random dropped steps."""
        rng = np.random.default_rng(seed)
        if hidden:
            return replace(self, net=tuple((rng.random((hidden, dims)).tolist(), rng.random(hidden).tolist(), rng.random((dims, hidden)).tolist()) for _ in range(len(self))))
        if dropout:
            return replace(self, dropped=tuple(tuple((int(rng.integers(1 << 31)), float(dropout)) for _ in w) for w in self.words for _ in self.freqs))
        return self

    @staticmethod
    def _lost(rule: tuple[int, float], length: int) -> np.ndarray:
        seed, share = rule
        return np.random.default_rng([seed, length]).choice(length, int(share * length), replace=False)

    def arrays(self, x: np.ndarray, raw: np.ndarray | None = None, only: range | None = None) -> Iterator[np.ndarray]:
        length, s, k, letters = x.shape[2], self.exponent, 0, {}
        alone = bool(self.net or self.dropped)
        # What the next letter multiplies, for the beginnings that several words share.
        shared: dict = {}
        left: dict = {}
        for w in self.words:
            for i in range(1, len(w)):
                left[w.brackets[:i]] = left.get(w.brackets[:i], 0) + 1
        for w in self.words:
            for f in self.freqs:
                if only is not None and k not in only:
                    k += 1
                    continue
                angle = np.pi * np.arange(length) / (f * max(length - 1, 1))
                parts = [np.cos(angle) ** r * np.sin(angle) ** (s - r) for r in range(s + 1)]
                back = None
                if self.net:
                    w1, b1, w2 = (np.asarray(v) for v in self.net[k])
                    y = np.einsum("oh,nht->not", w2, np.maximum(np.einsum("hd,ndt->nht", w1, x) + b1[None, :, None], 0))
                for level, b in enumerate(w):
                    begun = (f, w.brackets[: level + 1])
                    if level + 1 < len(w) and begun in shared:
                        back = shared[begun]
                        continue
                    if self.net:
                        c = array_value(b, y, False)
                    else:
                        if b not in letters:
                            letters[b] = array_value(b, x, False)
                        c = letters[b]
                    z = c if back is None else c * back
                    if self.dropped and not self.net:
                        z = z.copy(order="K")
                        z[:, self._lost(self.dropped[k][level], length)] = 0
                    if level + 1 == len(w) and not self.total:
                        break
                    sums = [running(np.add, z * p) for p in parts]
                    if level + 1 < len(w):
                        back = np.zeros_like(z)
                        for r in range(s + 1):
                            back[:, 1:] += comb(s, r) * parts[r][1:] * sums[r][:, :-1]
                        if not alone and left[begun[1]] > 1:
                            shared[begun] = back
                k += 1
                yield sum(comb(s, r) * parts[r] * sums[r] for r in range(s + 1)) if self.total else running(np.add, z)
            for i in range(1, len(w)):  # no word to come begins so
                left[w.brackets[:i]] -= 1
                if not left[w.brackets[:i]]:
                    for f in self.freqs:
                        shared.pop((f, w.brackets[:i]), None)

    def series(self, s: Series) -> Series:
        """Long form. Nets become linear combinations; dropped steps are known only for series of one
        length, so they exist in the array form alone."""
        if self.dropped and not self.net:
            raise ValueError("dropped steps need the array form")
        dims, e = [F.col(d) for d in s.dims], self.exponent
        s = s.add({"__n": s.length})
        for fi, f in enumerate(self.freqs):
            angle = F.lit(float(np.pi)) * F.col(s.t) / (F.lit(f) * F.greatest(F.col("__n") - 1, F.lit(1)))
            s = s.add({f"__c{fi}": F.cos(angle), f"__s{fi}": F.sin(angle)})
        part = lambda fi, r: F.pow(F.col(f"__c{fi}"), F.lit(r)) * F.pow(F.col(f"__s{fi}"), F.lit(e - r))
        keys = [(w, fi) for w in range(len(self.words)) for fi in range(len(self.freqs))]

        if self.net:  # the net of each output, as columns
            for k, (w1, b1, w2) in enumerate(self.net):
                s = s.add({f"__h{k}_{i}": F.greatest(sum((dims[d] * F.lit(float(a)) for d, a in enumerate(row)), F.lit(float(c))), F.lit(0.0)) for i, (row, c) in enumerate(zip(w1, b1, strict=True))})
                s = s.add({f"__y{k}_{o}": sum((F.col(f"__h{k}_{i}") * F.lit(float(v)) for i, v in enumerate(row)), F.lit(0.0)) for o, row in enumerate(w2)})
                s = replace(s, df=s.df.drop(*[f"__h{k}_{i}" for i in range(len(w1))]))

        def letter(k: int, b):
            return column_value(b, [F.col(f"__y{k}_{o}") for o in range(len(self.net[k][2]))] if self.net else dims, False)

        for level in range(max(map(len, self.words))):
            at = [(k, w, fi) for k, (w, fi) in enumerate(keys) if len(self.words[w]) > level]
            z = {}
            for k, w, fi in at:
                value = letter(k, self.words[w].brackets[level])
                if level:
                    value = value * sum((F.lit(float(comb(e, r))) * part(fi, r) * F.coalesce(F.sum(F.col(f"__z{k}") * part(fi, r)).over(s.before), F.lit(0.0)) for r in range(e + 1)), F.lit(0.0))
                z[f"__z{k}"] = value
            s = s.add(z)
        out = {}
        for k, (_, fi) in enumerate(keys):
            if self.total:
                out[f"s{k + 1}"] = sum((F.lit(float(comb(e, r))) * part(fi, r) * F.sum(F.col(f"__z{k}") * part(fi, r)).over(s.upto) for r in range(e + 1)), F.lit(0.0))
            else:
                out[f"s{k + 1}"] = F.sum(f"__z{k}").over(s.upto)
        s = s.swap(out)
        made = [f"__y{k}_{o}" for k, net in enumerate(self.net or ()) for o in range(len(net[2]))]
        return replace(s, df=s.df.drop("__n", *made, *[f"__z{k}" for k in range(len(keys))], *[f"__{c}{i}" for c in "cs" for i in range(len(self.freqs))]))
