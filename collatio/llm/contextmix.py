"""Scoring by online logistic context mixing: bit predictors over hashed contexts, mixed and refined.

A text is coded as its words (A-Z lower-cased), each followed by a blank, and an end mark; each
byte is eight binary decisions. Predictors see the last byte, two and three bytes of the word
(cells of tables hashed from the context and the bits already known), all bytes of the word so
far, and those bytes in texts of one class; each tells from its counts in the training texts the
log odds of the next bit. The odds are combined with weights from a set that a gate chooses (how
often both prefixes were seen, and whether they were ever followed by the other bit). The weights
learn by the coding error of all training tokens, each with its own count taken out: online over
some of them, to begin with, then by a Newton step over all; a map, counted over all, then refines
the mix. So every class of texts gives each word a cost.

Within a text, classes are mixed by gates that move with every token: the posterior of the classes
given all words before, with a small part shared out anew at each anchor. Anchors are places that
the three words before choose by their hash; the words up to the next anchor are a passage. What
passage followed those three words elsewhere in the corpus, and how often, is a context across
words: whether it follows again is one more decision, whose predictors (those counts, and the
text's own hits so far) are mixed by weights that step after each anchor. A training text's own
passages are taken out of the counts, but for those before the anchor.

All counts are of the whole corpus and grow with it. Words are range-partitioned in the order of
their bits, where the words that share a prefix are neighbours: totals of prefixes are differences
of running sums, exact whatever the size (totals of the few prefixes that cross a partition's
border are exchanged by the driver). The model sent to the scoring tasks is the cost table of the
most frequent words; the texts' other words are joined to theirs, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import Numbers, byte_texts, cut, mix64, ranges, segment_sums, slices, stored


@dataclass(frozen=True)
class Settings:
    #: bits of the number of cells of the predictors of the last one, two and three bytes
    cells: tuple[int, ...] = (16, 19, 21)
    #: classes of texts, and the texts (a hash's least) and buckets of words from which their seeds are fitted; all
    #: texts then correct them
    classes: int = 6
    seeds: int = 2_000
    buckets: int = 2_048
    #: training tokens from which the mixing weights get their first values; all tokens then correct them
    sample: int = 30_000
    rate: float = 0.05
    epochs: int = 3
    #: an anchor comes after so many words on average
    spacing: int = 24
    #: part of the classes' posterior that is shared out anew at an anchor
    share: float = 0.02
    #: rate of the steps that a text's own weights take
    own_rate: float = 0.25
    #: the most frequent words, whose costs are broadcast (28 bytes each); the costs of all others are joined
    broadcast_words: int = 1_000_000
    #: words in a partition of the word table
    part: int = 50_000


END = b"\n"
#: A worker passes its word counts on when it holds so many words, adds up the totals of so many words and
#: takes so many apart at a time, and so many bytes of texts.
HELD, ROUND, CHUNK, SLICE = 200_000, 12_000, 1_500, 1_600_000
#: Bytes by which words are dealt to partitions: no longer prefix crosses a border.
EDGE = 64
#: A count is one of these levels for a gate: 0, 1, 2, up to 4, 16, 256, and more.
LEVELS = np.array([1, 2, 3, 5, 17, 257])
GATES = (len(LEVELS) + 1) ** 2 * 4
DELTA, CLIP = 0.1, 14.0
INPUTS = 5


# ---- bits of words


class Bits:
    """The decisions of coded words: ``bit``, the outcomes; ``cells``, a row per table; ``size`` by word."""

    def __init__(self, words: list[bytes], s: Settings):
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        wide = data.astype(np.uint64) + np.uint64(1)
        back = [np.where(place >= k, np.roll(wide, k), np.uint64(0)) for k in (1, 2, 3)]
        contexts = [back[0], back[0] | back[1] << np.uint64(9), back[0] | back[1] << np.uint64(9) | back[2] << np.uint64(18)]
        self.bit = np.unpackbits(data)
        node = ((256 | data.astype(np.int16))[:, None] >> np.arange(8, 0, -1, dtype=np.int16)).ravel()
        self.cells = np.empty((len(contexts), len(node)), np.int32)
        offset = 0
        with np.errstate(over="ignore"):
            base = np.uint64(0x9E3779B97F4A7C15)
            mixed = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for row, c, b in zip(self.cells, contexts, s.cells):
                h = (np.repeat(mix64(c * base), 8) ^ mixed) * base
                row[:] = (h >> np.uint64(64 - b)).astype(np.int32) + np.int32(offset)
                offset += 1 << b
        self.size = lengths * 8


def shared_bits(words: list[bytes]) -> np.ndarray:
    """Bits that each word, in order, shares with the one before; the first one none."""
    n = len(words)
    out = np.zeros(n, np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, n)
    begin = np.cumsum(lengths) - lengths
    live, at = np.arange(1, n), 0
    while len(live):
        live = live[(lengths[live] > at) & (lengths[live - 1] > at)]
        x = data[begin[live] + at] ^ data[begin[live - 1] + at]
        apart = x > 0
        out[live[apart]] = 8 * at + 7 - np.floor(np.log2(x[apart])).astype(np.int64)
        live = live[~apart]
        at += 1
    return out


@dataclass
class Edge:
    """Counts of a partition's neighbours by depth: of words that share so many bits with its first and its last word.

    ``left`` and ``right`` are (depths, classes); ``before`` and ``after`` the bits shared with the next word there.
    """

    left: np.ndarray
    right: np.ndarray
    before: int
    after: int

    @classmethod
    def none(cls, classes: int) -> Edge:
        return cls(np.zeros((1, classes)), np.zeros((1, classes)), -1, -1)


def totals(near: np.ndarray, size: np.ndarray, counts: np.ndarray, edge: Edge) -> tuple[np.ndarray, np.ndarray]:
    """For each word, in order, and each depth 0 … its bits: the counts (by class) of words that share
    the bits up to there, as rows one word after the other; and the first row of each word.

    ``near`` are the bits that each word shares with the one before, ``size`` its own.
    """
    n = len(size)
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.repeat(counts.astype(np.float32), size + 1, axis=0)
    near = near.copy()
    near[0] = edge.before
    reach = np.maximum(near, np.append(near[1:], edge.after))
    order = np.argsort(-reach, kind="stable")
    deep = np.searchsorted(-reach[order], -np.arange(int(reach.max()) + 1), "right")
    for d, most in enumerate(deep.tolist()):
        at = np.sort(order[:most])
        first = near[at] < d
        first[0] = True
        # a run also begins behind a word that has no neighbour at this depth
        first[1:] |= at[1:] != at[:-1] + 1
        sums = np.add.reduceat(counts[at], np.flatnonzero(first), axis=0)
        if at[0] == 0 and edge.before >= d:
            sums[0] += edge.left[d]
        if at[-1] == n - 1 and edge.after >= d:
            sums[-1] += edge.right[d]
        out[begin[at] + d] = sums[np.cumsum(first) - 1]
    return out, begin


class Ordered:
    """A partition of the word table: words in order, their counts by class, and its neighbours' share."""

    def __init__(self, words: list[bytes], counts: np.ndarray, edge: Edge):
        self.words, self.counts, self.edge = words, counts, edge
        self.near = shared_bits(words)
        self.size = np.fromiter(map(len, words), np.int64, len(words)) * 8
        self.sums = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)])

    def before(self, i: int) -> tuple[int, np.ndarray]:
        """Bits that word ``i`` shares with the one before it, and by depth up to there the counts of those before."""
        if i == 0:
            return self.edge.before, self.edge.left
        bits = int(self.near[i])
        far = np.searchsorted(-np.minimum.accumulate(self.near[i:0:-1]), -np.arange(bits + 1), "right")
        out = self.sums[i] - self.sums[i - far]
        reach = int((far == i).sum())  # the depths at which all words from the first one on share the bits
        more = min(reach, self.edge.before + 1)
        out[:more] += self.edge.left[:more]
        return bits, out

    def after(self, i: int) -> tuple[int, np.ndarray]:
        """The same of words after ``i``."""
        n = len(self.words)
        if i == n - 1:
            return self.edge.after, self.edge.right
        bits = int(self.near[i + 1])
        far = np.searchsorted(-np.minimum.accumulate(self.near[i + 1 :]), -np.arange(bits + 1), "right")
        out = self.sums[i + 1 + far] - self.sums[i + 1]
        reach = int((far == n - 1 - i).sum())
        more = min(reach, self.edge.after + 1)
        out[:more] += self.edge.right[:more]
        return bits, out

    def chunk(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """``totals`` of the words from ``a`` to ``b``."""
        (before, left), (after, right) = self.before(a), self.after(b - 1)
        return totals(self.near[a:b], self.size[a:b], self.counts[a:b], Edge(left, right, before, after))

    def single(self, i: int) -> np.ndarray:
        """``totals`` of one word."""
        out = np.repeat(self.counts[i : i + 1], self.size[i] + 1, axis=0)
        for bits, more in (self.before(i), self.after(i)):
            if bits >= 0:
                out[: bits + 1] += more[: bits + 1]
        return out


# ---- classes of texts


@dataclass
class Classes:
    """A mixture of word distributions over buckets: log probabilities by class and bucket, and log shares."""

    logs: np.ndarray
    shares: np.ndarray

    def of(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The likeliest class of each text, given its words' buckets."""
        return np.argmax(segment_sums(self.logs.T[buckets], counts) + self.shares, axis=1)


def fit_classes(texts: np.ndarray, s: Settings, rounds: int = 25) -> Classes:
    """Classes of seed texts, given by their counts of words' buckets (texts, buckets).

    Long texts count as some hundred words. The first class begins as the corpus, each further one
    as the text that the classes so far explain worst for its length, among texts of middle length or more.
    """
    x = texts[texts.sum(axis=1) > 0].astype(np.float64)
    if not len(x):
        return Classes(np.full((s.classes, s.buckets), -np.log(s.buckets)), np.full(s.classes, -np.log(s.classes)))
    size = x.sum(axis=1)
    x *= np.minimum(1, 200 / size)[:, None]
    usual = (x.sum(axis=0) + 1) / (x.sum() + s.buckets)
    long = np.flatnonzero(size >= np.median(size))

    def smoothed(counts: np.ndarray, extra: float) -> np.ndarray:
        return np.log((counts + extra * usual) / (counts.sum(axis=-1, keepdims=True) + extra))

    per_word = x[long] / x[long].sum(axis=1, keepdims=True)
    own = (per_word * smoothed(x[long], 50)).sum(axis=1)
    logs = [np.log(usual)]
    for _ in range(s.classes - 1):
        worst = long[np.argmax(own - (per_word @ np.array(logs).T).max(axis=1))]
        near = x[long][np.argsort(-(per_word @ smoothed(x[worst], 50) - per_word @ logs[0]), kind="stable")[: max(1, len(long) // (4 * s.classes))]]
        logs.append(smoothed(near.sum(axis=0), 50))
    logs, shares = np.array(logs), np.full(s.classes, -np.log(s.classes))
    for _ in range(rounds):
        fit = x @ logs.T + shares
        post = np.exp(fit - fit.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        shares = np.log((post.sum(axis=0) + 1) / (len(x) + s.classes))
        logs = smoothed(post.T @ x, 50)
    return Classes(logs, shares)


# ---- predictions and mixing


def table_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a 1 in tenths, as the tables keep them."""
    return np.rint(np.clip(np.log((ones + 0.2) / (zeros + 0.2)), -12, 12) * 10).astype(np.int8)


def odds_of(own: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of the coded bit, seen ``own`` of ``total`` times."""
    delta = np.float32(DELTA)
    return np.log((own + delta) / (np.maximum(total - own, 0) + delta))


#: The level of each count up to the last limit.
LEVEL = np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), "right").astype(np.int16)


def level(count: np.ndarray) -> np.ndarray:
    return LEVEL[np.minimum(count, np.float32(LEVELS[-1])).astype(np.int16)]


def sure(own: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Was only one bit ever seen? It does not depend on which one is coded."""
    return ((own <= 0) | (own >= total)).view(np.int8)


def gate_of(own: np.ndarray, total: np.ndarray, own_k: np.ndarray, total_k: np.ndarray) -> np.ndarray:
    n = len(LEVELS) + 1
    return ((level(total) * np.int16(n) + level(total_k)) * np.int16(2) + sure(own, total)) * np.int16(2) + sure(own_k, total_k)


#: Steps of the mix in which its cost is tabled: a model's odds are rounded to these.
FINE = 32
WIDE = int(CLIP * FINE)


@dataclass
class Mixer:
    """Tables in tenths, weights by gate, and the map: what the mix is really worth, by gate and size."""

    tenths: np.ndarray
    weights: np.ndarray
    map: np.ndarray

    def __post_init__(self) -> None:
        self.table()

    def table(self) -> None:
        """The cost of a decision by gate and rounded mix, in nats; the two sides of 0 add up to a probability of 1."""
        x = np.arange(-WIDE, WIDE + 1, dtype=np.float32) / np.float32(FINE)
        gate = np.repeat(np.arange(GATES), len(x))
        self.tabled = np.logaddexp(0, -refined(np.tile(x, GATES), gate, self.map)).astype(np.float32)

    def inputs(self, bits: Bits, own: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Odds of what was coded by tables and by all words with the prefix, and room for the class's."""
        sign = (2 * bits.bit.astype(np.int8) - 1).astype(np.float32) * np.float32(0.1)
        out = np.empty((INPUTS, len(sign)), np.float32)
        for row, cells in zip(out, bits.cells):
            np.multiply(self.tenths[cells], sign, out=row)
        out[3] = odds_of(own, total)
        out[4] = 0
        return out

    def cost(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Natural logarithm of one over each decision's probability; rows of ``odds`` beyond the given ones are 0."""
        x = odds[0] * self.weights[:, 0][gate]
        for row, w in zip(odds[1:], self.weights.T[1:]):
            x += row * w[gate]
        x *= np.float32(FINE)
        np.clip(np.rint(x, out=x), -WIDE, WIDE, out=x)
        return self.tabled[x.astype(np.int32) + (gate.astype(np.int32) * (2 * WIDE + 1) + WIDE)]


KNOTS = 14


def _knots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.abs(x) * np.float32(KNOTS / CLIP), np.float32(KNOTS - 1e-3))
    low = at.astype(np.int32)
    return low, at - low


def refined(x: np.ndarray, gate: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean of the mix and the map's word on it; odd in ``x``, so that a 0 and a 1 add up to 1."""
    low, part = _knots(x)
    flat = table.ravel()
    spot = gate.astype(np.int32) * (KNOTS + 1) + low
    left = flat[spot]
    return (x + np.sign(x) * (left + (flat[spot + 1] - left) * part)) / 2


@dataclass
class Sample:
    """Decisions of sampled tokens, their own count taken out: tables' odds in tenths, counts, and the word of each."""

    odds: np.ndarray
    own: np.ndarray
    total: np.ndarray
    own_k: np.ndarray
    total_k: np.ndarray
    size: np.ndarray
    weight: np.ndarray


def learn(tenths: np.ndarray, sample: Sample, s: Settings) -> Mixer:
    """Mixing weights and map from sample tokens, in order, some hundreds at a time."""
    weights = np.full((GATES, INPUTS), 0.3, np.float32)
    table = np.tile(np.linspace(0, CLIP, KNOTS + 1, dtype=np.float32), (GATES, 1))
    mixer = Mixer(tenths, weights, table)
    gate = gate_of(sample.own, sample.total, sample.own_k, sample.total_k)
    odds = np.concatenate([sample.odds * np.float32(0.1), odds_of(sample.own, sample.total)[None], odds_of(sample.own_k, sample.total_k)[None]])
    ends = np.cumsum(sample.size)
    times = np.repeat(np.minimum(sample.weight / max(sample.weight.mean(), 1e-12), 20) if len(ends) else sample.weight, sample.size)
    power, bend = np.zeros(weights.shape), np.zeros(table.shape)
    for epoch in range(s.epochs + 1):
        for a in range(0, len(ends), 256):
            part = slice(int(ends[a - 1]) if a else 0, int(ends[min(a + 256, len(ends)) - 1]))
            g, rows = gate[part], odds[:, part]
            x = np.zeros(len(g), np.float32)
            for row, w in zip(rows, weights.T.copy()):
                x += row * w[g]
            x = np.clip(x, -CLIP, CLIP)
            if epoch < s.epochs:
                error = times[part] / (1 + np.exp(x.astype(np.float64)))
                step = np.stack([np.bincount(g, error * row, GATES) for row in rows], axis=1)
                power += step * step  # steps shrink as a weight's errors add up
                weights += (s.rate * step / np.sqrt(power + 1e-9)).astype(np.float32)
            else:
                low, rest = _knots(x)
                spot = g.astype(np.int64) * (KNOTS + 1) + low + (rest > 0.5)
                # the map's curve at a knot is of the likelier bit; the outcome is whether it came
                y = table.ravel()[spot]
                p = 1 / (1 + np.exp(-y))
                bend += np.bincount(spot, p * (1 - p) * times[part], bend.size).reshape(bend.shape)
                table += (np.bincount(spot, ((x > 0) - p) * times[part], bend.size).reshape(bend.shape) / (bend + 20)).astype(np.float32)
                np.clip(table, 0, CLIP, out=table)
                table[:, 0] = 0
    mixer.table()
    return mixer


#: What the first weights and the first map count for, in decisions.
PRIOR = 20.0


def whole_sums(table: Ordered, mixer: Mixer, s: Settings) -> np.ndarray:
    """Sums over all learnt tokens of a partition, each with its own count taken out, by gate.

    Columns: the slope of the coding cost by weight, its curvature (pairs of weights), and by knot of
    the map how many decisions there were and how often the likelier bit came.
    """
    out = np.zeros((GATES, INPUTS + INPUTS * INPUTS + 2 * (KNOTS + 1)))
    n = len(table.words)
    for a in range(0, n, ROUND):
        b = min(a + ROUND, n)
        every, begin = table.chunk(a, b)
        ends = np.append(begin, len(every))
        for i in range(a, b, CHUNK):
            j = min(i + CHUNK, b)
            _add_sums(out, table.words[i:j], table.counts[i:j], every[ends[i - a] : ends[j - a]], mixer, s)
    return out


def _add_sums(out: np.ndarray, words: list[bytes], counts: np.ndarray, every: np.ndarray, mixer: Mixer, s: Settings) -> None:
    """Adds the sums of some words, given their rows of totals."""
    word, k = np.nonzero(counts > 0)
    if not len(word):
        return
    bits = Bits(words, s)
    first = np.cumsum(bits.size) - bits.size
    size = bits.size[word]
    spot = ranges(first[word], size)
    row = spot + np.repeat(word, size)  # each word has one row more than decisions
    flat, at = every.ravel(), row * s.classes + np.repeat(k, size)
    one, whole = np.float32(1), every.sum(axis=1)
    total, own, total_k, own_k = whole[row] - one, whole[row + 1] - one, flat[at] - one, flat[at + s.classes] - one
    gate = gate_of(own, total, own_k, total_k)
    order = np.argsort(gate, kind="stable")
    start, runs = _runs(gate[order])
    odds = np.empty((INPUTS, len(spot)), np.float32)
    sign = (2 * bits.bit.astype(np.int8) - 1).astype(np.float32) * np.float32(0.1)
    by_gate = spot[order]
    for x, cells in zip(odds, bits.cells):
        x[:] = (mixer.tenths[cells] * sign)[by_gate]
    odds[3], odds[4] = odds_of(own, total)[order], odds_of(own_k, total_k)[order]
    times = np.repeat(counts[word, k], size)[order].astype(np.float32)
    gates = gate[order[start]].astype(np.int64)
    mix = np.empty(len(spot), np.float32)
    for g, a, b in zip(gates.tolist(), start.tolist(), (start + runs).tolist()):
        mix[a:b] = mixer.weights[g] @ odds[:, a:b]
    np.clip(mix, -CLIP, CLIP, out=mix)
    miss = 1 / (1 + np.exp(mix))
    slope, bend = times * miss, times * miss * (1 - miss)
    for g, a, b in zip(gates.tolist(), start.tolist(), (start + runs).tolist()):
        x = odds[:, a:b]
        out[g, :INPUTS] += x @ slope[a:b]
        out[g, INPUTS : INPUTS + INPUTS * INPUTS] += ((x * bend[a:b]) @ x.T).ravel()
    low, rest = _knots(mix)
    knot = np.repeat(gates, runs) * (KNOTS + 1) + low + (rest > 0.5)
    for column, by in ((INPUTS + INPUTS * INPUTS, times), (INPUTS + INPUTS * INPUTS + KNOTS + 1, times * (mix > 0))):
        out[:, column : column + KNOTS + 1] += np.bincount(knot, by, GATES * (KNOTS + 1)).reshape(GATES, -1)


def correct(mixer: Mixer, sums: np.ndarray) -> None:
    """Weights and map corrected by the sums over all tokens; rounded, so that the order of sums does not matter."""
    slope, curve, seen, came = np.split(sums, [INPUTS, INPUTS + INPUTS**2, INPUTS + INPUTS**2 + KNOTS + 1], axis=1)
    curve = curve.reshape(-1, INPUTS, INPUTS) + PRIOR * np.eye(INPUTS)
    step = np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -0.5, 0.5)
    mixer.weights[:] = np.rint((mixer.weights + step) * 4096) / 4096
    p = 1 / (1 + np.exp(-mixer.map.astype(np.float64)))
    odds = np.log((came + PRIOR * p) / (seen - came + PRIOR * (1 - p)))
    mixer.map[:] = np.rint(np.clip(odds, 0, CLIP) * 4096) / 4096
    mixer.map[:, 0] = 0
    mixer.table()


def word_costs(table: Ordered, mixer: Mixer, s: Settings) -> np.ndarray:
    """The cost of each word, in order, under each class: (words, classes), in nats.

    A decision that a class has no count for costs the same in all such classes.
    """
    n, classes = len(table.words), s.classes
    out = np.zeros((n, classes))
    for a in range(0, n, ROUND):
        b = min(a + ROUND, n)
        every, begin = table.chunk(a, b)
        ends = np.append(begin, len(every))
        for i in range(a, b, CHUNK):
            j = min(i + CHUNK, b)
            out[i:j] = _costs(table.words[i:j], every[ends[i - a] : ends[j - a]], mixer, s)
    return out


def _costs(words: list[bytes], every: np.ndarray, mixer: Mixer, s: Settings) -> np.ndarray:
    """``word_costs`` of some words, given their rows of totals."""
    classes = s.classes
    bits = Bits(words, s)
    first = np.cumsum(bits.size) - bits.size
    word = np.repeat(np.arange(len(words)), bits.size)
    at = np.arange(len(word)) + word  # each word has one row more than decisions
    whole = every.sum(axis=1)
    total, own = whole[at], whole[at + 1]
    odds = mixer.inputs(bits, own, total)
    nothing = np.zeros(1, np.float32)
    plain = mixer.cost(odds[:4], gate_of(own, total, nothing, nothing))
    out = np.repeat(np.add.reduceat(plain.astype(np.float64), first)[:, None], classes, axis=1)
    # of the decisions and classes, those that the class has counts for
    counted = every.astype(bool)
    counted[first + bits.size + np.arange(len(words))] = False  # the whole word's row is no decision
    cell = np.flatnonzero(counted.ravel())
    if len(cell):
        flat = every.ravel()
        row, k = np.divmod(cell, classes)
        spot = row - np.repeat(np.arange(len(words)), bits.size + 1)[row]
        own_k, total_k, own, total = flat[cell + classes], flat[cell], own[spot], total[spot]
        rows = odds[:, spot]
        rows[4] = odds_of(own_k, total_k)
        more = mixer.cost(rows, gate_of(own, total, own_k, total_k)) - plain[spot]
        out += np.bincount(word[spot] * classes + k, more, len(words) * classes).reshape(-1, classes)
    return out


def sample_of(table: Ordered, tenths: np.ndarray, drawn: np.ndarray, classes: np.ndarray, s: Settings) -> Sample:
    """The decisions (of up to EDGE bytes) of tokens ``drawn`` (places of words) of given classes, one occurrence taken out."""
    bits = Bits([table.words[i][:EDGE] for i in drawn], s)
    fields = []
    for i, k, size in zip(drawn.tolist(), classes.tolist(), bits.size.tolist()):
        every = table.single(i)
        whole = every.sum(axis=1)
        fields.append(np.stack([whole[1 : size + 1], whole[:size], every[1 : size + 1, k], every[:size, k]]) - 1)
    counts = np.concatenate(fields, axis=1).astype(np.float32)
    sign = 2 * bits.bit.astype(np.int8) - 1
    return Sample(tenths[bits.cells] * sign, *counts, bits.size, np.ones(len(drawn)))


# ---- texts: tokens, classes, passages


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``(ids, counts, vocab)`` of the texts' tokens: words as coded (lower-cased, a blank behind) and one end each."""
    seen = Numbers()
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    end = seen[END]
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes.lower() folds A-Z only
        ids.extend(map(seen.__getitem__, words))
        ids.append(end)
        counts[i] = len(words) + 1
    return np.array(ids, np.int64), counts, [END, *(w + b" " for w in list(seen)[1:])]


def hashed(vocab: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in vocab), np.uint64, len(vocab))


def passages(hashes: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts, given as hashes of their tokens, at their anchors.

    ``(start, text, context, passage)`` by segment: its first token, its text, the hash of the three
    words before (0 for the text's beginning) and that of its own words. Every text has an anchor
    behind its third word, and where the hash of three words falls into one of ``spacing`` parts.
    """
    n = len(hashes)
    begin = np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(begin, counts)
    with np.errstate(over="ignore"):
        back = [np.roll(hashes, k) for k in (1, 2, 3)]
        context = mix64(back[0] + mix64(back[1] + mix64(back[2])))
        anchor = (place == 3) | ((place > 3) & (context % np.uint64(s.spacing) == 0))
        start = np.flatnonzero(anchor | (place == 0))
        inside = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        passage = np.add.reduceat(mix64(hashes + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start) if n else hashes
    context = np.where(place[start] == 0, np.uint64(0), context[start] | np.uint64(1))
    return start, np.repeat(np.arange(len(counts)), counts)[start], context, passage


def class_mix(costs: np.ndarray, counts: np.ndarray, prior: np.ndarray, share: float) -> np.ndarray:
    """Cost of each segment under the classes' mixture, whose gates follow every word of the text.

    ``costs`` (segments, classes) are the classes' own; ``counts`` the number of segments by text.
    """
    out = np.zeros(len(costs))
    first = np.cumsum(counts) - counts
    gates = np.tile(prior, (len(counts), 1))
    for j in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > j)
        at = first[live] + j
        fit = np.log(gates[live]) - costs[at]
        top = fit.max(axis=1)
        post = np.exp(fit - top[:, None])
        whole = post.sum(axis=1)
        out[at] = -(top + np.log(whole))
        gates[live] = (1 - share) * post / whole[:, None] + share * prior
    return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


#: First weights of a text's passage decisions: of the corpus's counts, the text's own hits, and the last decision.
OWN_WEIGHTS = (0.6, 0.7, 0.6)


def passage_mix(
    cost: np.ndarray, context: np.ndarray, hit: np.ndarray, top: np.ndarray, total: np.ndarray, learnt: np.ndarray, counts: np.ndarray,
    s: Settings,
) -> np.ndarray:
    """Cost of each text: its segments', with the decision whether a passage goes on as elsewhere.

    ``context`` numbers the segments' contexts (0: none), ``hit`` tells whether the passage is the
    context's most frequent one, ``top`` and ``total`` the corpus's counts; ``learnt`` (by text)
    whether the text's own occurrences are among them.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        key = mix64(context.astype(np.uint64)) + mix64(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    start, size = _runs(key[order])
    start, last = np.repeat(start, size), np.repeat(start + size - 1, size)
    # occurrences in this text of the context, and of its frequent passage: in all, and before each place
    run = np.cumsum(hit[order])
    ahead = run[start] - hit[order][start] if len(key) else run
    every, before, own, own_before = (np.zeros(len(key), np.int64) for _ in range(4))
    every[order], before[order] = last - start + 1, np.arange(len(key)) - start
    own[order], own_before[order] = run[last] - ahead if len(key) else run, run - hit[order] - ahead
    mine = learnt[text].astype(np.int64)
    n_top = top - mine * own + own_before
    n_all = total - mine * every + before
    asked = (context != 0) & (n_top > 0)
    out = np.zeros(len(counts))
    first = np.cumsum(counts) - counts
    weights = np.tile(np.array(OWN_WEIGHTS), (len(counts), 1))
    good, tried, latest = np.zeros(len(counts)), np.zeros(len(counts)), np.zeros(len(counts))
    for j in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > j)
        at = first[live] + j
        free = ~asked[at]
        out[live[free]] += cost[at[free]]
        live, at = live[~free], at[~free]
        if not len(live):
            continue
        x = np.stack(
            [np.log((n_top[at] + 0.4) / (n_all[at] - n_top[at] + 0.4)), np.log((good[live] + 0.4) / (tried[live] - good[live] + 0.4)), latest[live]],
            axis=1,
        )
        odds = np.clip((x * weights[live]).sum(axis=1), -CLIP, CLIP)
        y = hit[at].astype(np.float64)
        out[live] += np.where(y > 0, np.logaddexp(0, -odds), np.logaddexp(0, odds) + cost[at])
        weights[live] += s.own_rate * ((y - 1 / (1 + np.exp(-odds)))[:, None] * x) / (1 + (x * x).sum(axis=1))[:, None]
        good[live], tried[live], latest[live] = 0.9 * good[live] + y, 0.9 * tried[live] + 1, 2 * y - 1
    return out


# ---- the corpus


def _columns(prefix: str, s: Settings, kind: str) -> str:
    return ", ".join(f"{prefix}{k} {kind}" for k in range(s.classes))


def seed_classes(source: DataFrame, s: Settings) -> Classes:
    """Classes fitted on the ``seeds`` learnt texts with the least hash of their id."""
    learnt = source.where("learnt").select(F.xxhash64(F.lit(11), "id").alias("mark"), F.xxhash64("text").alias("digest"), "text")
    most = learnt.select("mark").orderBy("mark").limit(s.seeds).agg(F.max("mark")).first()[0]
    x = np.zeros((0, s.buckets))
    if most is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    ids, counts, vocab = tokens(byte_texts(part, "text"))
                    bucket = (hashed(vocab) % np.uint64(s.buckets)).astype(np.int64)[ids]
                    key, times = np.unique(np.repeat(np.arange(len(counts)), counts) * s.buckets + bucket, return_counts=True)
                    ends = np.searchsorted(key // s.buckets, np.arange(len(counts) + 1))
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int32))) for v in (key % s.buckets, times)]
                    yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("digest"), *lists], names=["mark", "digest", "bucket", "n"])

        rows = learnt.where(F.col("mark") <= most).mapInArrow(
            run, "mark long, digest long, bucket array<int>, n array<int>",
        ).orderBy("mark", "digest").limit(s.seeds).toArrow()
        x = np.zeros((rows.num_rows, s.buckets))
        for i, (b, n) in enumerate(zip(rows.column("bucket"), rows.column("n"))):
            x[i, b.values.to_numpy()] = n.values.to_numpy()
    return fit_classes(x, s)


def refit_classes(source: DataFrame, classes: Classes, s: Settings) -> None:
    """Corrects the seeds' classes by all learnt texts, in place: one round of ``fit_classes`` over the corpus."""
    cells = s.classes * s.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells + s.classes)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, counts, vocab = tokens(byte_texts(part, "text"))
                bucket = (hashed(vocab) % np.uint64(s.buckets)).astype(np.int64)[ids]
                weight = np.minimum(1, 200 / counts)
                fit = segment_sums(classes.logs.T[bucket], counts) * weight[:, None] + classes.shares
                post = np.exp(fit - fit.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                sums[cells:] += post.sum(axis=0)
                for k in range(s.classes):
                    sums[k * s.buckets : (k + 1) * s.buckets] += np.bincount(bucket, np.repeat(post[:, k] * weight, counts), s.buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["slot", "value"])

    got = source.where("learnt").select("text").mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(cells + s.classes)
    sums[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    x, texts = sums[:cells].reshape(s.classes, -1), sums[cells:]
    usual = (x.sum(axis=0) + 1) / (x.sum() + s.buckets)
    # rounded, so that the order of sums does not matter
    classes.logs[:] = np.round(np.log((x + 50 * usual) / (x.sum(axis=1, keepdims=True) + 50)), 9)
    classes.shares[:] = np.round(np.log((texts + 1) / (texts.sum() + s.classes)), 9)


def word_counts(source: DataFrame, classes: Classes, s: Settings) -> DataFrame:
    """``(word, c0, c1, …)``: how often each coded word occurs in learnt texts of each class (0 in others).

    Workers sum up before the shuffle.
    """
    names = ["word", *(f"c{k}" for k in range(s.classes))]

    def out(held: Numbers, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array(n[: len(held), k]) for k in range(s.classes))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Numbers(), np.zeros((2 * HELD, s.classes), np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, counts, vocab = tokens(byte_texts(part, "text"))
                bucket = (hashed(vocab) % np.uint64(s.buckets)).astype(np.int64)
                own = classes.of(bucket[ids], counts)
                learnt = np.repeat(part.column("learnt").to_numpy(zero_copy_only=False), counts)
                times = np.bincount((ids * s.classes + np.repeat(own, counts))[learnt], minlength=len(vocab) * s.classes).reshape(-1, s.classes)
                place = np.fromiter(map(held.__getitem__, vocab), np.int64, len(vocab))
                if len(held) > len(n):
                    n = np.concatenate([n, np.zeros((len(held), s.classes), np.int64)])
                n[place] += times
                if len(held) > HELD:
                    yield out(held, n)
                    held = Numbers()
                    n[:] = 0
        if held:
            yield out(held, n)

    got = source.select("learnt", "text").mapInArrow(run, f"word binary, {_columns('c', s, 'long')}")
    return got.groupBy("word").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(s.classes)))


def word_table(words: DataFrame, parts: int, s: Settings) -> DataFrame:
    """``(part, data)``: the word table in the order of bits, some thousand words a row, compressed."""
    names = ["word", *(f"c{k}" for k in range(s.classes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                rows = batch.select(names)
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "data"])

    ordered = words.repartitionByRange(parts, F.substring("word", 1, EDGE)).sortWithinPartitions("word")
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, data binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The words of ``word_table``, with their partition's number."""
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
            for rows in pa.ipc.open_stream(data.as_buffer()):
                yield part, rows


def _whole(batches: Iterator[pa.RecordBatch], s: Settings) -> tuple[list[bytes], np.ndarray, int]:
    """A partition of the word table: words in order, counts, and its number."""
    words: list[bytes] = []
    counts, part = [np.zeros((0, s.classes))], 0
    for part, rows in _unpacked(batches):
        words += rows.column("word").to_pylist()
        counts.append(np.stack([rows.column(f"c{k}").to_numpy() for k in range(s.classes)], axis=1).astype(np.float64))
    return words, np.concatenate(counts), part


def edges(placed: DataFrame, s: Settings) -> dict[int, Edge]:
    """What each partition of the word table needs to know of its neighbours.

    Every partition sends its first and last word (up to EDGE bytes) and the counts of the words that
    share bits with them, by depth: some kilobytes each, put together in one pass on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, part = _whole(batches, s)
        if not words:
            return
        none = np.zeros((1, s.classes))
        table = Ordered(words, counts, Edge.none(s.classes))
        # a word of its own from one depth on: the last row then holds for all below
        head, tail = (
            counts[i] + np.concatenate([more[: bits + 1], none]) for i,
            (bits, more) in ((0, table.after(0)), (-1, table.before(len(words) - 1)))
        )
        through = int(table.near[1:].min(initial=8 * EDGE))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([words[0][: 2 * EDGE]], pa.binary()), pa.array([words[-1][: 2 * EDGE]], pa.binary()),
                pa.array([through], pa.int32()), pa.array([head.tobytes()], pa.binary()), pa.array([tail.tobytes()], pa.binary()),
            ],
            names=["part", "first", "last", "through", "head", "tail"],
        )

    got = placed.mapInArrow(run, "part int, first binary, last binary, through int, head binary, tail binary").orderBy("part").collect()
    rows = [
        (
            r.part, bytes(r["first"]), bytes(r["last"]), r.through,
            *(np.frombuffer(x, np.float64).reshape(-1, s.classes) for x in (r.head, r.tail)),
        ) for r in got
    ]

    def deep(sums: np.ndarray, depths: int) -> np.ndarray:
        """By depth up to ``depths``; from the last known one on, a word is alone."""
        return sums[np.minimum(np.arange(depths), len(sums) - 1)]

    out: dict[int, Edge] = {r[0]: Edge.none(s.classes) for r in rows}
    for order, own, other in ((rows, 1, 2), (rows[::-1], 2, 1)):
        before = None
        for row in order:
            if before is not None:
                bits = int(shared_bits([before[other], row[own]])[1])
                sums = deep(before[5 if own == 1 else 4], bits + 1).copy()
                edge = out[before[0]]
                beyond, reach = (edge.left, edge.before) if own == 1 else (edge.right, edge.after)
                # the neighbour's own neighbours, as far as all of its words share the bits
                more = min(bits, reach, before[3]) + 1
                sums[:more] += beyond[:more]
                if own == 1:
                    out[row[0]].left, out[row[0]].before = sums, bits
                else:
                    out[row[0]].right, out[row[0]].after = sums, bits
            before = row
    return out


#: Cells of the tables that are summed as one row.
BLOCK = 1 << 14


def tables(placed: DataFrame, parts: int, s: Settings) -> np.ndarray:
    """The tables' log odds in tenths, counted over all words.

    Each task sends its counts in compressed blocks of cells, which are summed block by block.
    """
    size = sum(1 << b for b in s.cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * size)
        starts = np.cumsum([0, *(1 << b for b in s.cells)])
        for _, batch in _unpacked(batches):
            n = np.sum([batch.column(f"c{k}").to_numpy() for k in range(s.classes)], axis=0)
            some = np.flatnonzero(n > 0)
            words = batch.column("word").take(pa.array(some)).to_pylist()
            if words:
                bits = Bits(words, s)
                each = np.repeat(n[some], bits.size).astype(np.float64)
                for row, a, b in zip(bits.cells, starts, starts[1:]):
                    counts[2 * a : 2 * b] += np.bincount((row - a) * 2 + bits.bit, each, 2 * (b - a))
        for b in range(0, size, BLOCK):
            part = counts[2 * b : 2 * (b + BLOCK)]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b // BLOCK], pa.int32()), pa.array([pa.compress(part.astype(np.int64).tobytes(), "zstd", asbytes=True)], pa.binary())],
                    names=["block", "data"],
                )

    def merge(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        cells = min(BLOCK, size - block * BLOCK)
        sums = np.zeros(2 * cells, np.int64)
        for data in group.column("data"):
            sums += np.frombuffer(pa.decompress(data.as_buffer(), 16 * cells, "zstd"), np.int64)
        return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([table_odds(sums[0::2], sums[1::2]).tobytes()], pa.binary())})

    out = np.zeros(size, np.int8)
    merged = placed.coalesce(max(8, -(-parts // 8))).mapInArrow(run, "block int, data binary").groupBy("block").applyInArrow(merge, "block int, data binary")
    for block, data in zip(*(c.to_pylist() for c in merged.toArrow().columns)):
        out[block * BLOCK : block * BLOCK + len(data)] = np.frombuffer(data, np.int8)
    return out


SAMPLED = "mark long, size int, weight double, odds binary, counts binary"


def train(placed: DataFrame, near: dict[int, Edge], tenths, n: int, s: Settings) -> Mixer:
    """Mixing weights and map from all training tokens, beginning with a sample of about ``sample`` ones.

    A word of a class that occurs c times is drawn if the first of its arrivals, at rate c, comes
    before ``sample`` of all tokens have arrived; it then stands for all of its arrivals by then.
    """
    until = s.sample / max(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, part = _whole(batches, s)
        if not words:
            return
        with np.errstate(over="ignore", divide="ignore"):
            mark = mix64(hashed(words)[:, None] + mix64(np.arange(1, s.classes + 1, dtype=np.uint64)))
            arrival = -np.log(((mark >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / counts
        at, k = np.nonzero(arrival < until)
        if not len(at):
            return
        got = sample_of(Ordered(words, counts, near[part]), tenths.value, at, k, s)
        expected = counts[at, k] * until
        ends = np.cumsum(got.size)
        rows = [slice(a, b) for a, b in zip(ends - got.size, ends)]
        fields = np.stack([got.own, got.total, got.own_k, got.total_k]).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(mark[at, k].view(np.int64)), pa.array(got.size, pa.int32()), pa.array(expected / -np.expm1(-expected)),
                pa.array([got.odds[:, r].tobytes() for r in rows], pa.binary()),
                pa.array([fields[:, r].tobytes() for r in rows], pa.binary()),
            ],
            names=["mark", "size", "weight", "odds", "counts"],
        )

    rows = placed.mapInArrow(run, SAMPLED).toArrow()
    order = np.argsort(rows.column("mark").to_numpy(), kind="stable")
    size = rows.column("size").to_numpy()[order].astype(np.int64)
    odds, counts = rows.column("odds").to_pylist(), rows.column("counts").to_pylist()
    none = [np.zeros((INPUTS - 2, 0), np.int8)], [np.zeros((4, 0), np.float32)]
    odds = np.concatenate(none[0] + [np.frombuffer(odds[i], np.int8).reshape(INPUTS - 2, -1) for i in order], axis=1)
    counts = np.concatenate(none[1] + [np.frombuffer(counts[i], np.float32).reshape(4, -1) for i in order], axis=1)
    mixer = learn(tenths.value, Sample(odds, *counts, size, rows.column("weight").to_numpy()[order]), s)
    first = placed.sparkSession.sparkContext.broadcast(mixer)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, part = _whole(batches, s)
        if words:
            sums = whole_sums(Ordered(words, counts, near[part]), first.value, s).ravel()
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["slot", "value"])

    got = placed.mapInArrow(whole, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(GATES * (INPUTS + INPUTS * INPUTS + 2 * (KNOTS + 1)))
    sums[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    correct(mixer, sums.reshape(GATES, -1))
    return mixer


def costs(placed: DataFrame, near: dict[int, Edge], mixer, s: Settings) -> DataFrame:
    """``(h, n, mean, e0, e1, …)``: each word's hash, count, mean cost, and what each class's cost is beyond it.

    The latter are rounded to half precision, in which they are sent.
    """
    names = ["h", "n", "mean", *(f"e{k}" for k in range(s.classes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, part = _whole(batches, s)
        if words:
            got = word_costs(Ordered(words, counts, near[part]), mixer.value, s)
            base = got.mean(axis=1).astype(np.float32)
            beyond = (got - base[:, None]).astype(np.float16).astype(np.float32)
            h = hashed(words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(counts.sum(axis=1).astype(np.int64)), pa.array(base), *(pa.array(beyond[:, k]) for k in range(s.classes))],
                names=names,
            )

    return placed.mapInArrow(run, f"h long, n long, mean float, {_columns('e', s, 'float')}")


def packed_type(s: Settings) -> np.dtype:
    return np.dtype([("h", np.int64), ("n", np.uint32), ("mean", np.float32), ("e", np.float16, (s.classes,))])


def pack(words: DataFrame, s: Settings) -> np.ndarray:
    """The cost table in the order of hashes: 16 bytes a word and two a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, packed_type(s))
            for name in ("h", "mean"):
                rows[name] = batch.column(name).to_numpy()
            rows["n"] = np.minimum(batch.column("n").to_numpy(), 0xFFFFFFFF)
            for k in range(s.classes):
                rows["e"][:, k] = batch.column(f"e{k}").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["data"])

    ordered = words.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(run, "data binary").toArrow()
    return np.frombuffer(b"".join(x.as_buffer() for x in ordered.column("data")), packed_type(s))


def frequent(known: DataFrame, most: int) -> tuple[Column, bool]:
    """Which words are among the about ``most`` (at most) most frequent ones; and whether all are."""
    size = F.when(F.col("n") > 0, F.floor(16 * F.log2("n"))).otherwise(-1).cast("int")
    taken, least, every = 0, 1 << 30, True
    for at, words in sorted(((r[0], r[1]) for r in known.groupBy(size).count().collect()), reverse=True):
        taken += words
        if taken > most:
            every = False
            break
        least = at
    return size >= least, every


# ---- scoring

TEXT = "id {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, base double"
#: A text's segments are lists; ``cost`` has one value a segment, or one a class where words are missing: those
#: are listed by hash, each with its segment and how often it occurs there.
LISTS = "row long, learnt boolean, context array<long>, passage array<long>, cost array<double>, word array<long>, place array<int>, times array<int>"


@dataclass
class Cut:
    """Texts of a slice, cut at their anchors."""

    ids: np.ndarray
    counts: np.ndarray
    vocab: list[bytes]
    hashes: np.ndarray
    start: np.ndarray
    text: np.ndarray
    context: np.ndarray
    passage: np.ndarray
    bytes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], s: Settings) -> Cut:
        ids, counts, vocab = tokens(texts)
        hashes = hashed(vocab)
        size = np.fromiter(map(len, vocab), np.int64, len(vocab))
        return cls(ids, counts, vocab, hashes, *passages(hashes[ids], counts, s), segment_sums(size[ids], counts))

    @property
    def segments(self) -> np.ndarray:
        """Segments by text."""
        return np.bincount(self.text, minlength=len(self.counts))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _texts(source: DataFrame, table, every: bool, prior: np.ndarray, log_all: float, s: Settings) -> DataFrame:
    """A row per text: its segments, their costs by the words of ``table``, and the words not in it (``every``: none)."""
    names = [x.split(" ")[0] for x in f"{LISTS}, {TEXT}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = table.value, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                c = Cut.of(byte_texts(part, "text"), s)
                texts = len(c.counts)
                own, n, met = (np.zeros((len(c.vocab), s.classes), np.float32), np.zeros(len(c.vocab)), np.zeros(len(c.vocab), bool))
                if len(known):
                    h = c.hashes.view(np.int64)
                    order = np.argsort(h)  # neighbours are found near each other
                    at = np.empty(len(order), np.int64)
                    at[order] = np.minimum(np.searchsorted(known["h"], h[order]), len(known) - 1)
                    mine = known[at]
                    met = mine["h"] == h
                    own[met] = (mine["mean"][:, None] + mine["e"].astype(np.float32))[met]
                    n[met] = mine["n"][met]
                cost = np.add.reduceat(own[c.ids], c.start, axis=0, dtype=np.float64) if len(c.ids) else np.zeros((0, s.classes))
                if every:
                    cost = class_mix(cost, c.segments, prior, s.share)
                base = segment_sums(np.where(met, np.log10(n + 0.5), 0)[c.ids], c.counts) - c.counts * log_all
                rest = np.flatnonzero(~met[c.ids])
                seg = np.searchsorted(c.start, rest, "right") - 1
                key, times = np.unique(seg * len(c.vocab) + c.ids[rest], return_counts=True)
                seg, word = np.divmod(key, max(len(c.vocab), 1))
                first = np.cumsum(c.segments) - c.segments
                missing = np.bincount(c.text[seg], minlength=texts)
                row = (np.int64(TaskContext.get().partitionId()) << np.int64(40)) + np.arange(done, done + texts, dtype=np.int64)
                done += texts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row), part.column("learnt"), _lists(c.context.view(np.int64), c.segments), _lists(c.passage.view(np.int64), c.segments),
                        _lists(cost.ravel(), c.segments * (1 if every else s.classes)), _lists(c.hashes.view(np.int64)[word], missing),
                        _lists((seg - first[c.text[seg]]).astype(np.int32), missing), _lists(times.astype(np.int32), missing),
                        part.column("id"), part.column("held_out"), pa.array(c.counts), pa.array(c.bytes),
                        pa.array(segment_sums((n > 0).astype(np.int64)[c.ids], c.counts)), pa.array(base),
                    ],
                    names=names,
                )

    return source.mapInArrow(run, f"{LISTS}, {TEXT.format(kind=source.schema['id'].dataType.simpleString())}")


def _scored(texts: DataFrame, rest: DataFrame | None, prior: np.ndarray, s: Settings) -> DataFrame:
    """One row per text: its text columns and ``cost``; the costs of words in ``rest`` are added, passages taken into account."""
    each = texts.select("row", "learnt", F.posexplode(F.arrays_zip("context", "passage")).alias("seg", "at")).select(
        "row", "learnt", "seg", F.col("at.context").alias("context"), F.col("at.passage").alias("passage"),
    ).where("context != 0")
    seen = each.groupBy("context", "passage").agg(F.count_if("learnt").alias("n"), F.count("*").alias("m"))
    per = seen.groupBy("context").agg(F.max(F.struct("n", "passage")).alias("b"), F.sum("n").alias("total"), F.sum("m").alias("m"))
    # a context that occurs once says nothing; written, so that a hot one's side of the join can be split
    best = stored(per.where("total > 0 and m > 1").select("context", F.col("b.n").alias("top"), F.col("b.passage").alias("likely"), "total"))
    links = each.select("row", "seg", "context").join(best.hint("merge"), "context").groupBy("row").agg(
        F.collect_list(F.struct("seg", "top", "likely", "total")).alias("links"),
    )
    met = texts.join(links.hint("merge"), "row", "left")
    if rest is not None:
        words = texts.select("row", F.explode(F.arrays_zip("word", "place", "times")).alias("at")).select(
            "row", F.col("at.word").alias("h"), F.col("at.place").alias("place"), F.col("at.times").alias("times"),
        ).join(rest.hint("merge"), "h")
        inside = F.struct("place", "h", "times", "n", "mean", *(f"e{k}" for k in range(s.classes)))
        met = met.join(words.groupBy("row").agg(F.sort_array(F.collect_list(inside)).alias("more")).hint("merge"), "row", "left")
    text, missing = ("id", "held_out", "n_tokens", "n_bytes", "n_known", "base"), rest is not None
    used = ["learnt", "context", "passage", "cost", "links", *(["more"] if missing else []), *text]

    def flat(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
        """The values of a column of lists, and the row of each; a null list is empty."""
        lists = batch.column(name)
        return lists.flatten(), np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, row = flat(batch, "context")
            counts = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            cost = flat(batch, "cost")[0].to_numpy(zero_copy_only=False)
            known, base = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("n_known", "base"))
            if missing:
                more, at = flat(batch, "more")
                place, times, n, mean = (more.field(x).to_numpy(zero_copy_only=False) for x in ("place", "times", "n", "mean"))
                cost = cost.reshape(-1, s.classes).copy()
                for k in range(s.classes):
                    own = times * (mean + more.field(f"e{k}").to_numpy(zero_copy_only=False)).astype(np.float64)
                    cost[:, k] += np.bincount(first[at] + place, own, len(cost))
                known = known + np.bincount(at, times * (n > 0), batch.num_rows).astype(np.int64)
                base = base + np.bincount(at, times * np.log10(n + 0.5), batch.num_rows)
                cost = class_mix(cost, counts, prior, s.share)
            passage = flat(batch, "passage")[0].to_numpy(zero_copy_only=False)
            context = context.to_numpy(zero_copy_only=False)
            link, at = flat(batch, "links")
            spot = first[at] + link.field("seg").to_numpy(zero_copy_only=False)
            useful, top, total, hit = (np.zeros(len(context), kind) for kind in (np.int64, np.int64, np.int64, bool))
            useful[spot] = context[spot]
            top[spot], total[spot] = (link.field(x).to_numpy(zero_copy_only=False) for x in ("top", "total"))
            hit[spot] = passage[spot] == link.field("likely").to_numpy(zero_copy_only=False)
            whole = passage_mix(cost, useful, hit, top, total, batch.column("learnt").to_numpy(zero_copy_only=False), counts, s)
            own = {"n_known": pa.array(known), "base": pa.array(base)}
            yield pa.RecordBatch.from_arrays([*(own[x] if x in own else batch.column(x) for x in text), pa.array(whole)], names=[*text, "cost"])

    kinds = ", ".join(f"{x} {texts.schema[x].dataType.simpleString()}" for x in text)
    return met.select(*used).mapInArrow(run, f"{kinds}, cost double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per row of ``df``: ``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``.

    Learns from rows whose id's crc32 modulo 5 is not 1 (a null id is neither learnt from nor
    held out) and scores all. ``base_score`` is the unigram log10 probability with half a count
    added to each of the known words and one unknown; ``score`` the mixed model's; ``bits_per_byte``
    the latter by byte of the coded text. Null text counts as empty: its end alone is coded.
    Nothing learnt: no token is known. Repeated rows are learnt from and scored each time (and are
    repeats of one another); other columns are ignored; texts are coded whole.
    """
    s = settings or Settings()
    spark = df.sparkSession
    learnt = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(False))
    source = df.select(
        F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), learnt.alias("learnt"),
        F.col(text_col).cast("string").alias("text"),
    )
    classes = seed_classes(source, s)
    refit_classes(source, classes, s)
    words = stored(word_counts(source, classes, s))
    each = [f"c{k}" for k in range(s.classes)]
    sums = words.agg(F.count("*"), F.count_if(F.expr(" + ".join(each)) > 0), *(F.coalesce(F.sum(c), F.lit(0)) for c in each)).first()
    every, v, by_class = int(sums[0]), int(sums[1]), np.array([float(x) for x in sums[2:]])
    n = int(by_class.sum())
    parts = max(1, -(-every // s.part))
    placed = cut(word_table(words, parts, s))
    near = edges(placed, s)
    tenths = spark.sparkContext.broadcast(tables(placed, parts, s))
    mixer = spark.sparkContext.broadcast(train(placed, near, tenths, n, s))
    known = stored(costs(placed, near, mixer, s))
    prior = (by_class + 1) / (n + s.classes)
    log_all = float(np.log10(n + 0.5 * (v + 1)))
    often, all_sent = frequent(known, s.broadcast_words)
    table = spark.sparkContext.broadcast(pack(known.where(often), s))
    texts = stored(_texts(source, table, all_sent, prior, log_all, s))
    out = _scored(texts, None if all_sent else known.where(~often), prior, s).withColumn("score", F.col("cost") / float(-np.log(10)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
