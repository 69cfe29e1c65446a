"""SentencePiece encoding and decoding; sampled segmentations without replacement.

The vocabulary of a public SentencePiece model spans a lattice over each unit of a text (a word
with the blanks before it); the text's lattice is the chain of its units' lattices. A piece
weighs a power of its rank, so a segmentation's probability is the product of its pieces'
weights over that of all segmentations of the text.

Gumbel top-k over the lattice, in the form of arrival times: a segmentation of probability p
arrives after an exponential time of rate p, and the first k arrivals are k segmentations drawn
without replacement (minus the logarithm of a time is a Gumbel-perturbed log probability). The
search is best-first from the top: the time of a subtree is the least of its segmentations',
known before they are. The best subtree is followed to a full segmentation by exact backward
probabilities; every alternative left beside the path is a subtree of its own whose time is the
path's plus an exponential time of that subtree's rate, and joins the queue. The popped order is
the order of arrival. The (k+1)-th time t gives each emitted segmentation its inclusion score
1 - exp(-p t).

All random numbers are hashes of the row's key, the round and the place in the text: a row
gets the same samples wherever it is computed.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import Numbers, mix64, ranges, run_sums, segment_sums, slices

#: A public model's file; a parameter everywhere, this is only the default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A unit: a word with the blanks before it, blanks at the end of a line, or line ends; none is cut.
UNIT = re.compile(r" *[^ \n]+| +|\n+")


@dataclass(frozen=True)
class Sampling:
    samples: int = 4
    #: weight of a piece: its rank to the power of minus alpha
    alpha: float = 0.5
    seed: int = 42
    #: alternatives beside a path count while the path's log probability is over this: those
    #: further on arrive in time with a probability below the precision of a double
    depth: float = -36.0


#: Bytes of texts whose lattices a worker holds at once, besides those of common units: what a core's cache holds.
SLICE = 400_000
#: Bytes before a unit's end over which products of weights stay far above the least double.
PLAIN = 100
#: Edges of a path looked at for alternatives, before it is known whether more can matter.
CLOSE = 256


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (the blank mark as a blank), byte pieces, and a double-array trie over the former."""

    pieces: list[bytes]
    byte_ids: np.ndarray
    weight: np.ndarray
    base: np.ndarray
    check: np.ndarray
    term: np.ndarray


def vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    byte_ids, pieces, rank = np.full(256, -1, np.int64), [b""] * n, np.full(n, n, np.float64)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            pieces[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
            rank[i] = 1 + len(pieces) - n + i
    if (byte_ids < 0).any():
        raise ValueError("the model lacks byte pieces, so it can't encode every text")
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i in range(n):
        if sp.is_byte(i) or not pieces[i]:
            continue
        node = 0
        for b in pieces[i]:
            if b not in tree[node]:
                tree[node][b] = len(tree)
                tree.append({})
            node = tree[node][b]
        ends[node] = i
    return Vocabulary(pieces, byte_ids, -np.log(rank), *_double_array(tree, ends))


def _double_array(tree: list[dict[int, int]], ends: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check``, ``term``: the child by byte b of the node in cell s is cell base[s]+b, if check there is s."""
    size = 4 * len(tree) + 100_000
    base, check, term = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    cell = {0: 0}
    low = high = 1
    for node, children in enumerate(tree):  # parents come before their children
        s = cell.pop(node)
        term[s] = ends.get(node, -1)
        if not children:
            continue
        keys = sorted(children)
        while not free[low]:
            low += 1
        if len(keys) == 1 and low >= keys[0]:  # only children fill the gaps
            place = low - keys[0]
        else:  # families look on from where the last one found room
            begin, place = max(high, keys[0]), -1
            while place < 0:
                fits = np.flatnonzero(free[begin : begin + 256]) + begin - keys[0]
                for k in keys[1:]:
                    fits = fits[free[fits + k]]
                begin += 256
                place = int(fits[0]) if len(fits) else -1
            high = max(high, begin - 512)
        base[s] = place
        for b in keys:
            t = place + b
            free[t], check[t] = False, s
            cell[children[b]] = t
    return base, check, term


class Lattice:
    """The lattices of distinct units, as one graph. A unit of n bytes has states 0 … n.

    Edges of a state are consecutive. ``logq`` is the logarithm of an edge's probability among its
    state's, weighed with everything behind it; ``upto`` the running sum of these inside the state, and
    ``lead`` that of a state's first edge. ``go`` is where an edge leads, -1 at the unit's end.
    Units are added behind those that are there; ``keep`` marks the ones that stay when the rest
    is dropped, so that a worker prepares common units once.
    """

    EDGES = {"src": np.int32, "piece": np.int32, "size": np.int32, "to": np.int32, "go": np.int32, "logq": np.float32, "upto": np.float32}
    STATES = {"data": np.uint8, "final": bool, "lead": np.float32, "first": np.int64}

    def __init__(self, units: list[bytes], v: Vocabulary, alpha: float):
        self.v, self.alpha, self.plain = v, alpha, np.exp(alpha * v.weight)
        for name, kind in (self.EDGES | self.STATES).items():
            setattr(self, name, np.zeros(1, kind))
        self.start = np.zeros(0, np.int64)
        self.states = self.edges = self.kept_units = self.kept_states = self.kept_edges = 0
        self.add(units)

    def keep(self) -> None:
        self.kept_units, self.kept_states, self.kept_edges = len(self.start), self.states, self.edges

    def drop(self) -> None:
        self.start, self.states, self.edges = self.start[: self.kept_units], self.kept_states, self.kept_edges

    def reset(self) -> None:
        self.kept_units = self.kept_states = self.kept_edges = 0
        self.drop()

    def _room(self, names: dict, used: int, more: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < used + more + 1:
                new = np.zeros(used + more + more // 4 + 1, old.dtype)
                new[: used + 1] = old[: used + 1]
                setattr(self, name, new)

    def add(self, units: list[bytes]) -> None:
        if not units:
            return
        v = self.v
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        # a zero byte ends each unit; no piece of the trie goes on with it, so a state is a byte's place
        data = np.frombuffer(b"\0".join([*units, b""]), np.uint8).astype(np.int32)
        states = len(data)
        ends = np.cumsum(lengths + 1) - 1
        inner = np.ones(states, bool)
        inner[ends] = False
        first = np.flatnonzero(((data & 0xC0) != 0x80) & inner).astype(np.int32)
        # bytes of the character that begins at each of them
        lead = data[first]
        wide = (1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)).astype(np.int32)
        width = np.zeros(states, np.int8)
        width[first] = wide
        at, node = first, np.zeros(len(first), np.int32)
        whole = np.zeros(states, bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(at):
            cell = v.base[node] + data[at + depth]
            ok = v.check[cell] == node
            if depth == 0:
                ok &= data[at] != 0
            some = np.flatnonzero(ok)
            at, node = at[some], cell[some]
            depth += 1
            piece = v.term[node]
            hit = np.flatnonzero(piece >= 0)
            here = at[hit]
            found.append((here, piece[hit]))
            whole[here[width[here] == depth]] = True
        # characters without a piece of their own go byte by byte, as one edge, the last of its state
        lost = np.flatnonzero(~whole[first])
        count = np.bincount(np.concatenate([first[lost], *(f[0] for f in found)]), minlength=states)
        opens = np.concatenate([[0], np.cumsum(count)])
        fill = opens[:-1].copy()
        edges = int(opens[-1])
        self._room(self.STATES, self.states, states)
        self._room(self.EDGES, self.edges, edges)
        src, piece, size, to, go, logq, upto = (getattr(self, name)[self.edges : self.edges + edges] for name in self.EDGES)
        piece[:] = -1
        for n in range(depth, 0, -1):  # long pieces first: they are the likelier ones
            s, p = found[n - 1]
            e = fill[s]
            src[e], piece[e], size[e] = s, p, n
            fill[s] += 1
        e = fill[first[lost]]
        src[e], size[e] = first[lost], wide[lost]
        np.add(src, size, out=to)
        spelt = np.flatnonzero(piece < 0)
        plain = self.plain[piece]
        plain[spelt] = self.plain[v.byte_ids[0]] ** size[spelt]
        # backward sums, by distance from the unit's end: near to it as they are, further on as logarithms
        rest = np.repeat(ends, lengths + 1) - np.arange(states)
        longest = int(lengths.max())
        near = rest[first].astype(np.uint16 if longest < 1 << 16 else np.int64)
        order = np.argsort(near, kind="stable")
        turn = first[order]
        cuts = np.searchsorted(near[order], np.arange(1, longest + 2))
        behind = np.zeros(states)
        behind[ends] = 1.0
        for a, b in zip(cuts[:PLAIN], cuts[1 : PLAIN + 1]):
            if a < b:
                s = turn[a:b]
                n = count[s]
                e = ranges(opens[s], n)
                behind[s] = np.add.reduceat(plain[e] * behind[to[e]], np.cumsum(n) - n)
        if longest > PLAIN:
            weight = np.log(plain)
            logs = np.log(np.maximum(behind, 1e-300))
            for a, b in zip(cuts[PLAIN:-1], cuts[PLAIN + 1 :]):
                if a < b:
                    s = turn[a:b]
                    n = count[s]
                    e = ranges(opens[s], n)
                    x = weight[e] + logs[to[e]]
                    begin = np.cumsum(n) - n
                    top = np.maximum.reduceat(x, begin)
                    logs[s] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), begin))
            share = np.exp(weight + logs[to] - logs[src])
        else:
            share = plain * behind[to] / behind[src]
        np.log(share, out=logq, casting="same_kind")
        run = np.concatenate([[0.0], np.cumsum(share)])
        np.subtract(run[1:], run[opens[src]], out=upto, casting="same_kind")
        some = count > 0
        upto[opens[1:][some] - 1] = np.inf
        np.add(to, np.int32(self.states), out=go)
        go[~inner[to]] = -1
        self.lead[self.states : self.states + states][some] = upto[opens[:-1][some]]
        src += self.states
        to += self.states
        self.start = np.concatenate([self.start, self.states + ends - lengths])
        self.data[self.states : self.states + states] = data
        self.final[self.states : self.states + states] = ~inner
        self.first[self.states : self.states + states + 1] = opens + self.edges
        self.states += states
        self.edges += edges

    def walk(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state to its unit's end: ``(number of edges, edges one state after the other)``."""
        owner, at = np.arange(len(state)), state  # no unit is empty, so each state has an edge
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        taken = np.zeros(len(state), np.int64)
        while len(owner):
            u = uniform(key)
            e = self.first[at]
            behind = np.flatnonzero(u > self.lead[at])
            if len(behind):
                u = u[behind]
                f = e[behind] + 1
                open_ = np.flatnonzero(u > self.upto[f])
                while len(open_):
                    f[open_] += 1
                    open_ = open_[u[open_] > self.upto[f[open_]]]
                e[behind] = f
            steps.append((owner, e))
            at = self.go[e]
            more = np.flatnonzero(at >= 0)
            taken[owner] = len(steps)
            owner, at, key = owner[more], at[more], key[more] + np.uint64(1)
        out = np.zeros(int(taken.sum()), np.int64)
        begin = np.cumsum(taken) - taken
        for i, (owner, e) in enumerate(steps):
            out[begin[owner] + i] = e
        return taken, out


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    with np.errstate(over="ignore"):
        return ((mix64(key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _stream(seed: np.ndarray, kind: int) -> np.ndarray:
    """A text's key for one kind of draw."""
    with np.errstate(over="ignore"):
        return mix64(seed ^ np.uint64(kind) * np.uint64(0xD6E8FEB86659FD93))


def _keys(stream: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Keys far apart, for draws at the given places: a unit's steps are numbered between them."""
    with np.errstate(over="ignore"):
        return stream + (number.astype(np.uint64) << np.uint64(28))


@dataclass
class Path:
    """A round's segmentations: edges of all texts one after the other, and each text's log probability and time."""

    edges: np.ndarray
    counts: np.ndarray
    log_prob: np.ndarray
    log_time: np.ndarray


def sample(
    units: np.ndarray, counts: np.ndarray, lattice: Lattice, keys: np.ndarray, s: Sampling,
) -> tuple[list[tuple[np.ndarray, Path]], np.ndarray]:
    """The search over some texts at once.

    ``units`` are their lattices in order, ``counts`` per text, ``keys`` a 64-bit key per text.
    Returns for each round the texts that have a further segmentation, with their paths, and the
    time after the last round, per text (infinite where no segmentation is left).
    """
    n = len(counts)
    seed = mix64(keys.astype(np.uint64) ^ mix64(np.full(n, s.seed, np.uint64)))
    begin = np.cumsum(counts) - counts
    rounds: list[tuple[np.ndarray, Path]] = []
    # the queue: text, time, round, token place, edge, log probability of the path before it
    queue = {
        k: np.zeros(0, t) for k,
        t in (("text", np.int64), ("time", float), ("round", np.int64), ("place", np.int64), ("edge", np.int64), ("before", float))
    }
    texts = np.arange(n)
    now = {
        "text": texts, "time": -np.log(uniform(_stream(seed, 1))), "round": np.full(n, -1), "place": np.zeros(n, np.int64),
        "edge": np.full(n, -1), "before": np.zeros(n),
    }
    for r in range(s.samples):
        texts = now["text"]
        if not len(texts):
            break
        prefix, prefix_counts, skip, state = _prefixes(now, rounds, lattice, counts)
        # walk on: the rest of the unit in which the queue's edge ends, then whole units
        todo = counts[texts] - skip
        unit = ranges(begin[texts] + skip, todo)
        from_state = lattice.start[units[unit]]
        lead = np.cumsum(todo) - todo
        open_unit = state >= 0
        from_state[lead[open_unit]] = state[open_unit]
        place = ranges(skip, todo)
        taken, walked = lattice.walk(from_state, _keys(np.repeat(_stream(seed[texts], 2 + 3 * r), todo), place))
        walked_counts = segment_sums(taken, todo)
        total = prefix_counts + walked_counts
        at = np.cumsum(total) - total
        if len(prefix):
            ends, rest = np.cumsum(prefix_counts).tolist(), np.cumsum(walked_counts).tolist()
            parts = zip([0, *ends], ends, [0, *rest], rest)
            edges = np.concatenate([x for a, b, c, d in parts for x in (prefix[a:b], walked[c:d])])
        else:
            edges = walked
        path = Path(edges, total, run_sums(lattice.logq[edges], total), np.log(now["time"]))
        rounds.append((texts, path))
        # alternatives beside the walked part, where the path is likely enough for them to matter:
        # looked for among the first edges, and among all where these do not make it unlikely
        close = np.minimum(prefix_counts + CLOSE, total)
        while True:
            near = ranges(at, close)
            logq = lattice.logq[edges[near]]
            run = np.cumsum(logq) - logq
            lead = np.cumsum(close) - close
            run -= np.repeat(run[lead[close > 0]], close[close > 0])
            ends = lead + close - 1
            on = (close < total) & (close > 0)
            on[on] = run[ends[on]] + logq[ends[on]] > s.depth
            if not on.any():
                break
            close = np.where(on, np.minimum(2 * close + CLOSE, total), close)
        mine = np.repeat(np.arange(len(texts)), close)
        likely = (run > s.depth) & (near - at[mine] >= prefix_counts[mine])
        fresh, owner, before = near[likely], mine[likely], run[likely]
        state_of = lattice.src[edges[fresh]]
        degree = lattice.first[state_of + 1] - lattice.first[state_of]
        other = ranges(lattice.first[state_of], degree)
        spot, who, before = np.repeat(fresh, degree), np.repeat(owner, degree), np.repeat(before, degree)
        keep = other != edges[spot]
        other, spot, who, before = other[keep], spot[keep], who[keep], before[keep]
        where = spot - at[who]
        e = -np.log(uniform(_keys(_stream(seed[texts], 3 + 3 * r)[who], where * 32 + (other - lattice.first[lattice.src[other]]))))
        new = {
            "text": texts[who], "time": now["time"][who] + e * np.exp(-(before + lattice.logq[other])), "round": np.full(len(who), r),
            "place": where, "edge": other, "before": before,
        }
        queue = {k: np.concatenate([queue[k], new[k]]) for k in queue}
        order = np.lexsort((queue["time"], queue["text"]))
        text = queue["text"][order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        top = order[rank == 0]
        now = {k: x[top] for k, x in queue.items()}
        later = order[(rank > 0) & (rank <= s.samples - r)]
        queue = {k: x[later] for k, x in queue.items()}
    after = np.full(n, np.inf)
    after[now["text"]] = now["time"]
    return rounds, after


def _prefixes(
    now: dict[str, np.ndarray], rounds: list[tuple[np.ndarray, Path]], lattice: Lattice, counts: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges before the walk, their number, the units they have finished, and the state inside the next (-1: none)."""
    n = len(now["text"])
    number = np.where(now["edge"] >= 0, now["place"] + 1, 0)
    out = np.zeros(int(number.sum()), np.int64)
    begin = np.cumsum(number) - number
    for r, (texts, path) in enumerate(rounds):
        mine = np.flatnonzero(now["round"] == r)
        if len(mine):
            source = (np.cumsum(path.counts) - path.counts)[np.searchsorted(texts, now["text"][mine])]
            out[ranges(begin[mine], now["place"][mine])] = path.edges[ranges(source, now["place"][mine])]
    forked = np.flatnonzero(now["edge"] >= 0)
    out[begin[forked] + number[forked] - 1] = now["edge"][forked]
    done = segment_sums(lattice.final[lattice.to[out]].astype(np.int64), number)
    state = np.full(n, -1)
    end = lattice.to[now["edge"][forked]]
    inside = ~lattice.final[end]
    state[forked[inside]] = end[inside]
    return out, number, done, state


def token_ids(path: Path, lattice: Lattice, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' tokens, and their number by text; byte edges become byte pieces."""
    ids = lattice.piece[path.edges]
    spelt = np.flatnonzero(ids < 0)
    if not len(spelt):
        return ids, path.counts
    e = path.edges[spelt]
    each = np.ones(len(ids), np.int64)
    each[spelt] = lattice.size[e]
    ids = np.repeat(ids, each)
    ids[ids < 0] = v.byte_ids[lattice.data[ranges(lattice.src[e], lattice.size[e])]]
    return ids, segment_sums(each, path.counts)


class Decoder:
    """Ids back to text: the pieces' bytes joined, less the blank put in front."""

    def __init__(self, v: Vocabulary):
        self.length = np.array([len(p) for p in v.pieces], np.int32)
        self.begin = np.cumsum(self.length, dtype=np.int32) - self.length
        self.data = np.frombuffer(b"".join(v.pieces) + b"\0", np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        each = self.length[ids]
        ends = np.cumsum(each, dtype=np.int64)
        small = np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64
        shift = (self.begin[ids] - (ends - each)).astype(small)
        place = np.arange(int(ends[-1]) if len(ends) else 0, dtype=small) + np.repeat(shift, each)
        joined = self.data[place].tobytes()
        bounds = np.cumsum(segment_sums(each.astype(np.int64), counts)).tolist()
        return [joined[a + 1 : b] for a, b in zip([0, *bounds[:-1]], bounds)]


#: Slices after which a worker chooses its common units anew, and how many it keeps.
CHOOSE, COMMON = (1, 4, 12), 40_000


class Encoder:
    """Samples segmentations of texts; the units that were common in the first slices are prepared once."""

    def __init__(self, v: Vocabulary, s: Sampling):
        self.v, self.s, self.common, self.lattice = v, s, Numbers(), Lattice([], v, s.alpha)
        self.slices, self.times = 0, Counter()

    def _choose(self) -> None:
        """Units seen twice, the most frequent ones: from now on the first of the lattice."""
        often = [u for u, n in self.times.most_common(COMMON) if n > 1 and len(u) <= 64]
        self.common = Numbers((u, i) for i, u in enumerate(often))
        self.lattice.reset()
        self.lattice.add([u.encode() for u in often])
        self.lattice.keep()

    def __call__(self, texts: list[str], keys: np.ndarray) -> tuple[Lattice, list[tuple[np.ndarray, Path]], np.ndarray]:
        found = [UNIT.findall(f" {text}") if text else [] for text in texts]
        counts = np.fromiter(map(len, found), np.int64, len(texts))
        if self.slices < CHOOSE[-1]:
            for own in found:
                self.times.update(own)
            self.slices += 1
            if self.slices in CHOOSE:
                self._choose()
            if self.slices == CHOOSE[-1]:
                self.times.clear()
        seen = Numbers(self.common)
        units: list[int] = []
        for own in found:
            units.extend(map(seen.__getitem__, own))
        self.lattice.drop()
        self.lattice.add([u.encode() for u in itertools.islice(seen, len(self.common), None)])
        rounds, after = sample(np.array(units, np.int64), counts, self.lattice, keys, self.s)
        return self.lattice, rounds, after


#: A worker's encoders and decoders by model: what they have prepared serves its later tasks, and changes no result.
_READY: dict[tuple[str, Sampling], tuple[Encoder, Decoder]] = {}


def _ready(model: str, v: Vocabulary, s: Sampling) -> tuple[Encoder, Decoder]:
    if (model, s) not in _READY:
        _READY.clear()
        _READY[model, s] = Encoder(v, s), Decoder(v)
    return _READY[model, s]


def sample_encodings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sampling: Sampling | None = None, model: str = MODEL,
) -> DataFrame:
    """Up to ``samples`` rows for each row of ``df``: ``(id, sample, ids, n_tokens, log_prob, log_inclusion, round_trip)``.

    A text's samples are distinct segmentations, numbered from 1 in the order drawn; a text with
    fewer segmentations gets them all, each with inclusion score 1 (logarithm 0). Null and empty
    texts have one segmentation, the empty one. ``round_trip``: the ids decode to the text
    exactly. Samples depend on id and text alone: rows that repeat get equal samples, null ids
    share a key. Other columns are ignored. Texts are encoded whole, some hundred thousand bytes of
    them at a time (a longer text by itself).
    """
    s = sampling or Sampling()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(model))
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "sample", "ids", "n_tokens", "log_prob", "log_inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder, decode = _ready(model, v, s)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                lattice, rounds, after = encoder(texts, part.column("key").to_numpy().view(np.uint64))
                coded = [t.encode() for t in texts]
                for r, (at, path) in enumerate(rounds):
                    ids, counts = token_ids(path, lattice, v)
                    same = [b == coded[i] for b, i in zip(decode(ids, counts), at.tolist())]
                    with np.errstate(divide="ignore", over="ignore"):
                        x = path.log_prob + np.log(after[at])
                        inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(at)), pa.array(np.full(len(at), r + 1, np.int32)), lists, pa.array(counts),
                            pa.array(path.log_prob), pa.array(np.minimum(inclusion, 0.0)), pa.array(same),
                        ],
                        names=names,
                    )

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, sample int, ids array<int>, n_tokens long, log_prob double, log_inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(id, ids)``: the model's own single encoding of each row; null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            ids = sp.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``(id, text)`` from rows of token ids; a null list is an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(shared.value)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            counts = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            texts = [t.decode("utf-8", "replace") for t in back(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
