"""SentencePiece encoding and decoding with k distinct sampled segmentations (Gumbel top-k).

The lattice of a text: the tokenizer's pieces over its characters, spaces written as the tokenizer does
and one in front.  A character outside the vocabulary is its bytes' pieces.  The model is a BPE model, whose
scores are ranks; a piece of rank r weighs 1 / (r + `RANK_SHIFT`) ** alpha (Zipf's law).  A segmentation's
probability is its weight over that of all segmentations, which the lattice's backward sums give.

Sampling without replacement by perturbed A-star search: every segmentation has a Gumbel-perturbed log
probability.  The root's largest is Gumbel(0) and belongs to a segmentation drawn from the model.  At each
of its pieces, all segmentations that leave it there form one node, of known mass, whose largest value is
a Gumbel truncated at the parent's.  The search pops the best node, draws its segmentation (a piece other
than those taken, then on from the model) and splits it in the same way.  Segmentations come out in
falling order and all differ; the value of the best node left is the threshold of the inclusion
probabilities 1 - exp(-exp(log_prob - threshold)).

No piece spans a character followed by a space, so the lattice falls apart into words.  Words that repeat
in a slice of texts share their part of the lattice; drawing, leaving out and branching run over all texts of
a slice at once, in arrays.  All random numbers are hashes of (seed, row key, path, position): any split into tasks gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, pieces, release, slices
from .token_counts import MARK, default_model, load

K, SEED, ALPHA, RANK_SHIFT = 2, 17, 1.0, 2.0
LONGEST = 16
#: Bytes of text whose lattice a task holds at once; a text's samples do not depend on it.
SLICE = 1_500_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_FULL = (1 << 64) - 1
_CHUNK = 1 << 16
#: Units of probabilities and of log probabilities where they are summed as whole numbers.
_ONE, _FINE = 2.0**32, 2.0**36


class Vocabulary:
    """Pieces and all their beginnings by the hash of their characters, with log weights and bytes."""

    def __init__(self, path: str, alpha: float):
        model = load(path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = {model.id_to_piece(i): i for i in normal}
        ranks = np.array([-model.get_score(i) for i in range(n)])
        worst = ranks[ranks < 1e8].max() + 1
        self.weight = -alpha * np.log(np.minimum(ranks, worst) + RANK_SHIFT)
        self.byte_weight = -alpha * np.log(worst + RANK_SHIFT)
        self.byte_id = np.zeros(256, np.int64)
        raw = [b""] * n
        for t, i in texts.items():
            raw[i] = t.replace(MARK, " ").encode()
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b], raw[i] = i, bytes([b])
        #: What a piece decodes to.
        self.lengths = np.array([len(b) for b in raw])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.longest = min(LONGEST, max(map(len, texts)))
        longer = {t[:k] for t in texts if len(t) <= self.longest for k in range(1, len(t))}
        starts = sorted(longer | {t for t in texts if len(t) <= self.longest})
        self.id = np.array([texts.get(t, -1) for t in starts], np.int32)
        self.extends = np.array([t in longer for t in starts])
        points = np.frombuffer("".join(starts).encode("utf-32-le"), np.uint32)
        length = np.array([len(t) for t in starts])
        first, self.key = np.cumsum(length) - length, np.zeros(len(starts), _U)
        for k in range(self.longest):
            on = np.flatnonzero(length > k)
            self.key[on] = further(self.key[on], points[first[on] + k])
        self.tables = []  # small open tables: what collides in one goes into the next
        left = np.arange(len(starts))
        for shift, bits in ((46, 18), (28, 16), (10, 16)):
            table = np.full(1 << bits, -1, np.int32)
            slot = (self.key[left] >> _U(shift)) & _U((1 << bits) - 1)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((shift, table))
        if len(left):
            raise ValueError("vocabulary too large for its tables")

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places in `id` and `extends`, -1 for what no piece begins with."""
        out, ask = np.full(len(key), -1, np.int32), None
        for shift, table in self.tables:
            at = table[(key >> _U(shift)) & _U(len(table) - 1)]
            taken = np.flatnonzero(at >= 0)
            at, own = at[taken], (taken if ask is None else ask[taken])
            hit = self.key[at] == key[taken]
            out[own[hit]] = at[hit]
            ask, key = own[~hit], key[taken[~hit]]  # only where a slot is taken by another can a key be in the next table
            if not len(ask):
                break
        return out


def further(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The hash of some characters and one more."""
    return (h + mix(point.astype(_U) + _U(1))) * _U(_BASE)


def word_names(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of characters that follow one another, from prefix sums."""
    n = len(points)
    sums, down = np.zeros(n + 1, _U), None
    back = np.full(_CHUNK, pow(_BASE, -1, 1 << 64), _U)
    up = np.full(_CHUNK, _BASE, _U)
    up[0] = back[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(back, out=back)
    name, end, at = np.empty(len(start), _U), start + size, 0
    for a in range(0, n, _CHUNK):  # in pieces, for the sake of the temporary arrays; a piece's powers start anew
        z = min(a + _CHUNK, n)
        part = sums[: z - a + 1]
        np.cumsum(mix(points[a:z].astype(_U) + _U(1)) * up[: z - a], out=part[1:])
        last = int(np.searchsorted(end, z, "right"))
        s, e = start[at:last], end[at:last]
        inside = s >= a
        name[at:last][inside] = (part[e[inside] - a] - part[s[inside] - a]) * back[s[inside] - a]
        for k in np.flatnonzero(~inside) + at:
            name[k] = _one_name(points[start[k] : end[k]], up)
        at = last
    return mix(name + size.astype(_U))


def _one_name(points: np.ndarray, up: np.ndarray) -> int:
    """The same hash for a run that crosses pieces, of any length."""
    total = 0
    for a in range(0, len(points), len(up)):
        part = points[a : a + len(up)]
        total += int(np.sum(mix(part.astype(_U) + _U(1)) * up[: len(part)], dtype=_U)) * pow(_BASE, a, 1 << 64)
    return total & _FULL


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """The lattices of the distinct words of some texts, as edges sorted by the node they leave.

    Nodes are characters of the distinct words; an edge of `length` characters leads that many nodes on.
    Draws use probabilities in whole numbers of 1 / `_ONE`, whose sums do not depend on what stands beside.
    """

    def __init__(self, points: np.ndarray, text_start: np.ndarray, v: Vocabulary):
        n = len(points)
        mark = points == ord(MARK)
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[text_start[text_start < n]] = True
        self.start = np.flatnonzero(opens)
        size = np.diff(np.append(self.start, n))
        name = word_names(points, self.start, size)
        self.word, distinct = pd.factorize(name)
        first = np.empty(len(distinct), np.int64)
        first[self.word[::-1]] = np.arange(len(name))[::-1]
        size = size[first]
        self.node0 = np.cumsum(size) - size
        count = int(size.sum())
        points = pieces(points, self.start[first], size)
        left = np.repeat(self.node0 + size, size) - np.arange(count)  # characters to the word's end
        node, length, ids = [], [], []
        here, h = np.arange(count, dtype=np.int32), np.zeros(count, _U)
        alone = here[:0]
        for k in range(1, v.longest + 1):
            h = further(h, points[here + (k - 1)])
            at = v.find(h)
            found = v.id[at]  # of no entry: the last one's, left out below
            hit = (at >= 0) & (found >= 0)
            if k == 1:
                alone = here[~hit]
            node.append(here[hit])
            length.append(np.full(len(node[-1]), k, np.int8))
            ids.append(found[hit])
            on = np.flatnonzero((at >= 0) & v.extends[at] & (left[here] > k))
            if not len(on):
                break
            here, h = here[on], h[on]
        code = points[alone]
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        node.append(alone)
        length.append(np.ones(len(alone), np.int8))
        ids.append(-1 - code.astype(np.int32))  # the bytes of a character
        weights = np.concatenate([v.weight[np.concatenate(ids[:-1])], n_bytes * v.byte_weight])
        node, length, ids = np.concatenate(node), np.concatenate(length), np.concatenate(ids)
        order = np.argsort(node, kind="stable")
        self.node, self.length, self.ids, weight = node[order], length[order], ids[order], weights[order]
        del node, length, ids, weights, order
        self.edge0 = np.zeros(count + 1, np.int32)
        np.cumsum(np.bincount(self.node, minlength=count), out=self.edge0[1:])
        far = left[self.node]
        self.ends = far == self.length  # the edge reaches the word's end
        back = np.zeros(count + 1)
        far = far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far  # sixteen bits sort by radix
        by_left = np.argsort(far, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(far, minlength=1)))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            e = by_left[a:z]
            own = self.node[e]
            total = weight[e] + np.where(self.ends[e], 0.0, back[np.minimum(own + self.length[e], count)])
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            top = np.maximum.reduceat(total, head)
            back[own[head]] = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, np.diff(np.append(head, len(e))))), head))
        del by_left, far
        self.log_p = weight
        self.log_p += np.where(self.ends, 0.0, back[np.minimum(self.node + self.length, count)])
        self.log_p -= back[self.node]
        self.p = np.exp(self.log_p)
        sums = np.cumsum((self.p * _ONE).astype(np.int64))
        sums -= np.append(0, sums)[self.edge0[:-1]][self.node]
        self.cdf = np.minimum(sums, _ONE - 1).astype(np.uint32)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its probability; most nodes have a few edges."""
        edge, last = self.edge0[node], self.edge0[node + 1] - 1
        u = (u * _ONE).astype(np.uint32)
        on = np.flatnonzero((edge < last) & (self.cdf[edge] <= u))
        at, last, u = edge[on] + 1, last[on], u[on]
        while len(on):
            stay = (at >= last) | (self.cdf[at] > u)
            edge[on[stay]] = at[stay]
            go = ~stay
            on, at, last, u = on[go], at[go] + 1, last[go], u[go]
        return edge


def spread(h: np.ndarray | int, x: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of hashes and whole numbers."""
    h, x = np.atleast_1d(np.asarray(h, _U)), np.atleast_1d(np.asarray(x)).astype(np.int64).view(_U)
    return mix(h ^ (x * _U(0x632BE59BD9B4E019) + _U(0x9E3779B97F4A7C15)))


def unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _paths(lattice: Lattice, key: np.ndarray, place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, edge) of a drawn segmentation of each of `words`, in order.  key, place: per word, for the hash."""
    out_word, out_edge = [words[:0]], [words[:0]]
    node, now = lattice.node0[lattice.word[words]], words
    h, at = key[words], place[words]
    while len(now):
        edge = lattice.draw(node, unit(spread(h, at)))
        out_word.append(now)
        out_edge.append(edge)
        on = np.flatnonzero(~lattice.ends[edge])
        step = lattice.length[edge[on]]
        now, node, h, at = now[on], node[on] + step, h[on], at[on] + step
    word, edge = np.concatenate(out_word), np.concatenate(out_edge)
    order = np.argsort(word.astype(np.int32), kind="stable")
    return word[order], edge[order]


def _below(top: np.ndarray, free: np.ndarray) -> np.ndarray:
    """A Gumbel variable truncated at `top`, from `free`, the same without a bound."""
    return -np.logaddexp(-top, -free)


class Paths:
    """One drawn path of each of some texts, with the values of what leaves it at each of its pieces.

    Flat arrays, text after text: `word`, `edge` and `value` of every piece; `cut`: each text's first piece.
    Values are those without the bound `top`, which keeps their order; `best` is bounded.
    A path's pieces before `own` are another path's, and so is what leaves that one there; `taken` are the
    edges that are left out at `own` already.
    """

    def __init__(self, lattice: Lattice, key: np.ndarray, has: np.ndarray, cut: np.ndarray, word: np.ndarray, edge: np.ndarray, top: np.ndarray, own: np.ndarray, taken: np.ndarray):
        self.has, self.cut, self.word, self.edge, self.top, self.own, self.taken = has, cut, word, edge, top, own, taken
        size = np.diff(cut)
        fine = np.rint(lattice.log_p[edge] * _FINE).astype(np.int64)  # whole numbers: sums are the same in any slice
        sums = np.append(0, np.cumsum(fine))
        self.log_prob = (sums[cut[1:]] - sums[cut[:-1]]) / _FINE
        text = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(edge)) - cut[text]
        fresh = np.flatnonzero(at >= own[text])
        text, at = text[fresh], at[fresh]
        before = (sums[fresh] - sums[cut[text]]) / _FINE
        rest = 1.0 - lattice.p[edge[fresh]]
        mine = np.flatnonzero(at == own[text])
        mine = mine[(taken[text[mine]] >= 0).any(axis=1)]
        rest[mine] -= np.where(taken[text[mine]] >= 0, lattice.p[taken[text[mine]]], 0.0).sum(axis=1)
        some = np.flatnonzero(rest >= 1e-12)
        self.value = np.full(len(edge), -np.inf)
        self.value[fresh[some]] = before[some] + np.log(rest[some] / -np.log(unit(spread(key[text[some]], at[some]))))
        self._best(np.flatnonzero(size))

    def _best(self, texts: np.ndarray) -> None:
        """For each text the largest value and its place."""
        n = len(self.cut) - 1
        self.best, self.where = np.full(n, -np.inf), np.zeros(n, np.int64)
        if len(texts):
            self.best[texts] = np.maximum.reduceat(self.value, self.cut[texts])
            at = np.flatnonzero(self.value == np.repeat(self.best, np.diff(self.cut)))[::-1]
            text = np.searchsorted(self.cut, at, "right") - 1
            self.where[text] = at  # the first of equals
            self.best = _below(self.top, self.best)

    def leave(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, edges left out there) of the best of `texts`, which are used up."""
        at = self.where[texts]
        again = at - self.cut[texts] == self.own[texts]
        taken = np.where(again[:, None], self.taken[texts], -1)
        taken[np.arange(len(texts)), (taken >= 0).sum(axis=1)] = self.edge[at]
        self.value[at] = -np.inf
        self._best(np.flatnonzero(np.diff(self.cut)))
        return at, taken


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _branch(lattice: Lattice, paths: list[Paths], key: np.ndarray, number: int, place: np.ndarray, owner: np.ndarray, word0: np.ndarray) -> Paths | None:
    """The next best segmentation of every text that has another one."""
    n = len(key)
    best = np.array([p.best for p in paths])
    source, value = best.argmax(axis=0), best.max(axis=0)
    texts = np.flatnonzero((value > -np.inf) & paths[-1].has)
    if not len(texts):
        return None
    at, taken = np.zeros(len(texts), np.int64), np.full((len(texts), paths[0].taken.shape[1]), -1)
    edge, word, prefix = at.copy(), at.copy(), []
    for m, p in enumerate(paths):
        mine = np.flatnonzero(source[texts] == m)
        at[mine], taken[mine] = p.leave(texts[mine])
        edge[mine], word[mine] = p.edge[at[mine]], p.word[at[mine]]
        start = p.cut[texts[mine]]
        size = at[mine] - start
        every = _ranges(start, size)
        prefix.append((np.repeat(texts[mine], size), p.word[every], p.edge[every]))
        at[mine] -= start
    h = spread(spread(key, 0)[texts], 2 * number)
    node = lattice.node[edge].astype(np.int64)
    first, degree = lattice.edge0[node], lattice.edge0[node + 1] - lattice.edge0[node]
    choice = first[:, None] + np.arange(int(degree.max()))
    open_ = np.arange(choice.shape[1]) < degree[:, None]
    for j in range(taken.shape[1]):
        open_ &= choice != taken[:, j : j + 1]
    some = open_.any(axis=1)
    share = np.where(open_, lattice.p[np.where(open_, choice, 0)], 0.0)
    share = np.cumsum(share, axis=1)
    pick = (share / np.maximum(share[:, -1:], 1e-300) >= unit(spread(h, -2))[:, None]).argmax(axis=1)
    pick = np.where(open_[np.arange(len(texts)), pick], pick, open_.argmax(axis=1))
    has = np.zeros(n, bool)
    has[texts[some]] = True
    # to the end of the word
    now, edge = np.flatnonzero(some), (first + pick)[some]
    parts, offset = prefix, 0
    while True:
        parts.append((texts[now], word[now], edge))
        on = ~lattice.ends[edge]
        if not on.any():
            break
        now, edge = now[on], edge[on]
        node = lattice.node[edge] + lattice.length[edge]
        edge = lattice.draw(node.astype(np.int64), unit(spread(h[now], -3 - at[now] - offset)))
        offset += 1
    later = word[some] + 1
    words, edges = _paths(lattice, spread(spread(key, 0), 2 * number)[owner], place, _ranges(later, word0[texts[some] + 1] - later))
    parts.append((owner[words], words, edges))
    text, word_, edge_ = (np.concatenate([p[c] for p in parts]) for c in range(3))
    keep = has[text]
    order = np.argsort(text[keep].astype(np.uint16) if n < 1 << 16 else text[keep], kind="stable")
    text, word_, edge_ = text[keep][order], word_[keep][order], edge_[keep][order]
    own, every, top = np.zeros(n, np.int64), np.full((n, taken.shape[1]), -1), np.zeros(n)
    own[texts], every[texts], top[texts] = at, taken, value[texts]
    cut = np.append(0, np.cumsum(np.bincount(text, minlength=n)))
    return Paths(lattice, spread(spread(key, 0), 2 * number + 1), has, cut, word_, edge_, top, own, every)


def sample(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int, seed: int) -> list[dict]:
    """For each rank the texts that have so many segmentations: `text`, `log_prob`, `value`, `inclusion`,
    the piece `ids` of all, one after another, and `cut`, where each text's ids start."""
    parts = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    size, n = np.array([len(p) for p in parts], np.int64), len(texts)
    text_start = np.cumsum(size) - size
    key = spread(spread(0, seed), keys)
    lattice = Lattice(points, text_start[size > 0], v)
    owner = np.searchsorted(text_start + size, lattice.start, "right")
    place = lattice.start - text_start[owner]
    word0 = np.searchsorted(owner, np.arange(n + 1))
    word, edge = _paths(lattice, spread(spread(key, 0), 0)[owner], place, np.arange(len(owner)))
    root = -np.log(-np.log(unit(spread(key, -1))))
    nothing = np.full((n, max(1, k)), -1)
    paths = [Paths(lattice, spread(spread(key, 0), 1), np.ones(n, bool), np.searchsorted(word, word0), word, edge, root, np.zeros(n, np.int64), nothing)]
    for number in range(1, k):
        more = _branch(lattice, paths, key, number, place, owner, word0)
        if more is None:
            break
        paths.append(more)
    limit = np.max([p.best for p in paths], axis=0)
    out = []
    for p in paths[:k]:
        text = np.flatnonzero(p.has)
        rate = np.where(limit[text] > -np.inf, np.exp(np.minimum(p.log_prob[text] - limit[text], 700.0)), np.inf)
        ids, cut = _ids(lattice.ids[p.edge], np.append(p.cut[text], p.cut[-1]), v)
        out.append({"text": text, "log_prob": p.log_prob[text], "value": p.top[text], "inclusion": -np.expm1(-rate), "ids": ids, "cut": cut})
    return out


def sample_texts(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int, seed: int) -> list[list[tuple]]:
    """For each text its segmentations: (ids, log_prob, perturbed value, inclusion)."""
    out = [[] for _ in texts]
    for x in sample(texts, keys, v, k, seed):
        for j, r in enumerate(x["text"].tolist()):
            out[r].append((x["ids"][x["cut"][j] : x["cut"][j + 1]], float(x["log_prob"][j]), float(x["value"][j]), float(x["inclusion"][j])))
    return out


def _ids(ids: np.ndarray, cut: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary become their bytes' pieces; `cut` moves along."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, cut
    raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in ids[odd].tolist()]
    times = np.ones(len(ids), np.int64)
    times[odd] = [len(b) for b in raw]
    start = np.cumsum(times) - times
    out = np.repeat(ids, times)
    out[_ranges(start[odd], times[odd])] = v.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.append(start, len(out))[cut]


def decoded(ids: np.ndarray, cut: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of piece ids: bytes put together, the space in front of each dropped."""
    data, ends = pieces(v.bytes, v.offsets[ids], v.lengths[ids]), np.append(0, np.cumsum(v.lengths[ids]))
    offs = ends[cut]
    some = np.diff(offs) > 0
    keep = np.ones(len(data), bool)
    keep[offs[:-1][some]] = False
    return data[keep], offs - np.append(0, np.cumsum(some))


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of piece ids."""
    return decoded(ids, np.array([0, len(ids)]), v)[0].tobytes().decode("utf-8", "replace")


def _strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sample(path: str, alpha: float, k: int, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts, keys = part.column("text").to_pylist(), part.column("key").to_numpy()
                want = [t.replace(MARK, " ").encode() for t in texts]
                for rank, x in enumerate(sample(texts, keys, v, k, seed)):
                    small, cut, n = x["ids"].astype(np.int32), x["cut"], len(x["text"])
                    data, offs = decoded(small, cut, v)
                    whole, raw_ids = data.tobytes(), small.tobytes()
                    same = [whole[a:z] == want[r] for r, a, z in zip(x["text"].tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                    digests = [hashlib.sha256(raw_ids[4 * a : 4 * z]).hexdigest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    named = {"id": part.column("id").take(pa.array(x["text"])), "rank": pa.array(np.full(n, rank, np.int32))}
                    if with_ids:
                        named |= {"ids": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(small)), "decoded": _strings(data, offs)}
                    named |= {"n_pieces": pa.array(np.diff(cut)), "log_prob": pa.array(x["log_prob"]), "perturbed": pa.array(x["value"]), "inclusion": pa.array(x["inclusion"])}
                    named |= {"ids_sha256": pa.array(digests, pa.string()), "round_trip": pa.array(same, pa.bool_())}
                    yield pa.RecordBatch.from_arrays(list(named.values()), list(named))
        release()

    return run


def sample_segmentations(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """Up to `k` rows per row of `docs`, fewer where a text has fewer segmentations: its id, `rank`,
    `ids`, `decoded` (the text of the ids), `n_pieces`, `log_prob`, `perturbed`, `inclusion`, `ids_sha256`
    (of the ids as little-endian int32) and `round_trip` (`decoded` is the text).  `with_ids` = False leaves
    out `ids` and `decoded`.

    Null counts as the empty text, whose one segmentation has no piece and probability 1.  The mark that
    stands for a space decodes to a space.  Rows that repeat an id and its text get the same samples;
    null ids share a key.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = "ids array<int>, decoded string, " * with_ids
    schema = f"id {kind}, rank int, {whole}n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean"
    return rows.mapInArrow(_sample(model_path or default_model(), alpha, k, seed, with_ids), schema).withColumnRenamed("id", id_col)
