"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

The lattice of a text falls apart at word starts: no piece runs on past one, so its nodes are built once for each distinct
word (all positions of a batch at a time, in numpy) and shared.  Backward sums give every edge its conditional
probability.  The best perturbed segmentation follows the edges down; the others come from a best-first search whose agenda
holds, for each node of a found path, the set of edges not yet taken there, with the largest perturbed log-probability
below it: a Gumbel at the log mass of that set, truncated at its parent's.  Popping the largest k times gives k distinct segmentations, an
exact sample without replacement, and the next value on the agenda their inclusion scores.  The texts of a batch are searched
together, a path of each at a time; no number depends on which texts those are.

All random numbers are hashes of (seed, row key, sample, place), so a row's samples depend on nothing else.

The piece vocabulary holds merge ranks, not probabilities: a piece of rank r weighs 1 / (r + SHIFT), Zipf's law.  Code points
without a piece fall back to their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT = 10.0
UNKNOWN = -12.0
SPACE = "▁"
#: Stands for a space mark that is a text's own character: no code point, so no piece matches it and its bytes are taken.
OWN_MARK = 0x110000
#: Texts are taken together up to so many code points.
TOGETHER = 600_000
#: No Gumbel made from 53 random bits exceeds this.
GUMBEL_MOST = 37.0
#: The search looks at so many edges of a path at first, and at twice as many while deeper ones could still win.
FIRST_LOOK = 160
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(" +[^ ]*")
_U = np.uint64
np.seterr(over="ignore", divide="ignore")  # hashes wrap, and a node without another edge has log mass -inf


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_STEPS = [_U(0xD1342543DE82EF95), _U(0x9FB21C651E98DF25), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)]


def uniforms(key, *places) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit keys and places (broadcast against each other)."""
    x = key
    for i, p in enumerate(places):
        x = x + p * _STEPS[i]
        if i < len(places) - 1:
            x ^= x >> _U(29)
    return ((_mixed(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbels(key, *places) -> np.ndarray:
    return -np.log(-np.log(uniforms(key, *places)))


def _points(words: pa.LargeStringArray) -> np.ndarray:
    """The code points of all words, one after the other; a space is the space mark's, a space mark OWN_MARK."""
    low, high = words.offset, words.offset + len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)
    text = bytes(words.buffers()[2][int(offsets[low]) : int(offsets[high])]).decode() if len(words) and words.buffers()[2] else ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    points[points == ord(SPACE)] = OWN_MARK
    points[points == ord(" ")] = ord(SPACE)
    return points


class Vocabulary:
    """The pieces of a SentencePiece model file, their weights, and a hash table of all their beginnings."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: dict[int, int] = {}
        plain, rank = {}, 0
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = int(p[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[p] = i
                rank += 1
        weights = 1.0 / (np.arange(rank) + 1 + SHIFT)
        logs = np.log(weights / weights.sum())
        self.ids, self.plain = plain, set(plain.values())
        self.logs = np.full(n + 1, UNKNOWN)  # the last is for a code point without a piece
        self.logs[list(plain.values())] = logs
        self.longest = max(map(len, plain))
        entries: dict[int, int] = {}
        for p, i in plain.items():
            h = 0
            for at, c in enumerate(p):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if at == len(p) - 1:
                    entries[h] = i
                else:
                    entries.setdefault(h, -1)
        self.bits = max(4, (4 * len(entries)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for h, i in entries.items():
            slot = (h * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = h, i

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a piece's beginning, and the piece's id where it is a whole one (else -1)."""
        slot = ((h * _U(0xD6E8FEB86659FD93)) >> _U(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        known, value = key == h, self.values[slot]
        open_ = np.flatnonzero(~known & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            known[open_[hit]] = True
            value[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return known, np.where(known, value, -1)


@dataclass
class Lattice:
    """Nodes of many words: edges first[q] .. first[q + 1] leave node q; to is a node, or -1 at the end of the word."""

    begin: np.ndarray  # node of each word's first position
    first: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # id, or -1 - code point for a byte fallback
    log: np.ndarray  # conditional log-probability
    upto: np.ndarray  # conditional distribution function

    @staticmethod
    def of(words: pa.LargeStringArray, vocabulary: Vocabulary) -> Lattice:
        """words as they stand in a text, each without one space before it; a space is matched as the space mark.

        Pieces are looked up for all positions of all words at a time, one length after the other.  Nodes are numbered by their
        distance to the end of the word and, within one distance, by word, longest words first: the node d positions from the end
        of word w is base[d] + w, so the backward sums move in slices.
        """
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        size = int(lengths.sum())
        letters = np.full(size + 1, ord(SPACE), np.uint32)
        own = np.ones(size, bool)
        own[starts] = False
        letters[:-1][own] = _points(words)
        del own
        letters = letters.astype(np.uint64) + _U(1)  # code points plus 1

        by_length = np.argsort(-lengths, kind="stable")
        most = int(lengths.max(initial=0))
        # alive[d]: words of at least d positions; base[d]: nodes nearer to the end
        alive = np.searchsorted(-lengths[by_length], -np.arange(most + 1), side="right")
        base = np.concatenate(([0, 0], np.cumsum(alive[1:])))
        rank = np.empty(len(words), np.int64)
        rank[by_length] = np.arange(len(words))
        left = np.repeat(ends, lengths) - np.arange(size)
        node = base[left] + np.repeat(rank, lengths)

        # entries at a position, by length: the position, how many came before there, the piece
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        counted = np.zeros(size, np.int8 if vocabulary.longest < 128 else np.int32)
        at, h = np.arange(size), np.zeros(size, np.uint64)
        for length in range(1, vocabulary.longest + 1):
            h *= _BASE
            h += letters[:-1] if length == 1 else letters[at + (length - 1)]
            known, ids = vocabulary.find(h)
            if length == 1:
                own = letters[:-1].astype(np.int64)  # below 128 a fallback is one byte piece
                ids = np.where(ids >= 0, ids, np.where(own <= 128, vocabulary.byte_ids[np.minimum(own - 1, 127)], -own)).astype(np.int32)
                found.append((at, counted.copy(), ids, 1))
                counted += 1
            else:
                edge = np.flatnonzero(ids >= 0)
                if len(edge):
                    where = at[edge]
                    found.append((where, counted[where], ids[edge], length))
                    counted[where] += 1
            on = np.flatnonzero(known & (left[at] > length))
            at, h = at[on], h[on]
            if not len(at):
                break
        del at, h, letters

        count = np.empty(size, counted.dtype)
        count[node] = counted
        first = np.zeros(size + 1, np.int64)
        np.cumsum(count, out=first[1:])
        to, piece = np.empty(int(first[-1]), np.int64), np.empty(int(first[-1]), np.int32)
        start = first[node]
        following = np.append(node, size)
        following[starts] = size  # only the word before ends there
        while found:
            at, k, ids, length = found.pop()
            slot = start[at] + k
            piece[slot] = ids
            to[slot] = following[at + length]
        begin = node[starts]
        del start, following, node, left, counted

        log = vocabulary.logs[np.maximum(piece, -1)]
        upto = np.empty(len(log))
        beta = np.empty(size + 1)
        beta[size] = 0.0  # the end
        for d in range(1, most + 1):
            low, high = int(base[d]), int(base[d + 1])
            a, b = int(first[low]), int(first[high])
            score, c, s = log[a:b], count[low:high], first[low:high] - a
            score += beta[to[a:b]]
            # a node's first edge is one position long; the others outweigh it by no more than a double holds
            least = score[s]
            odds = np.exp(score - np.repeat(least, c))
            mass = np.add.reduceat(odds, s)
            sums = np.log(mass)
            sums += least
            beta[low:high] = sums
            score -= np.repeat(sums, c)
            np.divide(odds, np.repeat(mass, c), out=upto[a:b])
        to[to == size] = -1
        np.minimum(log, 0.0, out=log)
        some = np.arange(size)
        for k in range(1, int(count.max(initial=0))):
            some = some[count[some] > k]
            slot = first[some] + k
            upto[slot] += upto[slot - 1]
        upto[first[1:] - 1] = 1.0
        return Lattice(begin, first, to, piece, log, upto)

    def walk(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that each uniform number chooses at each node."""
        edge = self.first[node]
        open_ = np.flatnonzero(self.upto[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.upto[edge[open_]] <= u[open_]]
        return edge


@dataclass
class _Found:
    """The s-th segmentation of each text that has one: edges[first[i] : first[i + 1]] is text i's.  looks holds the largest values
    below the edges not taken at its nodes, from depth ``since`` on, for some texts and depths at a time."""

    number: int
    edges: np.ndarray
    log: np.ndarray
    word: np.ndarray | None  # of each edge, in the batch; the last path is left by none
    first: np.ndarray
    value: np.ndarray
    since: np.ndarray
    keys: np.ndarray

    def __post_init__(self) -> None:
        self.length = np.diff(self.first)
        self.seen = self.since.copy()  # looked at up to this depth
        self.total = np.zeros(len(self.since))  # log-probability down to there
        some = np.flatnonzero((self.since > 0) & (self.length > 0))
        self.total[some] = self.down_to(some, self.since[some])
        self.top, self.at = np.full(len(self.since), -np.inf), np.zeros(len(self.since), np.int64)
        self.looks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def down_to(self, some: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return np.array([self.log[a : a + d].sum() for a, d in zip(self.first[some].tolist(), depth.tolist())], np.float64)

    def look(self) -> None:
        """Look deeper where deeper edges could still win: each time at as many edges as before in all."""
        width = FIRST_LOOK
        while len(some := np.flatnonzero((self.seen < self.length) & (self.top < self.total + GUMBEL_MOST))):
            spans = self.seen[some] - self.since[some]
            width = max(FIRST_LOOK, int(spans.min()))
            self._look(some[spans <= width], width)

    def _look(self, some: np.ndarray, width: int) -> None:
        # texts of like length together: no more than half of a block is beyond the ends
        left = np.minimum(self.length[some] - self.seen[some], width)
        while len(some):
            widest = int(left.max())
            now = left * 2 > widest
            self._block(some[now], widest)
            some, left = some[~now], left[~now]

    def _block(self, some: np.ndarray, width: int) -> None:
        low = self.seen[some]
        depth = low[:, None] + np.arange(width)
        inside = depth < self.length[some][:, None]
        # beyond the end an edge of log-probability 0 leaves nothing out
        part = np.where(inside, self.log[np.minimum(self.first[some][:, None] + depth, len(self.log) - 1)], 0.0)
        after = part.copy()
        after[:, 0] += self.total[some]
        np.cumsum(after, axis=1, out=after)
        free = np.log(-np.log(uniforms(_mixed(self.keys[some] + _U(3 + 16 * self.number))[:, None], depth.astype(np.uint64))))
        # minus the Gumbel at the log mass of the edges not taken; infinite where there are none
        free -= after - part
        free -= np.log(np.maximum(-np.expm1(part), 0.0))
        values = -np.logaddexp(-self.value[some][:, None], free)
        self.looks.append((some, low, values))
        self.seen[some] = np.minimum(low + width, self.length[some])
        self.total[some] = after[:, -1]
        self._raise(some, low, values)

    def _raise(self, some: np.ndarray, low: np.ndarray, values: np.ndarray) -> None:
        best = values.argmax(axis=1)
        value = values[np.arange(len(some)), best]
        more = value > self.top[some]
        self.top[some[more]], self.at[some[more]] = value[more], (low + best)[more]

    def put(self, some: np.ndarray, depth: np.ndarray, value: np.ndarray) -> None:
        """Give the looked-at edges at these depths other values (some is in ascending order)."""
        self.top[some] = -np.inf
        for rows, low, values in self.looks:
            place = np.minimum(np.searchsorted(rows, some), len(rows) - 1)
            here = rows[place] == some
            place, own, to, new = place[here], some[here], depth[here], value[here]
            column = to - low[place]
            mine = (column >= 0) & (column < values.shape[1])
            values[place[mine], column[mine]] = new[mine]
            self._raise(own, low[place], values[place])


def _leave(lattice: Lattice, found: list[_Found], parent: np.ndarray, limit: np.ndarray, picked: list[tuple], fresh, starts: np.ndarray, keys: np.ndarray, last: bool) -> _Found:
    """The next path of every text with a finite limit: it leaves the parent at the depth of its largest value by another edge, goes on
    at random to the end of the word, and is the independent sample fresh from there."""
    s, n = len(found), len(keys)
    some = np.flatnonzero(limit > -np.inf)
    chosen = parent[some]
    depth, edge, word = (np.empty(len(some), np.int64) for _ in range(3))
    above = np.empty(len(some))
    for p in found:
        mine = np.flatnonzero(chosen == p.number)
        texts = some[mine]
        depth[mine] = p.at[texts]
        where = p.first[texts] + p.at[texts]
        edge[mine], word[mine] = p.edges[where], p.word[where]
        above[mine] = p.down_to(texts, p.at[texts])
    leaving = np.full(n, -1)
    leaving[some] = depth
    node = np.searchsorted(lattice.first, edge, side="right") - 1
    low, high = lattice.first[node], lattice.first[node + 1]
    ways = low[:, None] + np.arange(int((high - low).max(initial=1)))
    left = (ways < high[:, None]) & (ways != edge[:, None])
    for texts, before, at, pick in picked:
        # an edge taken at the same node before
        taken = np.full(n, -1)
        same = (before == parent[texts]) & (at == leaving[texts])
        taken[texts[same]] = pick[same]
        left &= ways != taken[some][:, None]
    odds = np.where(left, np.exp(lattice.log[np.minimum(ways, len(lattice.log) - 1)]), 0.0)
    run = np.cumsum(odds, axis=1)
    under = (run <= (uniforms(keys[some], _U(4), _U(s)) * run[:, -1])[:, None]) & left
    place = np.minimum(under.sum(axis=1), left.sum(axis=1) - 1)
    column = (left & (np.cumsum(left, axis=1) == (place + 1)[:, None])).argmax(axis=1)
    rows = np.arange(len(some))
    pick = ways[rows, column]
    odds[rows, column] = 0.0
    free = above + np.log(odds.sum(axis=1)) + gumbels(keys[some], _U(5), _U(s))  # -inf where no edge is left
    value = -np.logaddexp(-limit[some], -free)
    for p in found:
        mine = chosen == p.number
        p.put(some[mine], depth[mine], value[mine])
    picked.append((some, chosen, depth, pick))

    middle: list[list[int]] = [[e] for e in pick.tolist()]
    to = lattice.to[pick]
    active, step = np.flatnonzero(to >= 0), 0
    to = to[active]
    while len(active):
        taken = lattice.walk(to, uniforms(keys[some[active]], _U(6), _U(s), _U(step)))
        for i, e in zip(active.tolist(), taken.tolist()):
            middle[i].append(e)
        to = lattice.to[taken]
        on = to >= 0
        active, to, step = active[on], to[on], step + 1
    edges, logs, first = fresh
    size = np.zeros(n, np.int64)
    parts: list[tuple[list, list, list]] = []
    tails, ends = first[word + 1].tolist(), first[starts[some + 1]].tolist()
    for i, (text, p, d, w) in enumerate(zip(some.tolist(), chosen.tolist(), depth.tolist(), word.tolist())):
        p = found[p]
        a, m = int(p.first[text]), np.array(middle[i], np.int64)
        parts.append(([p.edges[a : a + d], m, edges[tails[i] : ends[i]]], [p.log[a : a + d], lattice.log[m], logs[tails[i] : ends[i]]], [] if last else [p.word[a : a + d], np.full(len(m), w, np.int32)]))
        size[text] = d + len(m) + ends[i] - tails[i]
        if not last:
            lengths = np.diff(first[w + 1 : starts[text + 1] + 1])
            parts[-1][2].append(np.repeat(np.arange(w + 1, starts[text + 1], dtype=np.int32), lengths))
    del edges, logs, fresh
    together = [np.concatenate([x for part in parts for x in part[c]] or [np.zeros(0, np.int64)]) for c in range(2 if last else 3)]
    since, top = np.zeros(n, np.int64), np.full(n, -np.inf)
    since[some], top[some] = depth + 1, limit[some]
    return _Found(s, together[0], together[1], None if last else together[2], np.concatenate(([0], np.cumsum(size))), top, since, keys)


class Sampler:
    """Samples segmentations of texts and decodes them; it holds nothing but the vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def sample(self, texts: list[str | None], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text, up to k distinct segmentations in falling order of their perturbed log-probability: (ids,
        log-probability, perturbed, log inclusion).  There are fewer only where the text has fewer segmentations."""
        out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
        row, _, ids, first, *rest = self.sample_together(texts, keys, k)
        for j, (i, *x) in enumerate(zip(row.tolist(), *(c.tolist() for c in rest))):
            out[i].append((ids[first[j] : first[j + 1]], *x))
        return out

    def sample_together(self, texts: list[str | None], keys: list[int], k: int) -> tuple[np.ndarray, ...]:
        """The same as columns, by text and sample: the text's place, sample, ids of all rows, where each row's begin (and the last
        ends), log-probability, perturbed, log inclusion."""
        split = self._words(texts)
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        lattice = Lattice.of(coded.dictionary, self.vocabulary)
        del split, coded
        begin = lattice.begin[index]
        starts = np.concatenate(([0], np.cumsum(counts)))
        seeds = np.array(keys, np.uint64)
        seed = np.repeat(seeds, counts)
        place = (np.arange(len(index)) - np.repeat(starts[:-1], counts)).astype(np.uint64)
        found: list[_Found] = []
        picked: list[tuple] = []
        n = len(texts)
        parent, limit = np.zeros(n, np.int64), np.full(n, -np.inf)
        for s in range(k):
            edges, log, first = self._fresh(lattice, begin, seed, place, s)
            if s == 0:
                word = np.repeat(np.arange(len(index), dtype=np.int32), np.diff(first)) if k > 1 else None
                found.append(_Found(0, edges, log, word, first[starts], gumbels(seeds, _U(1)), np.zeros(n, np.int64), seeds))
                del word
            else:
                found.append(_leave(lattice, found, parent, limit, picked, (edges, log, first), starts, seeds, s == k - 1))
            del edges, log, first
            for p in found:
                p.look()
            tops = np.array([p.top for p in found])
            parent, limit = tops.argmax(axis=0), tops.max(axis=0)
        del index, begin, seed, place, p
        # an empty text has one segmentation, the empty one; a path is there if its value is
        there = np.array([p.value > -np.inf for p in found])
        row, sample = np.nonzero(there.T)
        value = np.array([p.value for p in found]).T[row, sample]
        sums, sizes = np.zeros((k, n)), np.array([p.length for p in found])
        for s, p in enumerate(found):
            some = np.flatnonzero(p.length)
            if len(some):
                sums[s, some] = np.add.reduceat(p.log, p.first[some])
        del p
        total = sums.T[row, sample]
        x = total - limit[row]  # inclusion: 1 - exp(-exp(x))
        inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50.0)))))
        inclusion[limit[row] == -np.inf] = 0.0
        bounds = [p.first.tolist() for p in found]
        edges = [p.edges for p in found]
        found.clear()
        pieces = [lattice.piece[edges[s][bounds[s][i] : bounds[s][i + 1]]] for i, s in zip(row.tolist(), sample.tolist())]
        del edges, lattice
        pieces = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        ids, first = self._ids(pieces, np.concatenate(([0], np.cumsum(sizes.T[row, sample]))))
        return row, sample, ids, first, total, value, inclusion

    @staticmethod
    def _words(texts: list[str | None]) -> pa.Array:
        """The words of each text, each with all spaces before it but one; null for a text that is null or empty."""
        plain = lambda t: "  " not in t and t[0] != " " and t[-1] != " "
        if any(t and "\0" in t for t in texts):
            return pa.array([[c[1:] for c in _RUNS.findall(" " + t)] if t else None for t in texts], pa.large_list(pa.large_string()))
        apart = [(t.replace(" ", "\0") if plain(t) else "\0".join([c[1:] for c in _RUNS.findall(" " + t)])) if t else None for t in texts]
        return pc.split_pattern(pa.array(apart, pa.large_string()), "\0")

    @staticmethod
    def _fresh(lattice: Lattice, begin: np.ndarray, seed: np.ndarray, place: np.ndarray, s: int):
        """An independent sample of every word: its edges, their logs, and where each word's begin."""
        seed = _mixed(seed + _U(7 + 16 * s) + place * _STEPS[1])
        active, node, step = np.arange(len(begin)), begin, 0
        length = np.zeros(len(begin), np.int64)
        parts = []
        while len(active):
            edge = lattice.walk(node, uniforms(seed, _U(step)))
            parts.append((active, edge))
            to = lattice.to[edge]
            on = np.flatnonzero(to >= 0)
            length[active] = step + 1
            active, node, seed, step = active[on], to[on], seed[on], step + 1
        first = np.concatenate(([0], np.cumsum(length)))
        edges = np.empty(int(first[-1]), np.int64)
        for step, (active, edge) in enumerate(parts):
            edges[first[active] + step] = edge
        return edges, lattice.log[edges], first

    def _ids(self, pieces: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pieces of rows that begin at first, with the bytes of each code point that has no piece, and where rows begin then."""
        bare = np.flatnonzero(pieces < 0)
        if not len(bare):
            return pieces, first
        own, which = np.unique(-1 - pieces[bare], return_inverse=True)
        coded = [(SPACE if c == OWN_MARK else chr(c)).encode() for c in own.tolist()]
        width = np.array([len(c) for c in coded])
        size = np.ones(len(pieces), np.int64)
        size[bare] = width[which]
        begin = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(pieces, size)
        table = self.vocabulary.byte_ids[np.frombuffer(b"".join(c.ljust(4, b"\0") for c in coded), np.uint8).reshape(-1, 4)]
        for b in range(4):
            more = np.flatnonzero(width[which] > b)
            out[begin[bare[more]] + b] = table[which[more], b]
        return out, begin[first]

    def decode(self, ids) -> str:
        """The text of a segmentation, exactly: the first space mark is the encoder's own."""
        v, out = self.vocabulary, []
        for i in ids:
            i = int(i)
            out.append(bytes([v.bytes_of[i]]) if i in v.bytes_of else v.pieces[i].replace(SPACE, " ").encode())
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_held: dict[str, Sampler] = {}


def sampler(path: str) -> Sampler:
    """The worker's sampler for a model file, made once."""
    if path not in _held:
        _held[path] = Sampler(Vocabulary(path))
    return _held[path]


def row_key(value, seed: int) -> int:
    return xxhash.xxh3_64_intdigest("\0" if value is None else str(value), seed)


def _sample_batches(path: str, k: int, seed: int):
    names = ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            low, size, taken = 0, 0, []
            for at in range(len(ids) + 1):
                if at == len(ids) or size >= TOGETHER:
                    if taken:
                        row, sample, values, offsets, *rest = own.sample_together(taken, [row_key(i, seed) for i in ids[low:at]], k)
                        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[low:at], pa.int64()).take(pa.array(row)), pa.array(sample, pa.int32()), lists, *map(pa.array, rest)], names)
                        del row, sample, values, offsets, lists, rest
                    low, size, taken = at, 0, []
                if at < len(ids):
                    text = texts[at].as_py() or ""
                    taken.append(text)
                    size += len(text)

    return run


def sample_pieces(docs: DataFrame, k: int = 2, seed: int = 23, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows per input row: doc_id, sample (0 is the largest perturbed), ids, log_prob (of the segmentation given the
    text), perturbed (log_prob plus its Gumbel), log_inclusion (log of the chance that the sample holds it, given the threshold).

    Whole texts are encoded.  A null or empty text has one segmentation, the empty one; a text with fewer than k segmentations gives
    all of them.  Rows of one id share their random numbers (so do rows with a null id), repeated rows give equal samples, and an
    empty table gives no rows.  A U+2581 in a text is encoded by its bytes, so decoding gives every text back.  Memory grows with the
    longest text.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    return rows.mapInArrow(_sample_batches(model, k, seed), "doc_id bigint, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double")


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """encoded with ``text``, the decoded ids_col; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model)
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col))
            yield batch.append_column("text", pa.array([None if x.as_py() is None else own.decode(x.as_py()) for x in ids], pa.string()))

    own_columns(encoded, ids=ids_col)
    return encoded.drop("text").mapInArrow(run, encoded.drop("text").schema.add("text", "string"))
