"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has an edge for each piece of the vocabulary (and byte pieces for characters it lacks). Pieces start
with blanks or hold none, so the lattice falls into chunks (blanks, then what stands before the next blank) that share no
edge, and the probability of a segmentation is the product over its chunks. Piece probabilities follow the vocabulary's rank
order by Zipf's law; backward sums over a chunk's lattice give each edge's conditional probability.

The k segmentations of largest Gumbel-perturbed log-probability are found by A* search over sets of segmentations: the best of
a set is drawn from the lattice, its perturbed value is the set's bound, and what remains of the set is split by the first
chunk that differs, each part with a truncated Gumbel bound. The set of best bound is opened next, so nothing is opened
that doesn't give a result. Draws are hashes of the row key, the sample and the place, so they don't depend on how rows are dealt out.

The inclusion score of a sample of log-probability p is log(1 - exp(-exp(p - t))), t being the bound of the best set left unopened.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import col, mix, table

BLANK = "▁"
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Vocabulary:
    """Pieces with log-probabilities by rank, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked) + 256)))
        self.logp = {sp.id_to_piece(i): (-math.log(r + 1) - total, i) for r, i in enumerate(ranked)}
        self.byte_logp = -math.log(len(ranked) + 256) - total
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.longest = max(map(len, self.logp))
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.logp):
            raise ValueError("a piece goes on after a blank; chunks are no unit of this vocabulary")
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.of_byte = np.array([self.byte_id[b] for b in range(256)])
        self.bytes = [b""] * len(ids)
        for i in plain:
            self.bytes[i] = sp.id_to_piece(i).replace(BLANK, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)


def chunked(text: str) -> tuple[list[str], str]:
    """(chunks, the character that stands for a BLANK that is in the text itself). A blank is put before the text."""
    if not text:
        return [], ""
    own = ""
    if BLANK in text:
        used = set(text)
        own = next((c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))) if c not in used), None)
        if own is None:
            raise ValueError("a text holds every private character")
        text = text.replace(BLANK, own)
    return _CHUNK.findall(BLANK + text.replace(" ", BLANK)), own


class Trie:
    """The vocabulary's pieces by character, as (node, character) keys in an open hash table: one look steps many strings at once."""

    BITS = 18

    def __init__(self, vocabulary: Vocabulary):
        child: dict[tuple[int, str], int] = {}
        value, logp = [-1], [0.0]
        for piece, (p, i) in vocabulary.logp.items():
            node = 0
            for c in piece:
                if (node, c) not in child:
                    child[node, c] = len(value)
                    value.append(-1)
                    logp.append(0.0)
                node = child[node, c]
            value[node], logp[node] = i, p
        keys = np.array([(n << 21) | ord(c) for n, c in child], np.int64)
        following = np.array(list(child.values()), np.int64)
        while len(keys) > 1 << self.BITS - 2:
            self.BITS += 1
        self.keys, self.next = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, who = np.unique(slot[free], return_index=True)
            self.keys[taken], self.next[taken] = keys[left[free[who]]], following[left[free[who]]]
            rest = np.flatnonzero(self.keys[slot] != keys[left])
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.BITS) - 1)
        self.value, self.logp = np.array(value), np.array(logp)
        self.first = np.full(0x110000, -1, np.int64)  # from the root, by character
        top = keys < 1 << 21
        self.first[keys[top]] = following[top]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).view(np.int64)

    def begin(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """step() from the root."""
        node = self.first[c]
        on = np.flatnonzero(node >= 0)
        return on, node[on]

    def step(self, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which go on, their next nodes)."""
        key = (node << 21) | c
        slot = self.slot(key)
        held = self.keys[slot]
        hit = held == key
        open_ = np.flatnonzero(~hit & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[open_]]
            hit[open_] = held == key[open_]
            open_ = open_[~hit[open_] & (held >= 0)]
        on = np.flatnonzero(hit)
        return on, self.next[slot[on]]


class Lattices:
    """The lattices of many chunks in common arrays. A chunk has a node per character and a last one; edges stand in the
    order of their nodes. cum[e] is the node plus the summed conditional probability of its edges up to e, so one sorted
    search draws an edge for any node."""

    KEPT, SHORT, BLOCK = 1 << 20, 24, 1 << 16  # edges kept, characters of a kept chunk at most, characters built at once

    def __init__(self, vocabulary: Vocabulary, alpha: float = 1.0):
        self.v, self.alpha, self.trie = vocabulary, alpha, Trie(vocabulary)
        self.first: dict[str, int] = {}
        self.passing: list[str] = []
        self.nodes, self.edges = 0, 0  # kept
        self.room = np.zeros(1, np.int64), *(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))

    def known(self, chunks: list[str]) -> list:
        """The first node of each chunk whose lattice is kept, else None."""
        self.forget()
        return list(map(self.first.get, chunks))

    def forget(self) -> None:
        """What passed by is gone."""
        for c in self.passing:
            del self.first[c]
        self.passing = []

    def of(self, kinds: list[str]):
        """((edge, to, id, cum, logq), first node by chunk) of these chunks at least, until the next call. Lattices of short chunks stay for
        later calls while there is room; others are built anew when they come again."""
        self.forget()
        new = list(dict.fromkeys(c for c in kinds if c not in self.first))
        size = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(size > self.SHORT, kind="stable")
        new, size = [new[i] for i in order.tolist()], size[order]
        # blocks of about as many characters, and none of short and long chunks
        block = np.cumsum(size) // self.BLOCK + (size > self.SHORT) * (int(size.sum()) // self.BLOCK + 1)
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(new)).tolist()
        self.passing, parts, nodes, edges = [], [], self.nodes, self.edges
        for at, to in zip(cuts, cuts[1:]):
            (edge, *part), first = self.build(new[at:to])
            self.first.update(zip(new[at:to], (first + nodes).tolist()))
            part[0] += nodes
            part[2] += nodes
            parts.append((edge[1:] + edges, *part))
            nodes, edges = nodes + len(edge) - 1, edges + len(part[0])
            if not self.passing and edges <= self.KEPT and size[to - 1] <= self.SHORT:
                self.nodes, self.edges = nodes, edges
            else:
                self.passing += new[at:to]
        grown = sum(len(p[0]) for p in parts), sum(len(p[1]) for p in parts)
        n, e = had = nodes - grown[0], edges - grown[1]
        room = self.room
        if nodes >= len(room[0]) or edges > len(room[1]):
            more = [nodes + nodes // 2 + 1 - n - 1] + [edges + edges // 2 - e] * 4
            room = tuple(np.concatenate([r[:i], np.zeros(m, r.dtype)]) for r, i, m in zip(room, [n + 1] + [e] * 4, more))
        for edge, *part in parts:
            room[0][n + 1 : n + 1 + len(edge)] = edge
            for r, x in zip(room[1:], part):
                r[e : e + len(x)] = x
            n, e = n + len(edge), e + len(part[0])
        if edges <= 2 * self.KEPT:
            self.room = room
        elif had != (self.nodes, self.edges):  # beyond, what passes by is for this call only
            self.room = room[0][: self.nodes + 1].copy(), *(r[: self.edges].copy() for r in room[1:])
        return (room[0][: nodes + 1], *(r[:edges] for r in room[1:])), self.first

    def build(self, chunks: list[str]):
        """((edge, to, id, cum, logq), first node of each chunk)."""
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last = np.cumsum(lens)  # of each chunk's characters, exclusive
        end = np.repeat(last, lens)
        pos = np.arange(len(text))
        node, frm, to, ids, own = np.zeros(len(text), np.int64), [], [], [], []
        here = pos
        for k in range(1, self.v.longest + 1):
            on, node = self.trie.begin(text) if k == 1 else self.trie.step(node, text[here + k - 1])
            here = here[on]
            found = self.trie.value[node] >= 0
            frm.append(here[found])
            to.append(here[found] + k)
            ids.append(self.trie.value[node[found]])
            own.append(self.trie.logp[node[found]])
            if k == 1:  # a character that is no piece is spelled in bytes
                known = np.zeros(len(text), bool)
                known[here[found]] = True
                spelt = np.flatnonzero(~known)
                size = 1 + (text[spelt] > 0x7F) + (text[spelt] > 0x7FF) + (text[spelt] > 0xFFFF)
                frm.append(spelt)
                to.append(spelt + 1)
                ids.append(-text[spelt])
                own.append(size * self.v.byte_logp)
            more = here + k < end[here]
            here, node = here[more], node[more]
            if not len(here):
                break
        # edges come by length; each goes to its place among those of its node
        taken, ranks = np.zeros(len(text), np.int64), []
        for f in frm:
            ranks.append(taken[f])
            taken[f] += 1
        frm, to, ids, own, rank = (np.concatenate(x) for x in (frm, to, ids, own, ranks))
        order = np.empty(len(frm), np.int64)
        order[(np.cumsum(taken) - taken)[frm] + rank] = np.arange(len(frm))
        frm, to, ids, own = frm[order], to[order], ids[order], own[order] * self.alpha
        # nodes: characters, and one more per chunk behind its last
        chunk = np.repeat(np.arange(len(chunks)), lens)
        n_edges = np.bincount(frm, minlength=len(text))
        first_edge = np.cumsum(n_edges) - n_edges
        far = end - pos
        target = np.where(to == end[frm], len(text), to)  # a chunk's end has the sum of nothing
        by = far[frm]
        by = np.argsort(by.astype(np.uint16) if by.max(initial=0) < 1 << 16 else by, kind="stable")  # short keys: radix sort
        d = far[frm][by]
        cuts = np.flatnonzero(np.diff(d, prepend=-1))
        slices = list(zip(cuts, np.append(cuts[1:], len(by))))
        share = self.shares(frm, target, own, by, slices, len(text))
        logq, run = np.log(share), np.cumsum(share)
        before = np.where(first_edge > 0, run[np.maximum(first_edge - 1, 0)], 0.0)
        number = pos + chunk
        cum = number[frm] + np.minimum(run - before[frm], 1.0)
        cum[first_edge + n_edges - 1] = number + 1.0
        edge = np.zeros(len(text) + len(chunks) + 1, np.int64)
        edge[number + 1] = n_edges
        return (np.cumsum(edge), to + chunk[frm], ids, cum, logq), last - lens + np.arange(len(chunks))


    @staticmethod
    def shares(frm, target, own, by, slices, n: int) -> np.ndarray:
        """The conditional probability of each edge at its node, by backward sums from the last characters of all chunks to the first
        ones; slices of ``by`` are edges at one distance from the end, by node. Sums are plain numbers, logarithms where those run out."""
        p, beta = np.exp(own), np.zeros(n + 1)
        beta[n] = 1.0
        value = np.empty(len(own))
        for i, j in slices:
            e = by[i:j]
            v = value[e] = p[e] * beta[target[e]]
            f = frm[e]
            heads = np.flatnonzero(np.diff(f, prepend=-1))
            beta[f[heads]] = np.add.reduceat(v, heads)
        if value.min(initial=1.0) > 1e-280:
            return value / beta[frm]
        beta[n] = 0.0
        for i, j in slices:
            e = by[i:j]
            v = value[e] = own[e] + beta[target[e]]
            f = frm[e]
            heads = np.flatnonzero(np.diff(f, prepend=-1))
            top = np.maximum.reduceat(v, heads)
            sizes = np.diff(np.append(heads, len(f)))
            beta[f[heads]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes)), heads))
        return np.exp(np.maximum(value - beta[frm], -700.0))  # never none at all: its logarithm is asked for


def uniform(key: np.ndarray, *at) -> np.ndarray:
    """Numbers within (0, 1), fixed by key and place."""
    h = key
    for x in at:
        h = mix(h + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(x).astype(np.uint64) + np.uint64(1)))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def uniform_one(key: int, *at: int) -> float:
    """uniform() of single numbers, without arrays."""
    h, m = key, (1 << 64) - 1
    for x in at:
        h = (h + 0x9E3779B97F4A7C15 * (x + 1)) & m
        h ^= h >> 31
        h = h * 0x7FB5D329728EA185 & m
        h ^= h >> 27
        h = h * 0x81DADEF4BC2DD44D & m
        h ^= h >> 33
    return ((h >> 12) + 0.5) / float(1 << 52)


def truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The maximum of a Gumbel process over a set of log-mass ``mass``, known to be under ``bound``."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


class Draw:
    """Edges drawn for chunks: per chunk its pieces (first, count in .ids) and its log-probability."""

    def __init__(self, arrays, start: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int):
        edge, to, ids, cum, logq = arrays
        n = len(start)
        live = np.argsort(start, kind="stable")  # like chunks together: the searches stay in the same places
        self.logp, steps, now = np.zeros(n), [], start[live]
        salted = mix(key + np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(64) + np.uint64(sample)))
        self.count = np.zeros(n, np.int64)
        while len(live):
            e = np.searchsorted(cum, now + uniform(salted[live], self.count[live]), "left")
            e = np.minimum(e, edge[now + 1] - 1)
            self.logp[live] += logq[e]
            steps.append((live, e))
            self.count[live] += 1
            now = to[e]
            on = edge[now] < edge[now + 1]
            live, now = live[on], now[on]
        self.first = np.cumsum(self.count) - self.count
        self.edges = np.zeros(int(self.count.sum()), np.int64)
        for t, (who, e) in enumerate(steps):
            self.edges[self.first[who] + t] = e


def redraw(arrays, start: int, banned: list[tuple[int, ...]], draw) -> tuple[tuple[int, ...], float] | None:
    """(edges, log-probability) of a segmentation of one chunk that is not banned, in proportion to its probability; None
    if the banned ones are all there are. draw(step): a number within (0, 1)."""
    edge, to, _, _, logq = arrays
    out, node, logp, among = [], start, 0.0, banned
    while edge[node] < edge[node + 1]:
        weights = []
        for e in range(edge[node], edge[node + 1]):
            through = [b for b in among if b[len(out)] == e]
            gone = sum(math.exp(sum(logq[x] for x in b[len(out) + 1 :])) for b in through)
            weights.append(math.exp(logq[e]) * max(0.0, 1 - gone) if gone < 1 - 1e-12 else 0.0)
        total = sum(weights)
        if total <= 0:
            return None
        u, k = draw(len(out)) * total, 0
        while k + 1 < len(weights) and u >= weights[k]:
            u -= weights[k]
            k += 1
        while weights[k] <= 0:  # rounding only
            k -= 1
        e = edge[node] + k
        among = [b for b in among if b[len(out)] == e]
        out.append(int(e))
        logp += float(logq[e])
        node = int(to[e])
    return tuple(out), logp


def sample_group(lattices: Lattices, keys: np.ndarray, chunk_lists: list[list[str]], k: int):
    """For each text of a group a list of (edges, log-probability, perturbed value), best first, and the bound that was left."""
    counts = np.array([len(c) for c in chunk_lists], np.int64)
    chunks = list(chain.from_iterable(chunk_lists))
    if chunks:
        kept = lattices.known(chunks)
        absent = [i for i, x in enumerate(kept) if x is None]
        arrays, first = lattices.of([chunks[i] for i in absent])
        for i in absent:
            kept[i] = first[chunks[i]]
        start = np.array(kept, np.int64)
    else:
        arrays, start = None, np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    begin = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(start)) - begin[doc]
    key, full = keys[doc], np.flatnonzero(counts)
    # texts without chunks have one segmentation, the empty one
    results = [[] if c else [(np.zeros(0, np.int64), 0.0, 0.0)] for c in counts]
    left = np.full(len(counts), -np.inf)
    if not len(full):
        return results, left, arrays
    root = -np.log(-np.log(uniform(keys, 1 << 40)))
    bounds, drawn, logps, edges_of, banned = [], [], [], [], {}

    def best():
        """(round, chunk, bound) of the best unopened set of each text in full."""
        top, which, where = np.full(len(full), -np.inf), np.zeros(len(full), np.int64), np.zeros(len(full), np.int64)
        for r, g in enumerate(bounds):
            m = np.maximum.reduceat(g, begin[full])
            hit = np.flatnonzero(g == np.repeat(m, counts[full]))
            first = hit[np.searchsorted(hit, begin[full])]
            better = m > top
            top, which, where = np.where(better, m, top), np.where(better, r, which), np.where(better, first, where)
        return which, where, top

    for r in range(k):
        if r == 0:
            d = Draw(arrays, start, key, place, r)
            drawn.append(d)
            pick = lambda i, d=d: d.edges[d.first[i] : d.first[i] + d.count[i]]
            logp, fork, value = d.logp, begin[full] - 1, root[full]
            source = None
        else:
            which, where, value = best()
            forked: dict[int, tuple] = {}
            fork = np.where(np.isfinite(value), where, -2)
            for t, (q, i, g) in enumerate(zip(which, where, value)):
                if not np.isfinite(g):
                    continue
                gone = banned.setdefault((int(q), int(i)), [tuple(int(e) for e in edges_of[q](int(i)))])
                salt, here = int(keys[full[t]]), int(place[i])
                got = redraw(arrays, int(start[i]), gone, lambda s, r=r, salt=salt, here=here: uniform_one(salt, here, 1 << 20, r, s))
                if got is None:
                    bounds[q][i], fork[t] = -np.inf, -2
                    continue
                forked[int(i)] = (q, got)
                gone.append(got[0])
                rest = 1 - sum(math.exp(sum(arrays[4][e] for e in b)) for b in gone)
                mass = float(logps[q][begin[full[t]] : i].sum()) + math.log(rest) if rest > 1e-12 else -math.inf
                bounds[q][i] = float(truncated(np.array(mass), np.array(g), np.array(uniform_one(salt, here, 1 << 21, r)))) if mass > -math.inf else -math.inf
            open_ = np.zeros(len(counts), bool)
            open_[full[fork != -2]] = True
            at = np.full(len(counts), -2, np.int64)
            at[full] = fork
            after = np.flatnonzero(open_[doc] & (np.arange(len(start)) > at[doc]))
            d = Draw(arrays, start[after], key[after], place[after], r)
            back = np.full(len(start), -1, np.int64)
            back[after] = np.arange(len(after))
            source = np.full(len(counts), -1, np.int64)
            source[full] = which
            logp = np.full(len(start), -np.inf)
            for q in range(r):
                own = np.flatnonzero(open_[doc] & (source[doc] == q) & (np.arange(len(start)) < at[doc]))
                logp[own] = logps[q][own]
            for i, (_, got) in forked.items():
                logp[i] = got[1]
            logp[after] = d.logp

            def pick(i, d=d, back=back, forked=forked, source=source):
                if i in forked:
                    return np.array(forked[i][1][0], np.int64)
                if back[i] >= 0:
                    j = back[i]
                    return d.edges[d.first[j] : d.first[j] + d.count[j]]
                return edges_of[source[doc[i]]](i)

        logps.append(logp)
        edges_of.append(pick)
        # split what remains of each opened set by the first chunk that differs
        some = np.where(np.isfinite(logp), logp, 0.0)
        run = np.cumsum(some) - some
        before = run - run[begin[full]].repeat(counts[full])
        at = np.full(len(counts), -2, np.int64)
        at[full] = fork
        top = np.full(len(counts), -np.inf)
        top[full] = value
        new = np.flatnonzero((at[doc] != -2) & (np.arange(len(start)) > at[doc]))
        g = np.full(len(start), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.log(-np.expm1(np.minimum(logp[new], 0.0)))
            rest[logp[new] > -1e-12] = -np.inf
            mass = before[new] + rest
            drawn_g = truncated(mass, top[doc[new]], uniform(key[new], place[new], 1 << 22, r))
        g[new] = np.where(np.isfinite(mass), drawn_g, -np.inf)
        bounds.append(g)
        whole = np.add.reduceat(some, begin[full])
        for t, i in enumerate(full):
            if fork[t] == -2:
                results[i].append(None)  # results are found by their round
                continue
            if r == 0:
                a, b = begin[i], ends[i] - 1
                edges = d.edges[d.first[a] : d.first[b] + d.count[b]]
            else:
                cut = int(fork[t])
                old = results[i][int(source[i])][0]
                prefix = int(sum_counts(count_of, int(source[i]), begin[i], cut))
                j0 = back[cut + 1] if cut + 1 < ends[i] else -1
                tail = d.edges[d.first[j0] : d.first[back[ends[i] - 1]] + d.count[back[ends[i] - 1]]] if j0 >= 0 else np.zeros(0, np.int64)
                edges = np.concatenate([old[:prefix], np.array(forked[cut][1][0], np.int64), tail])
            results[i].append((edges, float(whole[t]), float(value[t])))
        if r == 0:
            count_of = [d.count.copy()]
        else:
            c = np.zeros(len(start), np.int64)
            for q in range(r):
                own = np.flatnonzero(open_[doc] & (source[doc] == q) & (np.arange(len(start)) < at[doc]))
                c[own] = count_of[q][own]
            for i, (_, got) in forked.items():
                c[i] = len(got[0])
            c[after] = d.count
            count_of.append(c)
    left[full] = best()[2]
    return [[x for x in found if x] for found in results], left, arrays


def sum_counts(count_of, q, a, b):
    return count_of[q][a:b].sum()


def decode_ids(vocabulary: Vocabulary, ids, block: int = 1 << 18) -> bytes:
    """The text's bytes; the blank before it is taken off."""
    ids, out = np.asarray(ids, np.int64), []
    for i in range(0, len(ids), block):
        some = ids[i : i + block]
        sizes = vocabulary.sizes[some]
        at = np.repeat(vocabulary.starts[some] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        out.append(vocabulary.flat[at].tobytes())
    return b"".join(out)[1:]


def spelled(vocabulary: Vocabulary, ids: np.ndarray, own: str) -> np.ndarray:
    """Piece ids, with characters outside the vocabulary as their bytes. own: stands for a BLANK of the text itself."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    if ids[odd].min() > -0x80:
        ids = ids.copy()
        ids[odd] = vocabulary.of_byte[-ids[odd]]
        return ids
    out: list[int] = []
    for i in ids.tolist():
        if i >= 0:
            out.append(i)
        else:
            c = chr(-i)
            out += [vocabulary.byte_id[b] for b in (BLANK if c == own else c).encode("utf-8", "replace")]
    return np.array(out, np.int64)


_loaded: dict = {}


def lattices(path: str | None, alpha: float) -> Lattices:
    """Kept by worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattices(Vocabulary(path), alpha)
    return _loaded[path, alpha]


def log_inclusion(logp: float, bound: float) -> float:
    x = logp - bound
    if x > 30:
        return 0.0
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(x)))


SAMPLE = "sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, exact boolean"


def sample_encodings(docs: DataFrame, doc_id="doc_id", text="text", k: int = 2, seed: int = 0, model: str | None = None, alpha: float = 1.0, with_ids: bool = True, group: int = 100_000) -> DataFrame:
    """Up to k distinct segmentations per row of docs, best perturbed value first (sample 0), with their ids and whether the
    ids decode to the very text. alpha: exponent of the piece probabilities.

    Null texts are empty, and an empty text has one empty segmentation; a text with fewer than k segmentations gives them
    all, with inclusion score 0 (certain); a null id is a key of its own; repeated rows get equal rows; an empty table gives
    none; other columns are not read. k is 64 at most."""
    if not 0 < k <= 64:
        raise ValueError("k must be within 1 and 64")

    def run(batches):
        import pyarrow as pa

        lat = lattices(model, alpha)
        v = lat.v
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            at = 0
            while at < len(names):
                lists, owns, size, to = [], [], 0, at
                while to < len(names) and (to == at or size < group):
                    c, own = chunked(texts[to])
                    lists.append(c)
                    owns.append(own)
                    size += len(c)
                    to += 1
                keys = np.array([(x if x is not None else -(1 << 63)) & (2**64 - 1) for x in names[at:to]], np.uint64)
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1))
                results, left, arrays = sample_group(lat, keys, lists, k)
                rows: list = []
                for i, (found, bound) in enumerate(zip(results, left)):
                    whole = texts[at + i].encode("utf-8", "replace")
                    for s, (edges, logp, value) in enumerate(found):
                        ids = spelled(v, arrays[2][edges], owns[i]) if len(edges) else np.zeros(0, np.int64)
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        row = (names[at + i], s, len(ids), logp, value, log_inclusion(logp, bound), crc, decode_ids(v, ids) == whole)
                        rows.append((*row, ids) if with_ids else row)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(x.split()[0] for x in SAMPLE.split(", "))] + ["ids"] * with_ids)
                at = to

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SAMPLE}" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, ids="ids", model: str | None = None) -> DataFrame:
    """encoded with a column text, decoded from its ids; null ids give null. A text column that is there is replaced."""
    kept = [f for f in encoded.schema.fields if f.name != "text"]
    at = [f.name for f in kept].index(ids)

    def run(batches):
        import pyarrow as pa

        v = lattices(model, 1.0).v
        for b in batches:
            texts = [None if x is None else decode_ids(v, x).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    return encoded.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string")


def query(spark, sf_dir: str) -> DataFrame:
    return sample_encodings(table(spark, sf_dir, "documents"), with_ids=False)
