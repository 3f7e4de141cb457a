"""Sampled segmentations without replacement: Gumbel top-k by a perturbed A-star search over the piece lattice.

A text's lattice has a node at each character and an edge for each piece of the vocabulary (a character that is no
piece is a chain of its bytes). A piece of rank r has log probability -temperature * log(r + 1); backward sums turn these
into probabilities of the edges out of a node, so that a path's product is its probability among all segmentations of
the text. The search pops the group of paths with the largest Gumbel value, walks from the node where the group
leaves its parent to the end, and pushes all that branches off on the way as one group; where that is popped, it gives off the
branch at one place, chosen by mass, and stays for the others. A group's value is the exact maximum of its
leaves, a Gumbel at the group's log mass cut off at the parent's value. Leaves thus come out as a sample of k distinct
segmentations without replacement, largest value first. The value of the (k+1)-th group is the threshold of the
inclusion score, log(1 - exp(-exp(log_prob - threshold))); where all segmentations were emitted it is 0.

No piece crosses the start of a run of spaces or joins characters of different families (such as letters and commas), so
the lattice is a chain of small lattices, kept for each distinct chunk. Random numbers are hashes of (seed, row key, sample, place),
so a lost partition gives the same rows again. There is no shuffle.

Defined results: a null text counts as an empty one; an empty text has one segmentation, without pieces; texts of any
length are segmented whole; equal rows get equal samples; a null key is a key of its own; an empty table gives an empty
result; a text with fewer than k segmentations gives them all; ranks are unique; other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexgrove.llm.common import slices, table

SAMPLES = 4
TEMPERATURE = 1.0
SEED = 20
#: Characters that are segmented at once, and characters of the chunks kept by a worker.
SLAB, MEMO = 300_000, 1_600_000
SPACE = "▁"
#: Stands for a space mark that is part of the text itself; no valid text holds this code point.
_LITERAL = "\udfff"
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = 2**64 - 1
#: Random numbers of walks are 62 bits; the last rung is above them all.
_LEFT, _TOP = np.uint64(2), np.uint64(2**62)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers inside (0, 1) of mixed bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _one_unit(x: int) -> float:
    """_unit(_mix(x)) of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return (((x ^ (x >> 31)) >> 12) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces with log probabilities by rank, and the bytes as the last resort."""

    def __init__(self, pieces: list[str], byte_ids: list[int], first: int, temperature: float = TEMPERATURE) -> None:
        """pieces[i] has the id first + i and the rank i; byte_ids are the ids of the 256 bytes."""
        self.pieces, self.byte_ids, self.first = pieces, byte_ids, first
        self.weights = {p: (i + 1) ** -temperature for i, p in enumerate(pieces)}
        self.ids = {p: first + i for i, p in enumerate(pieces)}
        self.byte_weight = (len(pieces) + 1) ** -temperature
        self._plant()
        self.chunk = re.compile(self._chunk_pattern())
        of = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        kept = [of.get(i, b"") for i in range(max(of, default=-1) + 1)]
        self.bytes = np.frombuffer(b"".join(kept), np.uint8)
        self.sizes = np.array([len(x) for x in kept], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _chunk_pattern(self) -> str:
        """Space marks and then a run of characters that pieces may join; no piece reaches over a chunk's end."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces):
            return r"[\s\S]+"
        kin: dict[str, str] = {}

        def root(c: str) -> str:
            while kin.setdefault(c, c) != c:
                c = kin[c]
            return c

        for piece in self.pieces:
            for x, y in pairwise(piece.lstrip(SPACE)):
                kin[root(x)] = root(y)
        families: dict[str, list[str]] = {}
        for c in list(kin):
            families.setdefault(root(c), []).append(c)
        runs = [f"{SPACE}*[{''.join(map(re.escape, sorted(f)))}]+" for f in sorted(families.values(), key=len, reverse=True)]
        return "|".join([*runs, f"{SPACE}*[^{SPACE}]", f"{SPACE}+"])

    @classmethod
    def load(cls, model: str | None = None, temperature: float = TEMPERATURE) -> Vocabulary:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.vocab_size()
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        first = byte_ids[-1] + 1
        return cls([sp.id_to_piece(i) for i in range(first, n)], byte_ids, first, temperature)

    def marked(self, text: str) -> str:
        return SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE) if text else ""

    def _plant(self) -> None:
        """The pieces as a trie: sorted keys state << 21 | character, the state each leads to, and the states' pieces."""
        step: dict[int, int] = {}
        ends = {0: -1}
        for n, piece in enumerate(self.pieces):
            state = 0
            for c in piece:
                state = step.setdefault(state << 21 | ord(c), len(step) + 1)
                ends.setdefault(state, -1)
            ends[state] = n
        self.keys = np.array(sorted(step), np.int64)
        self.leads = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array([ends[i] for i in range(len(step) + 1)], np.int64)
        self.log_weight = np.log([self.weights[p] for p in self.pieces])
        #: The state that each character leads to from the root; -1 where no piece starts with it.
        self.heads = np.full(0x110000, -1, np.int32)
        top = self.keys >> 21 == 0
        self.heads[self.keys[top]] = self.leads[top]

    def lattices(self, chunks: list[str], base: int) -> tuple[np.ndarray, ...]:
        """Degrees of the nodes, and ids, targets and probabilities of the edges, of all the chunks at once.

        Nodes are the characters, from `base` on, then the bytes after the first one of a character, which have one edge
        each; the end of a chunk is the target -1.
        """
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes, total = np.array([len(c) for c in chunks], np.int64), len(code)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # characters up to the chunk's end
        at, state, length, single = np.arange(total), np.zeros(total, np.int64), 1, np.zeros(total, bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            if length == 1:
                state = self.heads[code]
                hit = state >= 0
                at, state = at[hit], state[hit].astype(np.int64)
            else:
                key = state << 21 | code[at + length - 1]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[i] == key
                at, state = at[hit], self.leads[i[hit]]
            piece = self.ends[state]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
            if length == 1:
                single[at[whole]] = True
            more = left[at] > length
            at, state, length = at[more], state[more], length + 1
        lone = np.flatnonzero(~single)
        raws = [(SPACE if c == _LITERAL else c).encode() for c in map(chr, code[lone].tolist())]
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
        source, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        log = np.where(piece >= 0, self.log_weight[piece], 0.0)
        log[len(log) - len(lone) :] = math.log(self.byte_weight) * np.array([len(r) for r in raws], float)
        ids = np.where(piece >= 0, self.first + piece, 0)
        ids[len(ids) - len(lone) :] = [self.byte_ids[r[0]] for r in raws]
        is_end = left[source] == length
        target = np.where(is_end, -1, base + source + length)
        extra_ids, extra_targets = [], []
        for e, raw in zip(range(len(ids) - len(lone), len(ids)), raws, strict=True):
            for b in raw[:0:-1]:
                extra_ids.append(self.byte_ids[b])
                extra_targets.append(int(target[e]))
                target[e] = base + total + len(extra_ids) - 1
        # backward sums, for all nodes with one character left, then with two, and so on
        order = np.lexsort((source, left[source]))
        log, source, ids, target, length, is_end = log[order], source[order], ids[order], target[order], length[order], is_end[order]
        heads = np.flatnonzero(np.diff(source, prepend=-1))
        rows = np.flatnonzero(np.diff(left[source[heads]], prepend=0))
        below, limits = np.zeros(total + 1), [*heads[rows].tolist(), len(source)]
        after = np.where(is_end, total, source + length)
        for a, b, h in zip(limits[:-1], limits[1:], np.split(heads, rows[1:]), strict=True):
            v = log[a:b] + below[after[a:b]]
            peak, many = np.maximum.reduceat(v, h - a), np.diff(h, append=b)
            v = np.exp(v - np.repeat(peak, many))
            sums = np.add.reduceat(v, h - a)
            below[source[h]] = peak + np.log(sums)
            log[a:b] = v / np.repeat(sums, many)
        order = np.argsort(source + (1.0 - log), kind="stable")  # of a node's edges the likeliest first
        degrees = np.concatenate([np.bincount(source, minlength=total), np.ones(len(extra_ids), np.int64)])
        join = lambda x, y: np.concatenate([x[order], np.array(y, x.dtype)])
        return degrees, join(ids, extra_ids), join(target, extra_targets), join(log, [1.0] * len(extra_ids))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, many: list[np.ndarray]) -> list[str]:
        """The texts that arrays of ids stand for; their pieces' bytes are gathered at once."""
        ids = np.concatenate(many)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.bytes[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())].tobytes()
        stops = np.r_[0, ends][np.cumsum([len(x) for x in many])].tolist()
        return [data[a + 1 : b].decode() for a, b in zip([0, *stops], stops, strict=False)]


class _Roots(dict):
    """The first node of each chunk; a new chunk gets the next nodes of its table."""

    def __init__(self, table: _Table) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, chunk: str) -> int:
        node = self[chunk] = self.table.add(chunk)
        return node


class _Table:
    """The lattices of the chunks met so far, joined: start[n] to start[n + 1] are the edges of node n.

    An edge has an id, a target node (-1: the end of the chunk), a log probability and a rung: the sum of the probabilities
    of its node's edges up to it as a share of _TOP, the likeliest edge first. To draw an edge, walks climb the rungs until one is above their
    random number, most of them one rung.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.root, self.held, self.nodes, self.edges, self.fresh = vocabulary, _Roots(self), 0, 0, 0, 0
        self.new: list[str] = []
        self.buffers = {n: np.zeros(1 << 16, t) for n, t in (("start", np.int32), ("ids", np.uint32), ("target", np.int32), ("logs", float), ("rung", np.uint64))}

    def close(self) -> None:
        """Lets go of all arrays now; the table and its roots refer to each other."""
        self.buffers.clear()
        self.root.clear()
        self.root.table = None

    def add(self, chunk: str) -> int:
        self.new.append(chunk)
        self.fresh += len(chunk)
        return self.nodes + self.fresh - len(chunk)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        buffer = self.buffers[name]
        if at + len(values) > len(buffer):
            self.buffers[name] = np.concatenate([buffer[:at], np.zeros(at // 4 + len(values), buffer.dtype)])
        self.buffers[name][at : at + len(values)] = values

    def flush(self) -> None:
        """Joins the new chunks to the arrays."""
        if not self.new:
            return
        degrees, ids, targets, shares = self.vocabulary.lattices(self.new, self.nodes)
        ends = np.cumsum(degrees)
        before = np.concatenate([[0.0], np.cumsum(shares)])
        sums = before[1:] - np.repeat(before[ends - degrees], degrees)
        sums[ends - 1] = 1.0
        self._put("start", self.nodes + 1, self.edges + ends)
        self._put("ids", self.edges, ids)
        self._put("target", self.edges, targets)
        self._put("logs", self.edges, np.log(np.maximum(shares, 1e-300)))
        rungs = (np.minimum(sums, 1.0) * float(_TOP)).astype(np.uint64)
        rungs[ends - 1] = _TOP
        self._put("rung", self.edges, rungs)
        self.held += self.fresh
        self.nodes, self.edges, self.new, self.fresh = self.nodes + len(degrees), self.edges + len(shares), [], 0


class _Slab:
    """Some texts as chains of chunks in the table, and k free walks through each chunk of them."""

    def __init__(self, table: _Table, texts: list[str], keys: np.ndarray, k: int) -> None:
        chunks, bounds, split, node_of = [], [0], table.vocabulary.chunk.findall, table.root.__getitem__
        for text in texts:
            chunks += map(node_of, split(text))
            bounds.append(len(chunks))
        table.flush()
        self.k, self.bounds, occ = k, np.array(bounds), np.array(chunks, np.int32)
        self.start = table.buffers["start"][: table.nodes + 1]
        self.ids, self.target, self.logs, self.rung = (table.buffers[n][: table.edges] for n in ("ids", "target", "logs", "rung"))
        self.key = keys
        counts, many = np.diff(self.bounds), len(occ) * k
        place = np.arange(1, len(occ) + 1, dtype=np.uint64) - np.repeat(self.bounds[:-1], counts).astype(np.uint64)
        base = _mix(np.repeat(keys, counts) + _GOLD * place)
        walk = np.concatenate([base + np.uint64((977 + (j << 32)) * int(_GOLD) & _MASK) for j in range(k)])
        node, active, edges, owners = np.tile(occ, k), None, [], []  # active: which walks go on; all of them at first
        lengths = np.ones(many, np.int32)
        while len(node):
            at = self.start[node]
            rung = self.rung[at]
            climb = np.flatnonzero(rung != _TOP)
            u = walk[climb] if active is None else walk[active[climb]] + np.uint64(len(edges) * int(_GOLD) & _MASK)
            u = _mix(u) >> _LEFT
            up = u >= rung[climb]
            while len(climb := climb[up]):
                at[climb] += 1
                u = u[up]
                up = u >= self.rung[at[climb]]
            if active is not None:
                lengths[active] += 1
            edges.append(at)
            owners.append(active)
            node = self.target[at]
            live = np.flatnonzero(node >= 0)
            node, active = node[live], live.astype(np.int32) if active is None else active[live]
        #: The walks end to end: sample 0 of all chunks, then sample 1; first[w] is the place of a walk's first edge.
        self.first = np.zeros(many + 1, np.int64)
        np.cumsum(lengths, out=self.first[1:])
        self.edge = np.zeros(self.first[-1], np.int32)
        for t, (at, own) in enumerate(zip(edges, owners, strict=True)):
            self.edge[self.first[:-1] if own is None else self.first[own] + t] = at


class Sampler:
    """Samples of one worker; keeps the lattices of the chunks it has met, and begins anew above MEMO characters."""

    def __init__(self, vocabulary: Vocabulary, k: int = SAMPLES, seed: int = SEED) -> None:
        self.table, self.k, self.seed = _Table(vocabulary), k, seed

    def key(self, row: object) -> int:
        return int(_mix(np.array([zlib.crc32(repr(row).encode()) << 32 | (zlib.crc32(repr(row)[::-1].encode()) ^ self.seed) & 0xFFFFFFFF], np.uint64))[0])

    def sample(self, keys: list[object], texts: list[str]) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples: ids, log probability, Gumbel value, log inclusion score."""
        marked, at = [self.table.vocabulary.marked(t) for t in texts], 0
        while at < len(marked):
            end, size = at, 0
            while end < len(marked) and (end == at or size + len(marked[end]) <= SLAB):
                size += len(marked[end])
                end += 1
            if self.table.held > MEMO:
                vocabulary = self.table.vocabulary
                self.table.close()
                self.table = _Table(vocabulary)
            slab = _Slab(self.table, marked[at:end], np.array([self.key(r) for r in keys[at:end]], np.uint64), self.k)
            for d in range(end - at):
                yield self._search(slab, d)
            at = end

    def _search(self, slab: _Slab, d: int) -> list[tuple[np.ndarray, float, float, float]]:
        low, high = int(slab.bounds[d]), int(slab.bounds[d + 1])
        total, tick = int(slab.bounds[-1]), [0]
        edge, logs, first = slab.edge, slab.logs, slab.first
        whole = int(slab.key[d])
        scaled = whole * 0xBF58476D1CE4E5B9 & _MASK

        def draw() -> float:
            tick[0] += 1
            return _one_unit(scaled + 0x9E3779B97F4A7C15 * tick[0] & _MASK)

        def cut(mass: float, limit: float) -> float:
            return mass - math.log(math.exp(mass - limit) - math.log(draw()))

        heap: list[tuple] = []  # (-value, order, run, group): what branches off a free walk, or a single group
        runs: list[tuple] = []
        found: list[tuple[list[np.ndarray], float, float]] = []

        def walk_freely(parts: list[np.ndarray], log: float, chunk: int, value: float) -> None:
            """Completes a path with the free walk through the chunks from `chunk` on and adds what branches off."""
            j = len(found)
            a, b = int(first[j * total + chunk]), int(first[j * total + high])
            steps = edge[a:b]
            fall = np.zeros(len(steps) + 1)
            np.cumsum(-logs[steps], out=fall[1:])
            found.append(([*parts, steps], log - float(fall[-1]), value))
            runs.append((log, fall, parts, steps, j, a, []))
            push_run(len(runs) - 1, value)

        def push_run(r: int, limit: float) -> None:
            """The branches of a walk that weren't popped yet, as one group; their shares are drops of exp(-fall)."""
            log, fall, *_, gone = runs[r]
            share = -math.expm1(-fall[-1]) - math.fsum(w for _, w in gone)
            if share > 1e-15:
                heapq.heappush(heap, (-cut(log + math.log(share), limit), len(heap) + 1000 * tick[0], r, None))

        def place_of(r: int) -> int:
            """A place of the walk, by the mass of what branches off there."""
            _, fall, *_, gone = runs[r]
            u = draw() * (-math.expm1(-fall[-1]) - math.fsum(w for _, w in gone))
            for i, w in sorted(gone):
                if u < -math.expm1(-fall[i]):
                    break
                u += w
            i = int(np.searchsorted(fall[1:], -math.log1p(-min(u, 1 - 2.0**-53)), "right"))
            i = min(i, len(fall) - 2)
            if fall[i] == fall[i + 1] or any(i == x for x, _ in gone):  # by rounding, a place without branches
                left = np.exp(-fall[:-1]) - np.exp(-fall[1:])
                left[[x for x, _ in gone]] = 0
                i = int(left.argmax())
            gone.append((i, math.exp(-fall[i]) - math.exp(-fall[i + 1])))
            return i

        def push_one(parts: list[np.ndarray], log: float, chunk: int, node: int, used: tuple[int, ...], limit: float) -> None:
            x, y = int(slab.start[node]), int(slab.start[node + 1])
            if y - x > len(used):
                left = [e for e in range(x, y) if e not in used]
                mass = log + math.log(math.fsum(map(math.exp, logs[left].tolist())))
                heapq.heappush(heap, (-cut(mass, limit), len(heap) + 1000 * tick[0], -1, (parts, log, chunk, node, left)))

        walk_freely([], 0.0, low, -math.log(-math.log(draw())))
        while heap and len(found) < self.k:
            value, _, r, group = heapq.heappop(heap)
            value = -value
            if group is None:
                i = place_of(r)
                push_run(r, value)
                log, fall, parts, steps, j, a, _ = runs[r]
                chunk = int(np.searchsorted(first, a + i, "right")) - 1 - j * total
                node = int(np.searchsorted(slab.start, steps[i], "right")) - 1
                parts, log = [*parts, steps[:i]], log - float(fall[i])
                left = [e for e in range(int(slab.start[node]), int(slab.start[node + 1])) if e != steps[i]]
            else:
                parts, log, chunk, node, left = group
            weights = list(map(math.exp, logs[left].tolist()))
            u, pick = draw() * math.fsum(weights), 0
            while pick < len(left) - 1 and u > weights[pick]:
                u -= weights[pick]
                pick += 1
            chosen = left[pick]
            every = range(int(slab.start[node]), int(slab.start[node + 1]))
            push_one(parts, log, chunk, node, (*(e for e in every if e not in left), chosen), value)
            path, log = [chosen], log + float(logs[chosen])
            node = int(slab.target[chosen])
            while node >= 0:  # the rest of this chunk
                a, b = int(slab.start[node]), int(slab.start[node + 1])
                e = min(a + int(np.searchsorted(slab.rung[a:b], np.uint64(draw() * float(_TOP)), "right")), b - 1)
                push_one([*parts, np.array(path)], log, chunk, node, (e,), value)
                path.append(e)
                log += float(logs[e])
                node = int(slab.target[e])
            walk_freely([*parts, np.array(path)], log, chunk + 1, value)
        threshold = -heap[0][0] if heap else -math.inf
        out = []
        for parts, log, value in found:
            z = log - threshold
            inclusion = 0.0 if z > 50 else z if z < -30 else math.log(-math.expm1(-math.exp(z)))
            out.append((slab.ids[np.concatenate(parts)] if parts else np.zeros(0, np.uint32), log, value, inclusion))
        return out


@lru_cache(maxsize=2)
def worker_sampler(model: str | None, temperature: float, k: int, seed: int) -> Sampler:
    """One for each worker, whose tasks follow each other; what it keeps changes no sample."""
    sampler = Sampler(Vocabulary.load(model, temperature), k, seed)
    gc.freeze()  # the vocabulary stays; a search makes many short-lived tuples and no cycles
    gc.set_threshold(100_000, 20, 100)
    return sampler


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, temperature: float = TEMPERATURE, seed: int = SEED, model: str | None = None, decode: bool = False) -> DataFrame:
    """Rows (doc_id, rank from 1, ids, log_prob, perturbed, log_inclusion); ids are little-endian unsigned 32-bit numbers. With
    decode, `decoded` too: the text that the ids stand for, by the same worker."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = {"rank": T.IntegerType(), "ids": T.BinaryType(), "log_prob": T.DoubleType(), "perturbed": T.DoubleType(), "log_inclusion": T.DoubleType()} | ({"decoded": T.StringType()} if decode else {})
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in names.items())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = worker_sampler(model, temperature, k, seed)
        vocabulary = sampler.table.vocabulary
        for whole in batches:
            for part in slices(whole, SLAB):
                rows: list[tuple] = []
                for row, samples in enumerate(sampler.sample(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    rows += [(row, n, *s) for n, s in enumerate(samples, 1)]
                columns = list(zip(*rows, strict=True))
                if decode:
                    columns.append(vocabulary.decode_all(list(columns[2])))
                columns[2] = [x.astype("<u4", copy=False).tobytes() for x in columns[2]]
                ids = part.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.record_batch([ids, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True))], schema=pa.schema([pa.field("doc_id", ids.type), *list(arrow)[1:]]))

    return source.mapInArrow(run, schema)


def decode_pieces(ids: Column, model: str | None = None) -> Column:
    """The text of a column of ids as sample_segmentations gives them; null for null."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary.load(model)
        for batch in batches:
            texts = vocabulary.decode_all([np.frombuffer(x or b"", "<u4") for x in batch]) if len(batch) else []
            yield pd.Series([None if x is None else t for x, t in zip(batch, texts, strict=True)], dtype=object)

    return decoded(ids)


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of every document: counts and digests of the ids and of the text they decode to."""
    samples = sample_segmentations(table(spark, sf_dir, "documents"), decode=True)
    digests = (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("decoded", "UTF-8")).alias("text_crc32")
    return samples.select("doc_id", "rank", *digests, "log_prob", "perturbed", "log_inclusion")
