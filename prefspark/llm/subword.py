"""Operator 2, SentencePiece encoding and decoding: Gumbel top-k without replacement.

A text's segmentations into pieces have a probability proportional to the product
of their pieces' probabilities. Each segmentation's log-probability is perturbed by
an independent Gumbel variable; the ``k`` largest are ``k`` distinct samples, drawn
without replacement. They are found by A-star search over the lattice:

- the agenda holds sets of segmentations that share a prefix and exclude some next
  pieces; its priority is the exact largest perturbed value within the set, drawn
  top-down as a Gumbel truncated at the parent's value;
- the best set is popped, its best member completed by sampling with the exact
  backward mass as heuristic, and what is left of the set is split along that path.

Sample j has the j-th largest perturbed value. With the (k+1)-th value as threshold
each sample has its inclusion score, the probability of exceeding it. Random numbers
are hashes of the row's key, so a row's samples don't depend on partitions.

The vocabulary is read, never trained: pieces have the probabilities of a Zipf law
over their order in the vocabulary file, to the power ``ALPHA``. Spaces become U+2581 with one more in front
of the text; a character in no piece falls back to its bytes. Pieces hold U+2581
only at their start, so a lattice falls apart before each run of spaces into units
that are independent given the boundary; equal units of a batch share one lattice.

Defined results: a null or empty text has one sample without pieces, of probability
1; a text with fewer than k segmentations has them all, each with inclusion 1; equal
texts under one key have equal samples, repeated rows are encoded each; a null key
counts as 0; an empty table gives no rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import mix64, prepare, runs, table, unit, utf8_buffer

SAMPLES = 4
SEED = 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF_SHIFT = 2.7
#: Power of the probabilities: below 1 the samples differ more.
ALPHA = 0.5
BATCH_BYTES = 1 << 18
_SPACE = 0x2581
#: Stands for a U+2581 of the text itself, which is no space.
_LITERAL = 0x110000
_B = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 21
#: Memory that a worker keeps between batches instead of faulting it in again.
_KEPT = 31 << 20
#: Prefixes below this share of their set's mass (in nats) can't be told from none.
_NEGLIGIBLE = -45.0


def vocabulary(path: str = MODEL) -> list[tuple[str, int]]:
    """(piece, kind) by id: 0 ordinary, 1 byte, 2 neither."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(sp.vocab_size())]
    return [(sp.id_to_piece(i), k) for i, k in enumerate(kinds)]


def decode(ids, vocab: list[tuple[str, int]]) -> str:
    """The text of a sequence of ids."""
    pieces = _piece_bytes(vocab)
    out = b"".join([pieces[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")


def _piece_bytes(vocab) -> list[bytes]:
    space = chr(_SPACE)
    return [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(space, " ").encode() for p, k in vocab]


class Pieces:
    """The ordinary pieces by a rolling hash of their code points."""

    def __init__(self, vocab: list[tuple[str, int]]):
        ordinary = [(p, i) for i, (p, k) in enumerate(vocab) if k == 0 and "▁" not in p.lstrip("▁")]
        mass = 1.0 / (np.arange(len(ordinary)) + ZIPF_SHIFT)
        logp = ALPHA * np.log(mass / mass.sum())
        self.byte_id = np.zeros(256, np.int64)
        for i, (p, k) in enumerate(vocab):
            if k == 1:
                self.byte_id[int(p[3:5], 16)] = i
        self.byte_logp = float(logp[-1])
        keys, starts = np.zeros(len(ordinary), np.uint64), set()
        for n, (p, _) in enumerate(ordinary):
            h = 0
            for c in p:
                starts.add(h)
                h = (h * int(_B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[n] = h
        slot = _slots(keys)
        order = np.argsort(slot, kind="stable")
        self.count, self.keys, self.starts = len(ordinary), keys[order], np.array(sorted(starts), np.uint64)
        # After the pieces: characters of one to four bytes that are in no piece.
        self.logp = np.concatenate([logp[order], self.byte_logp * np.arange(1, 5)])
        self.ids = np.concatenate([np.array([i for _, i in ordinary])[order], np.zeros(4, np.int64)]).astype(np.int32)
        self.longest = max(len(p) for p, _ in ordinary)
        self._index()

    def _index(self) -> None:
        """By a short hash: 1 a piece, 2 the start of a longer one (most lookups end
        here), and the first of the pieces with that short hash, which are neighbours."""
        used, at, shared = np.unique(_slots(self.keys), return_index=True, return_counts=True)
        self.maybe, self.first = np.zeros(1 << _SLOT_BITS, np.uint8), np.zeros(1 << _SLOT_BITS, np.int32)
        self.maybe[used] |= np.uint8(1)
        self.maybe[_slots(self.starts)] |= np.uint8(2)
        self.first[used], self.most = at, int(shared.max())

    def __getstate__(self) -> dict:
        """Without the index, which is large and quickly made."""
        return {k: v for k, v in vars(self).items() if k not in ("maybe", "first")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._index()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, piece) of the hashes that are pieces, and which may go on."""
        slot = _slots(hashes)
        flags = self.maybe.take(slot)
        at = np.flatnonzero(flags & np.uint8(1))
        hashes, found = hashes.take(at), self.first.take(slot.take(at)).astype(np.int64)
        ok = self.keys.take(found) == hashes
        for _ in range(1, self.most):
            other = np.flatnonzero(~ok)
            found[other] += 1
            ok[other] = self.keys.take(found[other], mode="clip") == hashes[other]
        ok = np.flatnonzero(ok)
        return at.take(ok), found.take(ok), flags > 1


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _STIR >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` of them."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Lattice:
    """The units of some texts: pieces as edges, and backward masses.

    ``texts`` are the code points of all texts, one after the other; ``cuts`` where
    each starts (one entry more). Node ``n`` is a character of a unit type; the end
    of a unit is no node, but ``-1``. Nodes are numbered by their distance to the end
    of the unit (their level), then by type, longer types first: what the masses of a
    level need is a slice, and a type has the same place in each of its levels."""

    def __init__(self, pieces: Pieces, texts: np.ndarray, cuts: np.ndarray):
        space = texts == _SPACE
        first = np.zeros(len(texts), bool)
        first[1:] = space[1:] & ~space[:-1]
        first[cuts[:-1][np.diff(cuts) > 0]] = True
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(texts)))
        #: Units of each text, as a range.
        self.unit_cuts = np.searchsorted(begin, cuts)
        # Types: equal units, by a rolling hash and the length.
        up = np.multiply.accumulate(np.full(len(texts) + 1, _B))
        down = np.multiply.accumulate(np.full(len(texts) + 1, np.uint64(pow(int(_B), -1, 1 << 64))))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((texts.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        key = mix64((total[begin + size] - total[begin]) * down[begin] + size.astype(np.uint64))
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]])
        at = order[new]
        by_size = np.argsort(-size[at], kind="stable")
        number = np.empty(len(at), np.int64)
        number[by_size] = np.arange(len(at))
        self.type_of = np.empty(len(order), np.int64)
        self.type_of[order] = number.take(np.cumsum(new) - 1)
        at = at[by_size]
        size = size[at]
        # Types of at least each size, and the first node of each level.
        at_least = np.bincount(size)[::-1].cumsum()[::-1]
        at_least[0] = 0
        level = np.concatenate([[0], np.cumsum(at_least)])
        n = int(level[-1])
        #: First node of each type.
        self.start = level.take(size) + np.arange(len(size))
        # Characters type by type.
        cp = texts.take(_ranges(begin[at], size)).astype(np.uint64)
        to_end = np.repeat(np.cumsum(size), size) - np.arange(n)
        node = level.take(to_end) + np.repeat(np.arange(len(size)), size)
        # An edge as one number: node, then long pieces first, then the piece. Sorted,
        # they are in the order of their nodes.
        piece_bits, bits = len(pieces.logp).bit_length(), len(pieces.logp).bit_length() + pieces.longest.bit_length()
        packed = []
        alive, left, h = np.arange(n), to_end, np.zeros(n, np.uint64)
        for k in range(1, pieces.longest + 1):
            h = h * _B + cp.take(alive + (k - 1)) + np.uint64(1)
            at, found, longer = pieces.find(h)
            src = alive.take(at)
            packed.append((node.take(src) << bits) + ((pieces.longest - k) << piece_bits) + found)
            if k == 1:
                covered = np.zeros(n, bool)
                covered[src] = True
            longer &= left > k
            longer = np.flatnonzero(longer)
            alive, left, h = alive.take(longer), left.take(longer), h.take(longer)
        bare = np.flatnonzero(~covered)  # characters in no piece: by their bytes
        bare = bare[np.argsort(node[bare])]
        code = np.where(cp[bare] == _LITERAL, _SPACE, cp[bare]).astype(np.int64)
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        packed.append((node[bare] << bits) + ((pieces.longest - 1) << piece_bits) + pieces.count + width - 1)
        packed = np.concatenate(packed)
        packed.sort()
        self.src = packed >> bits
        #: Piece of each edge.
        self.piece = packed & ((1 << piece_bits) - 1)
        length = pieces.longest - (packed >> piece_bits & ((1 << (bits - piece_bits)) - 1))
        self.degree = np.bincount(self.src, minlength=n)
        self.edges = np.concatenate([[0], np.cumsum(self.degree)])
        # The level below by the edge's length; no node is there at the end.
        below = np.repeat(np.arange(len(at_least)), np.diff(self.edges[level])) - length
        self.dst = self.src - level.take(below + length)
        self.dst += level.take(below)
        self.dst[below == 0] = -1
        # Edges of characters in no piece, and the ids of their bytes.
        self.bare = np.flatnonzero(self.piece >= pieces.count)
        self.bare_ids = np.zeros((len(bare), 4), np.int32)
        for row, c in enumerate(code.tolist()):
            raw = chr(c).encode("utf-8", "surrogatepass")
            self.bare_ids[row, : len(raw)] = pieces.byte_id[list(raw)]
        self.pieces = pieces
        self._masses(pieces.logp.take(self.piece), level)

    def _masses(self, logp: np.ndarray, level: np.ndarray) -> None:
        """Backward log-masses of the nodes, from a unit's end to its start, and the
        probability of each edge among those of its node."""
        beta = np.zeros(len(self.degree) + 1)  # the last entry, -1, is any unit's end
        nodes, cuts = level.tolist(), self.edges.take(level).tolist()
        for a, b, first, last in zip(nodes[1:], nodes[2:], cuts[1:], cuts[2:]):
            x = logp[first:last]
            x += beta.take(self.dst[first:last])
            starts = self.edges[a:b] - first
            top = np.maximum.reduceat(x, starts)
            x = x - np.repeat(top, self.degree[a:b])
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(x, out=x), starts))
        self.logq = logp
        self.logq -= beta.take(self.src)
        self.q = np.exp(self.logq)
        self.within = np.cumsum(self.q)
        first = self.edges[:-1]
        self.within -= (self.within.take(first) - self.q.take(first)).take(self.src)
        self.within[self.edges[1:] - 1] = 1.0  # rounding must not leave a gap

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Log-mass of all other edges of the edges' nodes."""
        rest = np.log(np.maximum(1.0 - self.q.take(edges), 1e-300)).astype(np.float32)
        rest[self.degree.take(self.src.take(edges)) == 1] = -np.inf
        return rest

    def ids_of(self, path: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some paths, one after the other, and where each path ends in
        them: an edge has one id, or those of a character's bytes."""
        piece = self.piece.take(path)
        ids = self.pieces.ids.take(piece)
        bare = np.flatnonzero(piece >= self.pieces.count)
        if not len(bare):
            return ids, ends
        of = np.searchsorted(self.bare, path[bare])
        ids[bare] = self.bare_ids[of, 0]
        more = piece[bare] - self.pieces.count
        ids = np.insert(ids, np.repeat(bare + 1, more), self.bare_ids.ravel()[_ranges(4 * of + 1, more)])
        return ids, ends + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(bare, ends)]

    def complete(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from nodes to their units' ends: edges one after the other,
        and the number of each path's edges. ``key`` seeds each path."""
        live, at, step = np.arange(len(node)), node, 0
        steps, sizes = [], np.zeros(len(node), np.int64)
        while len(live):
            u = key + np.uint64((step + 1) * int(_B) & 0xFFFFFFFFFFFFFFFF)  # keys are mixed already
            u ^= u >> np.uint64(32)
            u *= _STIR
            u ^= u >> np.uint64(29)
            u = unit(u)
            e = self.edges.take(at)  # long pieces come first and are mostly it
            late = np.flatnonzero(self.within.take(e) < u)
            next_, u = e.take(late), u.take(late)
            while len(late):
                next_ += 1
                e[late] = next_
                later = np.flatnonzero(self.within.take(next_) < u)
                late, next_, u = late.take(later), next_.take(later), u.take(later)
            steps.append((live, e))
            step += 1
            at = self.dst.take(e)
            sizes[live.take(np.flatnonzero(at < 0))] = step
            more = np.flatnonzero(at >= 0)
            live, at, key = live.take(more), at.take(more), key.take(more)
        first = np.cumsum(sizes) - sizes
        path = np.zeros(int(sizes.sum()), np.int64)
        for k, (live, e) in enumerate(steps):
            path[first.take(live) + k] = e
        return path, sizes


def _truncated(log_mass: np.ndarray, bound: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel variables of location ``log_mass``, given that they are below ``bound``;
    ``noise`` is log(-log(u)) of uniform variables."""
    return log_mass - np.logaddexp(log_mass - bound, noise)


_NONE = np.zeros(0, np.int64)


def _draws(keys: np.ndarray, what: int) -> np.ndarray:
    """Where the random numbers of one purpose start, for each text's key."""
    return mix64(keys ^ np.uint64(what * int(_B) & 0xFFFFFFFFFFFFFFFF))


def _numbered(draws: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix64(draws + number.astype(np.uint64))


class _Text:
    """One text's search: its samples and its agenda."""

    def __init__(self, first: int, units: int):
        self.first, self.units = first, units
        self.agenda: list[tuple] = []  # (-bound, number, sample, edge, log-mass before it, excluded)
        self.samples: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # path, end of each unit in it, log p, value


def top_k(lattice: Lattice, keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: edges, log-probability, perturbed value and
    log-inclusion, by decreasing perturbed value."""
    cuts = lattice.unit_cuts.tolist()
    keys = np.array(keys, np.uint64)
    texts = [_Text(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
    zero = np.zeros(len(keys), np.int64)
    for t, g in zip(texts, (-np.log(-np.log(unit(_numbered(_draws(keys, 0), zero))))).tolist()):
        heapq.heappush(t.agenda, (-g, 0, -1, 0, 0.0, ()))
    unit_start = lattice.start.take(lattice.type_of)
    for round_ in range(k):
        popped, nodes, inside, sizes = [], [], [], []
        chosen = unit(_numbered(_draws(keys, 2 * round_ + 1), zero)).tolist()
        searched = np.array([n for n, t in enumerate(texts) if t.agenda], np.int64)
        if not len(searched):
            break
        for n in searched.tolist():
            t = texts[n]
            minus, _, sample, edge, before, excluded = heapq.heappop(t.agenda)
            head, head_ends, forced, skip = _NONE, _NONE, _NONE, 0
            if sample >= 0:
                path, unit_ends, _, _ = t.samples[sample]
                skip = int(np.searchsorted(unit_ends, edge, side="right"))
                choice = _choose(lattice, int(path[edge]), excluded, chosen[n])
                head, head_ends, forced = path[:edge], unit_ends[:skip], np.array([choice])
                at = int(lattice.dst[choice])
                if at < 0:  # the forced piece ends its unit
                    skip += 1
                    head_ends = np.append(head_ends, edge + 1)
                else:
                    inside.append((len(nodes), at))
            popped.append((t, -minus, edge, before, excluded, head, head_ends, forced))
            nodes.append(unit_start[t.first + skip : t.first + t.units])
            sizes.append(t.units - skip)
        sizes = np.array(sizes)
        unit_at = np.concatenate([[0], np.cumsum(sizes)])
        node = np.concatenate(nodes)
        for n, at in inside:
            node[unit_at[n]] = at
        first = np.array([t.units for t, *_ in popped]) - sizes
        seeds = _numbered(np.repeat(_draws(keys[searched], 2 * round_ + 2), sizes), _ranges(first, sizes))
        path, counts = lattice.complete(node, seeds)
        ends = np.concatenate([[0], np.cumsum(counts)])
        fresh = []
        for (t, value, edge, _, _, head, head_ends, forced), a, b in zip(popped, unit_at[:-1].tolist(), unit_at[1:].tolist()):
            tail = path[ends[a] : ends[b]]
            fresh.append(np.concatenate([forced, tail]) if len(forced) else tail)
            whole = np.concatenate([head, fresh[-1]]) if len(head) else fresh[-1]
            unit_ends = np.concatenate([head_ends, ends[a + 1 : b + 1] + (edge + len(forced) - ends[a])])
            t.samples.append((whole, unit_ends, float(lattice.logq.take(whole).sum()), value))
        _split(lattice, popped, fresh, _draws(keys[searched], 1000 + round_), round_, k)
    return [_finished(t, k) for t in texts]


def _choose(lattice: Lattice, edge: int, excluded: tuple, u: float) -> int:
    """An edge of the node of ``edge`` that isn't excluded, by probability."""
    node = lattice.src[edge]
    options = [e for e in range(lattice.edges[node], lattice.edges[node + 1]) if e not in excluded]
    mass = np.cumsum(lattice.q[options])
    return options[min(int(np.searchsorted(mass, u * mass[-1])), len(options) - 1)]


def _split(lattice: Lattice, popped: list, fresh: list[np.ndarray], draws: np.ndarray, round_: int, k: int) -> None:
    """What is left of the popped sets, along their newest samples: for each edge of
    a sample, from where its set began, the segmentations that part from it there."""
    todo, width = np.array([n for n, path in enumerate(fresh) if len(path)], np.int64), min(384, max(map(len, fresh)))
    before, value = np.array([p[3] for p in popped]), np.array([p[1] for p in popped])
    most = k - round_  # as many can be popped yet, or be the threshold
    while len(todo):
        size = np.array([len(fresh[n]) for n in todo.tolist()])
        edges = np.zeros((len(todo), width), np.int64)
        for row, n in enumerate(todo.tolist()):
            edges[row, : size[row]] = fresh[n][:width]
        inside = np.arange(width) < size[:, None]
        logq = np.where(inside, lattice.logq.take(edges), 0.0)
        prefix = np.cumsum(logq, axis=1) - logq
        ok = inside & (prefix >= _NEGLIGIBLE)
        more = ok[:, -1] & (size > width)  # the prefix still has mass
        ok[more] = False
        row, at = np.nonzero(ok)  # the first edge of a row is always one of them
        e, start = edges[row, at], prefix[row, at]
        mass = start + lattice.log_rest(e)
        for i in np.flatnonzero(at == 0).tolist():
            excluded = popped[todo[row[i]]][4]
            if excluded:
                node = lattice.src[e[i]]
                rest = [x for x in range(lattice.edges[node], lattice.edges[node + 1]) if x not in excluded and x != e[i]]
                mass[i] = np.log(lattice.q[rest].sum()) if rest else -np.inf
        some = np.flatnonzero(mass > -np.inf)
        row, at, mass = row[some], at[some], mass[some]
        # Within a row the bounds go down as this goes up; only the best are made.
        late = np.full(edges.shape, np.inf)
        noise = np.log(-np.log(unit(_numbered(draws[todo[row]], at))))
        late[row, at] = noise - mass
        place = np.zeros(edges.shape, np.int64)
        place[row, at] = np.arange(len(row))
        best = np.argpartition(late, min(most, width) - 1, axis=1)[:, :most]
        best_row, best_at = np.nonzero(np.take_along_axis(late, best, axis=1) < np.inf)
        best_at = best[best_row, best_at]
        drawn, of = place[best_row, best_at], todo[best_row]
        bound = np.full(edges.shape, -np.inf)
        bound[best_row, best_at] = _truncated(mass[drawn] + before[of], value[of], noise[drawn])
        for row, n in enumerate(todo.tolist()):
            if more[row]:
                continue
            t, _, edge, start, excluded, *_ = popped[n]
            for i in best[row].tolist():
                if bound[row, i] == -np.inf:
                    continue
                e = int(edges[row, i])
                out = (*excluded, e) if i == 0 else (e,)
                entry = (-float(bound[row, i]), round_ * (1 << 40) + i, len(t.samples) - 1, edge + i, start + float(prefix[row, i]), out)
                heapq.heappush(t.agenda, entry)
        todo, width = todo[more], 4 * width


def _finished(t: _Text, k: int):
    threshold = -t.agenda[0][0] if len(t.samples) == k and t.agenda else -np.inf
    out = []
    for path, _, logp, value in t.samples:
        x = logp - threshold
        # log(1 - exp(-exp(x))), which is x where exp(x) is tiny.
        inclusion = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))
        out.append((path, logp, value, inclusion))
    return out


def code_points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a space in front of each that isn't empty and
    U+2581 for spaces; where each text starts."""
    raw = data[offsets[0] : offsets[-1]]
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cps[cps == _SPACE] = _LITERAL
    cps[cps == 32] = _SPACE
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    cuts = lead[offsets - offsets[0]]
    full = np.diff(cuts) > 0
    out = np.insert(cps, cuts[:-1][full], _SPACE)
    return out, cuts + np.concatenate([[0], np.cumsum(full)])


_NAMES = ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"]


def _rows(pieces: Pieces, piece_bytes: pa.Array, data, offsets, keys, i: int, j: int, k: int, doc_ids) -> pa.RecordBatch:
    """The samples of the rows from ``i`` to ``j``."""
    cps, cuts = code_points_of(data, offsets[i : j + 1])
    found = [[(_NONE, 0.0, 0.0, 0.0)]] * (j - i)
    if len(cps):
        lattice = Lattice(pieces, cps, cuts)
        some = top_k(lattice, keys[i:j].tolist(), k)
        found = [f if offsets[i + n] < offsets[i + n + 1] else found[n] for n, f in enumerate(some)]
    row = np.array([i + n for n, f in enumerate(found) for _ in f])
    paths = [s[0] for f in found for s in f]
    path = np.concatenate(paths)
    ends = np.cumsum([len(p) for p in paths])
    if len(path):
        ids, ends = lattice.ids_of(path, ends)
    else:
        ids = path.astype(np.int32)
    at = np.concatenate([[0], ends]).astype(np.int32)
    ids = pa.array(ids)
    # Decoded: the bytes of all pieces, of which the first is the space in front.
    decoded = piece_bytes.take(ids)
    byte_at = np.frombuffer(decoded.buffers()[1], np.int64)[at].tolist()
    text, base = decoded.buffers()[2].to_pybytes(), int(offsets[i])
    source = data[base : offsets[j]].tobytes()
    same = [
        b - a == (z - y) + (z > y) and text[a + 1 : b] == source[y - base : z - base]
        for a, b, y, z in zip(byte_at[:-1], byte_at[1:], offsets[row].tolist(), offsets[row + 1].tolist())
    ]
    scores = [s[1:] for f in found for s in f]
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array(row)),
            pa.array([n for f in found for n in range(len(f))], pa.int32()),
            pa.ListArray.from_arrays(pa.array(at), ids),
            *(pa.array(c, pa.float64()) for c in zip(*scores)),
            pa.array(same, pa.bool_()),
        ],
        _NAMES,
    )


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """Up to ``k`` rows per document row: doc_id, sample (from 0), ids, log_prob
    (among all segmentations), perturbed, log_inclusion, and whether decoding gives
    the text again."""
    spark = docs.sparkSession
    prepare(spark)
    vocab = vocabulary(model)  # a fixed vocabulary
    shared = spark.sparkContext.broadcast((Pieces(vocab), _piece_bytes(vocab)))
    need = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("0")), F.lit(seed)).alias("key"),
    )

    def run(batches):
        pieces, piece_bytes = shared.value[0], pa.array(shared.value[1], pa.large_binary())
        np.empty(_KEPT, np.uint8)  # freed at once: from then on freed arrays of a batch are kept for the next
        for b in batches:
            data, offsets = utf8_buffer(b.column(1))
            keys = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in runs(offsets, BATCH_BYTES):
                yield _rows(pieces, piece_bytes, data, offsets, keys, i, j, k, b.column(0))

    id_type = need.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return need.mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of all documents."""
    return encode(table(spark, sf_dir, "documents"))
