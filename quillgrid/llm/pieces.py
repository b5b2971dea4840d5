"""SentencePiece encoding and decoding: distinct segmentations sampled without replacement by Gumbel top-k.

A text's segmentations are the paths of a lattice whose edges are pieces. Backward
sums over the lattice give the probability of each edge at its node, so a
segmentation's probability is the product over its edges. A perturbed A* search finds
the k segmentations with the largest Gumbel-perturbed log probabilities:

* The agenda holds bundles: a path up to a node, with the edges taken there before
  excluded. Its bound is the largest perturbed value in the bundle: a Gumbel whose
  location is the bundle's log mass, truncated at the value of the path it left.
* The best bundle is popped, an edge is drawn among those left, and the rest of the
  path is drawn forward; each node it passes leaves a new bundle on the agenda.
* The k-th pop is the k-th largest value. The next bound, kappa, gives each sample's
  inclusion score, 1 - exp(-exp(log p - kappa)).

No piece has a space inside, so the lattice falls apart at words: it is built once for
each distinct word of a block. All texts of a block advance together in numpy. Random
numbers are a function of the seed, the row's key and the place, so a task that is run
again gives the same samples.

Unigram models give log probabilities; a BPE model has merge ranks only, so its pieces
get a Zipf prior, log p = -log(rank + ZIPF), normalised. Characters without a piece
are spelt in byte pieces.

Defined results: null or empty texts have one segmentation without pieces; a text with
fewer than k segmentations returns all it has, each with inclusion score 1; repeated
rows get the same samples; U+2581 decodes as a space, as the model itself has it; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernel as K

ZIPF = 32.0
BLOCK = 1 << 20
_U = np.uint64


def uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on ``parts`` alone."""
    x = parts[0]
    for p in parts[1:]:
        x = K.splitmix(x + np.asarray(p).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return ((K.splitmix(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel_below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel at ``location``, given that it is below ``top``; -inf where there is no mass."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        got = location - np.log(np.exp(location - top) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(got, top))


class Vocabulary:
    """Pieces, their log probabilities, and a hash table of all their prefixes."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        score = np.array([m.get_score(i) for i in range(size)])
        text: list[bytes] = []
        usable = np.zeros(size, dtype=bool)
        self.byte_id = np.full(256, m.unk_id(), dtype=np.int64)
        for i in range(size):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                text.append(bytes([int(p[3:5], 16)]))
                self.byte_id[text[-1][0]] = i
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                text.append(b"")
            else:
                text.append(p.replace("▁", " ").encode())
                usable[i] = True
                if b" " in text[-1].lstrip(b" "):
                    raise ValueError("pieces with inner spaces are not supported")
        # BPE scores are minus the merge rank; unigram scores are log probabilities, none of which is as low as that.
        ranks = bool(usable.any()) and score[usable].min() < -1000
        self.log_p = -np.log(np.maximum(-np.maximum(score, -size), 0) + ZIPF) if ranks else score.copy()
        byte_ids = np.unique(self.byte_id[self.byte_id != m.unk_id()])
        self.log_p[byte_ids] = self.log_p[usable].min() if usable.any() else 0.0
        known = np.concatenate([np.flatnonzero(usable), byte_ids])
        self.log_p -= np.log(np.exp(self.log_p[known]).sum()) if ranks else 0.0
        self.bytes_of = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.length = np.array([len(t) for t in text], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.longest = max((len(t) for t, u in zip(text, usable, strict=True) if u), default=1)
        prefixes: dict[bytes, int] = {}
        for i in np.flatnonzero(usable).tolist():
            for n in range(1, len(text[i])):
                prefixes.setdefault(text[i][:n], -1)
        for i in np.flatnonzero(usable).tolist():
            prefixes[text[i]] = i
        keys = sorted(prefixes)
        lengths = np.array([len(k) for k in keys], dtype=np.int64)
        ends = np.cumsum(lengths)
        h = K.span_hashes(np.frombuffer(b"".join(keys), dtype=np.uint8), ends - lengths, ends)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 8 + 1))))
        self.slot_key = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slot_id = np.full(1 << self.bits, -2, dtype=np.int64)
        mask = (1 << self.bits) - 1
        for key, k in zip(h.tolist(), keys, strict=True):
            at = key >> (64 - self.bits)
            while self.slot_id[at] != -2:
                at = (at + 1) & mask
            self.slot_key[at], self.slot_id[at] = key, prefixes[k]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1 for a prefix only, -2 for neither."""
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        got = np.where(self.slot_key[at] == h, self.slot_id[at], -2)
        open_ = np.flatnonzero((self.slot_key[at] != h) & (self.slot_id[at] != -2))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            same = self.slot_key[at] == h[open_]
            got[open_[same]] = self.slot_id[at[same]]
            more = ~same & (self.slot_id[at] != -2)
            open_, at = open_[more], at[more]
        return got

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of pieces, the prefix space included."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes_of[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)]


class Lattices:
    """Lattices of distinct words: nodes are byte places, edges leave a node together, longest first."""

    def __init__(self, v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        self.root = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        total = int((size + 1).sum())
        word = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(total) - self.root[word]
        inside = place < size[word]
        text = np.zeros(total, dtype=np.uint8)
        text[inside] = data[(starts[word] + place)[inside]]
        left = size[word] - place
        self.last = left == 0
        up, down = K._POWERS.upto(total + 1)
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(K.BYTE_CODES[text] * up[:-1], out=sums[1:])
        heads = inside & ((text & 0xC0) != 0x80)
        at = np.flatnonzero(heads)
        width = np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, np.where(text >= 0xC0, 2, 1)))
        spelt = np.ones(total, dtype=bool)
        src, dst, pid = [], [], []
        for n in range(1, v.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            got = v.look_up(K.splitmix((sums[at + n] - sums[at]) * down[at] + _U(n)))
            hit = got >= 0
            src.append(at[hit])
            dst.append(at[hit] + n)
            pid.append(got[hit])
            spelt[at[hit][width[at[hit]] == n]] = False
            at = at[got != -2]
        # Bytes of characters that are no piece themselves: one edge each.
        owner = np.maximum.accumulate(np.where(heads, np.arange(total), 0))
        raw = np.flatnonzero(inside & spelt[owner])
        src, dst, pid = [raw, *src], [raw + 1, *dst], [v.byte_id[text[raw]], *pid]
        src, dst, pid = (np.concatenate(x[::-1]) for x in (src, dst, pid))
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.pid = src[order], dst[order], pid[order]
        self.first = np.searchsorted(self.src, np.arange(total + 1))
        self.degree = np.diff(self.first)
        # Backward sums, by what is left of the word.
        beta = np.full(total, -np.inf)
        beta[self.last] = 0.0
        remaining = left[self.src]
        by = np.argsort(remaining, kind="stable")
        bounds = np.searchsorted(remaining[by], np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        score = v.log_p[self.pid]
        for r in range(len(bounds) - 1):
            e = by[bounds[r] : bounds[r + 1]]
            if len(e):
                value = score[e] + beta[self.dst[e]]
                cut = np.flatnonzero(np.r_[True, np.diff(self.src[e]) != 0])
                top = np.maximum.reduceat(value, cut)
                n = np.diff(np.r_[cut, len(e)])
                beta[self.src[e][cut]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), cut))
        self.log_q = np.minimum(score + beta[self.dst] - beta[self.src], 0.0)
        q = np.exp(self.log_q)
        sums = np.cumsum(q)
        start = self.first[self.src]
        self.cum = sums - (sums[start] - q[start])
        # The last edge takes what rounding leaves.
        self.cum[self.first[1:][self.degree > 0] - 1] = 2.0

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        e = self.first[node]
        go = np.flatnonzero(self.cum[e] < u)
        while len(go):
            e[go] += 1
            go = go[self.cum[e[go]] < u[go]]
        return e

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a drawn path from each node to its word's end, path by path, and each path's number of edges."""
        count = np.zeros(len(node), dtype=np.int64)
        live = np.flatnonzero(~self.last[node])
        steps, step = [], 0
        now = node[live]
        while len(live):
            e = self.draw(now, uniform(key[live], np.uint64(step)))
            steps.append((live, e))
            count[live] += 1
            now = self.dst[e]
            more = ~self.last[now]
            live, now, step = live[more], now[more], step + 1
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for i, (who, e) in enumerate(steps):
            out[start[who] + i] = e
        return out, count


def _segments(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+count[i]-1, for all i."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Path:
    """One sampled path of some of the rows: edges of all rows in a run, ``cuts`` their bounds, ``bound`` the bundle left at each place."""

    def __init__(self, rows: np.ndarray, n: int, edges: np.ndarray, count: np.ndarray, value: np.ndarray, cut: np.ndarray, excluded: list[list[int]]) -> None:
        self.rows, self.edges, self.value, self.cut, self.excluded = rows, edges, value, cut, excluded
        self.cuts = _segments(count)
        self.slot = np.full(n, -1)
        self.slot[rows] = np.arange(len(rows))

    def leave_bundles(self, L: Lattices, key: np.ndarray, turn: int, at_cut: np.ndarray | None) -> None:
        """Bounds of the bundles at each place; those before a row's ``cut`` belong to the path it left."""
        lq = L.log_q[self.edges]
        sums = np.cumsum(lq)
        mine = np.repeat(np.arange(len(self.rows)), np.diff(self.cuts))
        before = sums - lq - np.concatenate([[0.0], sums])[self.cuts[:-1]][mine]
        with np.errstate(divide="ignore"):
            location = before + np.log1p(-np.exp(lq))
        location[L.degree[L.src[self.edges]] < 2] = -np.inf
        place = np.arange(len(self.edges)) - self.cuts[:-1][mine]
        self.bound = _gumbel_below(location, self.value[mine], uniform(key[self.rows][mine], place, np.uint64(turn + (1 << 20))))
        self.bound[place < self.cut[mine]] = -np.inf
        if at_cut is not None:
            self.bound[self.cuts[:-1] + self.cut - 1] = at_cut
        self.log_prob = np.add.reduceat(lq, self.cuts[:-1]) if len(lq) else np.zeros(0)

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's best bound and its index among the edges."""
        top = np.maximum.reduceat(self.bound, self.cuts[:-1])
        hit = np.flatnonzero(self.bound == np.repeat(top, np.diff(self.cuts)))
        owner = np.searchsorted(self.cuts, hit, side="right") - 1
        _, one = np.unique(owner, return_index=True)
        return top, hit[one]


class Sampler:
    """The k samples of each text of a block."""

    def __init__(self, v: Vocabulary, k: int, seed: int) -> None:
        self.v, self.k, self.seed = v, k, seed

    def _suffixes(self, who: np.ndarray, node: np.ndarray, after: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from ``node`` to its word's end and on through the words from number ``after``; with each row's count."""
        lo = self.bounds[:-1][who] + after
        many = self.bounds[1:][who] - lo
        mine = np.repeat(np.arange(len(who)), many + 1)
        slot = np.cumsum(many + 1) - (many + 1)
        rest = np.ones(len(mine), dtype=bool)
        rest[slot] = False
        words = _gather(lo, many)
        nodes, number = np.empty(len(mine), dtype=np.int64), np.empty(len(mine), dtype=np.int64)
        nodes[rest], number[rest] = self.root[words], words - self.bounds[:-1][who][mine[rest]] + 1
        nodes[slot], number[slot] = node, after
        key = K.splitmix(K.splitmix(self.key[who][mine] + _U(turn * 0xD6E8FEB86659FD93 % (1 << 64))) ^ number.astype(np.uint64))
        edges, count = self.L.walk(nodes, key)
        return edges, np.bincount(mine, weights=count, minlength=len(who)).astype(np.int64)

    def _branch(self, paths: list[Path], alive: np.ndarray, path: np.ndarray, where: np.ndarray, value: np.ndarray, turn: int) -> tuple[Path, np.ndarray]:
        """Pop the best bundle of each row in ``alive``: its prefix, another edge there, a drawn suffix."""
        L, key = self.L, self.key
        u1 = uniform(key[alive], np.uint64(turn + (1 << 21)))
        u2 = uniform(key[alive], np.uint64(turn + (1 << 22)))
        chosen, cut, word = (np.zeros(len(alive), dtype=np.int64) for _ in range(3))
        location = np.full(len(alive), -np.inf)
        prefixes, excluded = [], []
        for i, r in enumerate(alive.tolist()):
            x = paths[path[r]]
            s, at = int(x.slot[r]), int(where[r])
            lo = int(x.cuts[s])
            x.bound[at] = -np.inf
            # Where a path branched off itself, what was excluded then stays so.
            taken = [int(x.edges[at]), *(x.excluded[s] if at == lo + x.cut[s] - 1 else [])]
            node = int(L.src[taken[0]])
            options = np.arange(L.first[node], L.first[node + 1])
            options = options[~np.isin(options, taken)]
            sums = np.cumsum(np.exp(L.log_q[options]))
            j = min(int(np.searchsorted(sums, u1[i] * sums[-1], side="right")), len(options) - 1)
            chosen[i], prefix = options[j], x.edges[lo:at]
            cut[i], word[i] = at - lo + 1, int(L.last[L.dst[prefix]].sum())
            left = np.delete(np.exp(L.log_q[options]), j).sum()
            if left > 0:
                location[i] = L.log_q[prefix].sum() + np.log(left)
            prefixes.append(prefix)
            excluded.append(taken)
        tail, count = self._suffixes(alive, L.dst[chosen], word + 1, turn)
        tails = _segments(count)
        edges = np.concatenate([y for i, p in enumerate(prefixes) for y in (p, chosen[i : i + 1], tail[tails[i] : tails[i + 1]])])
        return Path(alive, len(key), edges, cut + count, value, cut, excluded), _gumbel_below(location, value, u2)

    def __call__(self, column: pa.Array, key: np.ndarray) -> Iterator[dict]:
        """For each rank: the rows that have so many segmentations, with ids and their bounds, log_prob, value, inclusion and decodes."""
        column = pc.fill_null(column, "")
        if K.buffer_of(column)[0].tobytes().find("▁".encode()) >= 0:
            column = pc.replace_substring(column, "▁", " ")
        filled = np.diff(K.buffer_of(column)[1]) > 0
        rows, blank = np.flatnonzero(filled), np.flatnonzero(~filled)
        if len(blank):
            one, none = np.ones(len(blank)), np.zeros(len(blank))
            yield {"rows": blank, "rank": 0, "ids": np.zeros(0, np.int64), "cuts": np.zeros(len(blank) + 1, np.int64), "log_prob": none, "value": none, "inclusion": one, "decodes": one > 0}
        if not len(rows):
            return
        data, off = K.buffer_of(pc.binary_join_element_wise(pa.scalar(" "), column.filter(pa.array(filled)), ""))
        self.key = K.splitmix(key.astype(np.int64).view(np.uint64) + _U(self.seed))[rows]
        # Words: a run of spaces and what follows it.
        space = data == 0x20
        head = np.zeros(len(data), dtype=bool)
        head[1:] = space[1:] & ~space[:-1]
        head[off[:-1]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(data))
        self.bounds = np.searchsorted(starts, off)
        _, sample, kind = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.L = L = Lattices(self.v, data, starts[sample], ends[sample])
        self.root = L.root[kind]
        n = len(rows)
        nowhere = int(np.flatnonzero(L.last)[0])
        edges, count = self._suffixes(np.arange(n), np.full(n, nowhere), np.zeros(n, np.int64), 0)
        value = -np.log(-np.log(uniform(self.key, _U(1 << 40))))
        paths = [Path(np.arange(n), n, edges, count, value, np.zeros(n, np.int64), [[] for _ in range(n)])]
        paths[0].leave_bundles(L, self.key, 0, None)
        for turn in range(1, self.k + 1):
            kappa, path, where = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, dtype=np.int64)
            for p, x in enumerate(paths):
                top, at = x.best()
                better = top > kappa[x.rows]
                r = x.rows[better]
                kappa[r], path[r], where[r] = top[better], p, at[better]
            alive = np.flatnonzero(path >= 0)
            if turn == self.k or not len(alive):
                break
            new, at_cut = self._branch(paths, alive, path, where, kappa[alive], turn)
            new.leave_bundles(L, self.key, turn, at_cut)
            paths.append(new)
        for rank, x in enumerate(paths):
            ids = L.pid[x.edges]
            limit = kappa[x.rows]
            with np.errstate(over="ignore", invalid="ignore"):
                inclusion = np.where(np.isneginf(limit), 1.0, -np.expm1(-np.exp(np.minimum(x.log_prob - limit, 50.0))))
            out, sizes = self.v.decode(ids), np.add.reduceat(self.v.length[ids], x.cuts[:-1])
            want = np.diff(off)[x.rows]
            same = sizes == want
            if same.all():
                same = np.logical_and.reduceat(out == data[_gather(off[:-1][x.rows], want)], _segments(sizes)[:-1])
            yield {"rows": rows[x.rows], "rank": rank, "ids": ids, "cuts": x.cuts, "log_prob": x.log_prob, "value": x.value, "inclusion": inclusion, "decodes": same}


SCHEMA = "rank int, ids array<int>, n_pieces bigint, log_prob double, value double, inclusion double, decodes boolean"
_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(name: str) -> Vocabulary:
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(SparkFiles.get(name))
    return _LOADED[name]


def sample_encodings(docs: DataFrame, model_file: str, k: int = 3, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Up to k rows for each row of ``docs`` (doc_id, text, ...): doc_id, rank from 0, ids, n_pieces, log_prob, value, inclusion, decodes.

    ``decodes`` says whether the pieces spell the text again. The model file is sent to the executors as a Spark file.
    Texts are worked on ``block`` bytes at once (or one text): less takes less memory and more time, rows are the same.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    docs.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(_vocabulary(name), k, seed)
        for whole in batches:
            for batch in K.batches(whole, "text", block):
                key = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
                for x in sampler(batch.column(1), key):
                    ids = pa.ListArray.from_arrays(pa.array(x["cuts"].astype(np.int32)), pa.array(x["ids"].astype(np.int32)))
                    size = len(x["rows"])
                    yield pa.record_batch([batch.column(0).take(pa.array(x["rows"])), pa.array(np.full(size, x["rank"], np.int32)), ids, pa.array(np.diff(x["cuts"])), pa.array(x["log_prob"]), pa.array(x["value"]), pa.array(x["inclusion"]), pa.array(x["decodes"])], names=["doc_id", "rank", "ids", "n_pieces", "log_prob", "value", "inclusion", "decodes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, " + SCHEMA)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` (doc_id, ids, ...) as (doc_id, text): pieces joined, byte pieces as UTF-8, spaces back, the prefix space dropped."""
    encoded.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                spelt = v.decode(np.array(ids or [], dtype=np.int64)).tobytes()
                texts.append(spelt.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
