"""Op 3: n-gram Jaccard join by prefix filters under several global token orders.

A document is its set of distinct shingles; equal sets are one class. Under
any global order of the tokens, two sets that are similar enough share one of
the first ``n - ceil(t n) + 1`` tokens. Three orders are used: by frequency
(rare first) and two random ones; candidates must share prefix tokens under
all of them, be of fitting length and position, and are then verified exactly.

* Frequencies come from a count sketch over all documents, of about a cell for
  each ``PER_CELL`` shingles, up to a bound. An order need only be the same
  everywhere, so the sketch costs no exactness; but a sketch that is too small
  for its table cannot tell rare tokens from others, and these then tie sets.
* Order 0 proposes: prefix tokens meet in one exchange, sorted by token and
  set size, and are read once in that order. A token that up to ``FEW`` classes
  have in their prefix gives pairs. The classes of a more frequent one are cut
  into runs where the next size in order is too large to be similar; a run of
  up to ``FEW`` gives pairs, a larger one a star. Tokens that the sketch calls
  hot are salted: each salt ties the sets of one size to one of them, and these
  few are read once more without salt; as each stands for those tied to it, no
  filter takes what ties them.
* Orders 1 and 2 and the sizes of bins dispose, before any set is sent: every
  class carries a bitmap of its prefix under either order, and bitmaps of a
  pair must intersect; counts of its tokens in ``BINS`` bins may differ in sum
  by no more than the sets may. No link goes with what they drop. Pairs meet
  sums of the bins first, which are short. The sets of a star that is not of a
  hot token fall into the components of what these filters leave.
  Components of the rest are groups, and no link leaves one.
* A group that fits a block of bounded size is verified there: pairs must share
  prefix tokens under all orders, then matrix products over the sets' common
  tokens decide. It gives a spanning forest of its links, never its pairs.
  Each set is sent once.
* In a larger group, pairs are verified one by one, and the stars' components
  in blocks against blocks. Sets are first measured against one leader: what
  lies near enough to the leader's nearest set is linked to it by the triangle
  inequality of set differences (it needs no filter, as it is sure), and only
  the others meet all blocks.

Components come from the links by star contraction.

Defined cases: null or blank text has no shingles and no links; fewer words
than a shingle are one shingle; a null doc_id is a document below all others,
and one that holds the least number a long can is read as null; texts of any
length are one set each, in a task of their own if need be; ties need no
order, since only whole components come out; repeated rows share a class and
each give a row; empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import _words as W
from marlstone.llm._shared import collected, drop, drop_all_but, hidden, table, written
from marlstone.llm._tally import tally
from marlstone.llm.components import components

U = np.uint64
CELL_BITS, MOST_BITS, PER_CELL, STEPS = 20, 24, 128, 8  # cells of the sketch, the most of them, shingles a cell; levels in a doubling of the count
FEW, BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 16, 1024, 1_500_000, 8192
NO_ID = -(1 << 63)
BINS, BITMAP, FOLDED = 256, 64, 32  # bytes of a class's bins, of its bitmap under one order, and of its bins' sums
HOT_TIMES, HOT_LEAST, SALTS = 4, 4096, 1024  # a sketch cell is hot beyond so many times the mean and so many shingles
SALT = [U(0), U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)]


def prefix_size(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


class Sets:
    """The distinct shingles of rows i .. j of a text column, each row's in order of hash."""

    def __init__(self, data, off, i, j, size):
        w = W.Words(data, off, i, j, W.SPACED)
        self.rows = j - i
        counts = np.diff(w.first)
        g = W.grams(w.hash, size)
        row = w.rows()
        ok = row[: len(g)] == row[size - 1 : size - 1 + len(g)] if len(g) else np.zeros(0, bool)
        h, r = g[ok], row[: len(g)][ok]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            own = np.array([W.grams(w.hash[w.first[x] : w.first[x + 1]], int(counts[x]))[0] ^ U(int(counts[x])) for x in short], np.uint64)
            h, r = np.concatenate([h, own]), np.concatenate([r, short])
        packed = (r.astype(np.uint64) << U(43)) | (h >> U(21))
        o = np.argsort(packed)
        h, r, packed = h[o], r[o], packed[o]
        same = (packed[1:] == packed[:-1]) if len(h) else np.zeros(0, bool)
        if (h[1:][same] != h[:-1][same]).any():
            o = np.lexsort((h, r))
            h, r = h[o], r[o]
        new = np.ones(len(h), bool)
        if len(h):
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        self.h, self.r = h[new], r[new]
        self.first = np.searchsorted(self.r, np.arange(self.rows + 1))
        self.n = np.diff(self.first)

    @classmethod
    def of(cls, lists: list) -> Sets:
        """Sets whose tokens are there already."""
        s = cls.__new__(cls)
        s.rows, s.n = len(lists), np.array([len(x) for x in lists], np.int64)
        s.h = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64).view(np.uint64)
        s.r, s.first = np.repeat(np.arange(s.rows), s.n), np.concatenate([[0], np.cumsum(s.n)])
        return s

    def prefix_lists(self, order: int, levels: np.ndarray, num: int, den: int) -> list:
        at, row, _ = self.prefixes(order, levels, num, den)
        return np.split(self.h[at], np.searchsorted(row, np.arange(1, self.rows))) if self.rows else []

    def keys(self) -> pa.Array:
        """16 bytes for each row that stand for its set."""
        out = np.zeros((self.rows, 2), ">u8")
        for k, c in enumerate((U(0x2545F4914F6CDD1D), U(0x5851F42D4C957F2D))):
            s = np.concatenate([[U(0)], np.cumsum(W.mix(self.h ^ c))])
            out[:, k] = W.mix((s[self.first[1:]] - s[self.first[:-1]]) + self.n.astype(np.uint64))
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), self.rows, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())

    def sketches(self, num: int, den: int) -> pa.Array:
        """For each row its bins (how many of its tokens lie in each, modulo 256, a byte each) and bitmaps of its prefixes under orders 1 and 2."""
        width = BINS + 2 * BITMAP
        out = np.zeros((self.rows, width), np.uint8)
        for i in range(0, self.rows, 4096):
            j = min(i + 4096, self.rows)
            m = slice(self.first[i], self.first[j])
            at = (self.r[m] - i) * BINS + (self.h[m] >> U(40)).astype(np.int64) % BINS
            out[i:j, :BINS] = np.bincount(at, minlength=(j - i) * BINS).reshape(j - i, BINS).astype(np.uint8)
        for order in (1, 2):
            at, row, _ = self.prefixes(order, None, num, den)
            bit = (self.h[at] >> U(20)).astype(np.int64) % (8 * BITMAP)
            np.bitwise_or.at(out, (row, BINS + BITMAP * (order - 1) + bit // 8), (1 << (bit % 8)).astype(np.uint8))
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), self.rows, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())

    def ordered(self, order: int, levels: np.ndarray | None) -> np.ndarray:
        """Places in h, each row's in a global order."""
        key = W.mix(self.h ^ SALT[order])
        if order == 0:
            key = (level_of(self.h, levels).astype(np.uint64) << U(56)) | (key >> U(8))
        return np.argsort((self.r.astype(np.uint64) << U(43)) | (key >> U(21)), kind="stable")

    def prefixes(self, order: int, levels: np.ndarray | None, num: int, den: int):
        """(place in h, row, position in the row) of the prefix tokens."""
        o = self.ordered(order, levels)
        pos = np.arange(len(o)) - self.first[self.r[o]]
        inside = pos < prefix_size(self.n[self.r[o]], num, den)
        return o[inside], self.r[o][inside], pos[inside]


def _number(keys: pa.Array) -> np.ndarray:
    """The first half of each key: an 8-byte number for candidates, which come back to whole keys before they are judged."""
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64)[0::2] if len(keys) else np.zeros(0, np.uint64)


def _tag(keys: pa.Array, ids: np.ndarray) -> np.ndarray:
    return W.mix(_number(keys) ^ W.mix(ids.view(np.uint64)))


def _ids(col) -> np.ndarray:
    return np.array(col.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def cell_bits(shingles: int) -> int:
    """The sketch's size for so many shingles."""
    return max(CELL_BITS, min(MOST_BITS, (max(1, shingles // PER_CELL) - 1).bit_length()))


def cells(df: DataFrame, values, bits: int, final=None) -> np.ndarray:
    """Counts of uint64 values by their leading bits, over all rows; as bytes by ``final`` if it is given."""
    return tally(df, lambda b: [v >> U(64 - bits) for v in values(b)], 1 << bits, final)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Levels, ``STEPS`` to a doubling: the tokens of one level stand in random order."""
    return np.minimum(np.round(STEPS * np.log2(counts + 1.0)), 255).astype(np.uint8)


def level_of(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(h >> U(65 - len(levels).bit_length())).astype(np.int64)]


def _signatures(size, num, den):
    def run(batches):
        for b in batches:
            data, off = W.utf8(b.column(1))
            for i, j in W.slices(off):
                s = Sets(data, off, i, j, size)
                keys = s.keys()
                ids = _ids(b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), b.column(2).slice(i, j - i), keys, _i64(_number(keys)), _i64(s.n), _i64(_tag(keys, ids)), s.sketches(num, den)], ["id", "hash", "key", "number", "n", "tag", "sketch"]
                )

    return run


def hot_level(mean: float) -> int:
    """The least level of a cell that is hot, by the mean count of a cell."""
    return int(levels_of(np.array([max(HOT_LEAST, HOT_TIMES * mean)]))[0])


def _postings(size, num, den, shared):
    """Prefix tokens under order 0 with the number of their class; hot tokens with a salt from 1 on."""

    def run(batches):
        levels, hot = shared.value
        for b in batches:
            data, off = W.utf8(b.column(0))
            for i, j in W.slices(off):
                s = Sets(data, off, i, j, size)
                number = _number(s.keys())
                at, row, pos = s.prefixes(0, levels, num, den)
                token = s.h[at]
                level = level_of(token, levels).astype(np.int64)
                salts = np.minimum(SALTS, 2 << np.minimum(16, np.maximum(0, level - hot) // STEPS)).astype(np.uint64)
                salt = np.where(level > hot, (W.mix(number[row]) % salts).astype(np.int64) + 1, 0)
                for k in range(0, len(at), 100_000):
                    m = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [_i64(token[m]), pa.array(salt[m].astype(np.int32)), _i64(number[row[m]]), pa.array(s.n[row[m]].astype(np.int32)), pa.array(pos[m].astype(np.int32))], ["token", "salt", "number", "n", "pos"]
                    )

    return run


POSTING = "token long, salt int, number long, n int, pos int"
EDGE = "kind int, a long, b long, token long, n int"
PAIR, STAR, AGAIN, TIED = 0, 1, 2, 3


def _candidates(num: int, den: int):
    """Edges from postings in the order of token, salt, n, number and pos, of which one open run is kept at most.

    PAIR: classes of a small run whose sizes and positions fit. STAR: a class of a larger run and the run's first.
    Under a salt, a run is the classes of one size, each TIED to its first; it also gives this one with its token, to be read AGAIN.
    """

    def run(batches):
        held, large = None, False  # rows of the run that was open when the last batch ended: all, or first and last if it is large
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            old = 0 if held is None else len(held[0])
            x = new if held is None else [np.concatenate(y) for y in zip(held, new)]
            token, salt, number, n, _ = x
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            once = np.concatenate([[True], ~(same & (n[1:] == n[:-1]) & (number[1:] == number[:-1]))])
            once[:old] = True
            x = [y[once] for y in x]
            token, salt, number, n, pos = x
            fits = np.where(salt[1:] > 0, n[1:] == n[:-1], den * n[:-1].astype(np.int64) >= num * n[1:].astype(np.int64))
            cut = np.concatenate([[True], ~((token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & fits)])
            if large:
                cut[1] = False
            start = np.flatnonzero(cut)
            of = np.cumsum(cut) - 1
            size = np.diff(np.append(start, len(token)))
            size[0] += FEW * large
            star = (size > FEW) | (salt[start] > 0)
            ends = np.ones(len(start), bool)
            ends[-1] = False
            yield from pairs(x, of, star, ends)
            first = start[of]
            m = star[of] & (np.arange(len(token)) != first)
            if m.any():
                yield edges(np.where(salt[m] > 0, TIED, STAR), number[m], number[first[m]], token[m], n[m])
            m = start[(salt[start] > 0) & (start >= old)]
            if len(m):
                yield edges(AGAIN, number[m], number[m], token[m], n[m])
            large = bool(star[-1])
            at = [start[-1], len(token) - 1] if large and size[-1] > 1 else np.arange(start[-1], len(token))
            large = large and len(at) == 2
            held = [y[at] for y in x]
        if held is not None and not large:
            yield from pairs(held, np.zeros(len(held[0]), np.int64), held[1][:1] > 0, np.ones(1, bool))

    def pairs(x, of, star, ends):
        """Of the small runs that have ended."""
        token, _, number, n, pos = x
        ok = (~star & ends)[of]
        for d in range(1, FEW):
            i = np.flatnonzero(ok[:-d] & (of[d:] == of[:-d])) if len(of) > d else []
            if not len(i):
                return
            j = i + d
            na, nb, pa_, pb = (v.astype(np.int64) for v in (n[i], n[j], pos[i], pos[j]))
            room = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
            i, j = (v[(den * na >= num * nb) & ((den + num) * room >= num * (na + nb)) & (number[i] != number[j])] for v in (i, j))
            if len(i):
                yield edges(PAIR, np.minimum(number[i], number[j]), np.maximum(number[i], number[j]), token[i], n[i])

    def edges(kind, a, b, token, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(token), pa.array(n)], ["kind", "a", "b", "token", "n"])

    return run


def _held(size, wanted, bits):
    """Whole sets of the rows whose tag may be wanted."""

    def run(batches):
        for b in batches:
            data, off = W.utf8(b.column(1))
            for i, j in W.slices(off):
                s = Sets(data, off, i, j, size)
                keys = s.keys()
                tags = _tag(keys, _ids(b.column(0).slice(i, j - i)))
                rows = np.flatnonzero(wanted.value[(W.mix(tags) >> U(64 - bits)).astype(np.int64)] & (s.n > 0))
                if len(rows):
                    for r in np.array_split(rows, len(rows) // 200 + 1):
                        if len(r):
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), _i64(tags[r]), pa.array(s.n[r].astype(np.int32)), _lists([s.h[s.first[x] : s.first[x + 1]] for x in r])], ["key", "tag", "n", "tokens"])

    return run


def _lists(parts: list) -> pa.Array:
    lens = np.array([len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), _i64(np.concatenate(parts)))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)), np.repeat(np.arange(len(lists)), lens)


def common(a: list, b: list) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of incidence matrices."""
    ta, ra = _flat(a)
    tb, rb = _flat(b)
    vocabulary = np.intersect1d(ta, tb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(vocabulary):
        return out
    place = lambda t: np.searchsorted(vocabulary, t).clip(max=len(vocabulary) - 1)
    pa_, pb = place(ta), place(tb)
    oka, okb = vocabulary[pa_] == ta, vocabulary[pb] == tb
    pa_, ra, pb, rb = pa_[oka], ra[oka], pb[okb], rb[okb]
    for c in range(0, len(vocabulary), COLUMNS):
        width = min(COLUMNS, len(vocabulary) - c)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        m = (pa_ >= c) & (pa_ < c + width)
        x[ra[m], pa_[m] - c] = 1
        m = (pb >= c) & (pb < c + width)
        y[rb[m], pb[m] - c] = 1
        out += x @ y.T
    return out


def _block(num, den, levels):
    """Labels of one pair of blocks: every set with the least key it is linked to through links between the blocks."""

    def run(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
        right = group.column("right").to_numpy(zero_copy_only=False).astype(bool)
        key = group.column("key").to_pylist()
        n = group.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = [np.asarray(x.values) for x in group.column("tokens")]
        orders = [Sets.of(tokens).prefix_lists(o, levels.value, num, den) for o in range(3)]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        pick = lambda lists, at: [lists[x] for x in at]
        small, large = np.minimum.outer(n[a], n[b]), np.maximum.outer(n[a], n[b])
        ok = den * small >= num * large
        for prefix in orders:
            ok &= common(pick(prefix, a), pick(prefix, b)) > 0
        link = np.zeros(ok.shape, bool)
        ra, rb = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if len(ra):
            both = np.rint(common(pick(tokens, a[ra]), pick(tokens, b[rb]))).astype(np.int64)
            link[np.ix_(ra, rb)] = den * both >= num * (n[a[ra]][:, None] + n[b[rb]][None, :] - both)
        link &= ok
        rank = np.empty(len(key), np.int64)
        order = sorted(range(len(key)), key=key.__getitem__)
        rank[order] = np.arange(len(key))
        none = np.iinfo(np.int64).max
        while True:
            before = rank.copy()
            if link.size:
                rank[a] = np.minimum(rank[a], np.where(link, rank[b][None, :], none).min(1))
                rank[b] = np.minimum(rank[b], np.where(link, rank[a][:, None], none).min(0))
            if (rank == before).all():
                break
        out = [(k, key[order[r]]) for k, r in zip(key, rank) if key[order[r]] != k]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return run


def links(docs: DataFrame, classes: DataFrame, shingles: int, size: int, num: int, den: int) -> DataFrame:
    """a, b: keys of classes, enough links to connect what is connected. ``docs``: doc_id, text, with so many shingles."""
    spark = docs.sparkSession
    sc = spark.sparkContext

    def grams(batch):
        data, off = W.utf8(batch.column(0))
        for i, j in W.slices(off):
            yield Sets(data, off, i, j, size).h

    levels = sc.broadcast(cells(docs.select("text"), grams, cell_bits(shingles), levels_of))
    shared = sc.broadcast((levels.value, hot_level(shingles / len(levels.value))))
    in_order = lambda p: p.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "number", "pos").mapInArrow(_candidates(num, den), EDGE)
    found = written(in_order(docs.select("text").mapInArrow(_postings(size, num, den, shared), POSTING)), "candidates")
    again = found.where(F.col("kind") == AGAIN).select("token", F.lit(0).alias("salt"), F.col("a").alias("number"), "n", F.lit(0).alias("pos"))
    again = written(in_order(again), "candidates")  # position 0 rules nothing out
    near = found.where(F.col("kind") == PAIR).select(F.col("a").alias("number_a"), F.col("b").alias("number_b")).distinct()
    named = lambda s, *more: classes.select(F.col("number").alias(f"number_{s}"), F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in more])
    whole = lambda edges, *more: edges.join(named("a", *more), "number_a").join(named("b", *more), "number_b").drop("number_a", "number_b")
    folded = written(classes.select("number", "n", "sketch").mapInArrow(_folded, "number long, n long, folded binary"), "folded")
    short = lambda s: folded.select(*[F.col(c).alias(f"{c}_{s}") for c in folded.columns])
    near = near.join(short("a"), "number_a").join(short("b"), "number_b").mapInArrow(_may_be_near(num, den), "number_a long, number_b long")
    near = written(near.distinct(), "near")  # once, though several classes may have a number
    pairs = written(whole(near, "n", "sketch").mapInArrow(_may_link(num, den), "a binary, b binary"), "pairs")
    tied = found.where(F.col("kind") == TIED).unionByName(again)
    tied = whole(tied.select(F.col("a").alias("number_a"), F.col("b").alias("number_b")).distinct())
    runs = found.where(F.col("kind") == STAR).select("token", "a", "b")
    runs = runs.unionByName(runs.select("token", F.col("b").alias("a"), "b")).distinct().join(classes.select(F.col("number").alias("a"), "key", "n", "sketch"), "a")
    stars = written(tied.unionByName(runs.groupBy("token", "b").applyInArrow(_split(num, den), "a binary, b binary").distinct()), "stars")
    drop(found, again, folded, near)
    groups = components(pairs.unionByName(stars), "groups")
    sized = groups.withColumnRenamed("node", "key").join(classes.select("key", "tag", "n"), "key")
    sizes = sized.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("held"))
    sizes = written(sizes.select("label", _blocks("sets", "held").alias("blocks")), "group-blocks")
    groups = written(sized.join(sizes, "label"), "groups")

    # the sets of the classes that are in a group, read again from the texts
    bits = 22
    wanted = cells(groups.select("tag"), lambda batch: [W.mix(batch.column(0).to_numpy().view(np.uint64))], bits) > 0
    held = docs.select("doc_id", "text").mapInArrow(_held(size, sc.broadcast(wanted), bits), "key binary, tag long, n int, tokens array<long>")
    mine = groups.select("key", F.col("tag").alias("__tag"), "label", "blocks")
    held = written(held.join(mine, "key").where("tag = __tag").drop("tag", "__tag").dropDuplicates(["key"]), "sets")
    shape = ("g", "i", "j", "left", "right", "key", "n", "tokens")
    one = held.where("blocks = 1").select(F.col("label").alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"), "key", "n", "tokens")
    block = _block(num, den, levels)
    found = written(one.groupBy("g", "i", "j").applyInArrow(block, "a binary, b binary"), "links")
    if not collected(sizes.where("blocks > 1").limit(1)):
        return found

    # larger groups: stars in blocks, other pairs one by one
    large = groups.where("blocks > 1").select("key")
    held = held.where("blocks > 1").drop("label", "blocks")
    inner = components(stars.join(large.withColumnRenamed("key", "a"), "a", "left_semi"), "stars")
    name = lambda c: inner.select(F.col("node").alias(c), F.col("label").alias(f"g_{c}"))
    pairs = pairs.join(large.withColumnRenamed("key", "a"), "a", "left_semi").join(name("a"), "a", "left").join(name("b"), "b", "left")
    pairs = written(pairs.where("g_a IS NULL OR g_b IS NULL OR g_a <> g_b").select("a", "b"), "pairs")
    side = lambda s: held.select(F.col("key").alias(s), F.col("tokens").alias(f"tokens_{s}"))
    verified = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(num, den, levels), "a binary, b binary")
    verified = written(verified, "verified")
    return found.unionByName(verified).unionByName(_star_links(held, inner, num, den, block, shape))


def _blocks(sets: str, tokens: str):
    return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(tokens) / BLOCK_TOKENS)).cast("int")


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _bins_fit(one, two, held, num, den):
    """Whether sets of ``held`` tokens together may be similar by their bins, or by sums of these, modulo 256."""
    apart = np.minimum(one - two, two - one).sum(1, dtype=np.int64)
    return (den + num) * apart <= (den - num) * held


def _sketches_fit(one, two, held, num, den):
    met = one[:, BINS:] & two[:, BINS:]
    return met[:, :BITMAP].any(1) & met[:, BITMAP:].any(1) & _bins_fit(one[:, :BINS], two[:, :BINS], held, num, den)


def _folded(batches):
    """number, n, and ``FOLDED`` sums of the bins, of classes with sketches."""
    for b in batches:
        bins = _bytes(b.column(2), BINS + 2 * BITMAP)[:, :BINS].reshape(b.num_rows, FOLDED, BINS // FOLDED).sum(2, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeBinaryArray.from_buffers(pa.binary(FOLDED), b.num_rows, [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())], ["number", "n", "folded"])


def _may_be_near(num, den):
    """Of pairs of numbers with sums of bins, those whose sets may be similar by them."""

    def run(batches):
        for x in batches:
            cols = dict(zip(x.schema.names, x.columns))
            held = cols["n_a"].to_numpy().astype(np.int64) + cols["n_b"].to_numpy()
            keep = pa.array(np.flatnonzero(_bins_fit(_bytes(cols["folded_a"], FOLDED), _bytes(cols["folded_b"], FOLDED), held, num, den)))
            yield pa.RecordBatch.from_arrays([cols["number_a"].take(keep), cols["number_b"].take(keep)], ["number_a", "number_b"])

    return run


def _split(num, den):
    """The sets of one run, each with the first found of its component by what their sizes and sketches leave of all pairs.

    A run is of a token that is not hot, so it is bounded by the count from which tokens are; a set that has its component is compared no more.
    """

    def run(group: pa.Table) -> pa.Table:
        key, n = group.column("key").to_pylist(), group.column("n").to_numpy().astype(np.int64)
        sketch = _bytes(group.column("sketch"), BINS + 2 * BITMAP)
        rest, out = np.argsort(n, kind="stable"), []
        while len(rest) > 1:
            first, rest = rest[0], rest[1:]
            reached = [first]
            for x in reached:
                fits = (den * np.minimum(n[x], n[rest]) >= num * np.maximum(n[x], n[rest])) & _sketches_fit(sketch[x : x + 1], sketch[rest], n[x] + n[rest], num, den)
                reached += rest[fits].tolist()
                rest = rest[~fits]
            out += [(key[x], key[first]) for x in reached[1:]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return run


def _may_link(num, den):
    """Of pairs with their sets' sizes and sketches, those whose sets may be similar: prefixes that meet under orders 1 and 2, and bins near enough."""

    def run(batches):
        for x in batches:
            cols = dict(zip(x.schema.names, x.columns))
            one, two = (_bytes(cols[c], BINS + 2 * BITMAP) for c in ("sketch_a", "sketch_b"))
            held = cols["n_a"].to_numpy().astype(np.int64) + cols["n_b"].to_numpy()
            keep = pa.array(np.flatnonzero(_sketches_fit(one, two, held, num, den)))
            yield pa.RecordBatch.from_arrays([cols["a"].take(keep), cols["b"].take(keep)], ["a", "b"])

    return run


def _verify(num, den, levels):
    """Of pairs with their sets, those that pass the filters of all orders and are similar."""

    def run(batches):
        for x in batches:
            cols = dict(zip(x.schema.names, x.columns))
            one, two = ([np.asarray(v.values) for v in cols[c]] for c in ("tokens_a", "tokens_b"))
            ok = np.ones(x.num_rows, bool)
            for o in range(3):
                pa_, pb = (Sets.of(t).prefix_lists(o, levels.value, num, den) for t in (one, two))
                ok &= np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(pa_, pb)], bool)
            for k in np.flatnonzero(ok):
                both = len(np.intersect1d(one[k], two[k], assume_unique=True))
                ok[k] = den * both >= num * (len(one[k]) + len(two[k]) - both)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([cols["a"].take(keep), cols["b"].take(keep)], ["a", "b"])

    return run


def _star_links(held: DataFrame, inner: DataFrame, num: int, den: int, block, shape) -> DataFrame:
    sets = held.join(inner.select(F.col("node").alias("key"), F.col("label").alias("g")), "key")
    sizes = sets.groupBy("g").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("held"), F.min(F.struct("n", "key")).alias("lead"))
    sizes = written(sizes.select("g", F.col("lead.key").alias("lead"), _blocks("sets", "held").alias("blocks")), "group-sizes")
    sets = sets.join(sizes, "g")
    one = sets.where("blocks = 1").select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"), "key", "n", "tokens")

    # several blocks: distance of each set from its group's leader, which is there once for each salt
    some = sets.where("blocks > 1").withColumn("salt", F.abs(F.xxhash64("key")) % F.col("blocks"))
    leaders = held.join(sizes.where("blocks > 1").select(F.col("lead").alias("key"), "g", "blocks"), "key")
    leaders = leaders.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("salt"), F.col("tokens").alias("lead_tokens"))
    far = some.join(leaders, ["g", "salt"])
    apart = F.col("n") + F.size("lead_tokens") - 2 * F.size(F.array_intersect("tokens", "lead_tokens"))
    far = written(far.select("g", "key", ((den + num) * apart - (den - num) * F.col("n")).cast("long").alias("w")), "distances")
    nearest = far.groupBy("g").agg(F.min(F.struct("w", "key")).alias("s"))
    far = written(far.join(nearest, "g").select("g", "key", F.col("s.key").alias("s"), (F.col("w") + F.col("s.w") <= 0).alias("near")), "near")
    sure = far.where("near").select(F.col("key").alias("a"), F.col("s").alias("b"))

    # the others meet all blocks: their own ones and those of the near sets
    rest = far.groupBy("g").agg(F.count_if(~F.col("near")).alias("open"), F.count(F.lit(1)).alias("all"))
    some = some.drop("salt").join(far.select("g", "key", "near"), ["g", "key"]).join(rest, "g").where("open > 0")
    share = lambda c: F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col(c) / F.col("all"))).cast("int")
    some = some.withColumns({"k_open": share("open"), "k_near": F.when(F.col("all") > F.col("open"), F.greatest(F.lit(1), F.ceil(F.col("blocks") * (F.col("all") - F.col("open")) / F.col("all"))).cast("int")).otherwise(0)})
    some = some.withColumn("at", F.pmod(F.xxhash64("key"), F.when(F.col("near"), F.col("k_near")).otherwise(F.col("k_open"))).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("k_open") - 1), lambda t: F.struct(F.least("at", t).alias("i"), F.greatest("at", t).alias("j"), (F.col("at") <= t).alias("left"), (F.col("at") >= t).alias("right")))
    others = F.when(F.col("k_near") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("k_near"), F.lit(1)) - 1), lambda t: F.struct(F.col("at").alias("i"), (-1 - t).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))))
    met = F.transform(F.sequence(F.lit(0), F.col("k_open") - 1), lambda t: F.struct(t.alias("i"), (-1 - F.col("at")).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    where = F.when(F.col("near"), met).otherwise(F.concat(own, F.coalesce(others, F.filter(own, lambda _: F.lit(False)))))
    more = some.withColumn("x", F.explode(where)).select("g", "x.i", "x.j", "x.left", "x.right", "key", "n", "tokens")
    found = one.unionByName(more).select(*shape).groupBy("g", "i", "j").applyInArrow(block, "a binary, b binary")
    return written(found.unionByName(sure), "group-links")


def similar(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """id, hash (of the text), n_shingles, component (least id) for each row of ``docs`` (doc_id, text); a null doc_id is ``NO_ID``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.select("*", F.xxhash64("text").alias("hash")).mapInArrow(_signatures(size, num, den), "id long, hash long, key binary, number long, n long, tag long, sketch binary"), "signatures")
    with drop_all_but() as keep:
        classes = written(rows.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "tag", "number", "n", "sketch")).alias("rep")).select("key", "rep.*"), "classes")
        shingles = collected(rows.agg(F.coalesce(F.sum("n"), F.lit(0))))[0][0]
        labels = components(links(docs, classes, shingles, size, num, den))
        labelled = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("label", "key").alias("label"))
        labelled = written(labelled, "labelled")
        least = written(labelled.groupBy("label").agg(F.min("id").alias("component")), "least")
        by_key = keep(written(labelled.join(least, "label").select("key", "component"), "by-key"))
    out = rows.drop("sketch").join(by_key, "key", "left")
    return out.select("id", "hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that a document with a lower doc_id is connected to; repeated rows stay once.

    Texts go through one exchange, where the key of a row that stays meets them and rows that repeat stand side by side.
    """
    kept = similar(docs, size, num, den).where("id = component").select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    kept = written(kept.distinct(), "kept")
    mine, own = hidden(docs)
    keyed = mine.withColumns({"__id": F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(NO_ID)), "__hash": F.xxhash64(own["text"])})
    return keyed.join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*[F.col(own[c]).alias(c) for c in docs.columns])


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = similar(table(spark, sf_dir, "documents"), 3, 90, 100)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("id").alias("doc_id"), "n_shingles", known("component").alias("component_id"))
