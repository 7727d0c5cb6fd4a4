"""Op 13: runs of repeated words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends; those of at least ``min_length`` words and
``min_exponent`` periods are wanted. Each text is worked on by itself, whole, in
the task that reads it; nothing is exchanged.

* Stretches. A run of L words repeats its first L - q words q words later, so it
  lies where every word is covered by windows of ``min_length`` - ``min_length``
  / ``min_exponent`` words found again in the same text. The method works on
  these stretches, many at a time; stretches share no symbol, so none meets
  another, and all else holds no run.
* Suffix tree. Words are named, then stretches of 1, 2, 4 ... words by pairs of
  names, until all differ: that gives the order of suffixes, whose intervals are
  the nodes of the suffix tree, and compares any two places both ways in as many
  steps as there are levels.
* Phase 1. Lempel-Ziv blocks, each the longest stretch that starts earlier too.
  For each block, the common extensions at its borders give squares that cover
  the leftmost occurrence of every square.
* Phase 2. From each such square a walk along suffix links, which lead to the
  node of the square one word on, marks the vocabulary: all squares, by node. It
  ends where the occurrence does, or where all rotations have been marked.
* Phase 3. The suffixes below the marked nodes are all occurrences of squares;
  those of one period that start side by side merge into runs. Squares whose half
  is itself a power are left out, so the period is the smallest.

Words stand for 64-bit hashes of their bytes. The squares' occurrences are
O(n log n) for n words, so memory follows the longest text.

Defined cases: null, empty and wordless texts have no runs and collapse to the
empty text; a text of any length is worked on whole; rows that share a doc_id
are texts of their own; null ids are ids like others; an empty table gives an
empty result; other columns, whatever their names, come out as they went in.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import hidden, table
from marlstone.llm._words import SPACED, U, Words, grams, mix, slices, utf8

BATCH_WORDS = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Order of suffixes of a sequence of symbols, with names of all stretches of 2**j symbols.

    ``name[j][i]`` is the left end, among the suffixes in order, of those that begin with
    the 2**j symbols from i on. Names of stretches cut by the end differ from all others.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        s = symbols[order]
        new = np.ones(n, bool)
        new[1:] = s[1:] != s[:-1]
        name = np.empty(n + 1, np.int64)
        name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        name[n] = -1
        self.name = [name]
        at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that are not settled
        h = 1
        while len(at):
            a = order[at]
            key = name[a] * (n + 1) + name[np.minimum(a + h, n)] + 1
            by = np.argsort(key, kind="stable")
            order[at] = a = a[by]
            key = key[by]
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            name = name.copy()
            name[a] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.name.append(name)
            at = at[~(new & np.append(new[1:], True))]
            h *= 2
        self.order, self.rank = order, name
        self.table = np.concatenate(self.name)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are the same (a and b differ)."""
        a, b = a.copy(), b.copy()
        began = a.copy()
        for j in range(len(self.name) - 1, -1, -1):
            same = self.name[j][a] == self.name[j][b]
            a += same << j
            b += same << j
        return a - began

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a and before b are the same (a and b differ)."""
        a, b = a.copy(), b.copy()
        began = a.copy()
        for j in range(len(self.name) - 1, -1, -1):
            w = 1 << j
            there = (a >= w) & (b >= w)
            same = there & (self.name[j][np.maximum(a - w, 0)] == self.name[j][np.maximum(b - w, 0)])
            a -= same << j
            b -= same << j
        return began - a

    def same(self, a: np.ndarray, b: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` symbols from a and b on are the same; 2**j is the largest power up to length."""
        row = j * (self.n + 1)
        off = length - (1 << j)
        inside = np.maximum(a, b) + length <= self.n
        a2, b2 = np.minimum(a + off, self.n), np.minimum(b + off, self.n)
        return (a == b) | (inside & (self.table[row + a] == self.table[row + b]) & (self.table[row + a2] == self.table[row + b2]))

    def node(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of the ``length`` symbols from ``start`` on: the first and last place of its suffixes in the order."""
        level = np.int64(len(self.name) - 1)
        j = np.minimum(np.int64(np.log2(length)), level)
        full = (1 << j) * 2 > length  # else longer than any repeat: a leaf
        r = self.rank[start]
        low, high = np.where(full, self.name_at(j, start), r), r.copy()
        while True:  # the first place whose suffix agrees
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high) // 2
            ok = self.same(self.order[mid], start, j, length)
            high = np.where(open_ & ok, mid, high)
            low = np.where(open_ & ~ok, mid + 1, low)
        left = high.copy()
        low, high = r.copy(), np.where(full, self.n - 1, r)
        while True:  # and the last
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high + 1) // 2
            ok = self.same(self.order[mid], start, j, length)
            low = np.where(open_ & ok, mid, low)
            high = np.where(open_ & ~ok, mid - 1, high)
        return left, low

    def name_at(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.table[j * (self.n + 1) + i]


def _blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    n = tree.n
    before, after, stack = [n] * n, [n] * n, []  # neighbours in the order that start earlier
    for i in tree.order.tolist():
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else n
        stack.append(i)
    own = np.arange(n)
    longest = np.maximum(tree.ahead(own, np.array(before)), tree.ahead(own, np.array(after))).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += longest[i] or 1
    return np.array([*starts, n])


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of first[r], first[r] + 1, ... (counts[r] values) for every row r."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]


def _covering(tree: SuffixTree, symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, half) with half up to ``most`` that cover the leftmost occurrence of every square."""
    edges = _blocks(tree)
    h, h1 = edges[:-1], edges[1:]
    h2 = np.append(edges[2:], tree.n)
    symbols = np.append(symbols, -1)
    out = []
    # halves that end at the block's end or within it, seen from the next block
    row, k = _spread(np.ones(len(h), np.int64), np.minimum(h1 - h, most))
    c = h1[row]
    q = c - k
    hit = (c < tree.n) & (symbols[c] == symbols[q])
    c, q, k = c[hit], q[hit], k[hit]
    right, left = tree.ahead(c, q), tree.behind(c, q)
    ok = right + left >= k
    out.append((np.maximum(q - left, q - k + 1)[ok], k[ok]))
    # squares around the block's start
    row, k = _spread(np.ones(len(h), np.int64), np.minimum(h2 - h, most))
    c = h[row]
    q = c + k
    hit = (c > 0) & (q < tree.n) & (symbols[c] == symbols[np.minimum(q, tree.n)]) & (symbols[c - 1] == symbols[np.minimum(q, tree.n) - 1])
    row, c, q, k = row[hit], c[hit], q[hit], k[hit]
    right, left = tree.ahead(c, q), tree.behind(c, q)
    start = np.maximum(c - left, c - k + 1)
    ok = (right + left >= k) & (start + k <= h1[row])
    out.append((start[ok], k[ok]))
    start, k = (np.concatenate(x) for x in zip(*out))
    once = np.unique(start * (tree.n + 1) + k)
    return once // (tree.n + 1), once % (tree.n + 1)


def _primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the square's half is no power of a shorter string."""
    ok = np.ones(len(k), bool)
    if not len(k):
        return ok
    factor = np.arange(int(k.max()) + 1)
    for f in range(2, int(len(factor) ** 0.5) + 1):
        if factor[f] == f:
            some = factor[f * f :: f]
            some[some == np.arange(f * f, len(factor), f)] = f
    rest = k.copy()
    while (on := np.flatnonzero(rest > 1)).size:
        f = factor[rest[on]]
        d = k[on] // f
        ok[on] &= tree.ahead(start[on], start[on] + d) < 2 * k[on] - d
        rest[on] //= f
    return ok


def repetitions(symbols: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of the runs of a sequence of symbols (integers from 0), by start, then period."""
    tree = SuffixTree(symbols)
    start, k = _covering(tree, symbols, tree.n // min_exponent)
    keep = _primitive(tree, start, k)
    start, k = start[keep], k[keep]
    # the walk: from a square's node by suffix link to that of the next, while the occurrence goes on, through k rotations at most
    row, at = _spread(start, np.minimum(tree.ahead(start, start + k) - k + 1, k))
    once = np.unique(k[row] * (tree.n + 1) + at)
    k, at = once // (tree.n + 1), once % (tree.n + 1)
    left, right = tree.node(at, 2 * k)
    mark = k * (tree.n + 1) + left
    _, once = np.unique(mark, return_index=True)
    k, left, right = k[once], left[once], right[once]
    # all occurrences, and what starts side by side
    row, place = _spread(left, right - left + 1)
    found = np.sort(k[row] * (tree.n + 1) + tree.order[place])
    cut = np.ones(len(found), bool)
    cut[1:] = found[1:] != found[:-1] + 1
    first = found[cut]
    last = found[np.append(cut[1:], True)] if len(found) else found
    period = first // (tree.n + 1)
    start, length = first % (tree.n + 1), last - first + 2 * period
    keep = length >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _stretches(words: Words, window: int) -> list[tuple[int, int, int]]:
    """row, first and end word of the stretches covered by windows that their text holds twice."""
    g = grams(words.hash, window)
    row = words.rows()
    n = len(g)
    if not n:
        return []
    own = np.flatnonzero(row[:n] == row[window - 1 :])
    key = mix(g[own] ^ mix(row[own].astype(U) + U(1)))
    by = np.argsort(key)
    s = key[by]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= s[1:] == s[:-1]
    at = own[by[twin]]
    if not len(at):
        return []
    depth = np.zeros(len(row) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + window, -1)
    covered = np.cumsum(depth)[:-1] > 0
    edge = np.ones(len(row), bool)
    edge[1:] = (covered[1:] != covered[:-1]) | (row[1:] != row[:-1])
    firsts = np.flatnonzero(edge)
    ends = np.append(firsts[1:], len(row))
    return [(int(row[a]), int(a), int(b)) for a, b in zip(firsts[covered[firsts]], ends[covered[firsts]])]


def _solve(stretches: list, found: dict, min_length: int, min_exponent: int) -> None:
    """Adds the runs of stretches (row, first word, hashes) to ``found``: lists of (start, length, period) by row."""
    if not stretches:
        return
    sizes = np.array([len(x[2]) for x in stretches])
    _, word = np.unique(np.concatenate([x[2] for x in stretches]), return_inverse=True)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    _, symbols = np.unique(unit * len(word) + word, return_inverse=True)  # no symbol in two stretches
    start, length, period = repetitions(symbols, min_length, min_exponent)
    begin = np.cumsum(sizes) - sizes
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()):
        row, first, _ = stretches[unit[s]]
        found.setdefault(row, []).append((int(s - begin[unit[s]] + first), n, p))


def _batch(column, min_length: int, min_exponent: int) -> tuple[list, dict]:
    """The number of words of each text, and the runs of those that have some."""
    data, offsets = utf8(column)
    window = min_length - min_length // min_exponent
    counts, found, pool, held = [], {}, [], 0
    for i, j in slices(offsets):
        words = Words(data, offsets, i, j, SPACED, lower=False)
        counts += np.diff(words.first).tolist()
        for row, a, b in _stretches(words, window):
            pool.append((i + row, a - int(words.first[row]), words.hash[a:b]))
            held += b - a
        if held >= BATCH_WORDS:
            _solve(pool, found, min_length, min_exponent)
            pool, held = [], 0
    _solve(pool, found, min_length, min_exponent)
    return counts, {r: sorted(x, key=lambda x: (x[0], x[2])) for r, x in found.items()}


def _collapsed(text: bytes, runs: list) -> bytes:
    words = text.split()
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = compress(words, keep.tolist())
    return b" ".join(words)


def with_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``docs`` (text) with n_words, runs (by start, then period; word numbers from 0) and collapsed: the words that no run holds after its first period, joined by one space."""
    mine, own = hidden(docs)

    def work(batches):
        for b in batches:
            text = b.column(own_text)
            counts, found = _batch(text, min_length, min_exponent)
            lists = [found.get(r, []) for r in range(len(counts))]
            flat = np.array([x for runs in lists for x in runs], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            short = [_collapsed(t or b"", runs) for t, runs in zip(text.cast(pa.binary()).to_pylist(), lists)]
            more = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(short, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "__n", "__runs", "__collapsed"])

    own_text = list(own).index("text")
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields] + ["__n bigint", f"__runs {RUNS}", "__collapsed string"])
    out = mine.mapInArrow(work, shape)
    return out.select(*[F.col(own[c]).alias(c) for c in docs.columns], F.col("__n").alias("n_words"), F.col("__runs").alias("runs"), F.col("__collapsed").alias("collapsed"))


def collapse_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``docs`` with its columns; texts that hold runs are collapsed, the others stay as they are."""
    own = docs.columns
    out = with_runs(docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")), min_length, min_exponent)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in own])


def strongest(runs: Column) -> Column:
    """Of runs by start, then period, the first with the greatest length / period; null if there are none."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text by its id's CRC-32 repeats a part of itself to the end: the runs to be found."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.expr("CAST(g % n AS INT)"))).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    again = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a))")
    return d.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark, sf_dir: str) -> DataFrame:
    out = with_runs(looped(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return out.select("doc_id", "n_runs", *best, F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
