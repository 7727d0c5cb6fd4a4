"""Op 5: scores by a Brown class-based bigram model with exchange clustering.

Training documents are those whose crc32(doc_id as text) mod ``FOLDS`` is not
``HELD_OUT``. Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lowered) and one end
of text; a text starts as after an end.

* Word counts over all training texts, by 64-bit word hashes, in one table.
* Start: the ``HEAD`` most frequent words one by one, and all other words by
  the hash of their last three bytes, in ``TAIL`` units. Unit bigrams of all
  training texts are counted into one matrix, and exchange clustering puts the
  units in classes: they start by frequency, and each in turn moves to the class
  that raises the class-bigram likelihood most, until a sweep raises it by less
  than ``GAIN`` nats a token. There are as many classes as the cube root of the words clustered.
* Middle words, all others that occur ``LEAST`` times or more, start in their
  ending's class. Their bigrams stand in a table by word; a sweep over it moves
  each word of one half to its best class against the class totals, and holds
  where the likelihood of all bigrams rises; it ends when a sweep over both
  halves raises it by less than ``GAIN`` nats a token. Rarer words keep their ending's class.
* Score: log10 P(class | last class) + log10 P(word | class). Transitions are
  interpolated with class frequencies; emissions get 1/2 added to each count
  and to one unknown word in each class, so the probabilities sum to one.

Counts of the ``SCORED`` most frequent words are broadcast (bounded); a text's
other words meet their counts in a join.

Defined cases: null text is an empty one (just the end); a null doc_id counts
as remainder 0; repeated rows are scored alike, and each trains; words that tie
in frequency stand in the order of their hashes; a text of any length is scored
whole; without training texts every token has the probability that smoothing
alone gives; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import _words as W
from marlstone.llm._shared import drop, table, written
from marlstone.llm._tally import tally

U = np.uint64
FOLDS, HELD_OUT = 5, 1
HEAD, TAIL_BITS, CLASSES, SCORED = 1024, 10, 64, 1 << 19
TAIL = 1 << TAIL_BITS
BASE = HEAD + TAIL  # the first middle word's unit
LEAST, BUCKET, FLUSH = 5, 1 << 20, 1 << 21
GAIN = 0.01  # nats a token that a sweep must raise the likelihood by for another one to follow
END = U(0x454E44)
BACK = 4.0  # transitions: counts that the class frequencies are worth


def _endings(w: W.Words) -> np.ndarray:
    """Tail unit (0 .. TAIL - 1) of every word: its last three bytes."""
    n = w.ends - w.starts
    d = w.data.astype(np.uint64) if len(w.data) else np.zeros(1, np.uint64)
    v = d[w.ends - 1] if len(n) else np.zeros(0, np.uint64)
    for k in (2, 3):
        v = v | np.where(n >= k, (d[np.maximum(w.ends - k, 0)] + U(1)) << U(9 * (k - 1)), U(0))
    return (W.mix(v) >> U(64 - TAIL_BITS)).astype(np.int64)


def _tokens(w: W.Words):
    """Hashes and tail units of words and ends in text order, with first[r] the place of row r's first token."""
    rows = len(w.first) - 1
    n = len(w.hash) + rows
    at = np.arange(len(w.hash)) + w.rows()
    h, ending = np.full(n, END), np.zeros(n, np.int64)
    h[at], ending[at] = w.hash, _endings(w)
    return h, ending, w.first + np.arange(rows + 1)


def _texts(batch, column: int = 0):
    data, off = W.utf8(batch.column(column))
    for i, j in W.slices(off):
        yield i, j, _tokens(W.Words(data, off, i, j, W.SPACED))


def _count(batches):
    for b in batches:
        parts = [(h, e) for _, _, (h, e, _) in _texts(b)]
        if parts:
            h, e = (np.concatenate(x) for x in zip(*parts))
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(e[at].astype(np.int32)), pa.array(n)], ["h", "ending", "n"])


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(keys, h).clip(max=len(keys) - 1)
    return at, keys[at] == h


class Units:
    """Head words (sorted hashes) have units 0 .. HEAD - 1 in that order, endings those up to BASE - 1, middle words the rest."""

    def __init__(self, head: np.ndarray, middle: np.ndarray = np.zeros(0, np.uint64)):  # noqa: B008
        self.head, self.middle = np.sort(head), np.sort(middle)

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at, known = _find(self.head, h)
        u = np.where(known, at, HEAD + ending)
        at, known = _find(self.middle, h)
        return np.where(known, BASE + at, u)


def classes_for(words: int) -> int:
    return max(CLASSES, round(words ** (1 / 3)))


def exchange(pairs: np.ndarray, classes: int = CLASSES, least: float | None = None) -> np.ndarray:
    """Class of each unit, from counts of unit bigrams (a square matrix); sweeps go on while each gains ``least`` nats a token."""
    size = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    cls = np.empty(size, np.int64)
    cls[order] = np.arange(size) % classes
    one = np.zeros((size, classes))
    one[np.arange(size), cls] = 1
    to, frm = pairs @ one, pairs.T @ one  # counts of a unit before / after each class
    n = one.T @ to
    f = lambda x: x * np.log(np.maximum(x, 1))
    least, moved = (GAIN if least is None else least) * pairs.sum(), True
    while moved:
        moved, gained = False, 0.0
        for u in order:
            if not weight[u]:
                break
            a, self_pair = cls[u], pairs[u, u]
            t, s = to[u].copy(), frm[u].copy()
            # counts without u
            n[a] -= t
            n[:, a] -= s
            n[a, a] += self_pair
            t[a] -= self_pair
            s[a] -= self_pair
            # what comes before u ends in it whichever class it is in, and so with what follows it
            rows, cols = n.sum(1) + s, n.sum(0) + t
            # likelihood gain of putting u into each class b
            gain = (f(n + t) - f(n)).sum(1) + (f(n + s[:, None]) - f(n)).sum(0)
            d = np.diag(n)
            gain += f(d + t + s + self_pair) - f(d + t) - f(d + s) + f(d)
            gain -= f(rows + t.sum() + self_pair) - f(rows) + f(cols + s.sum() + self_pair) - f(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += t
            n[:, b] += s
            n[b, b] += self_pair
            if b != a:
                moved, gained = True, gained + gain[b] - gain[a]
                cls[u] = b
                to[:, a] -= pairs[:, u]
                to[:, b] += pairs[:, u]
                frm[:, a] -= pairs[u]
                frm[:, b] += pairs[u]
        if gained < least:
            break
    return cls


def _f(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    return float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())


def _zip(code: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes and their counts, bytes of equal weight side by side."""
    planes = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return zlib.compress(planes(np.diff(code, prepend=0)) + planes(n.astype(np.int32)), 1)


def _unzip(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(12, -1)
    whole = lambda x, t: np.ascontiguousarray(x.T).view(t).ravel()
    return np.cumsum(whole(raw[:8], np.int64)), whole(raw[8:], np.int32).astype(np.int64)


def _follow(units, buckets: int):
    """Bigrams that hold a middle word, once for each such word: 33 bits from its place on, the other unit and which one comes first."""

    def rows(parts):
        last, u = (np.concatenate(x) for x in zip(*parts))
        a, z = last >= BASE, u >= BASE
        code, n = np.unique(np.concatenate([(last[a] - BASE << 33) + 2 * u[a], (u[z] - BASE << 33) + 2 * last[z] + 1]), return_counts=True)
        bucket = (code >> 33) % buckets
        o = np.argsort(bucket, kind="stable")
        some, at = np.unique(bucket[o], return_index=True)
        out = [(int(b), _zip(code[i], n[i])) for b, i in zip(some, np.split(o, at[1:]))] if len(o) else []
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], ["bucket", "data"])

    def run(batches):
        of = units.value.of
        end = of(np.array([END]), np.zeros(1, np.int64))
        held, size = [], 0
        for b in batches:
            for _, _, (h, e, _) in _texts(b):
                u = of(h, e)
                held.append((np.concatenate([end, u[:-1]]) if len(u) else u, u))
                size += len(u)
                if size >= FLUSH:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _merge(t: pa.Table) -> pa.Table:
    code, n = (np.concatenate(x) for x in zip(*(_unzip(d) for d in t.column("data").to_pylist())))
    code, at = np.unique(code, return_inverse=True)
    return pa.table({"data": pa.array([_zip(code, np.bincount(at, n).astype(np.int64))], pa.binary())})


def _bigrams(batches):
    """Place of the middle word, the other unit, whether the other comes first, and the count."""
    for b in batches:
        for d in b.column(0):
            code, n = _unzip(d.as_py())
            yield code >> 33, (code >> 1) & 0xFFFFFFFF, (code & 1).astype(bool), n


def class_counts(bigrams: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class bigrams that hold a middle word."""
    shared = bigrams.sparkSession.sparkContext.broadcast(cls)

    def run(batches):
        cls, total = shared.value, np.zeros(classes * classes)
        for key, other, first, n in _bigrams(batches):
            x, y = cls[BASE + key], cls[other]
            once = ~first | (other < BASE)  # two middle words stand under both
            total += np.bincount(np.where(first, y * classes + x, x * classes + y)[once], n[once], len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["at", "n"])

    out = np.zeros(classes * classes)
    for r in bigrams.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(classes, classes)


def _joining(t: np.ndarray, n: np.ndarray, small: int = 8) -> np.ndarray:
    """Growth of sum f(n[b]) when each row of counts ``t`` joins each class b."""
    out = np.zeros(t.shape)
    for k in range(1, small + 1):
        out += (t == k).astype(np.float32) @ (_f(n + k) - _f(n)).T.astype(np.float32)
    row, col = np.nonzero(t > small)
    for i in range(0, len(row), 1 << 14):
        r, c = row[i : i + (1 << 14)], col[i : i + (1 << 14)]
        grown = _f(n.T[c] + t[r, c][:, None]) - _f(n.T[c])
        some, at = np.unique(r, return_index=True)
        out[some] += np.add.reduceat(grown, at)
    return out


def best_classes(t: np.ndarray, s: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class for words with counts ``t`` of classes that follow and ``s`` of classes before, which now are in ``own``."""
    rows, cols, ts, ss = n.sum(1), n.sum(0), t.sum(1), s.sum(1)
    gain = _joining(t, n) + _joining(s, n.T) - _f(rows + ts[:, None]) + _f(rows) - _f(cols + ss[:, None]) + _f(cols)
    stay = (_f(n[own]) - _f(n[own] - t) + _f(n.T[own]) - _f(n.T[own] - s)).sum(1)
    stay -= _f(rows[own]) - _f(rows[own] - ts) + _f(cols[own]) - _f(cols[own] - ss)
    gain[np.arange(len(own)), own] = stay
    best = gain.argmax(1)
    return np.where(gain[np.arange(len(own)), best] > stay + 1e-3, best, own)


def moves(bigrams: DataFrame, cls: np.ndarray, n: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Middle words of one half that have a better class, and that class."""
    shared = bigrams.sparkSession.sparkContext.broadcast((cls, n))

    def run(batches):
        cls, n = shared.value
        size = len(n)
        for key, other, first, k in _bigrams(batches):
            mine = (W.mix(key.astype(np.uint64)) & U(1)) == U(half)
            key, other, first, k = key[mine], other[mine], first[mine], k[mine]
            words, at = np.unique(key, return_index=True)
            edges = np.append(at, len(key))
            for i in range(0, len(words), 4096):
                w = words[i : i + 4096]
                part = slice(edges[i], edges[i + len(w)])
                cell = np.searchsorted(w, key[part]) * size + cls[other[part]]
                t, s = (np.bincount(cell[x], k[part][x], len(w) * size).reshape(len(w), size) for x in (~first[part], first[part]))
                own = cls[BASE + w].astype(np.int64)
                best = best_classes(t, s, own, n)
                new = np.flatnonzero(best != own)
                yield pa.RecordBatch.from_arrays([pa.array([w[new].tobytes()], pa.binary()), pa.array([best[new].tobytes()], pa.binary())], ["word", "class"])

    rows = bigrams.mapInArrow(run, "word binary, class binary").collect()
    return tuple(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[x], np.int64) for r in rows)]) for x in ("word", "class"))


def sweep(bigrams: DataFrame, cls: np.ndarray, n: np.ndarray, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and counts of class bigrams after the sweeps over middle words; ``n`` are the counts before.

    The halves take turns until two in a row raise the likelihood by less than ``least`` nats a token together.
    """
    least = (GAIN if least is None else least) * n.sum()
    fixed = n - class_counts(bigrams, cls, len(n))
    now, gains = likelihood(n), [np.inf]
    while sum(gains[-2:]) >= least:
        words, best = moves(bigrams, cls, n, (len(gains) - 1) % 2)
        gains.append(0.0)
        if len(words):
            new = cls.copy()
            new[BASE + words] = best
            counts = fixed + class_counts(bigrams, new, len(n))
            after = likelihood(counts)
            if after > now:
                gains[-1] = after - now
                cls, n, now = new, counts, after
    return cls, n


class Model:
    """Everything that scoring needs beside the counts of rare words; its size follows the vocabulary of ``LEAST`` occurrences or more."""

    def __init__(self, units: Units, cls, n, words, counts, total, vocabulary, keys, known):
        self.units, self.cls = units, cls
        of_class = np.bincount(cls, counts, len(n)) + 0.5 * (np.bincount(cls, words, len(n)) + 1)
        unigram = of_class / of_class.sum()
        self.step = np.log10((n + BACK * unigram) / (n.sum(1, keepdims=True) + BACK))
        self.out = np.log10(of_class)
        self.total, self.base = total, float(np.log10(total + 0.5 * (vocabulary + 1)))
        self.keys, self.known = keys, known
        self.end = int(units.of(np.array([END]), np.zeros(1, np.int64))[0])


def _pack(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in b.columns], b.schema.names)


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words: whole levels of frequency, up to ``most`` words."""
    level = F.floor(8 * F.log2("n")).cast("int")
    n, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        n += r["words"]
        if n > most:
            break
        least = r["level"]
    rows = [] if least is None else counts.where(level >= least).select("h", "n").mapInArrow(_pack, "h binary, n binary").collect()
    keys = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["h"], np.int64) for r in rows)]).astype(np.int64).view(np.uint64)
    known = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["n"], np.int64) for r in rows)]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], known[order]


def middle_words(counts: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the middle words, their endings and counts."""
    rows = counts.where(F.col("n") >= LEAST).select("h", "ending", "n").mapInArrow(_pack, "h binary, ending binary, n binary").collect()
    h, ending, n = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[x], np.int64) for r in rows)]) for x in ("h", "ending", "n"))
    h = h.view(np.uint64)
    o = np.argsort(h)
    o = o[~_find(units.head, h[o])[1]]
    return h[o], ending[o], n[o]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of word counts (h, n). ``docs``: the training texts, one column ``text``."""
    spark = docs.sparkSession
    counts = written(docs.mapInArrow(_count, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "word-counts")
    keys, known = frequent(counts, SCORED)
    units = Units(keys[np.lexsort((keys, -known))[:HEAD]])
    middle, ending, seen = middle_words(counts, units)
    shared = spark.sparkContext.broadcast(units)

    def bigrams(batch):
        size = HEAD + TAIL
        for _, _, (h, e, first) in _texts(batch):
            u = shared.value.of(h, e)
            last = np.concatenate([shared.value.of(np.array([END]), np.zeros(1, np.int64)), u[:-1]])
            if len(u):
                yield last * size + u

    size = HEAD + TAIL
    pairs = tally(docs, bigrams, size * size).reshape(size, size).astype(np.float64)
    # words and tokens of each unit
    head = pa.array(units.head.view(np.int64)).to_pylist()
    tails = counts.where(F.col("n") < LEAST)
    tails = tails.where(~F.col("h").isin(head)) if head else tails
    words, tokens = np.zeros(size), np.zeros(size)
    for r in tails.groupBy("ending").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect():
        words[HEAD + r["ending"]], tokens[HEAD + r["ending"]] = r["words"], r["n"]
    place, there = _find(keys, units.head)
    words[: len(units.head)], tokens[: len(units.head)] = 1, known[place]
    words, tokens = np.append(words, np.ones(len(middle))), np.append(tokens, seen)
    classes = classes_for(len(units.head) + len(middle))
    cls = exchange(pairs, classes)
    one = np.eye(classes)[cls]
    n = one.T @ pairs @ one
    cls = np.append(cls, cls[HEAD + ending])
    units = Units(units.head, middle)
    if len(middle):
        buckets = 1 + int(tokens.sum()) // BUCKET
        pieces = docs.mapInArrow(_follow(spark.sparkContext.broadcast(units), buckets), "bucket int, data binary")
        bigrams = written(pieces.groupBy("bucket").applyInArrow(_merge, "data binary"), "bigrams")
        cls, n = sweep(bigrams, cls, n)
        drop(bigrams)
    return Model(units, cls, n, words, tokens, int(tokens.sum()), int(words.sum()), keys, known), counts.select("h", "n")


def _score(model):
    def run(batches):
        for b in batches:
            m = model.value
            for i, j, (h, e, first) in _texts(b, 1):
                cls = m.cls[m.units.of(h, e)]
                last = np.concatenate([[m.cls[m.end]], cls[:-1]]) if len(cls) else cls
                at, known = _find(m.keys, h)
                rare = ~known
                n = np.where(known, m.known[at] if len(m.known) else 0, 0)
                word = np.where(known, np.log10(n + 0.5), 0.0)
                score = m.step[last, cls] + word - m.out[cls]
                base = word - m.base
                cut = lambda v: np.add.reduceat(v, first[:-1]) if len(first) > 1 else np.zeros(0)
                row = np.repeat(np.arange(j - i), np.diff(first))[rare]
                hr = h[rare]
                o = np.lexsort((hr, row))
                row, hr = row[o], hr[o]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hr[1:] != hr[:-1])])) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([new, [len(row)]]))
                offsets = pa.array(np.searchsorted(row[new], np.arange(j - i + 1)).astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(hr[new].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "k"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.array(cut(known.astype(np.int64)).astype(np.int64)), pa.array(cut(base)), pa.array(cut(score)), pa.ListArray.from_arrays(offsets, pairs)],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0))
    d = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("id"), "text", (fold == HELD_OUT).alias("held_out"))
    model, counts = train(d.where(~F.col("held_out")).select("text"))
    kind = d.schema["id"].dataType.simpleString()
    out = d.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,k:int>>")
    out = written(out, "scores")
    # rare words: log10(c + 1/2) each; rows that repeat bring the same words, so what they bring is shared among them
    rare = out.select("id", F.explode("rare").alias("x")).select("id", "x.h", "x.k")
    rare = rare.join(counts.withColumnsRenamed({"h": "__h", "n": "c"}), F.col("h") == F.col("__h"), "left")
    rows = out.where(F.size("rare") > 0).select("id", F.lit(0).alias("known"), F.lit(0.0).alias("more"), F.lit(1).alias("copies"))
    words = rare.select("id", F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0).alias("known"), (F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.lit(0).alias("copies"))
    more = words.unionByName(rows).groupBy("id").agg(F.sum("known").alias("known"), F.sum("more").alias("more"), F.sum("copies").alias("copies"))
    more = more.withColumns({"known": F.expr("known div copies"), "more": F.col("more") / F.col("copies")})
    more = written(more.select(F.col("id.doc_id").alias("__doc"), F.col("id.hash").alias("__hash"), "known", "more"), "rare-scores")
    j = out.drop("rare").join(more, F.col("id.doc_id").eqNullSafe(F.col("__doc")) & (F.col("id.hash") == F.col("__hash")), "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return j.select("id.doc_id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base_score", "more"), plus("score", "more"))


def op5_class_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
