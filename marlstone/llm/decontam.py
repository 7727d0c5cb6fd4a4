"""Op 9: benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of an item; an item with fewer words,
but not none, is one window. A window counts as found in a document where all
its words stand in a row (containment 1). At that threshold the necessary
prefix of a window, with its shingles ordered by rarity in the documents, is
its rarest shingle: a document without it cannot hold the window. So

1. one pass counts the benchmark's shingles in all documents;
2. each window keeps its rarest shingle, with the place it has in the window;
3. documents' shingles meet the kept ones; the place bounds the window to one
   position, which must lie inside the document (positional and length bound);
4. what is left is compared word by word, exactly.

The benchmark is read in blocks of at most ``BLOCK`` windows, whatever its
size; each block is a broadcast of bounded size, and all documents meet all
blocks. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lowered.

Defined cases: null texts have no words and are not contaminated; a null
item_id is dropped from the list of ids but its windows still hit; items or
documents that repeat are treated each on their own, ids are listed once; ties
in rarity go by hash; texts and items of any length are searched whole; an
empty benchmark leaves every document clean, an empty table of documents gives
an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import _words as W
from marlstone.llm._shared import hidden, table, written
from marlstone.llm._tally import tally

SIZE, SHINGLE, BLOCK, BLOCK_CHARS = 10, 3, 200_000, 8 << 20


def item_blocks(bench: DataFrame):
    """Lists of (item_id as string, text): items one after the other, in blocks of bounded characters."""
    block, chars = [], 0
    for r in bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        chars += len(r["t"])
        if chars >= BLOCK_CHARS or chars // 2 >= BLOCK * SIZE:
            yield block
            block, chars = [], 0
    if block:
        yield block


class Index:
    """Windows of a block of items: words, hashes and, after ``order``, the shingle that each needs."""

    def __init__(self, items: list, size: int):
        col = pa.array([t for _, t in items], pa.string())
        data, off = W.utf8(col)
        w = W.Words(data, off, 0, len(items), W.ALNUM)
        self.words = np.array([w.text(k) for k in range(len(w.starts))], dtype=object)
        self.hash = w.hash
        starts, lengths, owner = [], [], []
        for r in range(len(items)):
            a, b = int(w.first[r]), int(w.first[r + 1])
            if a == b:
                continue
            s = np.arange(a, max(a, b - size) + 1)
            starts.append(s)
            lengths.append(np.full(len(s), min(size, b - a)))
            owner.append(np.full(len(s), r))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.starts, self.lengths, self.owner = cat(starts), cat(lengths), cat(owner)
        self.ids = [i for i, _ in items]
        # shingle sizes: SHINGLE words, or all words of a shorter window
        self.k = np.minimum(self.lengths, SHINGLE)
        self.places = self.lengths - self.k + 1

    def shingles(self, k: int) -> np.ndarray:
        """For every word of the items, the hash of the k words from it on (0 past the end)."""
        g = W.grams(self.hash, k)
        return np.concatenate([g, np.zeros(len(self.hash) - len(g), np.uint64)])

    def wanted(self) -> dict:
        """Shingle size -> sorted distinct hashes of all shingles of all windows."""
        out = {}
        for k in np.unique(self.k):
            g, mine = self.shingles(k), self.k == k
            at = [self.starts[mine & (self.places > p)] + p for p in range(int(self.places[mine].max()))]
            out[int(k)] = np.unique(g[np.concatenate(at)])
        return out

    def order(self, counts: dict) -> None:
        """By rarity (document frequency, then hash) keep for each window its first shingle."""
        self.need = {}
        for k in np.unique(self.k):
            keys, freq = counts[int(k)]
            g, mine = self.shingles(k), np.flatnonzero(self.k == k)
            best = np.full(len(mine), -1, np.int64)
            best_f, best_h = np.full(len(mine), np.iinfo(np.int64).max), np.zeros(len(mine), np.uint64)
            for p in range(int(self.places[mine].max())):
                ok = self.places[mine] > p
                h = g[np.where(ok, self.starts[mine] + p, 0)]
                f = freq[np.searchsorted(keys, h).clip(max=len(keys) - 1)]
                first = ok & ((f < best_f) | ((f == best_f) & (h < best_h)) | (best < 0))
                best, best_f, best_h = np.where(first, p, best), np.where(first, f, best_f), np.where(first, h, best_h)
            order = np.argsort(best_h, kind="stable")
            self.need[int(k)] = (best_h[order], mine[order], best[order])


def _found(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of values that are in the sorted keys. A table of 16 leading bits rules out most of them cheaply."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
    hm = h[maybe]
    return maybe[keys[np.searchsorted(keys, hm).clip(max=len(keys) - 1)] == hm]


def _inside(w: W.Words, n: int, k: int) -> np.ndarray:
    """Whether the k words from each word on are of one row."""
    row = w.rows()
    ok = np.zeros(n, bool)
    if n:
        ok[:] = row[:n] == row[k - 1 : k - 1 + n]
    return ok


def count_shingles(docs: DataFrame, wanted: dict) -> dict:
    """Shingle size -> (sorted hashes, documents that hold each), over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    base = dict(zip(wanted, np.cumsum([0, *map(len, wanted.values())]).tolist()))

    def codes(batch):
        data, off = W.utf8(batch.column(0))
        for i, j in W.slices(off):
            w = W.Words(data, off, i, j, W.ALNUM)
            row = w.rows()
            for k, keys in shared.value.items():
                g = W.grams(w.hash, k)
                at = _found(keys, g)
                at = at[_inside(w, len(g), k)[at]]
                if len(at):  # once a document
                    yield base[k] + np.unique(row[at] * len(keys) + np.searchsorted(keys, g[at])) % len(keys)

    total = tally(docs.select("text"), codes, sum(map(len, wanted.values())))
    shared.unpersist()
    return {k: (keys, total[base[k] : base[k] + len(keys)]) for k, keys in wanted.items()}


def hits(docs: DataFrame, index: Index) -> DataFrame:
    """__id, n_words, spans (first word, words) and items for each row of docs (__id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches):
        ix = shared.value
        for batch in batches:
            ids = batch.column(0)
            data, off = W.utf8(batch.column(1))
            for i, j in W.slices(off):
                w = W.Words(data, off, i, j, W.ALNUM)
                row = w.rows()
                found: dict = {}
                for k, (keys, windows, places) in ix.need.items():
                    g = W.grams(w.hash, k)
                    for at in _found(keys, g).tolist():
                        for x in range(int(np.searchsorted(keys, g[at], "left")), int(np.searchsorted(keys, g[at], "right"))):
                            v = int(windows[x])
                            s, n = at - int(places[x]), int(ix.lengths[v])
                            r = int(row[at])
                            if s < w.first[r] or s + n > w.first[r + 1]:
                                continue
                            b = int(ix.starts[v])
                            if (w.hash[s : s + n] == ix.hash[b : b + n]).all() and all(w.text(s + y) == ix.words[b + y] for y in range(n)):
                                spans, items = found.setdefault(r, (set(), set()))
                                spans.add((s - int(w.first[r]), n))
                                items.add(int(ix.owner[v]))
                out_s, out_i = [], []
                for r in range(j - i):
                    spans, items = found.get(r, ((), ()))
                    out_s.append([{"at": a, "n": n} for a, n in sorted(spans)])
                    out_i.append(sorted({ix.ids[x] for x in items if ix.ids[x] is not None}))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), pa.array(out_s, pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))), pa.array(out_i, pa.list_(pa.string()))],
                    ["__id", "n_words", "spans", "items"],
                )

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "text").mapInArrow(search, f"__id {kind}, n_words long, spans array<struct<at:long,n:long>>, items array<string>")


def contamination(docs: DataFrame, bench: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, __hash (of the text), n_words, spans and items, a row for each row of ``docs``."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("__id"), "text")
    parts = []
    for items in item_blocks(bench):
        ix = Index(items, size)
        if len(ix.starts):
            ix.order(count_shingles(docs, ix.wanted()))
            parts.append(hits(keyed, ix))
    if not parts:
        parts.append(hits(keyed, _empty(size)))
    if len(parts) == 1:
        out = parts[0]
    else:  # several blocks: what each found for a row comes together
        all_parts = parts[0].withColumn("__part", F.lit(0))
        for k, p in enumerate(parts[1:], 1):
            all_parts = all_parts.unionByName(p.where(F.size("items") + F.size("spans") > 0).withColumn("__part", F.lit(k)))
        out = written(all_parts, "decontam").groupBy("__id").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.greatest(F.count_if(F.col("__part") == 0), F.lit(1)).alias("copies"),
        ).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("__id.doc_id", F.col("__id.hash").alias("__hash"), "n_words", "spans", "items")


def _empty(size: int) -> Index:
    ix = Index([], size)
    ix.need = {}
    return ix


def hit_words(spans):
    """Words inside any span: spans ordered by start, each adds what lies past the furthest end so far."""
    s = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(a, x):
        end = x["at"] + x["n"]
        return F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(s, zero, step, lambda a: a["n"])


def keep_clean(docs: DataFrame, bench: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` without a window of the benchmark."""
    found = contamination(docs.select("doc_id", "text"), bench, size).where(F.size("spans") > 0)
    found = written(found.select(F.col("doc_id").alias("__doc"), "__hash"), "contaminated").distinct()
    mine, own = hidden(docs)
    same = F.col(own["doc_id"]).eqNullSafe(F.col("__doc")) & (F.xxhash64(own["text"]) == F.col("__hash"))
    return mine.join(found, same, "left_anti").select(*[F.col(own[c]).alias(c) for c in docs.columns])


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    c = contamination(docs.select("doc_id", "text"), bench)
    n_hit = hit_words(F.col("spans"))
    return c.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id
), x AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)
"""
