"""Words and phrases of many queries found in one pass over the texts, where no index has been built.

A document (tenant, id, heading, body) is read once, line by line, against all words that are asked for; a chunk is a line with
a word in it, numbered densely. What a chunk adds to each query is summed where the chunk is read, so nothing is exchanged for it. Queries are
taken ``BLOCK`` at a time, each block in a pass of its own, which bounds what driver and tasks hold of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.store import collected

BLOCK = 4096  # queries of one pass
ROWS = 50_000  # postings that leave a task at once
PAIRS = 1 << 20  # pairs of a chunk and a query that are summed at once
K1, B = 1.2, 0.75
_find = re.compile("[a-z0-9]+").findall


class Lists(NamedTuple):
    """Lists of numbers, end to end."""

    start: np.ndarray
    n: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Lists:
        n = np.array([len(x) for x in lists], np.int64)
        return cls(np.cumsum(n) - n, n, np.array([y for x in lists for y in x], np.int64))

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members of the lists ``rows``, and for each the place in ``rows`` that it comes from."""
        n = self.n[rows]
        at = np.repeat(np.arange(len(rows)), n)
        return self.flat[np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())], at


class Texts(NamedTuple):
    docs: DataFrame  # tenant, id, heading (null: none), body
    seen: bool = False  # whether these are only documents that may be seen

    @classmethod
    def read(cls, docs: DataFrame, seen: bool = False) -> Texts:
        """The texts of documents (tenant, id, title, body)."""
        return cls(docs.select("tenant", "id", F.col("title").alias("heading"), "body"), seen)

    def phrases(self, words: DataFrame) -> DataFrame:
        """As ``lexical.phrases``; the slots of a part follow one another."""
        parts = words.groupBy("query_id", "part").agg(F.array_sort(F.collect_list(F.struct("slot", "stem"))).alias("w"))
        return _blocks(parts, ["query_id", "part"], lambda r: [(r["w"], False)], lambda keys, run: self._found(keys, run, "query_id string, part int"))

    def matches(self, words: DataFrame, best: bool = False) -> DataFrame:
        """query_id, tenant, id, seq, len, in_heading, in_text, strict of queries in parts (query_id, part, negated, slot, stem): chunks that hold a part and
        no word left out; of a query that leaves words out, chunks with all parts alone. ``best``: of each document its best chunk."""
        parts = words.groupBy("query_id", "part", "negated").agg(F.array_sort(F.collect_list(F.struct("slot", "stem"))).alias("w"))
        parts = parts.groupBy("query_id").agg(F.collect_list(F.struct("w", "negated")).alias("p"))
        return _blocks(parts, ["query_id"], lambda r: [(p["w"], p["negated"]) for p in r["p"]], lambda keys, run: self._found(keys, run, "query_id string"), best)

    def _found(self, keys: list, run, shape: str) -> DataFrame:
        spark = self.docs.sparkSession
        rows = self.docs.select("tenant", "id", "heading", "body").mapInArrow(run, "q long, tenant string, id string, seq int, len int, in_heading int, in_text int, strict boolean")
        return rows.join(F.broadcast(spark.createDataFrame([(n, *k) for n, k in enumerate(keys)], f"q long, {shape}")), "q").drop("q")

    def postings(self, words: list | None = None) -> DataFrame:
        """tenant, id, seq, term, tf, len: the words of each body's lines, or those of ``words`` there."""
        asked = None if words is None else frozenset(words)

        def batch(b, rows):
            doc, seq, term, tf, size = zip(*rows) if rows else [()] * 5
            doc = pa.array(doc, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array(seq, pa.int32()), pa.array(term, pa.string()), pa.array(tf, pa.int32()), pa.array(size, pa.int32())],
                                              ["tenant", "id", "seq", "term", "tf", "len"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list = []
                for i, body in enumerate(b.column(2).to_pylist()):
                    for seq, w in enumerate(_lines(body)):
                        n = len(w)
                        if asked is None:
                            rows += [(i, seq, t, k, n) for t, k in Counter(w).items()]
                        else:
                            rows += [(i, seq, t, w.count(t), n) for t in asked.intersection(w)]
                    if len(rows) > ROWS:
                        yield batch(b, rows)
                        rows = []
                yield batch(b, rows)

        return self.docs.select("tenant", "id", "body").mapInArrow(run, "tenant string, id string, seq int, term string, tf int, len int")

    def counts(self, words: list) -> tuple[dict, int, float]:
        """In how many chunks each of ``words`` stands, the number of chunks and their mean length."""
        asked = frozenset(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df: Counter = Counter()
            chunks = size = 0
            for b in batches:
                for heading, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    h = _find((heading or "").lower())
                    ahead = asked.intersection(h)
                    for w in _lines(body):
                        df.update(asked.intersection(w) | ahead)
                        chunks += 1
                        size += len(h) + len(w)
            yield pa.RecordBatch.from_pydict({"term": [None, "", *df], "n": [chunks, size, *df.values()]})

        found = {r["term"]: r["n"] for r in collected(self.docs.select("heading", "body").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))}
        chunks, size = found.pop(None, 0), found.pop("", 0)
        return found, chunks, size / chunks if chunks else 1.0

    def best(self, words: DataFrame, k: int, of: Texts, heading: float) -> DataFrame:
        """query_id, id, score of queries (query_id, stem): the ``k`` best documents of each part of these texts by saturated, rarity-weighted
        frequency, where a word of the heading counts ``heading`` times. Rarity and mean length are those of the texts ``of``."""
        asked = words.groupBy("query_id").agg(F.collect_set("stem").alias("w"))
        frames = []
        for rows in pieces(asked, ["query_id"]):
            terms = sorted({w for r in rows for w in r["w"]})
            df, chunks, avgdl = of.counts(terms)
            terms = [t for t in terms if t in df]
            number = {t: n for n, t in enumerate(terms)}
            lists: list = [[] for _ in terms]
            for n, r in enumerate(rows):
                for w in r["w"]:
                    if w in number:
                        lists[number[w]].append(n)
            idf = np.log(1 + (chunks - np.array([df[t] for t in terms], float) + 0.5) / (np.array([df[t] for t in terms], float) + 0.5))
            run = _scorer(number, Lists.of(lists), idf, avgdl, len(rows), k, heading)
            found = self.docs.select("id", "heading", "body").mapInArrow(run, "q long, id string, score double")
            keys = self.docs.sparkSession.createDataFrame([(n, r["query_id"]) for n, r in enumerate(rows)], "q long, query_id string")
            frames.append(found.join(F.broadcast(keys), "q").select("query_id", "id", F.round("score", 5).alias("score")))
        return reduce(DataFrame.unionByName, frames)


def _lines(body: str | None) -> Iterator[list]:
    """The words of each line that has some."""
    for line in (body or "").split("\n"):
        w = _find(line.lower())
        if w:
            yield w


def pieces(table: DataFrame, keys: list) -> list:
    """The rows of a table of queries, about ``BLOCK`` at a time."""
    n = table.count()
    blocks = max(1, -(-n // BLOCK))
    if blocks == 1:
        return [collected(table)]
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    return [collected(table.where(block == k)) for k in range(blocks)]


def _blocks(parts: DataFrame, keys: list, phrases, found, best: bool = False) -> DataFrame:
    frames = []
    for rows in pieces(parts, keys):
        number: dict = {}
        lists: tuple = ([], [])  # for each phrase, the queries that ask for it and those that leave it out
        wanted, left_out = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for n, r in enumerate(rows):
            for w, negated in phrases(r):
                p = number.setdefault(tuple(x["stem"] for x in w), len(number))
                if p == len(lists[0]):
                    lists[0].append([])
                    lists[1].append([])
                lists[int(negated)][p].append(n)
                wanted[n] += not negated
                left_out[n] |= negated
        first: dict = {}
        for p, n in number.items():
            first.setdefault(p[0], {}).setdefault(len(p), {})[p] = n
        begins = {w: (by.pop(1, {}).get((w,)), list(by.items())) for w, by in first.items()}
        frames.append(found([tuple(r[c] for c in keys) for r in rows], _finder(begins, Lists.of(lists[0]), Lists.of(lists[1]), wanted, left_out, best)))
    return reduce(DataFrame.unionByName, frames)


def _standing(begins: dict, w: list) -> dict:
    """How often each phrase stands in a list of words."""
    found: dict = {}
    for k, x in enumerate(w):
        b = begins.get(x)
        if b is not None:
            if b[0] is not None:
                found[b[0]] = found.get(b[0], 0) + 1
            for n, of in b[1]:
                p = of.get(tuple(w[k : k + n]))
                if p is not None:
                    found[p] = found.get(p, 0) + 1
    return found


def _finder(begins: dict, wants: Lists, without: Lists, wanted: np.ndarray, left_out: np.ndarray, best: bool):
    from marlstone.sources.fielded import HEADING, TEXT

    queries = max(1, len(wanted))

    def summed(b, chunks, hits):
        doc, seq, size = (np.array(x, np.int64) for x in zip(*chunks))
        chunk, phrase, h, t = (np.array(x, np.int64) for x in zip(*hits))
        q, at = wants.expand(phrase)
        key = chunk[at] * queries + q
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        if not len(starts):
            return None
        h, t, n, key = np.add.reduceat(h[at], starts), np.add.reduceat(t[at], starts), np.diff(np.r_[starts, len(key)]), key[starts]
        chunk_of, q = key // queries, key % queries
        strict = n == wanted[q]
        keep = strict | ~left_out[q]
        if len(without.flat):
            bad, at = without.expand(phrase)
            keep &= ~np.isin(key, chunk[at] * queries + bad)
        h, t, chunk_of, q, strict = (x[keep] for x in (h, t, chunk_of, q, strict))
        if best:
            rank = np.round((h * HEADING + t * TEXT) / (1 + np.log(size[chunk_of])), 9)
            order = np.lexsort((seq[chunk_of], -rank, ~strict, q, doc[chunk_of]))
            d, o = doc[chunk_of][order], q[order]
            order = order[np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1])][: len(order)]]
            h, t, chunk_of, q, strict = (x[order] for x in (h, t, chunk_of, q, strict))
        rows = pa.array(doc[chunk_of])
        i32 = lambda x: pa.array(x.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(q), b.column(0).take(rows), b.column(1).take(rows), i32(seq[chunk_of]), i32(size[chunk_of]), i32(h), i32(t), pa.array(strict)],
                                          ["q", "tenant", "id", "seq", "len", "in_heading", "in_text", "strict"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks, hits, pairs = [], [], 0
            for i, (heading, body) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                head = _find((heading or "").lower())
                ahead = _standing(begins, head)
                for seq, w in enumerate(_lines(body)):
                    found = _standing(begins, w)
                    if found or ahead:
                        c = len(chunks)
                        chunks.append((i, seq, len(head) + len(w)))
                        for p in {**ahead, **found}:
                            hits.append((c, p, ahead.get(p, 0), found.get(p, 0)))
                            pairs += int(wants.n[p])
                if pairs > PAIRS and hits:
                    out = summed(b, chunks, hits)
                    chunks, hits, pairs = [], [], 0
                    if out is not None:
                        yield out
            if hits:
                out = summed(b, chunks, hits)
                if out is not None:
                    yield out

    return run


def _scorer(number: dict, wants: Lists, idf: np.ndarray, avgdl: float, queries: int, k: int, weight: float):
    """Documents that no ``k`` others of the task are known to beat, for each query."""

    def summed(ids, docs, hits, top):
        chunk, term, x = np.array(hits[0], np.int64), np.array(hits[1], np.int64), np.array(hits[2])
        q, at = wants.expand(term)
        score = np.bincount(chunk[at] * queries + q, (idf[term] * x)[at], len(docs) * queries).reshape(len(docs), queries)
        docs = np.array(docs)
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        score = np.maximum.reduceat(score, starts, axis=0)
        top = np.concatenate([top, score])
        top = np.partition(top, len(top) - k, axis=0)[len(top) - k :]
        d, q = np.nonzero((score > 0) & (score >= top[0] - 1e-4))
        return top, pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(docs[starts][d])), pa.array(score[d, q])], ["q", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((k, queries))
        for b in batches:
            docs, hits, pairs = [], ([], [], []), 0
            for i, (heading, body) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                h = _find((heading or "").lower())
                ahead = Counter(w for w in h if w in number)
                for w in _lines(body):
                    tf = Counter(x for x in w if x in number)
                    if not (tf or ahead):
                        continue
                    floor = K1 * (1 - B + B * (len(h) + len(w)) / avgdl)
                    for x in {**ahead, **tf}:
                        f = weight * ahead.get(x, 0) + tf.get(x, 0)
                        hits[0].append(len(docs))
                        hits[1].append(number[x])
                        hits[2].append(f * (K1 + 1) / (f + floor))
                        pairs += int(wants.n[number[x]])
                    docs.append(i)
                if docs and (pairs > PAIRS or len(docs) * queries > PAIRS):
                    top, out = summed(b.column(0), docs, hits, top)
                    yield out
                    docs, hits, pairs = [], ([], [], []), 0
            if docs:
                top, out = summed(b.column(0), docs, hits, top)
                yield out

    return run
