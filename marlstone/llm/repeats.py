"""Op 4: exact removal of repeated passages by a depth-limited radix sort of suffixes.

Texts are UTF-8 bytes. A window is ``size`` bytes; two windows are the same
string exactly if their suffixes stay in one group through depth ``size``. The
sort takes most significant digits first, where a digit is the hash of a piece
of the suffix at a fixed place, and never looks beyond the threshold depth:

* Digit 1. Every window holds exactly one *anchor*: the least of the ``CORE``-
  byte strings in it (order of a hash, leftmost on ties). Equal windows have
  equal anchors at equal places, so suffixes are first dealt by their anchor's
  core. One row stands for all windows (some hundred) that share an anchor.
  A core that occurs once ends there: none of its windows is repeated.
* Group collapse. The *hull* of an anchor is all text that its windows can
  cover. Equal hulls make all their windows equal: these are done, and only
  one of them stays in the sort, as the partner of the others.
* Digit 2. What is left is dealt by blocks of ``STEP`` neighbouring windows,
  again with a core (what the block's windows share) and a hull.
* Last digit. Single windows, by the hash of all their bytes. Equal groups of
  more than one are exactly the repeated windows.

No pairs are made, and each pass groups by hashes of more of the text than the
one before, so a passage that a third of the texts hold is counted, map side
first, and never gathered. What a pass counted is written before it is joined:
the join then reads two plain exchanges, of which Spark splits the partition of
a frequent core. Identity rests on 128 bits of hash.

The digits are those of the suffix at its window's anchor, not of the window's
own start: a row for every byte would be many times the text.

Defined cases: null or empty text has no bytes; texts under ``size`` bytes
lose nothing; a longer text than ``SEGMENT`` is taken in segments that overlap;
rows that repeat or tie (with the same doc_id too) are occurrences of their
own; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import _words as W
from marlstone.llm._shared import drop, table, written

SIZE, STEP, SEGMENT = 400, 16, 800_000
U = np.uint64
_BYTE2 = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def core_length(size: int) -> int:
    return max(1, size * 3 // 8)


class Hashes:
    """Hashes of any substrings of ``data``: two independent 64-bit ones."""

    def __init__(self, data: np.ndarray, second: bool = True):
        p, self.inv = W.powers(len(data))
        p = p[: len(data)]
        self.one = self._sums(W._BYTE, data, p)
        self.two = self._sums(_BYTE2, data, p) if second else None

    @staticmethod
    def _sums(table: np.ndarray, data: np.ndarray, p: np.ndarray) -> np.ndarray:
        s = np.empty(len(data) + 1, np.uint64)
        s[0] = 0
        np.cumsum(table[data] * p, out=s[1:])
        return s

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix((self.one[b] - self.one[a]) * self.inv[a] + (b - a).astype(np.uint64))

    def second(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix((self.two[b] - self.two[a]) * self.inv[a] + (b - a).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """first() of all substrings of a length."""
        n = len(self.one) - length
        return W.mix((self.one[length:] - self.one[:n]) * self.inv[:n] + U(length))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, bounds: np.ndarray, size: int):
    """(row, anchor, first window, last window) for the rows of ``data`` cut at ``bounds``; places count from the row's start.

    Positions within rows of over ``SEGMENT`` bytes are taken a segment at a time.
    """
    core = core_length(size)
    width = size - core + 1
    rows, places, lows, highs = [], [], [], []
    lo, end = int(bounds[0]), int(bounds[-1])
    while lo + size <= end:
        hi = min(end, lo + SEGMENT + size - 1)  # windows that start in lo .. hi - size
        part = data[lo:hi]
        v = Hashes(part, False).every(core)
        v = (v >> U(20) << U(20)) | np.arange(len(v), dtype=np.uint64)
        at = (_least(v, width) & U((1 << 20) - 1)).astype(np.int64) + lo
        x = np.arange(lo, lo + len(at))
        row = np.searchsorted(bounds, x, "right") - 1
        ok = x + size <= bounds[row + 1]
        x, at, row = x[ok], at[ok], row[ok]
        if len(x):
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([new[1:], [len(x)]]) - 1
            r, a, s, e = row[new], at[new], x[new], x[last]
            if places and len(places[-1]) and places[-1][-1] == a[0]:  # an anchor that the last segment had already
                highs[-1][-1] = e[0]
                r, a, s, e = r[1:], a[1:], s[1:], e[1:]
            rows.append(r), places.append(a), lows.append(s), highs.append(e)
        lo = hi - size + 1
    cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    rows, places, lows, highs = cat(rows), cat(places), cat(lows), cat(highs)
    base = bounds[rows]
    return rows, places - base, lows - base, highs - base


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _take(col, rows: np.ndarray):
    return col.take(pa.array(rows))


ANCHORS = "core long, hull1 long, hull2 long, id {id}, at long, lo long, hi long, hull_lo long, hull_hi long"


def _anchor_rows(size: int):
    core = core_length(size)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, off = W.utf8(batch.column(1))
            for i, j in W.slices(off):
                bounds = off[i : j + 1] - off[i]
                part = data[off[i] : off[j]]
                r, at, lo, hi = anchors(part, bounds, size)
                if not len(r):
                    continue
                h = Hashes(part)
                base, n = bounds[r], bounds[r + 1] - bounds[r]
                a, b = np.maximum(0, at + core - size), np.minimum(n, at + size)
                one = h.first(base + at, base + at + core)
                clip = (at - a).astype(np.uint64)  # hulls are equal only with the anchor at the same place
                hull1, hull2 = W.mix(h.first(base + a, base + b) + clip), W.mix(h.second(base + a, base + b) + clip)
                yield pa.RecordBatch.from_arrays(
                    [_i64(one), _i64(hull1), _i64(hull2), _take(ids, r + i), _i64(at), _i64(lo), _i64(hi), _i64(a), _i64(b)],
                    ["core", "hull1", "hull2", "id", "at", "lo", "hi", "hull_lo", "hull_hi"],
                )

    return run


BLOCKS = "core long, block long, hull1 long, hull2 long, id {id}, at long, lo long, windows array<long>"


def _block_rows(size: int, step: int):
    """Blocks of the windows of the anchors in column 2, with a hash for each window."""

    def run(batches):
        for batch in batches:
            ids, spots = batch.column(0), batch.column(2)
            for k in range(batch.num_rows):
                data, off = W.utf8(batch.column(1).slice(k, 1))
                data, n = data[off[0] : off[1]], int(off[1] - off[0])
                s = spots[k].as_py()
                h = Hashes(data)
                out: list = [[] for _ in range(7)]
                for spot in sorted((x["at"], x["lo"], x["hi"]) for x in s):
                    at, lo, hi = spot
                    x = np.arange(lo, hi + 1)
                    win = h.first(x, x + size)
                    for b in range((at - hi) // step, (at - lo) // step + 1):
                        wl, wh = max(lo, at - b * step - step + 1), min(hi, at - b * step)
                        full = wl == at - b * step - step + 1 and wh == at - b * step
                        for z, v in zip(out, (b, at, wl, wh, full, at - b * step, win[wl - lo : wh - lo + 1])):
                            z.append(v)
                if not out[0]:
                    continue
                b, at, wl, wh, full, top = (np.array(z) for z in out[:6])
                c1 = h.first(top, top - step + 1 + size)
                f1, f2 = h.first(wl, wh + size), h.second(wl, wh + size)
                miss = pa.array(~full.astype(bool))
                null = lambda v: pa.compute.if_else(miss, pa.scalar(None, pa.int64()), _i64(v))
                lens = np.array([len(z) for z in out[6]])
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), _i64(np.concatenate(out[6])))
                for i in range(0, len(b), 20_000):
                    m = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [_i64(c1[m]), _i64(b[m]), null(f1)[m], null(f2)[m], _take(ids, np.full(len(b[m]), k)), _i64(at[m]), _i64(wl[m]), windows[m]],
                        ["core", "block", "hull1", "hull2", "id", "at", "lo", "windows"],
                    )

    return run


def repeated_spans(docs: DataFrame, size: int = SIZE, step: int = STEP) -> tuple[DataFrame, list[DataFrame]]:
    """id (struct of doc_id and the text's hash), lo, hi: byte ranges that repeated windows cover; and the tables it reads, to drop."""
    spark = docs.sparkSession
    core = core_length(size)
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash")).alias("id"), "text")
    kind = keyed.schema["id"].dataType.simpleString()
    rows = written(keyed.where(F.octet_length("text") >= size).mapInArrow(_anchor_rows(size), ANCHORS.format(id=kind)), "anchors")

    # digit 1: cores that occur more than once
    often = written(rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "cores")
    held = written(rows.join(often, "core", "left_semi"), "anchors-held")
    drop(rows, often)
    hulls = written(held.groupBy("core", "hull1", "hull2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("rep")), "hulls")
    kinds = written(hulls.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    # what is alone in its hull needs no partner from there
    shared = written(hulls.where("n > 1"), "hulls-shared")
    drop(hulls)
    judged = written(held.join(kinds, "core", "left").join(shared, ["core", "hull1", "hull2"], "left").where("n > 1 OR kinds > 1").drop("core", "hull1", "hull2"), "anchors-judged")
    drop(held, kinds, shared)
    done = judged.where("n > 1").select("id", F.col("hull_lo").alias("lo"), F.col("hull_hi").alias("hi"))
    left = judged.where((F.col("kinds") > 1) & (F.col("n").isNull() | (F.col("rep") == F.struct("id", "at"))))

    # digit 2: blocks of windows, where the core is shared but not the hull
    spots = left.groupBy("id").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("spots"))
    spots = spots.select(F.col("id.doc_id").alias("__doc"), F.col("id.hash").alias("__hash"), "spots")
    again = keyed.join(spots, F.col("id.doc_id").eqNullSafe(F.col("__doc")) & (F.col("id.hash") == F.col("__hash"))).select("id", "text", "spots")
    blocks = written(again.mapInArrow(_block_rows(size, step), BLOCKS.format(id=kind)), "blocks")
    often = written(blocks.groupBy("core", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "block"), "block-cores")
    held = written(blocks.join(often, ["core", "block"], "left_semi"), "blocks-held")
    drop(blocks, often)
    hulls = held.where("hull1 IS NOT NULL").groupBy("core", "block", "hull1", "hull2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("rep")).where("n > 1")
    hulls = written(hulls, "block-hulls")
    anchored = judged
    judged = written(held.join(hulls, ["core", "block", "hull1", "hull2"], "left").drop("block", "hull1", "hull2"), "blocks-judged")
    drop(held, hulls)
    last = F.col("lo") + F.size("windows") - 1 + size
    done2 = judged.where("n > 1").select("id", "lo", last.alias("hi"))
    left = judged.where(F.col("n").isNull() | (F.col("rep") == F.struct("id", "at")))

    # last digit: single windows
    single = left.select("core", "id", "at", "lo", F.posexplode("windows").alias("k", "window"))
    single = single.select("core", "window", (F.col("at") - F.col("lo") - F.col("k")).alias("delta"), "id", (F.col("lo") + F.col("k")).alias("lo"))
    equal = written(single.groupBy("core", "window", "delta").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "windows")
    done3 = single.join(equal, ["core", "window", "delta"], "left_semi").select("id", "lo", (F.col("lo") + size).alias("hi"))
    return done.unionByName(done2).unionByName(done3), [anchored, judged, equal]


def merge(spans: list) -> list:
    out: list = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _cut(batches):
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        text, spans = batch.column(1), batch.column(2)
        out: list = [[], [], [], []]
        for k in range(batch.num_rows):
            t = text[k].as_py()
            t = b"" if t is None else bytes(t)
            s = merge([(x["lo"], x["hi"]) for x in spans[k].as_py() or ()])
            kept, at = [], 0
            for lo, hi in s:
                kept.append(t[at:lo])
                at = hi
            kept = b"".join([*kept, t[at:]])
            for z, v in zip(out, (len(t), [{"lo": a, "hi": b} for a, b in s], kept, hashlib.sha256(kept).hexdigest())):
                z.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())],
            ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs), kept (bytes) and kept_sha256, a row for each row of ``docs``."""
    ranges, tables = repeated_spans(docs, size)
    spans = ranges.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = written(spans.select(F.col("id.doc_id").alias("__doc"), F.col("id.hash").alias("__hash"), "spans"), "spans")
    drop(*tables)
    d = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.col("text").cast("binary").alias("text"))
    j = d.join(spans, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__hash")), "left").select("doc_id", "text", "spans")
    kind = d.schema["doc_id"].dataType.simpleString()
    return j.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary, kept_sha256 string")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
