"""Op 10: word-piece counts by a linear longest-match automaton.

Each word ``[^\\x20\\x09-\\x0D]+`` with a space before it is cut into the longest
pieces of a byte-level vocabulary, from left to right. The automaton is the
vocabulary's trie with a failure link for each node: where no edge fits, the
pieces that are surely there are popped and matching goes on from what is
left. The number popped is stored with the link, so counts come out without
building pieces, in one step per byte (amortised).

A batch's distinct words step through the automaton together, a byte at a
time, while there are many of that length; the few longest go on one by one.
Each then counts as often as its texts hold it.

Defined cases: null or blank text has no words and no tokens; words and texts
of any length take time in proportion to their bytes; repeated rows and ties
are counted alike; an empty table gives an empty result; other columns are
ignored, whatever their names. Bytes the vocabulary lacks count as one token each.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import _words as W
from marlstone.llm._shared import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FEW = 64  # so many words or fewer are walked one by one


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file: lines of a base64 piece and its rank."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie nodes are numbers from 0 (the root); ``pops`` and ``fail`` as above, ``rest`` pops all that is left at the end."""

    def __init__(self, pieces):
        edges: dict = {}
        ends = {0: False}
        parents, chars, depth = [0], [0], [0]
        for p in [*(bytes([c]) for c in range(256)), *sorted(set(pieces) - {b""})]:
            node = 0
            for c in p:
                nxt = edges.get((node << 8) | c)
                if nxt is None:
                    nxt = edges[(node << 8) | c] = len(parents)
                    parents.append(node)
                    chars.append(c)
                    depth.append(depth[node] + 1)
                    ends[nxt] = False
                node = nxt
            ends[node] = True
        size = len(parents)
        fail, pops = np.zeros(size, np.int64), np.zeros(size, np.int64)
        rest = np.zeros(size, np.int64)
        for v in sorted(range(1, size), key=depth.__getitem__):
            if ends[v]:
                fail[v], pops[v] = 0, 1
            else:  # all single bytes are pieces, so this ends at the root at last
                z, n = int(fail[parents[v]]), int(pops[parents[v]])
                while (nxt := edges.get((z << 8) | chars[v])) is None:
                    n += int(pops[z])
                    z = int(fail[z])
                fail[v], pops[v] = nxt, n
            rest[v] = pops[v] + rest[fail[v]]
        self.fail, self.pops, self.rest = fail.astype(np.int32), pops.astype(np.int32), rest.astype(np.int32)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.edges = self.links = None  # for walk, made where it is needed

    def step(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The states after one byte more; ``count`` gets what was popped."""
        out = np.empty(len(state), np.int64)
        open_ = np.arange(len(state))
        state = state.copy()
        while len(open_):
            k = (state[open_] << 8) | byte[open_]
            at = np.searchsorted(self.keys, k).clip(max=len(self.keys) - 1)
            ok = self.keys[at] == k
            out[open_[ok]] = self.to[at[ok]]
            open_ = open_[~ok]
            count[open_] += self.pops[state[open_]]
            state[open_] = self.fail[state[open_]]
        return out

    def walk(self, state: int, word: bytes) -> tuple[int, int]:
        """The state after all bytes of a word, and what was popped."""
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.to.tolist()))
            self.links = self.fail.tolist(), self.pops.tolist()
        edges, (fail, pops), n = self.edges, self.links, 0
        for c in word:
            while (nxt := edges.get(state << 8 | c)) is None:
                n += pops[state]
                state = fail[state]
            state = nxt
        return state, n

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: bytes = b" ") -> np.ndarray:
        """Pieces in ``before`` + data[starts:ends], for all words at once."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still open are a prefix
        s, n = starts[order], (ends - starts)[order]
        count = np.zeros(len(s), np.int64)
        state = np.zeros(len(s), np.int64)
        for c in before:
            state = self.step(state, np.full(len(s), c, np.int64), count)
        for k in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -k, "left"))
            if m <= FEW:  # long words: one by one from here
                for w in range(m):
                    state[w], more = self.walk(int(state[w]), data[s[w] + k : s[w] + n[w]].tobytes())
                    count[w] += more
                break
            state[:m] = self.step(state[:m], data[s[:m] + k].astype(np.int64), count[:m])
        out = np.empty(len(s), np.int64)
        out[order] = count + self.rest[state]
        return out


def count_tokens(docs: DataFrame, pieces: list[bytes], before: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_tokens and n_chars for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))

    def run(batches):
        for b in batches:
            data, off = W.utf8(b.column(1))
            for i, j in W.slices(off):
                w = W.Words(data, off, i, j, W.SPACED, lower=False)
                _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
                each = shared.value.lengths(w.data, w.starts[at], w.ends[at], before)[back] if len(at) else np.zeros(0, np.int64)
                s = np.concatenate([[0], np.cumsum(each)])
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])[w.offsets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), pa.array(s[w.first[1:]] - s[w.first[:-1]]), pa.array(np.diff(chars).astype(np.int64))],
                    ["doc_id", "n_words", "n_tokens", "n_chars"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_chars long")


def op10_token_counts(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_pieces(vocabulary))
