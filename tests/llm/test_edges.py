"""Very long texts, ties, repeated rows, nulls and clashing names, against plain versions of each operator."""

import hashlib
import random
import re
import sys
import time

import pytest

from marlstone.llm import chat, class_lm, decontam, jaccard, line_dedup, mixing, quality, repeats, token_counts

rng = random.Random(12)
LONG = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(25000))  # 1.7 MB
CLASH = ["n_lines", "n_dropped", "words", "doc", "hash", "key", "n", "size", "block", "cut", "label", "__doc", "__hash", "spans", "__id", "lo", "core", "kept", "rid", "bucket", "first", "piece"]
ROWS = [(1, LONG), (2, LONG + "\nEnd."), (3, None), (None, ""), (4, "a b c"), (4, "a b c"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(CLASH)]).repartition(3)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=str)


def test_lines(docs):
    lines = LONG.split("\n")
    got = by_id(line_dedup.line_report(docs, 5, 2), "n_lines", "n_dropped")
    assert got == sorted([(1, 25000, 25000), (2, 25001, 0), (3, 1, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0), (None, 1, 0)], key=str) and len(set(lines)) == len(lines)
    out = line_dedup.dedup_lines(docs, 5, 2)
    assert out.columns == docs.columns
    for r in out.collect():
        assert [r[c] for c in CLASH] == list(range(len(CLASH)))
        assert r["text"] == ("" if r["doc_id"] == 1 else dict(ROWS[1:5]).get(r["doc_id"]) if r["doc_id"] is not None else r["text"])


def test_hot_lines_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 10)
    monkeypatch.setattr(line_dedup, "PIECES", 4)
    hot, rare = "the line that nearly everybody holds", "a line that just two documents hold"
    rows = [(k, "\n".join([hot, f"line number {k} of its own kind", hot] + [rare] * (k < 2))) for k in range(40)] + [(None, hot), (39, hot)]
    got = by_id(line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "n_dropped")
    assert got == sorted([(k, 0 if k == 39 else 2) for k in range(40)] + [(None, 1), (39, 0)], key=str)
    lines = spark.createDataFrame([(1,)] * 90 + [(k,) for k in range(2, 40)], "h1 long")
    assert [r[0] for r in line_dedup.hot_keys(lines).collect()] == [1]


def test_jaccard(docs):
    got = by_id(jaccard.similar(docs, 3, 90, 100).selectExpr("id AS doc_id", "component"), "component")
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (jaccard.NO_ID, jaccard.NO_ID), (jaccard.NO_ID, jaccard.NO_ID)], key=str)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns and [r[0] for r in by_id(out)].count(4) == 1 and 2 not in [r[0] for r in by_id(out)]


def test_repeats_beyond_a_segment(docs, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 50_000)
    n = len(LONG.encode())
    got = by_id(repeats.remove_repeats(docs), "n_bytes", "kept_sha256")
    end = hashlib.sha256(b"\nEnd.").hexdigest()
    assert got[:2] == [(1, n, hashlib.sha256(b"").hexdigest()), (2, n + 5, end)] and len(got) == len(ROWS)


@pytest.mark.parametrize("segment", [500, 1000, 5000])
def test_repeats_across_segments_match_brute_force(spark, monkeypatch, segment):
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_operators import brute_repeats

    monkeypatch.setattr(repeats, "SEGMENT", segment)
    r = random.Random(segment)
    shared = ["".join(r.choice("abcdef ") for _ in range(n)) for n in (410, 700, 1500)]
    texts = ["".join(r.choice([*shared, "".join(r.choice("xyz") for _ in range(300))]) for _ in range(8)) for _ in range(10)]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400).collect()
    for g, (n, removed, spans, sha) in zip(sorted(got), brute_repeats(texts, 400), strict=True):
        assert (g["n_bytes"], sum(x["hi"] - x["lo"] for x in g["spans"]), len(g["spans"]), g["kept_sha256"]) == (n, removed, spans, sha)


def test_scores(docs):
    got = by_id(class_lm.score(docs), "n_tokens", "n_known")
    assert [g[1] for g in got if g[0] == 1] == [25000 * 12 + 1] and [g[1] for g in got if g[0] is None] == [1, 1]


def test_quality(docs):
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert got[1]["n_words"] == 300000 and got[1]["n_dup_lines"] == 0 and got[3]["n_words"] == 0 and got[3]["base_failed"]
    assert quality.keep_good(docs).columns == docs.columns


def test_mixing(docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(ROWS) and abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) <= 0.5


def test_decontamination_with_several_blocks(spark, docs, monkeypatch):
    words = re.findall(r"\w+", LONG)
    items = [(k, " ".join(words[k * 500 : k * 500 + 30])) for k in range(40)] + [(100, "a b c"), (None, "a b c"), (101, None), (102, ".,")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = None
    for chars in (8 << 20, 900):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        got = [(i, n, len(s), tuple(x)) for i, n, s, x in by_id(decontam.contamination(docs.select("doc_id", "text", "words", "spans").drop("words", "spans"), bench), "n_words", "spans", "items")]
        assert want is None or got == want
        want = got
    assert [g for g in got if g[0] == 4] == [(4, 3, 1, ("100",))] * 2 and len([g for g in got if g[0] == 1][0][3]) == 40
    out = decontam.keep_clean(docs, bench)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {3, None}


def test_long_words_take_time_in_proportion(spark):
    pieces = token_counts.read_pieces(token_counts.VOCABULARY)
    a = token_counts.Automaton(pieces)
    import numpy as np

    word = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(200_000))
    data = np.frombuffer(word + word[:300], np.uint8)
    began = time.time()
    both = a.lengths(data, np.array([0, 200_000]), np.array([200_000, 200_300]))
    assert time.time() - began < 3
    state, n = a.walk(0, b" " + word[:300])
    assert both[1] == n + a.rest[state]
    got = by_id(token_counts.count_tokens(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), pieces), "n_words", "n_chars")
    assert got == [(1, 300000, len(LONG))]


def test_chat_ties_and_long_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", LONG), (1, 0, "user", "a"), (None, 3, None, None), (None, None, "user", "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [LONG, "a", "a", "b"] and got[1]["round_trip_ok"]
    assert [t["role"] for t in got[None]["turns"]] == ["user", ""] and got[None]["round_trip_ok"]
