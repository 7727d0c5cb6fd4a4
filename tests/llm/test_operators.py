"""Each operator against SQL or a brute-force version, and on odd tables."""

import hashlib
import random
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, decontam, line_dedup, mixing, quality, registry, repeats

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, key string, n long, size long, id long, h long"
ODD = [(None, None, None, None, "k", 1, 1, 1, 1), (1, "", "en", "s", "k", 1, 1, 1, 1), (2, " \n\t", "en", None, "k", 1, 1, 1, 1), (3, "one two three " * 30, "en", "s", "k", 1, 1, 1, 1), (3, "one two three " * 30, "en", "s", "k", 1, 1, 1, 1), (4, "word " * 30000, "en", "s", "k", 1, 1, 1, 1)]


def text_rows(df):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert text_rows(registry.queries()[name](spark, SF).toPandas()) == text_rows(con.execute(registry.oracle_sql()[name]).df())


def brute_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,size", [(1, 20), (2, 40)])
def test_repeats_match_brute_force(spark, seed, size):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [word(rng.randrange(size - 5, 4 * size)) for _ in range(6)]
    texts = [None, "", "a" * 200, "ab" * 90] + ["".join(rng.choice([word(rng.randrange(60)), rng.choice(shared)]) for _ in range(6)) for _ in range(50)]
    texts += [texts[10], texts[10]]
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS lo", "'x' AS spans").repartition(3)
    got = repeats.remove_repeats(docs, size).select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]), F.size("spans"), "kept_sha256").collect()
    want = [(k if k % 9 else None, *r) for k, r in enumerate(brute_repeats(texts, size))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_mix_meets_its_targets(spark):
    r = mixing.op8_mix_sources(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    assert (r.taken <= 2 * r["size"]).all() and (r.target <= 2 * r.source_size).all()
    per = r.groupby("source", dropna=False)
    assert (abs(per.taken.sum() - per.target.first()) <= 1).all()
    total = r["size"].sum()
    assert per.target.first().sum() == pytest.approx(min(1.5 * total, 2 * total))
    again = mixing.op8_mix_sources(spark, SF).toPandas()
    assert sorted(zip(again.doc_id, again.taken, again.shards)) == sorted(zip(r.doc_id, r.taken, r.shards))


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "<~|", "<~~|", "~", "<", "|", "\n", "x", "~0", "assistant"]
    rows = [(c, t, rng.choice(["user", "assistant", "a<|b\n~1", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])) for c in range(60) for t in range(rng.randrange(1, 5))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS body")).collect()
    assert len(out) == 60 and all(r["round_trip_ok"] for r in out)
    for r in out:
        want = [(x or "", y or "") for c, _, x, y in sorted((q for q in rows if q[0] == r["conv_id"]), key=lambda q: q[1])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["formatted"].count("<|im_end|>") == len(want)


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, WIDE)
    bench = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.line_report(docs).count() == len(rows)
    assert quality.verdicts(docs).count() == len(rows)
    assert mixing.mix_report(docs).count() == len(rows)
    assert decontam.contamination(docs, bench).count() == len(rows)
    assert decontam.contamination(docs, bench.limit(0)).count() == len(rows)
    assert repeats.remove_repeats(docs.select("doc_id", "text", "key")).count() == len(rows)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_class_model_beats_the_base_on_held_out_texts(spark):
    from marlstone.llm import class_lm

    r = class_lm.op5_class_lm(spark, SF).toPandas()
    held = r[r.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_all_thirteen_are_registered():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    assert {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in e.queries()


def test_a_group_is_drawn_to_its_language_by_its_size(spark):
    """The high fence of word lengths as the group grows: from its language's to its own, without a jump."""
    rows = [("en", "wide", "r_length", b, 10_000) for b in (400, 600)] + [(lang, src, r, 0, 10_000) for lang, src in (("en", "wide"),) for r in ("r_symbols", "r_lines", "r_repeats")]
    highs = []
    for n in (1, 99, 100, 101, 100_000):
        mine = [("en", "own", "r_length", b, n) for b in (500, 504)] + [("en", "own", r, 0, n) for r in ("r_symbols", "r_lines", "r_repeats")]
        f = quality.fences(spark.createDataFrame(rows + mine, "lang string, source string, rate string, bucket long, n long"))
        highs.append({r["source"]: r["hi_r_length"] for r in f.collect()}["own"])
    assert highs == sorted(highs, reverse=True) and highs[0] > 1150 and highs[-1] == 504 + 3 * 20
    assert abs(highs[1] - highs[3]) < 10
