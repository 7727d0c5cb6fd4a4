"""Answers to many open questions from the first source that has one: near documents first, then search, then a person.

A rung is a source. Questions that one rung answers do not reach the next; the others go on by an anti join. In a rung of documents, the
first document (by order) with a fitting paragraph answers by its best one. In the rung of search, scores gate what is read: too low
a best score, or too small a lead, and nothing is. What a judge quotes must stand in the document that it is cited from. What nobody answers
goes to a person, with the scores that were seen.

Questions are a stated set: their words make an automaton, in blocks, through which every paragraph runs once.

Defined cases: a question without content words, null or empty, goes to a person; texts may be null; of documents that tie in order the least id
comes first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.answers import Answers
from marlstone.sources.store import collected, written

# The share of a question's words that a paragraph must hold and the least number, floors of the best score and of its lead
# (a document that is first in one arm scores 1 / 61), how many documents are judged, and words that say nothing of a topic.
SHARE, LEAST = 0.6, 2
TOP_FLOOR, GAP_FLOOR, JUDGED = 1.5 / 61, 0.6 / 61, 3
NO_TOPIC = set((
    "what when where which who whom whose why how does did the and for are was were that this with from into its our their them they then than not but "
    "all any can may must shall will would should could have has had been about after before during while there here"
).split())
BLOCK = 20_000  # questions whose automaton a task holds
FOUND = "query_id string, id string, rank long, hits int, paragraph string, at int"


def content_words(question: str | None) -> list[str]:
    """Distinct words of a topic, in order; hyphens stay inside."""
    return [w for w in dict.fromkeys(re.findall(r"[a-z0-9][a-z0-9-]{2,}", (question or "").lower())) if w not in NO_TOPIC]


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def fitting(questions: DataFrame, docs: DataFrame, only: bool = False) -> DataFrame:
    """query_id, id, rank, hits, paragraph, at: the best paragraph that fits a question in each of ``docs`` (id, rank, body; with query_id too if ``only`` pairs count).

    A paragraph holds a word wherever the word's letters stand in it.
    """
    asked = [(r["query_id"], content_words(r["question"])) for r in collected(questions.select("query_id", "question"))]
    asked = [a for a in asked if a[1]]
    out = None
    for k in range(0, len(asked), BLOCK):
        found = docs.select("id", "rank", "body", *(["query_id"] if only else [])).mapInPandas(_matcher(asked[k : k + BLOCK], only), FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def _matcher(asked: list, only: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        of: dict = {}
        for q, words in asked:
            for w in words:
                of.setdefault(w, []).append(q)
        size = {q: len(words) for q, words in asked}
        machine = ahocorasick.Automaton()
        for w in of:
            machine.add_word(w, w)
        machine.make_automaton()
        for b in batches:
            rows = []
            pairs = b["query_id"] if only else [None] * len(b)
            for i, rank, body, pair in zip(b["id"], b["rank"], b["body"], pairs):
                best: dict = {}
                for at, paragraph in enumerate(re.split(r"\n\s*\n", body or "")):
                    text = flat(paragraph)
                    hits = Counter(q for w in {w for _, w in machine.iter(text.lower())} for q in of[w])
                    for q, n in hits.items():
                        if (pair is None or q == pair) and n >= LEAST and n / size[q] >= SHARE and n > best.get(q, (0,))[0]:
                            best[q] = (n, text, at)
                rows += [(q, i, rank, *x) for q, x in best.items()]
            yield pd.DataFrame(rows, columns=["query_id", "id", "rank", "hits", "paragraph", "at"])

    return run


def first_document(found: DataFrame) -> DataFrame:
    """query_id, id, answer: of each question the first document's paragraph."""
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", "id", F.col("paragraph").alias("answer"))


def best_paragraph(questions: DataFrame, shown: DataFrame) -> DataFrame:
    """The judge that needs no model: query_id, quote, from what is shown (query_id, id, rank, body); the paragraph with most of the question's words."""
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "rank", "id")
    found = fitting(questions, shown, only=True)
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", F.col("paragraph").alias("quote"))


def resolve(questions: DataFrame, rungs: list[tuple[str, DataFrame]], search: Callable[[DataFrame], Answers], docs: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame] = best_paragraph) -> DataFrame:
    """query_id, rung, id, answer, top_score, score_gap of every question (query_id, question).

    ``rungs``: names and documents (id, rank, body) in order. ``search`` answers questions (query_id, query); ``docs`` (id, body) are what it may
    quote. ``judge`` gives a quote, or no row, for each question that it can answer.
    """
    left, out = questions.select("query_id", "question"), []
    for name, source in rungs:
        got = written(first_document(fitting(left, source)).withColumn("rung", F.lit(name)), "ground")
        out.append(got.select("query_id", "rung", "id", "answer", F.lit(None).cast("double").alias("top_score"), F.lit(None).cast("double").alias("score_gap")))
        left = written(left.join(got.select("query_id"), "query_id", "left_anti"), "ground-left")
    found = search(left.select("query_id", F.col("question").alias("query")))
    scores = found.contract.select("query_id", "top_score", "score_gap", "n_above_threshold")
    near = F.least(F.greatest(F.col("n_above_threshold"), F.lit(1)), F.lit(JUDGED))
    read = found.results.join(scores.where((F.col("top_score") >= TOP_FLOOR) & (F.col("score_gap") >= GAP_FLOOR)), "query_id").where(F.col("position") <= near)
    shown = read.select("query_id", "id", F.col("position").cast("long").alias("rank")).join(docs.select("id", "body"), "id").where(F.trim(F.coalesce("body", F.lit(""))) != "")
    shown = written(shown, "ground-shown")
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    quoted = shown.join(judge(left, shown), "query_id").where((squeezed(F.col("quote")) != "") & F.contains(squeezed(F.col("body")), squeezed(F.col("quote"))))
    cited = quoted.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where("k = 1").select("query_id", "id", F.col("quote").alias("answer"))
    last = left.select("query_id").join(scores.drop("n_above_threshold"), "query_id", "left").join(cited, "query_id", "left")
    out.append(last.select("query_id", F.when(F.col("answer").isNull(), "human").otherwise("knowledge_base").alias("rung"), "id", "answer", "top_score", "score_gap"))
    done = out[0]
    for o in out[1:]:
        done = done.unionByName(o)
    return done
