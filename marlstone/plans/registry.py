"""All queries of the engine by name, with their SQL oracles."""

from __future__ import annotations

from marlstone.plans import frames, ingest, jobs, lexical, notes, portable, reqs, stores

QUERIES: dict = {k: portable.query(v) for k, v in portable.PLANS.items()} | frames.Q | lexical.Q | notes.Q | ingest.Q | reqs.Q | jobs.Q | stores.Q
ORACLES: dict = {k: portable.oracle(v) for k, v in portable.PLANS.items()} | frames.O | lexical.O | notes.O | ingest.O | reqs.O | jobs.O | stores.O


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
