"""A repository in step with a catalog: after any history it equals a fresh read."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone.operators import sync
from marlstone.sources import versions

rng = random.Random(11)


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "repo"
    path.mkdir()

    def git(*a):
        return subprocess.run(["git", "-C", str(path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    return path, git


@pytest.fixture
def catalog(spark, tmp_path):
    return versions.Catalog(spark, f"file://{tmp_path}/catalog", 4)


def held(catalog):
    return {r["title"]: r["body"] for r in catalog.read("documents").where("NOT tombstoned").collect()}


def tree(path):
    out = {}
    for f in path.rglob("*"):
        if f.is_file() and ".git" not in f.relative_to(path).parts:
            data = f.read_bytes()
            if b"\0" not in data[:8192] and len(data) <= 512 * 1024:
                out[str(f.relative_to(path))] = data.decode()
    return out


def change(path, git):
    names = [str(f.relative_to(path)) for f in path.rglob("*") if f.is_file() and ".git" not in f.relative_to(path).parts]
    for _ in range(rng.randrange(1, 5)):
        what, name = rng.choice(["add", "add", "edit", "delete", "rename", "swap", "binary"]), rng.choice(names) if names else None
        if what == "add" or name is None or not (path / name).exists():
            f = path / rng.choice(["a", "src/b", "src/deep/c"]) / f"f{rng.randrange(12)}.ts"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(f"new {rng.randrange(1000)}\nline")
        elif what == "edit":
            (path / name).write_text(f"edited {rng.randrange(1000)}")
        elif what == "binary":
            (path / name).write_bytes(b"a\0b")
        elif what == "delete":
            (path / name).unlink()
        elif what == "rename":
            (path / name).rename(path / f"moved{rng.randrange(8)}.ts")
        else:  # renamed away and made anew
            (path / name).rename(path / f"moved{rng.randrange(8)}.ts")
            (path / name).write_text("in its place")
    git("add", "-A")
    git("commit", "-q", "--allow-empty", "-m", "x")


def step(catalog, path, at, **how):
    return sync.sync(catalog, str(path), "r", "t", at, **how)


def test_any_history_ends_as_a_fresh_read(spark, catalog, repo):
    path, git = repo
    for at in range(1, 6):
        for _ in range(rng.randrange(1, 4)):
            change(path, git)
        r = step(catalog, path, at)
        assert r.mode == ("full" if at == 1 else "changes") and r.failed == [] and r.cursor == git("rev-parse", "HEAD")
        assert held(catalog) == tree(path)
        chunked = {r["id"] for r in catalog.read("chunks").select("id").distinct().collect()}
        assert chunked == {f"code:r:{n}" for n, body in tree(path).items() if body.strip()}
    assert step(catalog, path, 9).mode == "none"


def test_an_unknown_revision_takes_everything_and_retires_the_rest(spark, catalog, repo):
    path, git = repo
    (path / "a.ts").write_text("one")
    (path / "b.ts").write_text("two")
    git("add", "-A")
    git("commit", "-qm", "x")
    step(catalog, path, 1)
    git("checkout", "-q", "--orphan", "other")
    (path / "a.ts").unlink()
    git("add", "-A")
    git("commit", "-qm", "rewritten")
    sync._advance(catalog, "r", "0" * 40)
    catalog.upsert(spark.createDataFrame([("t", "code:other:z.ts", "z.ts", "z", "", "")], versions.BATCH), 1)
    r = step(catalog, path, 2)
    assert r.mode == "full" and r.retired == 1 and held(catalog) == {"b.ts": "two", "z.ts": "z"}
    assert {r["id"]: r["revision"] for r in catalog.read("documents").collect()} == {"code:r:a.ts": 1, "code:r:b.ts": 1, "code:other:z.ts": 1}


def test_a_file_that_fails_holds_the_cursor(spark, catalog, repo):
    path, git = repo
    (path / "a.ts").write_text("one")
    git("add", "-A")
    git("commit", "-qm", "x")
    first = step(catalog, path, 1).cursor
    (path / "a.ts").write_text("two")
    (path / "b.ts").write_text("three")
    git("add", "-A")
    git("commit", "-qm", "y")
    fails = lambda c, repo, wanted: sync.working_tree(c, repo, wanted).withColumn("content", F.when(F.col("path") != "b.ts", F.col("content")))
    r = step(catalog, path, 2, read=fails)
    assert r.failed == ["b.ts"] and r.cursor == first == sync.cursor_of(catalog, "r") and held(catalog) == {"a.ts": "two"}
    r = step(catalog, path, 3)
    assert r.failed == [] and held(catalog) == {"a.ts": "two", "b.ts": "three"} and r.cursor == git("rev-parse", "HEAD")
    assert {r["title"]: r["revision"] for r in catalog.read("documents").collect()} == {"a.ts": 2, "b.ts": 1}
    assert step(catalog, path, 4, include=("*.md",)).mode == "none"
