"""Periodic runs against brute force, planted repeats and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from huescope.llm import queries, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - a + p >= max(6, 4 * p):
                found.setdefault((a, i - a + p), p)
    rows = sorted((a, size, p) for (a, size), p in found.items())
    gone = {i for a, size, p in rows for i in range(a + p, a + size)}
    best = None
    for r in rows:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    one = best or (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, len(rows), *one, 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{s},{p}\n" for a, s, p in rows)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = order(brute(r.doc_id, r.text, True) for r in docs)
    assert order(runs.document_runs(spark.read.parquet(f"{SF}/documents.parquet"), plant=True).collect()) == want
    assert sum(w[2] for w in want) > 10
    assert queries.QUERIES["op13_periodic_runs"](spark, SF).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words(spark, letters):
    rng = np.random.default_rng(letters)
    rows = [(i, " ".join("abc"[x] for x in rng.integers(0, letters, rng.integers(0, 60)))) for i in range(150)]
    rows += [(200, " ".join(["x y z"] * 9 + ["q"] + ["x y"] * 7)), (201, "a " * 5), (202, "a " * 6), (203, "a b " * 3 + "a"), (204, "a b " * 4)]
    got = runs.document_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(got) == order(brute(i, t, False) for i, t in rows)


def test_odd_rows(spark):
    long = " ".join(["word"] * 5000 + [f"w{i}" for i in range(2000)] + ["p q r"] * 900)
    rows = [(1, None, 0), (2, "", 0), (3, " \n ", 0), (None, "a a a a a a a", 0), (5, "b b b b b b", 0), (5, "b b b b b b", 1), (6, long, 0), (7, "Ä Ä Ä Ä Ä Ä   Ä", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length int")
    assert order(runs.document_runs(frame, plant=True).collect()) == order(brute(i, t, True) for i, t, _ in rows)
    assert runs.document_runs(frame.limit(0)).collect() == []


def test_a_lying_hash_is_found_out(monkeypatch):
    ids = np.array([1, 2] * 8 + list(range(3, 40)))
    monkeypatch.setattr(runs.Prefixes, "equal", lambda self, at, p, length: np.ones(len(at), bool))
    assert runs.find_runs(ids, np.array([len(ids)])).tolist() == [[0, 0, 16, 2]]


def test_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    ids, counts = rng.integers(0, 2, 300), np.array([100, 0, 3, 197])
    whole = runs.find_runs(ids, counts).tolist()
    monkeypatch.setattr(runs, "BLOCK", 7)
    assert runs.find_runs(ids, counts).tolist() == whole
