"""Repeated passages against brute force and SQL."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

from huescope.llm import queries, substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    rank = [float("inf") if i is None else i for i, _ in rows]
    for r, ws in zip(rank, words, strict=True):
        for k in range(len(ws) - window + 1):
            s = tuple(ws[k : k + window])
            first[s] = min(first.get(s, r), r)
    out = []
    for (i, _), r, ws in zip(rows, rank, words, strict=True):
        gone = {j for k in range(len(ws) - window + 1) if first[tuple(ws[k : k + window])] < r for j in range(k, k + window)}
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out, key=repr)


def digests(rows):
    return sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in rows), key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = queries.QUERIES["op12_substring_dedup"](spark, SF)
    rel = con.sql(queries.sql()["op12_substring_dedup"])
    assert rel.columns == frame.columns
    rows = got(frame)
    assert rows == sorted(rel.fetchall(), key=repr)
    assert rows == digests(brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 50))
    assert sum(r[2] > 0 for r in rows) > 3


@pytest.mark.parametrize("letters,seed", [(2, 1), (3, 2), (40, 3)])
def test_automaton(letters, seed):
    """Least ranks of windows against sets of windows, over few words, where everything overlaps."""
    rng = np.random.default_rng(seed)
    texts = [[str(x) for x in rng.integers(0, letters, rng.integers(0, 40))] for _ in range(12)]
    one = substrings.Automaton()
    for rank, t in enumerate(texts):
        one.add(t, 100 - rank)
    one.close()
    query = [str(x) for x in rng.integers(0, letters, 60)] + texts[3] + texts[7]
    for window in (1, 3, 8):
        known = {}
        for rank, t in enumerate(texts):
            for k in range(len(t) - window + 1):
                known[tuple(t[k : k + window])] = 100 - rank  # later texts have lesser ranks
        want = [known.get(tuple(query[i - window + 1 : i + 1]), substrings.LAST) if i >= window - 1 else substrings.LAST for i in range(len(query))]
        assert one.matches(query, window) == want


def test_shards_and_copies(spark, monkeypatch):
    """Passages that many documents share, at document edges, overlapping, and in copies, over many shards and tasks."""
    monkeypatch.setattr(substrings, "SHARD", 60)
    monkeypatch.setattr(substrings, "QUERY", 200)
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{k}.{i}" for i in range(n)) for k, n in enumerate((20, 20, 25, 60))]
    filler = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 10**6, n))
    rows = []
    for i in range(60):
        parts = [filler(int(rng.integers(0, 15))), passages[i % 4], filler(int(rng.integers(0, 3))), passages[int(rng.integers(0, 4))], passages[0] if i % 3 else ""]
        rows.append((int(rng.integers(0, 50)), " \n ".join(parts)))
    rows += [(99, rows[0][1]), (99, rows[0][1]), (None, rows[1][1]), (None, " ".join(["a b"] * 40)), (98, " ".join(["a b"] * 30)), (97, " ".join(["a b"] * 10 + ["c"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.substring_digests(frame, 20)) == digests(brute(rows, 20))


def test_odd_rows_and_texts(spark):
    long = " ".join(f"w{i % 4000}" for i in range(9000))
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "one", 5), (5, long, 5), (6, long + " tail", 5), (6, long + " tail", 6), (7, "Ä   ö " * 60, 7), (8, "Ä  ö " * 60, 7), (None, long, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    want = brute([r[:2] for r in rows], 50)
    assert got(substrings.substring_digests(frame)) == digests(want)
    cut = substrings.without_repeats(frame)
    assert cut.columns == frame.columns
    kept = {(i, n): t for i, n, m, t in want if m}
    left = sorted(((r.doc_id, r.text, r["rank"]) for r in cut.collect()), key=repr)
    assert left == sorted(((i, kept.get((i, len(WORD.findall(t or ""))), t), n) for i, t, n in rows), key=repr)
    assert substrings.substring_digests(frame.limit(0)).collect() == [] and substrings.without_repeats(frame.limit(0)).collect() == []
