"""Duplicate search, similarity join, vector search and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import chunk_dedup, jaccard_join, queries, shared, suffix_dedup, vector_search
from plumbline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}


def cut(text, gone):
    runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
    return len(text), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("crowded", [2048, 2])
def test_suffix_dedup(docs, rows, empty, crowded):
    seen, want = set(), {}
    for r in sorted(rows):
        text = (r[1] or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(text[i : i + 100])
        want[r[0]] = cut(text, gone)
    assert digest(suffix_dedup.suffix_dedup(docs, max_contexts=crowded).collect()) == want
    if crowded == 2:
        assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("extend", [True, False, None])
def test_dedup_without_ids_and_with_repeats(spark, extend):
    """extend None: by suffixes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7))
    a, b = (" ".join(word() for _ in range(60)) for _ in range(2))
    rows = [(7, a), (7, a), (7, b), (None, a), (None, None), (2, b), (3, "short"), (3, "x" * 5), (9, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, doc long")
    found = suffix_dedup.suffix_dedup(df) if extend is None else chunk_dedup.chunk_dedup(df, extend=extend)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in found.collect())
    assert got == Counter([(7, 479, 0), (7, 479, 0), (7, 479, 479), (None, 479, 479), (None, 0, 0), (2, 479, 0), (3, 5, 0), (3, 5, 0), (9, 0, 0)])


def test_suffix_blocks_of_long_texts(monkeypatch):
    """Pieces of a long text have every string once, and equal strings the same gram."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    texts = ["x" * 300, text, "short", None, text[:2600], text[700:800]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc", "text"])
    monkeypatch.setattr(shared, "SLICE_BYTES", 500)
    seen = {}
    for piece in (1 << 20, 1000, 777):
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
        strings = Counter()
        for out in suffix_dedup._blocks(iter([batch])):
            for gram, _, doc, at in zip(*(c.to_pylist() for c in out.columns), strict=True):
                start, count, anchor = at >> 14, (at >> 7) & 127, at & 127
                for j in range(start, start + count):
                    strings[doc, j] += 1
                    assert seen.setdefault(texts[doc][j : j + 100], gram) == gram
                assert anchor <= 76
        assert strings == Counter((d, j) for d, x in enumerate(texts) for j in range(len(x or "") - 99))


def test_runs_of_crowded_strings(monkeypatch):
    """Small runs, cut anywhere and merged: every string but the first of its kind is found."""
    rng = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "RUN_STRINGS", 150)
    base = "".join(rng.choice("ab") for _ in range(400))
    texts = [base[k : k + rng.randint(100, 300)] for k in (rng.randrange(250) for _ in range(30))]
    texts = [t for t in texts if len(t) >= 100]
    block = lambda t: [{"at": (s << 14) | (min(77, len(t) - 99 - s) << 7), "crowded": True} for s in range(0, len(t) - 99, 77)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([block(t) for t in texts])], ["doc", "text", "blocks"])
    limits = sorted({base[k : k + 100].encode() for k in (3, 80, 200, 290)})
    runs, spans = {}, []
    for out in suffix_dedup._sorted_runs([], limits)(batch.slice(k, 1) for k in range(len(batch))):
        for part, run, *span in zip(*(c.to_pylist() for c in out.columns), strict=True):
            if part is None:
                spans.append(span)
            else:
                runs.setdefault(part, []).append(run)
    assert len(runs) > 2 and max(map(len, runs.values())) > 3
    for some in runs.values():
        spans += suffix_dedup.merge_strings(some)
    got = {(d, j) for d, a, b in spans for j in range(a, b)}
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                want.update((d, x) for x in range(j, j + 100))
            seen.add(t[j : j + 100])
    assert got == want


def test_loser_tree_merges():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))), b"l", 1, i, j) for j in range(rng.randint(1, 30))) for i in range(k)]
        merged = list(suffix_dedup.LoserTree([suffix_dedup.front_code(r) for r in runs]))
        assert [m[0] for m in merged] == sorted(e[0] for r in runs for e in r)
        assert [m[1] for m in merged] == [suffix_dedup.common_prefix(a, b[0]) for a, b in zip([b"", *[m[0] for m in merged]], merged, strict=False)]


def test_chunk_dedup(docs, rows, empty):
    first, chunks = {}, {}
    for r in sorted(rows):
        text = (r[1] or "").encode()
        ends = chunk_dedup.chunk_ends(text)
        assert ends == sorted(set(ends)) and (not text or ends[-1] == len(text))
        chunks[r[0]] = [(a, b, text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        for a, _, c in chunks[r[0]]:
            first.setdefault(c, (r[0], a))
    want = {}
    for r in rows:
        text = (r[1] or "").encode()
        runs, gone = [], bytearray(len(text))
        for a, b, c in chunks[r[0]]:
            if first[c] != (r[0], a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        for a, b in runs:
            if b - a >= 40:
                gone[a:b] = b"\1" * (b - a)
        want[r[0]] = cut(text, gone)
    assert digest(chunk_dedup.chunk_dedup(docs, min_run=40).collect()) == want
    assert chunk_dedup.chunk_dedup(empty).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    moved = text[:5000] + b"inserted" + text[5000:]
    pieces = lambda t: {t[a:b] for a, b in zip([0, *chunk_dedup.chunk_ends(t)], chunk_dedup.chunk_ends(t), strict=False)}
    assert len(pieces(text) - pieces(moved)) < 10


def sets_of(rows):
    out = {}
    for r in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        out[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets):
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {d: top(d) for d in sets}


def near_copies():
    rng = random.Random(5)
    words = [f"v{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(n)] for n in (8, 30, 60, 120, 120)]
    rows = []
    for i in range(260):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("hot", [8, 2])
def test_jaccard_join(spark, docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_COUNT", hot)
    near = near_copies()
    both = [(docs, rows), (spark.createDataFrame(near, "doc_id long, text string"), near)]
    for df, data in both[hot == 2 :]:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df).collect()}
        sets = sets_of(data)
        want = brute_components(sets)
        assert got == {d: (len(sets[d]), want[d]) for d in sets}
    if hot == 2:
        assert jaccard_join.jaccard_join(empty).count() == 0


def crowd(rng, words, size, changes, n=60):
    """Near copies of one text, most of them just too different from one another."""
    base = [rng.choice(words) for _ in range(n)]
    out = []
    for k in range(size):
        b = list(base)
        for j in range(changes[k % len(changes)]):
            b[rng.randrange(len(b))] = f"own{k}x{j}"
        out.append(" ".join(b))
    return out


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_BYTES, 2000])
def test_jaccard_join_of_crowds(spark, monkeypatch, block):
    """Crowds just below and above 0.8, of short and long texts, in cells of any size."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(jaccard_join, "_UNPACKED", 2048 if block == 2000 else jaccard_join._UNPACKED)
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    texts = crowd(rng, words, 120, [1, 2, 2, 3]) + crowd(rng, words, 60, [2]) + crowd(rng, words, 12, [9, 14, 20, 30], 900)
    data = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(data)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = brute_components(sets_of(data))
    assert got == want
    assert 20 < len(set(want.values())) < len(want) - 20


def test_every_link(spark):
    rng = random.Random(12)
    words = [f"v{k}" for k in range(300)]
    texts = crowd(rng, words, 50, [0, 1, 1, 2, 3]) + crowd(rng, words, 30, [1], 40) + ["", None, "one two", "one two", "One  two"]
    data = list(enumerate(texts))
    sets = sets_of(data)
    want = {i: sum(1 for j in sets if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    got = {r.doc_id: r.n_links for r in jaccard_join.link_counts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) > 10 and 0 in want.values()


def test_near_pairs_of_bitmaps():
    rng = random.Random(1)
    sets = []
    for n in (30, 200, 700, 1500):
        base = [rng.getrandbits(63) for _ in range(n)]
        for k in range(12):
            sets.append(np.array(sorted({*base[: n - rng.randint(0, n // 5)], *(rng.getrandbits(63) for _ in range(rng.randint(0, n // 6)))}), np.uint64))
    n = np.array([len(s) for s in sets])
    rows = (n, n, np.arange(len(sets)) % 7, np.arange(len(sets)) % 5 > 0, [jaccard_join._bitmap(s) for s in sets])
    a, b, far = jaccard_join.near_pairs(rows, None)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    real = [set(s.tolist()) for s in sets]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if rows[2][i] != rows[2][j] and (rows[3][i] or rows[3][j]) and 5 * len(real[i] & real[j]) >= 4 * len(real[i] | real[j])}
    assert {(min(x), max(x)) for x in links} <= got and links
    assert all(f <= len(real[i] ^ real[j]) for i, j, f in zip(a.tolist(), b.tolist(), far.tolist(), strict=True))
    half = len(sets) // 2
    some = [tuple(c[x] if isinstance(c, np.ndarray) else c[x] for c in rows) for x in (slice(0, half), slice(half, None))]
    a, b, _ = jaccard_join.near_pairs(*some)
    assert set(zip(a.tolist(), (b + half).tolist(), strict=True)) == {(i, j) for i, j in got if i < half <= j}


def test_jaccard_join_without_ids_and_with_repeats(spark):
    long = " ".join(f"w{k}" for k in range(40))
    near = long + " end"
    rows = [(5, long), (None, long), (9, near), (9, near), (9, "five other words stand here"), (None, "quite another text of some words"), (None, None), (3, ""), (3, "five other words stand here")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df).collect())
    assert got == Counter([(5, 36, 5), (None, 36, 5), (9, 37, 5), (9, 37, 5), (9, 1, 3), (None, 2, None), (None, 0, None), (3, 0, 3), (3, 1, 3)])
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], (None, "quite another text of some words"), (None, None), (3, ""), (3, "five other words stand here")])
    twice = jaccard_join.one_of_each(df.where("doc_id = 9")).collect()
    assert Counter((r.doc_id, r.text) for r in twice) == Counter([(9, near), (9, "five other words stand here")])


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 150), (150, 120), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {150: 100, 120: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, every=50, k=5):
    """(query id, [(id, score)..]) of each query row, in plain double arithmetic."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    out = []
    for q, x in good:
        if q % every == 0:
            near = [(float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i) for i, v in good if i != q and len(v) == len(x)]
            out.append((q, sorted(((-round(s, 12), i) for s, i in near))[:k]))
    return sorted(out)


def answers(found):
    """As brute_nearest() of query ids that occur once, with ranks checked."""
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("shard_bytes", [vector_search.SHARD_BYTES, 16 * 8 * 200])
def test_vector_search(spark, shard_bytes):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    v = (centres[rng.integers(30, size=3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[40:400] = v[40]  # copies of one vector
    rows = [(i, [float(x) for x in a], "r") for i, a in enumerate(v)]
    rows += [(3000, None, "r"), (3050, [0.0] * 16, "r"), (3100, [float("nan")] + [1.0] * 15, "r"), (3101, [None] + [1.0] * 15, "r"), (3102, [float("inf")] + [1.0] * 15, "r"), (None, [1.0] * 16, "r")]
    rows += [(3150, [1.0, 2.0], "r"), (3151, [1.0, 2.5], "r"), (3200, [1.0, 2.0, 3.0], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    want = dict(brute_nearest([r[:2] for r in rows]))
    for factor, least in ((1.0, 1.0), (vector_search.FACTOR, 0.9)):
        got = answers(vector_search.nearest(df, factor=factor, shard_bytes=shard_bytes))
        assert set(got) == {q for q in want if want[q]}
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
        assert hits >= least * sum(len(want[q]) for q in got)
        if factor == 1.0:
            assert all(got[q] == want[q] for q in got)
    few = vector_search.nearest(df.where("vec_id IN (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]
    assert vector_search.nearest(df.limit(0)).count() == 0


def test_vector_search_of_extremes_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in a * 10.0 ** (300 if i % 3 else -300)]) for i, a in enumerate(base)]
    rows += [(100, [1e200] * 8), (101, [1e-320] * 8), (102, [2e200] * 8), (50, rows[7][1]), (50, rows[8][1]), (50, rows[8][1]), (7, rows[20][1])]
    got: dict = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=1.0, shard_bytes=600).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    want: dict = {}
    for q, near in brute_nearest(rows):
        want.setdefault(q, []).extend(near)
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert len(want[50]) == 15 and {i for _, i in want[100]} >= {101, 102}


def test_router_reaches_every_neighbour():
    rng = np.random.default_rng(5)
    rows = vector_search.unit(rng.normal(size=(900, 6)))
    router = vector_search.Router(np.unique(rows[:300], axis=0), 20)
    home = [x[0] for x in router.visited(rows)]
    assert router.leaves == 20 and set(home) == set(range(20))
    reach = router.visited(rows[:50], np.full(50, 0.3 + 1e-7))
    for q in range(50):
        near = np.flatnonzero(np.sqrt(np.maximum(0, 2 - 2 * rows @ rows[q])) <= 0.3)
        assert {home[i] for i in near} <= set(reach[q])
    assert sum(map(len, reach)) < 50 * 20


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    tables = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = current
        current = stage(spark, current, str(tmp_path)).cache()
        tables[name] = Counter(r.doc_id for r in current.collect())
        assert current.columns == before.columns
    names = list(tables)
    sets = sets_of([r for r in rows if r[0] in tables[names[0]]])
    comp = brute_components(sets)
    assert set(tables[names[1]]) == {d for d in sets if comp[d] == d}
    assert tables[names[2]] == tables[names[1]] and set(tables[names[3]]) <= set(tables[names[2]])
    assert got == tables[names[3]]
    assert all(stage(spark, docs.limit(0), "").count() == 0 for name, stage in corpus_pipeline.STAGES if name != names[1])


def test_queries_are_registered():
    import __spark_entry__ as e

    numbers = [k.split("_")[0] for k in queries.QUERIES if k.startswith("op")]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 11)) and set(queries.QUERIES) <= set(e.queries())
