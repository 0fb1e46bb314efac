"""Whitening, token-id files and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from meterfold.llm import periodic_kernels, periodic_runs, token_files, token_files_kernels, whitening, whitening_kernels
from meterfold.llm.queries import FILE_TOKENIZER, _tokenizer_path
from meterfold.session import scratch_root

RNG = random.Random(9)
DOCS = "doc_id bigint, text string, nth string, shard int, start int, runs string, _words int"
VECTORS = "vec_id bigint, embedding array<float>, whitened int, deviation int, at int, place int"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def words_of(text):
    return (text or "").encode().split()


# --- whitening -----------------------------------------------------------------------------

def test_eigenvectors_of_clustered_values():
    rng = np.random.default_rng(5)
    for values in ([5, 5 - 1e-9, 3, 2, 2 - 1e-12, 1, 0.5, 0.1], [1] * 10 + list(1 + 1e-11 * np.arange(1, 11)), [7.0], [2.0, 2.0],
                   [1e6, 1] + [1e-6] * 10):
        lam = np.sort(np.array(values, np.longdouble))[::-1]
        q = np.linalg.qr(rng.normal(size=(len(lam), len(lam))))[0].astype(np.longdouble)
        for _ in range(4):
            q = q @ (1.5 * np.eye(len(lam)) - 0.5 * (q.T @ q))
        a = (q * lam) @ q.T
        found, x = whitening_kernels.eigen(a)
        assert np.abs(found - lam).max() <= 1e-15 * lam[0]
        assert np.abs(x.T @ x - np.eye(len(lam))).max() < 2e-15
        assert np.abs(a @ x - x * found).max() <= 1e-15 * lam[0]
        apart = np.abs(lam[:, None] - lam[None, :]) + np.eye(len(lam)) * lam[0]
        for k in np.flatnonzero(apart.min(axis=0) > 1e-10 * lam[0]):  # float64 solvers miss these by 1e-7
            assert min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max()) < 1e-8


def brute_whitening(vectors, components=8):
    """(vec_id, component) -> (n, deviation, whitened up to sign, explained)."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100000 for c in v] + [100000] * (width - len(v)) for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    values, axes = np.linalg.eigh(np.cov(np.array(x, float).T, bias=True))
    white = (np.array(x, float) - np.array(sums) / n) @ axes[:, ::-1][:, :components] / np.sqrt(values[::-1][:components])
    return n, [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x], np.abs(white), values[::-1] / values.sum(), kept


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=12) * np.arange(1, 13)).astype(np.float32).tolist()) for i in range(300)]
    good += [good[7], (None, good[8][1]), (900, good[9][1][:5]), (901, [])]  # repeated, without id, short, empty
    bad = [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11)]
    rows = [(i, v, 1, 2, 3, 4) for i, v in good + bad]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1).repartition(3)
    got = whitening.whitening_report(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, white, explained, kept = brute_whitening(good + bad)
    found = got.collect()
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), k + 1, deviation[j], round(white[j][k], 6)) for j, (i, _) in enumerate(kept) for k in range(8))
    assert sorted((key(r.vec_id), r.component, r.deviation, round(abs(r.whitened), 6)) for r in found) == want
    for r in found:
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
    signs = {r.component: [] for r in found}
    for r in sorted(found, key=lambda r: (key(r.vec_id), r.component)):
        signs[r.component].append(r.whitened)
    assert all(abs(np.mean(v)) < 1e-9 and abs(np.var(v) - 1) < 1e-9 for v in signs.values())


def test_whitening_of_few_or_no_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, 0, 0, 0)], VECTORS)
    rows = whitening.whitening_report(one).collect()
    assert [(r.component, r.n, r.deviation, r.whitened) for r in rows] == [(k, 1, 0, None) for k in (1, 2, 3)]
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, 0, 0, 0), (2, [5.0, 2.0, 3.0], 0, 0, 0, 0)], VECTORS)
    rows = sorted(whitening.whitening_report(two).collect(), key=lambda r: (r.component, r.vec_id))
    assert [abs(r.whitened) for r in rows[:2]] == [1, 1] and all(r.whitened is None for r in rows[2:])
    assert rows[0].whitened == -rows[1].whitened and rows[0].explained == 1
    assert whitening.whitening_report(one.limit(0)).collect() == []


def test_deviation_is_exact_beyond_a_long(spark):
    rows = [(k, [float(k * 2**20)] * 3, 0, 0, 0, 0) for k in range(2000)]
    df = spark.createDataFrame(rows, VECTORS)
    model = whitening.fit(whitening.moments(df, "embedding", whitening.LATTICE))
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df, model, lattice=whitening.LATTICE).collect()}
    sums = sum(k * 2**30 + 100000 for k in range(2000))
    assert got == {k: 3 * (2000 * (k * 2**30 + 100000) - sums) ** 2 for k in range(2000)}
    report = {r.vec_id: r.deviation for r in whitening.whitening_report(df).where("component = 1").collect()}
    assert report == {k: v if v < 2**63 else None for k, v in got.items()} and None in report.values()


# --- token-id files ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts():
    odd = [None, "", " \n", "a<|endoftext|>b", "<|startoftext|>", "é ́x", "A\x1cB\x85C D E", "ΑΣ ΣΑΣ. İ ǅ",
           "don't WE'LL 12345 ½ ②", "日本語 テキスト", "x" * 3000, "\U0001f600‍\U0001f525 !?", "ﬁ ẛ̣"]
    prose = [" ".join(RNG.choice(["Alpha", "beta,", "gamma's", "42", "Überzahl", "d'or"]) for _ in range(k)) for k in range(1, 40)]
    return odd + prose + [" ".join(prose) * 20]


def test_token_files_against_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(_tokenizer_path(FILE_TOKENIZER))
    rows = [(i * 3 - 5, t) for i, t in enumerate(texts)] + [(5, "twice here")] * 3 + [(None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], DOCS).repartition(3)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows}
    for options in ({"width": 2, "words_apart": True}, {"width": 4}, {"width": 4, "bucket_keys": 1, "shard_chars": 1000}):
        files, keys = token_files.write_files(df, _tokenizer_path(FILE_TOKENIZER), scratch_root(spark), **options)
        got = files.read(keys).collect()
        by_place = sorted(got, key=lambda r: r.start)
        assert [r.doc_id for r in by_place] == sorted(i for i, _ in rows if i is not None) + [None, None]
        at = 0
        for r in by_place:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens
        asked = lambda i: sorted((ids[t] for k, t in rows if k == i))
        for i in {i for i, _ in rows}:
            mine = [r for r in got if r.doc_id == i]
            assert sorted(r.nth for r in mine) == list(range(len(mine)))
            assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in mine) == asked(i)
    unknown = spark.createDataFrame([(-999, 0), (5, 3), (5, 2), (None, 1), (None, 2)], "doc_id bigint, nth long")
    places = {(r.doc_id, r.nth): r.start for r in files.look_up(unknown).collect()}
    assert places[(-999, 0)] is None and places[(5, 3)] is None and places[(None, 2)] is None
    assert places[(5, 2)] is not None and places[(None, 1)] is not None
    assert files.read(unknown).count() == 2


def test_token_file_report(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(_tokenizer_path(FILE_TOKENIZER))
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y", 3) for i, t in enumerate(texts)], DOCS).repartition(4)
    path = _tokenizer_path(FILE_TOKENIZER)
    got = token_files.token_file_report(df, path, width=2, words_apart=True)
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got.collect())) == want
    assert token_files.token_file_report(df.limit(0), path, width=2).collect() == []


def test_a_hot_id_is_numbered_over_shards(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id END AS doc_id", "'ab cd' AS text")
    files, keys = token_files.write_files(df, _tokenizer_path(FILE_TOKENIZER), scratch_root(spark), bucket_keys=64)
    got = files.read(keys).collect()
    assert len(got) == 3000 and len({r.start for r in got}) == 3000
    assert sorted(r.nth for r in got if r.doc_id == 7) == list(range(2000))
    assert keys.where("doc_id = 7").count() == 2000
    assert files.look_up(keys.where("doc_id = 7")).select("shard").distinct().count() > 1


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 17, 500, 3000):
        h1, h2 = (np.array([RNG.getrandbits(63) for _ in range(n)], np.int64) for _ in range(2))
        seed, group, _ = token_files_kernels._seeds(h1, h2)
        pilots, slots = token_files_kernels.build(seed, group)
        assert sorted(slots.tolist()) == list(range(n)) and len(pilots) == -(-n // token_files_kernels.GROUP_KEYS)
    with pytest.raises(ValueError):
        token_files_kernels.build(np.array([5, 5], np.uint64), np.array([0, 0], np.uint64))


# --- periodic runs -------------------------------------------------------------------------

def brute_runs(words, times=4, least=6):
    """Maximal stretches by every period; an interval counts with its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rng):
    n = rng.randint(0, 70)
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 9)
        words = [words[i] if i < a else words[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return words


def test_catchers_know_all_runs_after_every_append():
    rng = random.Random(1)
    for _ in range(400):
        words, times, at = random_words(rng), rng.choice([2, 3, 4]), 0
        catchers = periodic_kernels.SquareCatchers(times, 6)
        while at < len(words):
            step = rng.choice([1, 1, 2, 7, 60])
            catchers.append(words[at:at + step])
            at += step
            got = [tuple(map(int, r)) for r in zip(*catchers.runs())]
            assert got == brute_runs(words[:at], times)


def test_names_that_collide_cost_no_run(monkeypatch):
    monkeypatch.setattr(periodic_kernels, "_values", lambda words: (words > 0).astype(np.uint64))
    rng = random.Random(2)
    for _ in range(300):
        words = random_words(rng)
        catchers = periodic_kernels.SquareCatchers()
        catchers.append(words)
        assert [tuple(map(int, r)) for r in zip(*catchers.runs())] == brute_runs(words)


def planted(doc_id, words):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_run_report_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join("abcdefgh"[w] for w in random_words(rng)) for _ in range(150)]
    texts += [None, "", " ", "w", "w " * 5, "w " * 6, "é x " * 9, "a\tb\x0bc\nd " * 30, "same " * 3000, " ".join(map(str, range(700)))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2 + [(None, "a b " * 8), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], DOCS).repartition(3)
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, words_of(text))
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        want.append((doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
                     sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = periodic_runs.run_report(periodic_runs.with_planted_periods(df))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 50 and any(planted(i, words_of(t)) != words_of(t) for i, t in rows)
    assert periodic_runs.run_report(df.limit(0)).collect() == []
