"""The pipeline's stages on a small table."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="corpus tables absent")
def test_stages_keep_the_columns_and_run_agrees(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, total = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        assert 0.5 * total < docs.count() <= total, name
    mixed = corpus_pipeline.run(spark, SMALL)
    assert mixed.columns[:len(columns)] == columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= kept


def test_near_copy_stage_keeps_one_document_of_each_group(spark):
    words = [" ".join(f"{stem}{k}" for k in range(40)) for stem in ("a", "b", "c", "d", "e")]
    rows = [(None, words[0], "s"), (None, words[0], "s"), (None, words[0].upper(), "t"),  # copies without ids
            (5, words[1], "s"), (5, words[1], "s"), (None, words[1], "s"),  # a repeated row and one without an id
            (1, words[2], "s"), (7, words[2], "s"), (7, words[3], "s"),  # another text under a dropped copy's id
            (9, words[4], "s"), (None, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([("None", words[0]), ("5", words[1]), ("1", words[2]), ("7", words[3]), ("9", words[4]),
                          ("None", "")])


# --- every stage but language ID and the draw against plain Python -----------------------------

CLASHES = ("doc_id bigint, text string, lang string, source string, n_chars bigint, hit_id string, hit_h int, _key string, "
           "_n int, _doc int, _lines int, _gone int, text_hash string, fp string, block int, size int, end int, row int, names int")
RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choices("abdegiklmnorstu", k=RNG.randint(2, 9))) for _ in range(600)]


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def without_lines(rows):
    """Lines of at least 40 characters in at least five documents stay in the largest id alone."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, text, *rest in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), *rest))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def without_near_copies(rows):
    prints = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 3:
                root[find(x)] = find(y)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[find(x)].append(rows[x])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_benchmark(rows, items):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    windows = {tuple(w[k:k + 10]) for w in map(words, items) if w for k in range(max(len(w) - 9, 1))}
    held = lambda w: any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return [r for r in rows if not held(words(r[1]))]


def test_stages_against_plain_python(spark, tmp_path):
    line, item = "This notice is repeated in a good many documents.", prose(14)
    rows = [(i, prose(RNG.randint(20, 60)), "s1" if i % 3 else "s2") for i in range(60)]
    rows += [(100 + i, f"{prose(30)}\n {line.upper()}\t\n{prose(12)}", "s1") for i in range(6)]
    rows += [(200 + i, rows[5][1], "s2") for i in range(4)] + [(210, rows[6][1].upper(), "s1"), (5, rows[5][1], "s1")]
    rows += [(300, f"{prose(20)} {item} {prose(9)}", "s1"), (301, prose(25), None), (None, prose(40), "s2"), (302, prose(4000), "s1")]
    rows += [(303, "the end", "s1"), (304, f"{prose(15)} the END, {prose(15)}", "s1"), (305, "", "s2"), (306, None, "s2")]
    spark.createDataFrame([(1, item), (2, "the end"), (3, None)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ("h", 1, "k", 2, 3, 4, 5, "t", "f", 6, 7, 8, 9, 10)
    docs = spark.createDataFrame([(i, t, "xx", s, 7, *extra) for i, t, s in rows], CLASHES).repartition(3)
    stages, want = dict(corpus_pipeline.STAGES), rows
    for name, plain in (("line_dedup", without_lines), ("simhash", without_near_copies),
                        ("decontaminate", lambda r: without_benchmark(r, [item, "the end", None]))):
        want = plain(want)
        docs = corpus_pipeline.written(stages[name](spark, docs, str(tmp_path)))
        assert docs.schema.fieldNames()[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 19
        got = docs.collect()
        assert Counter((r.doc_id, r.text or "") for r in got) == Counter((i, t or "") for i, t, _ in want), name
        assert all(tuple(r)[5:] == extra for r in got)
    assert 50 < len(want) < len(rows) - 8
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns[:19] == docs.columns
    drawn = Counter(r.doc_id for r in mixed.collect())
    assert set(drawn) <= {i for i, *_ in want} and max(drawn.values()) <= 3
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name


def test_language_stage_on_clashing_names(spark):
    extra = ("h", 1, "k", 2, 3, 4, 5, "t", "f", 6, 7, 8, 9, 10)
    rows = [(i, prose(40) if i % 2 else "".join(RNG.choices("уеыаоэяию ", k=200)), "aa" if i % 2 else "bb", None, 7, *extra)
            for i in range(40)] + [(None, prose(30), None, None, 7, *extra), (90, "12 3", "aa", None, 7, *extra), (91, None, "aa", None, 7, *extra)]
    docs = spark.createDataFrame(rows, CLASHES).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if r[0] not in (90, 91))
