"""Every operator against brute force, on rows with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import plan_of
from pyspark.sql import functions as F

from meterfold.llm import (
    decontaminate, language_id, line_dedup, mixing, pii, ppm_kernels, repeats, simhash, token_counts, topk, toxicity,
)
from meterfold.llm.queries import _tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, block int"
RNG = random.Random(4)
SYLLABLES = ["ba", "ko", "ti", "re", "lun", "mos", "da", "vi", "ser", "pon", "é", "ß"]
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    passage, line, common = prose(60), "Licensed under some LICENCE, " + prose(6), prose(300)
    texts = [None, "", " ", "\n\n", "one", "A b", "12 345 ?!", line, f"{line}\n{prose(20)}", f"  {line.upper()}\t\n{prose(9)}"]
    texts += [f"{prose(30)}\n{line}\n{prose(5)}" for _ in range(5)]
    texts += [f"{prose(k)} {passage} {prose(9 + k)}" for k in (3, 11, 40)] + [common, common, common + " end", common.upper()]
    texts += ["ab " * 120, "ab " * 130 + "cd", "aa " * 70, prose(6000), " ".join(["x y z"] * 60)]
    texts += [f"mail a.b@c-d.example.com and x@y.z_q@w.v {prose(4)}", "ip 1.2.3.4.5 and 300.1.1.1 or 001.002.003.255!",
              "cards 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111114111111111111111 é+33 (1) 23-45-67-89",
              "+1 (017) 555-7713 +12 3 tel +1.2.3.4.5.6.7.8.9.0.1", "a@b.c" * 40, "1" * 5000, "1.1." * 2000, "9 " * 3000]
    out = [(i, t, "fr" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 7, 1, "x", 2) for i, t in enumerate(texts)]
    out += [(100, prose(55), "fr", "s1", 0, 1, "x", 2)] * 2  # a repeated row
    out += [(None, passage, "fr", None, 0, 1, "x", 2), (None, None, None, None, 0, 1, "x", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def multiset(values):
    return Counter(map(tuple, values))


def test_decontaminate(spark, docs, rows, none):
    items = [(1, prose(14)), (2, " ".join((rows[15][1] or "").split()[20:34])), (3, "ab ab AB"), (4, None), (5, " ?"),
             (None, "one"), (2, "x y z x y z x y z x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        ws = word.findall(lower(text or ""))
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows[tuple(ws[i:i + n])].add(item)
    want = []
    for doc, text in texts(rows):
        ws, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if owners := windows.get(tuple(ws[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in owners if x is not None}
        want.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    assert multiset(decontaminate.contamination_report(docs, bench).collect()) == multiset(want)
    assert multiset(decontaminate.contamination_report(docs.dropDuplicates(), bench, limit=40).collect()) == multiset(set(want))
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    best = {(r.item, r.item_pos): r.length for r in decontaminate.longest_matches(docs, bench).collect()}
    assert best["2", 0] in (10, 14) and max(best.values()) >= 14
    assert not decontaminate.contamination_report(none, bench).count()
    assert not any(r.contaminated for r in decontaminate.contamination_report(docs, bench.limit(0)).collect())


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 6)) * np.repeat([1, 3], 60)[:, None])]
    vectors += [(200, vectors[3][1]), (200, vectors[3][1]), (220, [0.5] * 6), (None, [1.0] * 6), (7, None),
                (20, [float("nan")] * 6), (40, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    real = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in vectors
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (q, v) in enumerate(real):
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for b, (i, w) in enumerate(real) if a != b)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert multiset(topk.top_k(frame, block=30, query_block=4).collect()) == multiset(want)
    few = topk.top_k(frame.where("vec_id < 3")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert not topk.top_k(frame.limit(0)).count()


def test_pii(docs, rows, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def valid(kind, text):
        d = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    want = []
    for doc, text in texts(rows):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items())
                       for m in re.finditer(p, text) if valid(kind, m.group()))
        counts = Counter(s[2] for s in spans)
        want.append((doc, *(counts[k] for k in patterns), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))))
    got = pii.pii_report(docs).collect()
    assert multiset(r[:6] for r in got) == multiset(want)
    for r in got:
        base = [s for s in r.spans.split(",") if s]
        assert len(base) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert not pii.pii_report(none).count()


def test_votes_separate_true_from_false_spans():
    counts = [((1, 1, 1, 1, 1), 500), ((1, 1, 0, 1, 1), 200), ((1, 0, 0, 0, 0), 400), ((0, 0, 0, 0, 1), 100)]
    belief = pii.aggregate_votes(counts)
    assert belief[0] > 0.9 and belief[1] > 0.9 and belief[2] < 0.1 and belief[3] < 0.1
    weights = pii.train_classifier(counts, belief)
    z = [weights[0] + sum(w * x for w, x in zip(weights[1:], v)) for v, _ in counts]
    assert z[0] > 0 > z[2]


def test_language_id(spark, docs, none):
    words = {"xx": ["ka", "lo", "mi"], "yy": ["zut", "pre", "war"], "zz": ["ça", "été", "où"]}
    rng = random.Random(2)
    known = [(i, " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(40)), lang)
             for i in range(300) for lang in [rng.choice(list(words))]]
    frame = spark.createDataFrame(known, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_report(frame).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].lang_pred == known[i][2] and 0.9 < got[i].score <= 1 for i in held)
    mixed = language_id.language_report(docs).collect()
    assert len(mixed) == docs.count() and {r.lang_pred for r in mixed} <= {"fr", "und"}
    assert language_id.language_report(frame.withColumn("lang", frame.lang.substr(9, 1))).count() == 300
    assert not language_id.language_report(none).count()
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").isEmpty()


def test_code_lengths_are_exact():
    langs, training = ["a", "b"], {"a": b"abracadabra\n" * 3, "b": b"barbara rabat"}
    tables, rows = {}, []
    for k, lang in enumerate(langs):
        data = b"\n\n\n" + training[lang]
        tree = tables[k] = defaultdict(Counter)
        for i in range(3, len(data)):
            rows.append((k, int.from_bytes(data[i - 3:i + 1], "big")))
            for o in range(4):
                tree[data[i - o:i]][data[i]] += 1
    counted = Counter(rows)
    model = ppm_kernels.Model(langs, *(np.array(x) for x in (
        [k for k, _ in counted], np.array([c for _, c in counted], np.uint32), list(counted.values()))))
    text = b"abrabat zq"
    for k in range(2):
        bits, data = 0.0, b"\n\n\n" + text
        for i in range(3, len(data)):
            for o in range(3, -1, -1):
                seen = tables[k].get(data[i - o:i])
                if not seen:
                    continue
                n, t = sum(seen.values()), len(seen)
                if data[i] in seen:
                    bits -= np.log2(seen[data[i]] / (n + t))
                    break
                bits -= np.log2(t / (n + t))
            else:
                bits += 8
        assert model.lengths(text)[k] == pytest.approx(bits)
        assert model.many([text, b"x", text])[2][k] == pytest.approx(bits)


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = prose(rng.randint(20, 200), rng).split()
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["lumpkin", "sodbrain"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, f"{prose(20)} ЅODВRAIN and 1umpk1n"), (901, None), (902, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(frame, marks).collect()}
    assert all(got[i].predicted == t for i, _, t in labels) and got[900].predicted == 1
    assert got[901].predicted == got[902].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity_report(docs, marks.limit(0)).count() == docs.count()
    assert not toxicity.toxicity_report(none, marks).count()


def test_exception_phrases_excuse_a_word():
    from meterfold.llm.toxicity_kernels import Lexicon
    lexicon = Lexicon({"ciown": 5.0}, ["ciown fish"])
    assert lexicon.measure("A clown fish!")[0] == 0 and lexicon.measure("clown fish, clown")[0] == 5


def test_line_dedup(docs, rows, none):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for doc, text in texts(rows):
        for line in text.split("\n") if doc is not None else ():
            if len(key(line)) >= 40:
                held[key(line)].add(doc)
    want = []
    for doc, text in texts(rows):
        lines = text.split("\n")
        kept = [x for x in lines if doc is None or len(held[key(x)]) < 5 or max(held[key(x)]) == doc]
        want.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert sum(w[2] for w in want) >= 5
    assert multiset(line_dedup.line_report(docs).collect()) == multiset(want)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert multiset((r.doc_id, sha(r.text or "")) for r in kept.collect()) == multiset((w[0], w[3]) for w in want)
    assert not line_dedup.line_report(none).count()


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, k), (2, k, k)], "h1 bigint, h2 bigint, doc_id bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = {(r.h1, r.h2): (r.n_docs, r.last_doc) for r in runs.merged().collect()}
    assert total == {(1, 1): (5, 4), **{(2, k): (1, k) for k in range(5)}}
    batch = spark.createDataFrame([(1, 1), (9, 9)], "h1 bigint, h2 bigint")
    assert [tuple(r) for r in runs.fresh(batch).collect()] == [(9, 9)]
    held = [(r.h1, r.h2) for name in runs.names for r in spark.table(name).where("is_new").collect()]
    assert sorted(held) == sorted(total)  # every key is new in one run only
    runs.close()


def test_line_totals_rest_on_the_anti_join(spark, monkeypatch):
    def total():
        runs = line_dedup.LineRuns(spark, fanout=3)
        for k in range(5):
            runs.add(spark.createDataFrame([(1, 1, k)], "h1 bigint, h2 bigint, doc_id bigint"))
        rows = sorted((r.n_docs, r.last_doc) for r in runs.merged().collect())
        runs.close()
        return rows

    assert total() == [(5, 4)]
    monkeypatch.setattr(line_dedup.LineRuns, "marked", lambda self, batch: batch.withColumn("is_new", F.lit(True)))
    assert total() != [(5, 4)]


def test_line_buckets_follow_the_size(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert line_dedup.LineRuns(spark).buckets == least
    assert line_dedup.LineRuns(spark, lines=1000 * line_dedup.BUCKET_LINES + 1).buckets == 1001


def mixed_words(spark, rows):
    """Words taken per source, after looking at every document's limit."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = mixing.mix_report(df).collect()
    assert len(out) == len(rows) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in out)
    taken, targets = Counter(), {}
    for r in out:
        taken[r.source_size] += r.taken
        targets[r.source_size] = r.target
    return taken, targets


def test_mixing_of_repeated_rows(spark):
    w = lambda n: " ".join(["w"] * n)
    rows = [(1, w(7), "a")] * 100 + [(i, w(11), "b") for i in range(2, 400)] + [(i, w(13), "c") for i in range(500, 700)]
    taken, targets = mixed_words(spark, rows)
    assert all(abs(taken[s] - targets[s]) <= 7 for s in targets)


@pytest.mark.parametrize("first", [0, 1000, 5000])
def test_mixing_of_one_very_long_document(spark, first):
    w = lambda n: " ".join(["w"] * n)
    rows = [(first + i, w(300), "a") for i in range(100)] + [(first + 500, w(100_000), "a")]
    rows += [(first + i + 600, w(250), "b") for i in range(200)] + [(None, None, "c"), (None, " ", None)]
    taken, targets = mixed_words(spark, rows)
    assert all(abs(taken[s] - targets[s]) <= 150 for s in targets)


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_fills_plan_every_round_alike(spark, monkeypatch):
    met = spark.createDataFrame(
        [("a", k, 100 + k, 3 ** k, 7 * k, None, []) for k in range(1, 9)] + [("a", 90, 190, 5, 1, 5000.0, [(0, 3)])],
        "_key string, doc_id bigint, text_hash bigint, size bigint, inner bigint, limit double, draws array<struct<pass int, shard int>>"
    ).withColumns({"target": F.lit(5000.0), "source_size": F.lit(20000)})
    plan = spark.createDataFrame([("a", 5000.0, [(0, 3)])], "_key string, limit double, draws array<struct<pass int, shard int>>")
    plans, written = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, *p: (plans.append(joins_of(df)), written(df, *p))[1])
    fills = mixing._fills(met, plan).collect()
    # 4995 words are missing: the documents of 6561 and then none brings the source nearer.
    assert [(r._key, r.doc_id, r.text_hash, tuple(r.end)) for r in fills] == [("a", 8, 108, (0, 3))]
    met = met.where("size < 6000")
    plans.clear()
    fills = mixing._fills(met, plan).collect()
    # 4995 = 2187 + 729 + 243 + ... : one document a round, none twice, and no round plans those before it.
    assert [r.doc_id for r in fills] == [7, 6, 5, 4, 3, 2, 1]
    assert len(plans) == 10 and max(plans[2:]) == min(plans[2:]) == 1


def test_mixing(docs, rows, none):
    got = mixing.mix_report(docs).collect()
    assert multiset(got) == multiset(mixing.mix_report(docs.repartition(5)).collect())
    size = {i: len(BLANK.findall(r[1] or "")) for i, r in enumerate(rows)}
    sums = Counter()
    for i, r in enumerate(rows):
        sums[r[3]] += size[i]
    order = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(sums.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 3 * sums[s]}
        target |= {s: 3.0 * sums[s] for s in above}
        open_ -= above
        if not above:
            break
    target |= {s: weight[s] * level for s in open_}
    assert multiset((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == multiset(
        (r[0], size[i], sums[r[3]], round(target[r[3]], 6)) for i, r in enumerate(rows))
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    largest = max(size.values())
    taken = Counter()
    for r in got:
        taken[r.target] += r.taken
    assert all(abs(taken[t] - t) <= largest for t in taken)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_pass", "mix_place"]
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size)
    assert not mixing.mix_report(none).count() and not mixing.mix(none).count()


def test_token_counts(docs, rows, none):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=_tokenizer_path())
    want = [(d, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for d, t in texts(rows)]
    assert multiset(token_counts.token_counts(docs, _tokenizer_path()).collect()) == multiset(want)
    assert not token_counts.token_counts(none, _tokenizer_path()).count()


def test_simhash(docs, rows, none):
    def fingerprint(text):
        words = lower(text).encode().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    prints = [(d, fingerprint(t)) for d, t in texts(rows)]
    group = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    first = {g: min((prints[k][0] for k in range(len(prints)) if group[k] == g and prints[k][0] is not None), default=None)
             for g in set(group)}
    want = [(d, f"{f:016x}", first[group[k]]) for k, (d, f) in enumerate(prints)]
    assert multiset(simhash.near_duplicates(docs).collect()) == multiset(want)
    kept = simhash.keep_first_of_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(w[0] is None or w[0] == w[2] or w[2] is None for w in want)
    assert not simhash.near_duplicates(none).count()


def test_tiles_lose_no_link(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    from meterfold.llm import simhash_kernels
    found = simhash.tile_pairs(nodes, tile=3).mapInArrow(simhash_kernels.links(3), "u long, v long").collect()
    got = {frozenset((r.u, r.v)) for r in found}
    want = {frozenset(p) for p in itertools.combinations(fps, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 3}
    roots = {}

    def root(x):
        while roots.get(x, x) != x:
            x = roots[x]
        return x

    for pair in got:
        a, b = map(root, pair)
        roots[max(a, b)] = min(a, b)
    assert got <= want and all(len({root(x) for x in pair}) == 1 for pair in want)


def test_tile_copies_are_not_broadcast(spark):
    nodes = spark.range(500).select(F.xxhash64("id").alias("fp"))
    pairs = simhash.tile_pairs(nodes)
    pairs.collect()
    assert "Broadcast" not in plan_of(pairs) and "SortMergeJoin" in plan_of(pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 90)], "u bigint, v bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 91: 90}


def test_each_star_is_planned_by_itself(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 8)], "u bigint, v bigint")
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: (plans.append(joins_of(df)), cut(df))[1])
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {2: 1, 3: 1, 4: 1, 8: 7}
    assert max(plans) == 1


def test_repeats(docs, rows, none):
    seen = defaultdict(set)
    for doc, text in texts(rows):
        words = text.encode().split()
        for i in range(len(words) - 49) if doc is not None else ():
            seen[tuple(words[i:i + 50])].add(doc)
    want = []
    for doc, text in texts(rows):
        words, gone = text.encode().split(), set()
        for i in range(len(words) - 49) if doc is not None else ():
            if min(seen[tuple(words[i:i + 50])]) < doc:
                gone.update(range(i, i + 50))
        want.append((doc, len(words), len(gone), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert sum(w[2] for w in want) > 500
    assert multiset(repeats.repeat_report(docs).collect()) == multiset(want)
    assert not repeats.repeat_report(none).count()


def test_anchors_are_the_same_in_the_first_text_of_a_group():
    from meterfold.llm.repeats_kernels import ROUNDS, Texts, names_of
    rng = random.Random(17)
    for _ in range(150):
        passage, before = (names_of([str(rng.randrange(40)).encode() for _ in range(n)]) for n in (50, 60))
        want = Texts([before, np.concatenate((before, passage))], 50).anchors(ROUNDS)[0][-51]
        for group, at in (([passage], 1), ([passage, before], 1), ([before, passage], 62)):
            anchor, valid = Texts(group, 50).anchors(ROUNDS)
            assert valid[at] and anchor[at] == want
            assert valid.sum() == sum(len(t) - 49 for t in group)


def test_repeats_finds_passages_that_open_a_batch(spark):
    rng = random.Random(23)
    texts = []
    for k in range(60):
        passage = " ".join(rng.choices(["ba", "ko", "ti", "re", "mos", "vi", "da", "ser"], k=50))
        texts += [(k, passage + f" end{k}"), (100 + k, f"{prose(20, rng)} {passage} {prose(9, rng)}")]
    # A partition for every row: each text is the first of its batch.
    frame = spark.createDataFrame(spark.sparkContext.parallelize(texts, len(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in repeats.repeat_report(frame).collect()}
    assert got == {i: 50 if i >= 100 else 0 for i, _ in texts}


def test_decontaminate_is_the_same_for_any_block_size(spark, docs, rows):
    ws = (rows[15][1] or "").split()
    items = [(1, " ".join(ws[20:34])), (2, " ".join(ws[26:52])), (2, " ".join(ws[30:41])), (3, "ab ab AB"), (4, None),
             (None, "one"), (6, "x y z x y z x y z x"), (7, (rows[-4][1] or "")[:120])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams[tuple(w[i:i + n])].add(item)
    want, clean = [], []
    for row in rows:
        w, hit, found = word.findall(lower(row[1] or "")), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if owners := grams.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in owners if x is not None}
        want.append((row[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
        clean += [] if hit else [row]
    assert sum(w[-1] for w in want if w[0] == 100) == 2 and any(w[3] > 1 for w in want)
    for limit in (30, 200, decontaminate.BLOCK_CHARS):
        assert multiset(decontaminate.contamination_report(docs, bench, limit=limit).collect()) == multiset(want)
        kept = decontaminate.clean(docs, bench, limit=limit)
        assert kept.columns == docs.columns and multiset(kept.collect()) == multiset(clean)
    one, many = (multiset((r.doc_id, r.n_words, tuple(r.hit_from), tuple(r.hit_to), tuple(r["items"]))
                          for r in decontaminate.contamination(docs, bench, limit=limit).collect())
                 for limit in (decontaminate.BLOCK_CHARS, 30))
    assert one == many


def test_language_id_keeps_every_language_and_leaf(spark):
    rng = random.Random(31)
    known = [(i, f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)}{chr(0x4E02 + 40 * k)} " * (4 if k < 66 else 2), f"l{k:02}")
             for k in range(70) for i in range(4 * k, 4 * k + 4)]
    wide = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40_000))
    known += [(1000, wide, "wide"), (1001, wide[500:900], None), (None, None, "l00"), (1002, "12 ?", "l01")]
    frame = spark.createDataFrame(known, "doc_id bigint, text string, lang string").repartition(5)
    train = [(t, x) for _, t, x in known if t and x]
    langs = sorted({x for _, x in train})
    counted = Counter()
    for text, lang in train:
        data = b"\n\n\n" + ppm_kernels.folded(text)
        counted.update((langs.index(lang), int.from_bytes(data[j - 3:j + 1], "big")) for j in range(3, len(data)))
    assert sum(k == langs.index("wide") for k, _ in counted) > 65_536 and len(langs) > 64
    model = ppm_kernels.Model(langs, *(np.array(x) for x in (
        [k for k, _ in counted], np.array([c for _, c in counted], np.uint32), list(counted.values()))))
    want = {}
    for i, text, _ in known:
        if i is not None and i != 1002:
            bits = model.lengths(ppm_kernels.folded(text))
            least = bits.min()
            want[i] = (langs[int(bits.argmin())], 1 / np.exp2(least - bits).sum(), least / len(ppm_kernels.folded(text)))
    got = {r.doc_id: r for r in language_id.identify(frame, frame).collect()}
    assert len(got) == len(known) and {want[i][0] for i in want} == set(langs)
    for i, (lang, score, rate) in want.items():
        assert got[i].lang_pred == lang
        assert (got[i].score, got[i].bits_per_byte) == (pytest.approx(score), pytest.approx(rate))
    assert all((got[i].lang_pred, got[i].score, got[i].bits_per_byte) == ("und", 0, None) for i in (None, 1002))


def test_language_id_is_the_same_in_several_passes(docs, rows):
    by_pass = [{(r.doc_id, r.lang_pred, round(r.score, 9), round(r.bits_per_byte or 0, 9)) for r in
                language_id.identify(docs, docs.withColumn("lang", docs.text.substr(1, 1)), max_cells=cells).collect()}
               for cells in (1, 1 << 30)]
    assert by_pass[0] == by_pass[1] and len({r[1] for r in by_pass[0]}) > 3


def test_longest_matches_give_the_smallest_place_for_any_block_size(spark):
    rng = random.Random(41)
    texts = [(i, " ".join(rng.choices("abc", k=60))) for i in (9, 3, 7, 1, 5, 8, 2)] + [(4, None), (6, "z z a b c")]
    items = [(1, " ".join(rng.choices("abc", k=18))), (2, "a b c z"), (3, " ".join(rng.choices("abcz", k=30))), (4, "é")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    for bench in (items, items[:1] + items[2:3]):
        least = min(10, min(len(t.split()) for _, t in bench))
        want = {}
        for item, text in bench:
            ws = text.split()
            for at in range(len(ws)):
                found = []
                for doc, body in texts:
                    bs = (body or "").split()
                    for p in range(len(bs)):
                        n = 0
                        while at + n < len(ws) and p + n < len(bs) and ws[at + n] == bs[p + n]:
                            n += 1
                        found.append((-n, doc, p))
                if -min(found)[0] >= least:
                    want[str(item), at] = (-min(found)[0], *min(found)[1:])
        for limit in (20, decontaminate.BLOCK_CHARS):
            got = decontaminate.longest_matches(
                frame, spark.createDataFrame(bench, "item_id bigint, text string"), limit=limit).collect()
            assert {(r.item, r.item_pos): (r.length, r.doc_id, r.doc_pos) for r in got} == want
