"""Operators that learn or approximate: language model, quality classifier, passages, and the pipeline."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm_exact import docs

import __spark_entry__ as entry
import corpus_pipeline
from slatewise.llm import hmm, passages, quality, simhash
from slatewise.llm.common import written

SMALL = "/root/testdata/sf0.01"


# ---- language model


def plain_counts(data):
    seen = collections.Counter()
    for i, t in data:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            seen.update((t or "").encode().lower().split() + [b""])
    return seen


@pytest.mark.parametrize("common", [5, 100_000])
def test_language_model_scores(spark, common):
    rng = random.Random(4)
    langs = [[f"w{k}x{n}" for n in range(60)] for k in range(3)]
    data = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(rng.randint(0, 80)))) for i in range(240)]
    data += [(900, None), (901, ""), (None, "w0x1 É"), (902, "W0x1 never-seen never-seen"), (3, data[3][1])]
    got = hmm.score(docs(spark, data), common=common, iterations=4).collect()
    seen = plain_counts(data)
    total, kinds = sum(seen.values()), len(seen)
    want = []
    for i, t in data:
        words = (t or "").encode().lower().split() + [b""]
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        want.append((i, held, len(words), sum(seen[w] > 0 for w in words), total, round(base, 6)))
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.score(docs(spark, [])).count() == 0


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    pick = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    return hmm.Hmm(pick(hmm.STATES), pick(hmm.STATES), pick(hmm.STATES, hmm.STATES), pick(hmm.STATES, hmm.CLASSES))


def test_forward_is_the_sum_over_paths():
    import itertools
    model, codes = small_model(), np.array([3, 1, 4000], dtype="<i2")
    total = 0.0
    for path in itertools.product(range(hmm.STATES), repeat=3):
        p = model.first[path[0]] * model.emit[path[0], codes[0]]
        for a, b, c in zip(path, path[1:], codes[1:]):
            p *= model.move[a, b] * model.emit[b, c]
        total += p
    assert hmm.likelihoods([codes[:1], codes], model)[1] == pytest.approx(math.log10(total))


def test_a_class_distribution_sums_to_one(spark):
    counts = spark.createDataFrame([(f"t{k}".encode(), 1 + k % 7) for k in range(4000)], "token binary, n long")
    lex = hmm.lexicon(counts, 3000)
    by_class = collections.defaultdict(float)
    for r in counts.collect():
        token = bytes(r["token"])
        if token not in lex.common[:hmm.OWN]:
            c = hmm.shared_class(token)
            by_class[c] += (r["n"] + 0.1) / (lex.shared_total[c] + 0.1 * (lex.shared_distinct[c] + 1))
    for c, p in by_class.items():  # what is missing is one unseen token
        assert p + 0.1 / (lex.shared_total[c] + 0.1 * (lex.shared_distinct[c] + 1)) == pytest.approx(1)


def test_expected_counts_match_the_plain_version():
    model, rng = small_model(1), np.random.default_rng(3)
    segments = [rng.integers(0, 50, n) for n in (1, 7, 4, 7)]
    opens = [True, False, True, True]
    z = np.zeros
    sums = hmm.Sums(z(hmm.STATES), z(hmm.STATES), z((hmm.STATES, hmm.STATES)), z((hmm.STATES, hmm.CLASSES)))
    hmm.expect(segments, opens, model, sums)
    first, move, emit, fit = z(hmm.STATES), z((hmm.STATES, hmm.STATES)), z((hmm.STATES, hmm.CLASSES)), 0.0
    for s, head in zip(segments, opens):
        a = [(model.first if head else model.later) * model.emit[:, s[0]]]
        for o in s[1:]:
            a.append((a[-1] @ model.move) * model.emit[:, o])
        b = [np.ones(hmm.STATES)]
        for o in s[:0:-1]:
            b.insert(0, model.move @ (model.emit[:, o] * b[0]))
        p = a[-1].sum()
        fit += math.log(p)
        for t, o in enumerate(s):
            emit[:, o] += a[t] * b[t] / p
            if t:
                move += np.outer(a[t - 1], model.emit[:, o] * b[t]) * model.move / p
        if head:
            first += a[0] * b[0] / p
    assert sums.fit == pytest.approx(fit)
    for got, want in ((sums.first, first), (sums.move, move), (sums.emit, emit)):
        assert np.allclose(got, want)


def test_training_raises_the_likelihood(spark):
    source = hmm.whole("text")
    frame = docs(spark, [(i, " ".join(random.Random(i).choices([f"{'abc'[i % 3]}{k}" for k in range(20)], k=60))) for i in range(60)])
    frame = frame.select("doc_id", source.cast("binary").alias("text")).withColumnRenamed("doc_id", "id")
    lex = hmm.lexicon(hmm.token_counts(frame.select("text")), 1000)
    codes = hmm.encoded(frame.withColumn("trained", hmm._trained()), lex).select("classes")
    model, fits = hmm.start(lex), []
    for _ in range(5):
        model, fit = hmm.baum_welch(codes, model, lex)
        fits.append(fit)
    assert all(a < b for a, b in zip(fits, fits[1:]))


# ---- quality classifier


def test_classifier_on_held_out_labels(spark):
    found = quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"),
                             spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("doc_id % 2 = 0")).toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("doc_id % 2 = 1").toPandas()
    both = found.merge(truth, on="doc_id")
    assert len(found) == 1000 and ((both["score"] >= 0.5) == (both["quality"] == 1)).mean() > 0.95
    assert both[both["quality"] == 1]["kept"].mean() > 0.98


def test_classifier_odd_inputs(spark):
    base = docs(spark, [(1, None), (2, ""), (None, "x y"), (2, ""), (3, "word " * 50_000)])
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.classify(base, labels).filter("kept").count() == 5
    named = base.withColumn("score", quality.F.lit("mine")).withColumn("label", quality.F.lit(1))
    assert quality.keep_good(named, labels).columns == named.columns
    assert quality.classify(base.limit(0), labels.limit(0)).count() == 0


# ---- passages


def test_wide_nodes_are_the_cartesian_tree():
    rng = np.random.default_rng(8)
    for width in (1, 2, 3, 5, 46):
        for top in (4, 1000):
            values = rng.integers(0, top, 300).astype(np.uint64)

            def nodes(lo, hi):
                out, todo = [], [(lo, hi)]
                while todo:
                    a, b = todo.pop()
                    if b - a >= width and b > a:
                        k = a + int(np.argmin(values[a:b]))
                        out.append(k)
                        todo += [(a, k), (k + 1, b)]
                return out

            cuts = [-1, *np.flatnonzero(values == 0).tolist(), len(values)]
            want = sorted(k for a, b in zip(cuts, cuts[1:]) for k in nodes(a + 1, b))
            assert passages.wide_nodes(values, width).tolist() == want


def test_planted_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    body = [text(rng.randint(0, 300)) for _ in range(120)]

    def put(i, part):
        at = rng.randint(0, len(body[i]))
        body[i] = body[i][:at] + part + body[i][at:]
    exact, long, line = text(51), text(300), text(40)
    near = list(long)
    near[100], near[200] = "zzz", "yyy"
    del near[250]
    for i in (3, 50, 110):
        put(i, exact)
    put(7, long), put(99, near), put(60, long[100:180])
    for i in (20, 21, 22, 23):
        put(i, line)  # under fifty words: a clean document
    data = [(i, " ".join(b)) for i, b in enumerate(body)] + [(200, " ".join(body[5]).upper() if len(body[5]) >= 50 else " ".join(body[3])), (201, None), (202, ""), (203, "a " * 60_000)]
    found = passages.passage_links(docs(spark, data)).collect()
    links = {(r["doc_id"], r["match_id"]) for r in found}
    twin = 5 if len(body[5]) >= 50 else 3
    assert {(50, 3), (110, 3), (99, 7), (60, 7), (200, twin)} <= links
    assert {i for pair in links for i in pair} <= {3, 50, 110, 7, 99, 60, 200, twin}
    spot = next(r for r in found if r["doc_id"] == 50)
    assert body[50][spot["first_word"]:spot["end_word"]] == exact == body[3][spot["match_first"]:spot["match_end"]]
    cut = {r["doc_id"]: r["text"] for r in passages.drop_repeats(docs(spark, data)).collect()}
    left = " ".join(cut[50].split())
    assert left == " ".join(body[50][:spot["first_word"]] + body[50][spot["end_word"]:]) and cut[3] == data[3][1] and len(cut) == len(data)


def test_every_exact_repeat_is_found(spark):
    folder = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {i for r in passages.passage_links(frame).collect() for i in (r["doc_id"], r["match_id"])}
    first, both = {}, set()
    for r in sorted(frame.collect(), key=lambda r: r["doc_id"]):
        words = (r["text"] or "").encode().lower().split()
        for k in range(len(words) - 49):
            key = tuple(words[k:k + 50])
            if first.setdefault(key, r["doc_id"]) != r["doc_id"]:
                both |= {first[key], r["doc_id"]}
    assert both and both <= seen


def test_one_edit_in_a_short_passage(spark):
    """Passages of 55 to 65 words with one word inserted or deleted, inside different texts."""
    rng, data = random.Random(11), []
    words = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    for k in range(90):
        one = words((55, 60, 65)[k % 3])
        at = rng.randrange(10, len(one) - 10)
        two = one[:at] + one[at + 1:] if k // 3 % 2 else one[:at] + words(1) + one[at:]
        data += [(2 * k + j, " ".join(words(80) + part + words(80))) for j, part in enumerate((one, two))]
    found = passages.passage_links(docs(spark, data)).collect()
    assert {(r["doc_id"], r["match_id"]) for r in found} == {(2 * k + 1, 2 * k) for k in range(90)}


def test_no_link_is_lost_behind_the_first_document(spark):
    """Of a group of seeds the first document may hold too little, or another part, of what two later ones share."""
    rng, data = random.Random(5), []
    words = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    put = lambda part: data.append((len(data), words(70) + part + words(70)))
    for _ in range(25):
        body = words(110)
        put(body[:42])  # too little of it, in the first document
        for at in (0, 8, 16, 24, 50):
            put(body[at:at + 60])
        put(body[:30] + words(1) + body[31:60])
    line = words(60)
    for k in range(30):  # a passage of many documents, and two that hold a part of it with other words
        put(line)
    tail = words(40)
    put(line[40:] + tail), put(words(3) + line[40:] + tail)
    for _, text in [*data[:7], data[-3]]:
        data.append((len(data), list(text)))  # copies
    frame = docs(spark, [(i, " ".join(text)) for i, text in data])
    links = {(r["doc_id"], r["match_id"]) for r in passages.passage_links(frame).collect()}
    at: dict[tuple, set] = {}
    for i, text in data:
        for k in range(len(text) - 49):
            at.setdefault(tuple(text[k:k + 50]), set()).add(i)
    shared = {(max(p), min(p)) for ids in at.values() for p in itertools.combinations(ids, 2)}
    first = {}
    rep = {i: first.setdefault(tuple(text), i) for i, text in data}
    shared = {(rep[i], rep[j]) for i, j in shared if rep[i] != rep[j]}
    shared = {(max(p), min(p)) for p in shared}
    before = {i: {i} | {q for j, q in links if j == i} for i in rep}
    # each is a link, or both hold the passage of an earlier document and are linked to that
    assert [p for p in shared if p not in links and not before[p[0]] & before[p[1]]] == []
    assert {(7 * k + 6, 7 * k + 1) for k in range(25)} <= links
    assert {(i, j) for i, j in links if rep[i] == rep[j]} == {(i, j) for i, j in rep.items() if i != j}
    assert len([1 for i, _ in links if 175 <= i < 207]) < 30 * 29 / 4  # the passage of many costs a few links for each
    report = {r["doc_id"]: r for r in passages.passage_report(frame).collect()}
    ends = collections.Counter(i for p in links if rep[p[0]] != rep[p[1]] for i in p)
    assert {i: r["n_links"] for i, r in report.items() if r["n_links"]} == dict(ends)
    assert {i: r["class_id"] for i, r in report.items()} == {i: rep[i] for i in report}


def test_passages_of_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    base = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text[:20])], "doc_id long, text string")
    assert {(r["doc_id"], r["match_id"]) for r in passages.passage_links(base).collect()} == {(1, None)}
    named = base.withColumn("spans", passages.F.lit(1)).withColumn("key", passages.F.lit(2))
    assert passages.drop_repeats(named).columns == named.columns
    assert passages.passage_links(base.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_against_plain_stages(spark):
    """Each stage on what the one before kept; the deciding stages against plain versions."""
    frame, cols = spark.read.parquet(f"{SMALL}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = before = {r["doc_id"]: r["text"] for r in frame.collect()}
        frame = written(stage(spark, frame, SMALL), "t")
        after = {r["doc_id"] for r in frame.collect()}
        assert after <= set(before) and frame.columns[:5] == cols
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            assert all(i in after for i in before if labels.get(i) == 1)
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert after == set(first.values())
        elif name == "SimHash near-dedup":
            from test_llm_exact import near_groups
            ids = sorted(before)
            assert after == {ids[k] for k in near_groups([before[i] for i in ids]).tolist()}
        elif name == "benchmark decontamination":
            from test_llm_exact import brute_hits
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert after == {r[0] for r in brute_hits(list(before.items()), items) if not r[5]}
    assert frame.filter("copies < 1 or taken <> copies * size").count() == 0


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
