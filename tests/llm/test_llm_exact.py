"""Operators with exact answers: block naming, decontamination, licences, mixing, fingerprints, URLs, WARC."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slatewise.llm import decontamination, exact_dedup, licences, mixing, simhash, url_filter, warc
from slatewise.llm.common import ascii_lower, scratch, word_count

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (id, text) or (id, text, source) as documents."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOC)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_text_helpers(spark):
    odd = ["", " ", "a", " Ab\tÉç ", "\x1c x\u00a0y", "ÀB\nc\x0bD"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select("t", ascii_lower(F.col("t")), word_count(F.col("t"))).collect()
    for t, low, n in got:
        assert low.encode() == t.encode().lower() and n == len(t.encode().split())


# ---- exact dedup


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_block_naming(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", None, " ", "\t\n", "abcd" * 9, "abcd" * 9 + "x", "abcd" * 8, "abcd  abcd", "abcd\tabcd", "é" * 20]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "abcd" * 9), (3, texts[3]), (3, "other"), (None, "alone")]
    got = exact_dedup.exact_duplicates(docs(spark, data), block_chars=block).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in data:
        groups[norm(t)].append(i)
    assert len(got) == len(data) and sum(r["kept"] for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        real = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(real) if real else None)
    stay = exact_dedup.drop_duplicates(docs(spark, data), block_chars=block)
    assert stay.count() == len(groups) and stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exact_dedup_keeps_other_columns(spark):
    base = spark.createDataFrame([(1, "a b", "x", 5), (2, "a  b", "y", 6), (1, "a b", "w", 4)], "doc_id long, text string, name string, block int")
    assert rows(exact_dedup.drop_duplicates(base)) == [(1, "a b", "w", 4)]
    assert exact_dedup.exact_duplicates(base.limit(0)).count() == 0


# ---- decontamination


def brute_hits(data, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k:k + n])].add(str(i))
    out, sizes = [], {len(w) for w in windows}
    for i, t in data:
        w, hit, found = cut(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k:k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("room", [0, 1000])
def test_decontamination(spark, room):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "cé", "É", "7", "Ab"])
    long_item = " ".join(word() for _ in range(14))
    items = [(1, long_item), (2, "a b"), (10, "B, a cé."), (3, ""), (4, None), (5, "!!"), (6, "zz yy")]
    data = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(25)]
    data += [(100, "x y " + long_item.replace(" ", "--") + " z"), (101, None), (102, ""), (103, "ZZ"), (None, "a b"), (7, "a b"), (7, "a b"), (104, "zz,YY zz yy")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs(spark, data), bench, broadcast_windows=room).drop("spans", "digest")
    assert rows(got) == brute_hits(data, items)


def test_decontamination_removes(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    data = docs(spark, [(1, f"Start, {item.upper()}; and the end. "), (2, "clean text é"), (3, None)])
    assert {r["doc_id"] for r in decontamination.decontaminate(data, bench).collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(data, bench, remove="spans").collect()}
    assert cut == {1: "Start; and the end. ", 2: "clean text é", 3: None}
    assert decontamination.decontaminate(data, bench.limit(0)).count() == 3
    assert decontamination.contamination(data.limit(0), bench).count() == 0


# ---- licences


def test_licences(spark):
    mit = [licences.SENTENCES[k] for k in ("MITGrant", "MITNotice", "MITAsIs", "MITLiable")]
    data = [(1, "Copyright (c) 2020 Me\n\n" + "\n".join(s[:60] + "\n # " + s[61:] if s[60] == " " else s for s in mit)),
            (2, "\n".join(reversed(mit))), (3, "Text.\nReleased under the MIT License. All rights reserved."),
            (4, "My licence is strange."), (5, None), (6, ""), (7, "x " * 50_000)]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, data)).collect()}
    assert got[1]["licences"] == "MIT" and got[1]["identifiers"].startswith("Copyright")
    assert got[2]["licences"] == "" and got[3]["licences"] == "MIT" and got[3]["identifiers"] == "MITShort AllRights"
    assert got[4]["n_unknown"] == 1 and got[5]["n_sentences"] == got[6]["n_sentences"] == 0 and len(got) == 7


# ---- mixing


def test_targets_reach_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), ("Z", 2), (None, 7)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights = dict(zip(["Z", "a", "b", "c", None], [5, 2, 1, 5, 2]))
    size = {"a": 1, "b": 100, "c": 100, "Z": 2, None: 7}
    total, fixed = 210, {}
    while True:  # the plain version
        free = {s: w for s, w in weights.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(free.values())
        over = {s: 3 * size[s] for s, w in free.items() if level * w > 3 * size[s]}
        if not over:
            break
        fixed |= over
    want = {s: fixed.get(s, level * w) for s, w in weights.items()}
    assert got == pytest.approx(want)


def test_mixing(spark):
    rng = random.Random(3)
    data = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(3000)]
    data += [(5000, None, "b"), (5001, "", "only empty"), (None, "x y", "b"), (1, "x y z", "c"), (1, "p q r", "c")]
    first, again = (mixing.mix(docs(spark, data).repartition(n)).toPandas() for n in (3, 7))
    order = ["source", "doc_id", "size", "nth"]
    assert first.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert len(first) == len(data) and first["copies"].between(0, 3).all() and (first["taken"] == first["copies"] * first["size"]).all()
    for _, g in first.groupby("source", dropna=False):
        rate = g["target"].iloc[0] / max(1, g["source_size"].iloc[0])
        assert g["copies"].between(np.floor(rate), np.ceil(rate)).all()
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    taken = mixing.mixture(docs(spark, data))
    assert taken.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
    assert taken.agg(F.sum("taken")).first()[0] == first["taken"].sum() and taken.filter("copies < 1").count() == 0
    assert mixing.mix(docs(spark, data).limit(0)).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_fingerprints_and_components(spark):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9)))) for i in range(300)]
    data += [(400, None), (401, ""), (402, " \n"), (403, "É é"), (None, "a b c d"), (7, "a b"), (7, "a b"), (404, "w " * 70_000)]
    got = simhash.near_duplicates(docs(spark, data), leaf=8).collect()
    marks = {t: plain_fingerprint(t) for _, t in data if t is None or len(t) < 1000}
    marks["w " * 70_000] = plain_fingerprint("w w w")
    values = sorted(set(marks.values()))
    root = {v: v for v in values}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, t in data:
        if i is not None:
            least[find(marks[t])] = min(i, least.get(find(marks[t]), i))
    want = sorted(((i, f"{marks[t]:016x}", least.get(find(marks[t]))) for i, t in data), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.near_duplicates(docs(spark, []), leaf=8).count() == 0


@pytest.mark.parametrize("crowded", [False, True])
def test_walk_finds_all_pairs(crowded):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64) if not crowded else
                       rng.integers(0, 2**63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 12, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(40, 52, 400, dtype=np.uint64)))
    i, j = simhash.walk(values, values, True, 0, 2)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    want = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def near_groups(texts):
    """The smallest position that each text reaches over fingerprints within two bits, all pairs compared."""
    prints = np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.int64).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    return simhash.roots(len(texts), i, j)


def test_drop_near(spark):
    """Near and exact copies, texts without words, nulls, repeated rows and ids, extra columns with clashing names."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(600)] for _ in range(12)]
    data = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(30):
        b = list(base[k % 3])
        b[rng.randrange(600)] = word()
        data.append((100 + k, " ".join(b)))
    data += [(201, ""), (202, None), (203, "a b"), (204, "a b"), (None, " ".join(base[4])), (205, "long " * 20_000)]
    want = [data[k] for k in sorted(set(near_groups([t for _, t in data]).tolist()))]
    assert len(want) < 40
    frame = spark.createDataFrame([(i, t, "n", 1, k % 2) for k, (i, t) in enumerate(data)], "doc_id long, text string, name string, gone int, row int")
    got = simhash.drop_near(frame.repartition(4))
    assert got.columns == frame.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(want)
    twice = frame.unionByName(frame.withColumn("row", F.lit(9)))
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near(twice).filter("row < 9").collect()) == sorted(want)
    same = spark.createDataFrame([(7, "one text"), (7, "another text of some words"), (None, "no id"), (None, "no id")], "doc_id long, text string")
    assert simhash.drop_near(same).count() == 3 and simhash.drop_near(same.limit(0)).count() == 0


# ---- URLs


def test_rules(spark):
    urls = ["http://x.com/a?b#c", "HTTP://WWW.Example.COM/en/1", "https://m.example.com/en/", "ftp://example.com", "http://a.net/es/?x", "net/es/",
            "http://net/fr/1", "x://y://z/p", "", None, "http://com?x", "http://a.net/en/", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.filter_urls(pages).collect()}
    assert got == {
        0: ("x.com", "/a", "com/"), 1: ("www.example.com", "/en/1", "www.example.com/en/"), 2: ("m.example.com", "/en/", "example.com/en/"),
        3: ("example.com", "", None), 4: ("a.net", "/es/", "net/es/"), 5: ("", "", None), 6: ("net", "/fr/1", "net/fr/"), 7: ("y:", "//z/p", None),
        8: ("", "", None), 9: ("", "", None), 10: ("com", "", None), 11: ("a.net", "/en/", None), 12: ("notexample.com", "/en/", "com/")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_model_is_a_distribution_and_learns(spark):
    counts = np.zeros(url_filter.TABLE)
    _, slots = url_filter.url_slots([b"http://a.com/x", b"http://b.com/y"])
    for row in slots:
        counts += np.bincount(row, minlength=url_filter.TABLE)
    seen, unseen = url_filter.log_likelihoods([b"http://a.com/y", b"zqzqzqzqzqzqzq"], counts)
    assert seen > unseen
    rng = random.Random(0)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good = [f"http://{word('abcd')}.com/{word('abcd')}" for _ in range(300)]
    bad = [f"http://{word('wxyz')}.net/es/{word('wxyz')}" for _ in range(300)]
    ask = [f"http://{word('abcd')}.org/{word('abcd')}" for _ in range(50)] + [f"http://{word('wxyz')}.org/es/{word('wxyz')}" for _ in range(50)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + ask)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()}
    assert all(got[i] == "allow" for i in range(300)) and all(got[i] == "block" for i in range(300, 600))
    assert sum(got[600 + i] == "allow" for i in range(50)) >= 48 and sum(got[650 + i] == "block" for i in range(50)) >= 48


# ---- WARC


def test_warc_round_trip(spark):
    data = [(5, "http://a/", "same"), (2, "http://b/ü \n", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (None, "n", "null id"),
            (6, "v", "x\r\n\r\nWARC/1.1\r\n\r\n" * 50), (7, "w", "é" * 400_000), (8, "w", "tiny"), (2, "http://b/ü \n", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive_and_read(pages, scratch(spark, "t")).collect()), key=str)
    first = {}
    for i, _, h in data:
        first[h or ""] = min([x for x in (i, first.get(h or "")) if x is not None], default=None)
    want = []
    for i, _, h in data:
        body = (h or "").encode()
        again = first[h or ""] != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(pages.limit(0), scratch(spark, "t")).count() == 0


def test_warc_chunks_carry_digests(spark):
    text = "".join(random.Random(1).choice("abc\n") for _ in range(10_000))
    pages = spark.createDataFrame([(1, "u", text), (2, "v", "b")], "page_id long, url string, html string")
    folder = scratch(spark, "t")
    files = warc.write_archives(warc.with_record_types(pages, revisit_from=1), folder, chunk=777)
    parts = warc.read_chunks(files, folder, chunk=500).filter("page = '1'").orderBy("chunk").collect()
    assert b"".join(bytes(p["data"]) for p in parts) == text.encode() and max(len(p["data"]) for p in parts) <= 500
    so_far = hashlib.sha1()
    for p in parts:
        so_far.update(bytes(p["data"]))
        assert p["digest_so_far"] == base64.b32encode(so_far.digest()).decode()
    assert [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "long text"), (4, "x", "long text")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_and_read(pages, scratch(spark, "t"), revisit_from=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_are_read_in_many_tasks(spark):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"), F.concat(F.lit("text "), "id").alias("html"))
    folder = scratch(spark, "warc-test")
    files = warc.write_archives(warc.with_record_types(pages), folder, limit=1)  # a file for each record
    assert files.count() == 60
    tasks = warc.read_chunks(files, folder).select(F.spark_partition_id().alias("task"), "page")
    assert tasks.select("page").distinct().count() == 60 and tasks.select("task").distinct().count() >= 20
