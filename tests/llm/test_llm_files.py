"""Token files, phrase mining and the Merkle manifest against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slatewise.llm import collocations, merkle, token_files
from slatewise.llm.common import scratch

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BPE = P.path("byte_bpe_50k.json")


# ---- token files


def plain_files(tokenizer, rows):
    out, start = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "b", "Ab", " ", " ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "é", "'s", "'ll", "1", "　", "\xa0", "。", "😀", "<|endoftext|>", "."]), max_size=40).map("".join))
def test_units_give_the_ids_of_the_whole_text(text):
    encoder = test_units_give_the_ids_of_the_whole_text.encoder
    assert encoder.by_unit
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


test_units_give_the_ids_of_the_whole_text.encoder = token_files.Encoder(BPE, units=50)


def test_long_texts_are_split_at_joints(monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 50)
    encoder = token_files.Encoder(BPE)
    rng = random.Random(3)
    text = "".join(rng.choice(["word", "x", " ", " ", "\n", ".", "  ", "ü"]) for _ in range(3000))
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(["x" * 300])[0].tolist() == encoder.tokenizer.encode("x" * 300, add_special_tokens=False).ids


@pytest.mark.parametrize("name, chunk", [("byte_bpe_50k.json", 8), ("byte_bpe_50k.json", 8192), ("word_bpe_49k.json", 5)])
def test_token_files(spark, name, chunk):
    """Nulls, empty and long texts, equal rows, extra columns with clashing names, another kind of tokenizer."""
    rng = random.Random(chunk)
    data = [(i, " ".join(rng.choice(["one", "two", "three,", "Ünï", "4.5"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    data += [(100, None), (101, ""), (102, "long text " * 3000), (103, " \n "), (104, "one")]
    rng.shuffle(data)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in data], "doc_id long, text string, part string, start long, n_tokens long").repartition(6)
    folder = scratch(spark, "tokens-test")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = token_files.write_token_files(docs, folder, P.path(name), chunk=chunk)
    got = token_files.documents_of(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == plain_files(tokenizers.Tokenizer.from_file(P.path(name)), sorted(data))
    # a look-up gets the ids back, and its filter reaches the reader
    one = rows.filter("doc_id = 102").orderBy("chunk")
    ids = [x for r in one.collect() for x in r["ids"]]
    assert ids == tokenizers.Tokenizer.from_file(P.path(name)).encode("long text " * 3000, add_special_tokens=False).ids + [2]
    assert "EqualTo(doc_id,102)" in one._jdf.queryExecution().toString()


def test_token_files_with_equal_and_null_ids(spark):
    data = [(None, "b"), (None, "a"), (1, "x y"), (1, "x y"), (1, "z"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOC).repartition(3)
    got = [tuple(r) for r in token_files.documents_of(token_files.write_token_files(docs, scratch(spark, "tokens-test"), BPE)).collect()]
    assert sorted(x[0] is None for x in got) == [False] * 4 + [True] * 2
    by_start = sorted(got, key=lambda x: x[1])
    assert [x[0] for x in by_start] == [None, None, 1, 1, 1, 2]
    assert [x[1] for x in by_start] == np.cumsum([0] + [x[2] for x in by_start])[:-1].tolist()
    want = collections.Counter(x[2:] for x in plain_files(tokenizers.Tokenizer.from_file(BPE), data))
    assert collections.Counter(x[2:] for x in got) == want


def test_token_files_of_an_empty_table(spark):
    rows = token_files.write_token_files(spark.createDataFrame([], DOC), scratch(spark, "tokens-test"), BPE)
    assert rows.count() == 0 and token_files.documents_of(rows).collect() == []


def test_files_have_stripes_run_lengths_and_bloom_filters(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text")).coalesce(1)
    folder = scratch(spark, "tokens-test")
    with_one = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    token_files.write_token_files(docs, folder, BPE, stripe=1 << 12, stride=1000)
    spark.conf.set("spark.sql.shuffle.partitions", with_one)
    jvm = spark._jvm
    hadoop = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = [f.getPath() for f in path.getFileSystem(hadoop).listStatus(path) if f.getPath().getName().endswith(".orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(hadoop))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    codes = [footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())]
    assert codes[-1] == "DIRECT_V2"  # run-length encoding of the ids


def test_joined_checksums():
    data = bytes(random.Random(1).randbytes(5000))
    for cuts in ([0, 5000], [0, 1, 4, 2000, 5000], [0, 0, 2500, 2500, 5000]):
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        assert token_files.joined_crc32([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


# ---- phrases


def plain_counts(rows):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts["und" if lang is None else lang][tuple(words[i:i + n])] += 1
    return counts


def plain_collocations(rows, least, top):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in cand.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def some_text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r"]) for _ in range(n))


@pytest.mark.parametrize("sample, bits", [(1, 12), (3, 8), (50, 16), (100000, 20)])
def test_collocations(spark, sample, bits):
    """Whatever the sample (the last holds no document) and however full the bit maps, the result is the same."""
    rng = random.Random(5)
    words = ["Ab", "c", "d", "É", "new", "york", "x\x01", "'", "<e>"] + [f"w{i}" for i in range(15)]
    rows = [(some_text(rng, words[:rng.randint(3, len(words))], rng.randint(0, 90)), rng.choice(["en", "en", "de\nx", None])) for _ in range(150)]
    rows += [("New York city hall. " * 40, "en"), (None, "en"), ("", "de\nx"), ("only once", "xx"), ("one two three four five", "fr")] + [("a b c d", "es")] * 12
    docs = spark.createDataFrame([(i if i % 9 else None, t, lang, 1, "p") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string")
    got = collocations.collocations(docs.repartition(5), least=6, top=40, sample=sample, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 6, 40)


def test_flushes_and_slabs_change_nothing(monkeypatch):
    rng = random.Random(8)
    texts = [some_text(rng, ["a", "b", "c"], 200).encode() for _ in range(6)]
    full = [[np.full(4, np.iinfo(np.uint64).max, np.uint64)]] * 3

    def counts():
        text, total = collocations._Text("en"), collections.Counter()
        for t in texts:
            text.add(t)
            if text.held > 500:
                for b in collocations._counted(text, set(range(5)), full, None):
                    total.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist())))
                text = collocations._Text("en")
        for b in collocations._counted(text, set(range(5)), full, None) if text.parts else []:
            total.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist())))
        return total

    whole = counts()
    plain = plain_counts([(t.decode(), "en") for t in texts])["en"]
    assert {p: n for p, n in whole.items() if p != "en\n"} == {"en\n" + " ".join(p): n for p, n in plain.items()}
    monkeypatch.setattr(collocations, "SLAB", 37)
    assert counts() == whole


def test_rare_phrases_are_not_counted_as_text():
    """The counts by place let all frequent phrases through and next to no others, over several flushes and gaps."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["new", "york", "city"]) if rng.random() < 0.2 else f"w{rng.randrange(5000)}" for _ in range(4000)).encode() for _ in range(5)]
    full = [[np.full(4, np.iinfo(np.uint64).max, np.uint64)]] * 3
    waiting, rows, plain = [], [], collections.Counter()
    for t in texts:
        waiting.append(collocations._Text("en"))
        waiting[-1].add(t)
        rows += [r for b in collocations._packed(waiting[-1], {3, 4}, full) for r in b.to_pylist()]
        for b in collocations._counted(waiting[-1], {1, 2, 3, 4}, full, None):
            plain.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist())))
    assert all(len(r["steps"]) == len(r["counts"]) for r in rows)
    dealt = collocations.pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["part"]))
    bits = np.zeros(1 << (20 - 6), np.uint64)
    for b in collocations._heavy_places(iter([dealt]), 8, 20):
        np.bitwise_or.at(bits, b.column("word").to_numpy(), b.column("bits").to_numpy().view(np.uint64))
    found = collections.Counter()
    for text in waiting:
        for b in collocations._counted(text, {1, 2, 3, 4}, full, None, [bits]):
            found.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist())))
    frequent = {p: n for p, n in plain.items() if n >= 8}
    assert frequent and {p: n for p, n in found.items() if n >= 8} == frequent
    assert len(found) < len(frequent) + len(plain) / 100


def test_a_failed_border_brings_its_extensions(spark, monkeypatch):
    """A sample without any document: all phrases hold failures, and one expansion finds them."""
    docs = spark.createDataFrame([(i, "p q r s", "en", "", 0) for i in range(9)], DOC)
    passes = []
    real = collocations._pass
    monkeypatch.setattr(collocations, "_pass", lambda texts, levels, *a: passes.append(levels) or real(texts, levels, *a))
    got = {r["phrase"]: r["n"] for r in collocations.frequent_phrases(docs, least=5, sample=10**9).collect()}
    assert got == {p: 9 for p in ("p", "q", "r", "s", "p q", "q r", "r s", "p q r", "q r s", "p q r s")} | {"": 36}
    assert len(passes) == 3 + 1 + 1


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOC)).collect() == []


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout):
    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def way(nodes, at):
        """root, and (siblings before, siblings after) of each level."""
        out = []
        while len(nodes) > 1:
            run = at // fanout * fanout
            out.append((nodes[run:at], nodes[at + 1:run + fanout]))
            nodes = [sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
            at //= fanout
        return nodes[0], out

    low = lambda x: (x is not None, x)
    trees = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        fields = (i, source, lang, n, text)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        changed = (i, source, lang, None if n is None else n + tampered, text)
        trees[lang].append((low(i), leaf(fields), i, leaf(changed)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = [way([x[1] for x in sorted(trees[name])], 0)[0] for name in names]
    out = []
    for k, name in enumerate(names):
        own = sorted(trees[name])
        for at, (_, node, i, changed) in enumerate(own):
            subroot, lower = way([x[1] for x in own], at)
            root, upper = way(tops, k)
            now = changed
            for before, after in lower + upper:
                now = sha("".join([*before, now, *after]))
            proof = sha("".join("".join(b + a) for b, a in lower + upper))
            out.append((i, node, subroot, root, proof, now, now == root))
    return out


@pytest.mark.parametrize("fanout, block", [(2, 4), (2, 4096), (3, 9), (4, 5), (2, 1)])
def test_manifest(spark, fanout, block):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["text", "", None, "é" * 9, "x" * 5000]), rng.choice(["en"] * 6 + ["de", "Z", "ä", None]), rng.choice(["s", None]), rng.choice([None, 5, 0, 2**63 - 1]))
            for i in range(70)]
    rows += [(None, "no id", "en", "s", 1), (3, "again", rows[3][2], "s", 1), rows[4], (200, "alone", "zz", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC + ", leaf string, pos string").repartition(5)
    changed = [F.col(c) for c in merkle.FIELDS]
    changed[3] = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, merkle.FIELDS, F.when(tampered, merkle.digest(*changed)), fanout=fanout, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows, fanout), key=str)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(spark.createDataFrame([(1, "t", None, None, 1)], DOC), merkle.FIELDS).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("") and one["verified"]
    assert merkle.manifest(spark.createDataFrame([], DOC), merkle.FIELDS).collect() == []
