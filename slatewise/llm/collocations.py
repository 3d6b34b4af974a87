"""Frequent phrases by a sample and its negative border, and the collocations among them.

A sample proposes phrases, level by level.  One full pass then counts exactly the proposed phrases and the
negative border: phrases whose two longest parts were proposed, and which were not themselves.  The border is
never written down; a task counts a phrase when both parts are in the proposal, which covers either kind.  If
a phrase of the border turns out frequent (a failure), phrases that have it as a part were not counted yet:
an expansion pass counts all that hold a failure and whose other parts are frequent.  Whatever it finds holds a
failure, and so does each phrase around that, which was counted in the same pass: the set is closed.  As every
part of a frequent phrase is frequent, the frequent phrases are then complete, however the sample fell.

The proposal reaches the tasks as a bit map of a bounded size for each level.  It may let other phrases through,
which are then counted exactly as well; it never loses one.

Most phrases of the border are rare.  So the full pass is made twice: first it adds up counts by a hash of the phrase,
packed as sorted places of some two bytes each, then only phrases whose place has a large enough sum are counted and
shuffled as text.  All pairs of words are among the former, so that the expansion leaves out rare pairs and what holds them.  A place may hold several phrases, so its sum is no less than that of any of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise.llm.common import ODD, batches_of, checkpointed, mixed, setting, table, whole, written
from slatewise.operators.skew import GROUP_LIMIT

LONGEST = 4
LEAST = 30
TOP = 2000
SAMPLE = 8  # one document in so many is in the sample
MAP_BITS = 27  # a bit map of a level has 16 MB at most
KEY_BITS = 32  # and so many bits for each phrase below that
FLUSH = 1 << 21  # words that a task codes and counts at a time
SLAB = 1 << 22  # bytes of a text that are split at a time
TEXTS = 500  # texts in an Arrow batch
SALTS = 64
PLACE_BITS = 32  # places of the counts by hash
PART_BITS = 24  # and of those that are added up at a time, 32 MB
GAP = 0xFFFF  # the longest step between two packed places

# What ends a piece (those signs, and U+000A to U+000D) and what separates words (space, U+0009).
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(0x0A if c in ENDS else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
NO_LANG = "und"

COUNTS = "key string, n long"  # the language, a line feed, which no phrase has, and the phrase


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _longer(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    return mixed(first * ODD + word)


def _in_maps(maps: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Whether a hash may be in one of the bit maps, each of a power of two of bits."""
    found = np.zeros(len(hashes), bool)
    for bits in maps:
        low = hashes & np.uint64(len(bits) * 64 - 1)
        found |= (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0
    return found


class _Words(dict):
    """A number for each word, in the order in which they come; 0 is the empty one and 1 the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Text:
    """The texts of one language that wait to be counted."""

    def __init__(self, lang: str) -> None:
        self.lang, self.words, self.parts, self.held = lang, _Words({b"": 0, b"\n": 1}), [], 0

    def add(self, text: bytes) -> int:
        """How many words and ends came to it."""
        at, before = 0, self.held
        while at < len(text):
            end = len(text)
            if end - at > SLAB:  # cut where a piece ends, as no phrase goes over it
                found = [x for x in (text.find(e, at + SLAB) for e in ENDS) if x >= 0]
                end = min(found, default=end)
            words = (text[at:end].translate(_TABLE) + b"\n").replace(b"\n", b" \n ").split(b" ")
            coded = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
            self.parts.append(coded[coded > 0])
            self.held += len(self.parts[-1])
            at = end
        return self.held - before


def _distinct(seq: np.ndarray, at: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases of ``size`` words that begin at the places ``at``: their words and how often they occur."""
    keys, code = [], seq[at].astype(np.int64)
    for k in range(1, size):
        code = code << 32 | seq[at + k]
        if k < size - 1:  # numbered anew, so that the next word has room
            key, code = np.unique(code, return_inverse=True)
            keys.append(key)
    key, n = np.unique(code, return_counts=True)
    words = []
    for k in range(size - 1, 0, -1):
        words.append(key & 0xFFFFFFFF)
        key = key >> 32 if k == 1 else keys[k - 2][key >> 32]
    return [key, *reversed(words)], n


def _spots(seq: np.ndarray, hashes: np.ndarray, levels: set[int], known: list[list[np.ndarray]],
           fresh: list[list[np.ndarray]] | None = None, heavy: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places of ``seq``, hashes) of the phrases of two words or more of ``levels`` whose parts are ``known`` (of
    level k at k - 1).

    With ``fresh``, which are known too, those that hold a fresh phrase: parts that hold one may be frequent or not, all
    other parts must be known.  ``heavy`` is a bit map that has every frequent phrase of two words.
    """
    # at each place of seq: may the phrase that begins there be frequent, does it hold a fresh one, and its hash
    may, code = seq > 1, hashes[seq]
    at_word, inside = code, np.zeros(len(seq), bool)
    for size in range(2, max(levels, default=0) + 1):
        if len(seq) < size:
            return
        may &= inside | _in_maps(known[size - 2], code)
        may_next = may[:-1] & may[1:]
        if fresh is not None:
            holds = inside | may & _in_maps(fresh[size - 2], code)
            inside = holds[:-1] | holds[1:]
        else:
            inside = inside[1:]
        may, code = may_next, _longer(code[:-1], at_word[size - 1:])
        if size == 2 and heavy is not None:
            may &= _in_maps(heavy, code)
        if size in levels and len(at := np.flatnonzero(may & inside if fresh is not None else may)):
            yield size, at, code[at]


def _hashes(text: _Text) -> np.ndarray:
    seed = _seed(text.lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in text.words), np.uint64, len(text.words))


def _counted(text: _Text, levels: set[int], known: list[list[np.ndarray]], fresh: list[list[np.ndarray]] | None,
             heavy: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of ``levels`` that ``_spots`` finds.

    The bit map ``heavy`` has all frequent words and pairs, and all frequent phrases of those found without ``fresh``.
    """
    seq, hashes = np.concatenate(text.parts), _hashes(text)
    names = pa.array([w for w in text.words], pa.binary())
    if 0 in levels:
        yield from _rows(text.lang, pa.array([b""]), np.array([np.count_nonzero(seq > 1)]))
    if 1 in levels:
        n = np.bincount(seq, minlength=len(names))
        there = np.flatnonzero(n[2:]) + 2
        there = there if heavy is None else there[_in_maps(heavy, hashes[there])]
        yield from _rows(text.lang, names.take(pa.array(there)), n[there])
    for size, at, code in _spots(seq, hashes, levels, known, fresh, heavy):
        at = at if heavy is None or size > 2 and fresh is not None else at[_in_maps(heavy, code)]
        if len(at):
            words, n = _distinct(seq, at, size)
            yield from _rows(text.lang, pc.binary_join_element_wise(*[names.take(pa.array(w)) for w in words], b" "), n)


PACKED = "part int, steps binary, counts binary"


def _packed(text: _Text, levels: set[int], known: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """All words and pairs, and the longer phrases that ``_counted`` counts, as counts by place: of each part, the steps
    from place to place."""
    seq, hashes = np.concatenate(text.parts), _hashes(text)
    both = np.flatnonzero((seq[:-1] > 1) & (seq[1:] > 1))
    codes = [hashes[seq[seq > 1]], _longer(hashes[seq[both]], hashes[seq[both + 1]]), *(code for _, _, code in _spots(seq, hashes, levels, known))]
    places, n = np.unique(np.concatenate([c.astype(np.uint32) for c in codes]), return_counts=True)  # the low PLACE_BITS
    ends = np.searchsorted(places, np.arange(1, 1 << (PLACE_BITS - PART_BITS), dtype=np.uint32) << np.uint32(PART_BITS))
    out = []
    for part, (own, count) in enumerate(zip(np.split(places, ends), np.split(n, ends))):
        if len(own):
            own = (own & np.uint32((1 << PART_BITS) - 1)).astype(np.int64)
            gaps = np.diff(own, prepend=0)
            more = gaps // GAP  # whole long steps before a place; they count 0
            steps, counts = np.full(len(own) + more.sum(), GAP, np.uint16), np.zeros(len(own) + more.sum(), np.uint16)
            at = np.arange(len(own)) + np.cumsum(more)
            steps[at], counts[at] = gaps % GAP, np.minimum(count, 0xFFFF)
            out.append((part, steps.tobytes(), counts.tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["part", "steps", "counts"])


def _heavy_places(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(word, bits) of the bit map of the places with a sum of ``least`` or more; rows come by part."""
    least = min(least, 0xFFFF)  # where counts stop
    held, now = np.zeros(1 << PART_BITS, np.uint16), None

    def found() -> pa.RecordBatch:
        low = np.unique((np.flatnonzero(held >= least) + (now << PART_BITS)) & ((1 << bits) - 1))
        words, first = np.unique(low >> 6, return_index=True)
        marks = np.left_shift(np.uint64(1), (low & 63).astype(np.uint64))
        marks = np.bitwise_or.reduceat(marks, first) if len(first) else marks
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(marks.view(np.int64))], ["word", "bits"])

    for b in batches:
        for part, steps, counts in zip(*(b.column(c).to_pylist() for c in ("part", "steps", "counts"))):
            if part != now:
                if now is not None:
                    yield found()
                now = part
                held[:] = 0
            at, n = np.cumsum(np.frombuffer(steps, np.uint16).astype(np.int64)), np.frombuffer(counts, np.uint16)
            at, n = at[n > 0], n[n > 0]  # places differ
            held[at] = np.minimum(held[at].astype(np.uint32) + n, 0xFFFF).astype(np.uint16)
    if now is not None:
        yield found()


def _heavy(texts: DataFrame, levels: set[int], known: list[list[np.ndarray]], least: int, bits: int) -> list[np.ndarray]:
    """A bit map of 2 ** ``bits`` that has the hash of every phrase of ``_packed`` with ``least`` occurrences or more."""
    maps = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _flushed(batches):
            yield from _packed(own, levels, maps.value)

    # a place's bits beyond ``bits`` are dropped, so that one word of the map may come from several parts
    dealt = texts.mapInArrow(run, PACKED).repartition("part").sortWithinPartitions("part")
    marks = (dealt.mapInArrow(lambda b: _heavy_places(b, least, bits), "word long, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    maps.unpersist(blocking=True)
    return [out]


def _flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[_Text]:
    """The texts of the task (lang, text) by language, some ``FLUSH`` words at a time."""
    waiting: dict[str, _Text] = {}
    held = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            own = waiting.get(lang) or waiting.setdefault(lang, _Text(lang))
            held += own.add(text.as_py())
            if held >= FLUSH:
                most = max(waiting.values(), key=lambda x: x.held)
                yield most
                held -= most.held
                del waiting[most.lang]
    yield from (own for own in waiting.values() if own.parts)


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 1 << 16):
        keys = pc.binary_join_element_wise(pa.scalar(lang.encode()), phrases.slice(at, 1 << 16), b"\n").cast(pa.string())
        yield pa.RecordBatch.from_arrays([keys, pa.array(n[at:at + (1 << 16)], pa.int64())], ["key", "n"])


def _pass(texts: DataFrame, levels: set[int], known: list[list[np.ndarray]], keep: str,
          fresh: list[list[np.ndarray]] | None = None, heavy: list[np.ndarray] | None = None) -> DataFrame:
    """(lang, phrase, size, n) of one pass over ``texts`` (lang, text as bytes): the summed counts that ``keep`` holds for."""
    maps = texts.sparkSession.sparkContext.broadcast((known, fresh, heavy))  # MAP_BITS for each level at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _flushed(batches):
            yield from _counted(own, levels, *maps.value)

    # a task has summed already; another sum of its few rows for a phrase would cost more than it saves
    summed = texts.mapInArrow(run, COUNTS).repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\n", -1)
    out = checkpointed(summed.select(
        F.expr("substring(key, 1, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"),
        F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1).alias("size"), "n").filter(keep))
    maps.unpersist(blocking=True)
    return out


def _map_of(phrases: DataFrame, most: int) -> list[list[np.ndarray]]:
    """For each level from 1 to ``LONGEST`` - 1 of (lang, phrase, size) a bit map, or none where the level is empty.

    A map has ``KEY_BITS`` bits for each phrase, but never more than 2 ** ``most``.
    """
    counts = dict(phrases.filter(F.col("size") < LONGEST).groupBy("size").count().collect())  # LONGEST - 1 rows
    widths = {k: min(most, max(6, (KEY_BITS * n - 1).bit_length())) for k, n in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, (lang, phrase, size) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "size")))):
                seed = _seed(lang)
                words = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in phrase.encode().split(b" ")), np.uint64)
                code = words[:1]
                for k in range(1, len(words)):
                    code = _longer(code, words[k:k + 1])
                out[i] = code[0] & np.uint64((1 << widths[size]) - 1)
            yield pa.RecordBatch.from_arrays([b.column("size"), pa.array((out >> np.uint64(6)).view(np.int64)),
                                              pa.array((np.uint64(1) << (out & np.uint64(63))).view(np.int64))], ["size", "word", "bits"])

    marks = (phrases.filter(F.col("size") < LONGEST).select("lang", "phrase", "size").mapInArrow(run, "size int, word long, bits long")
             .groupBy("size", "word").agg(F.bit_or("bits").alias("bits")).toArrow())  # 2 ** (most - 6) rows a level at most
    out = []
    for k in range(1, LONGEST):
        part = marks.filter(pc.equal(marks.column("size"), k))
        level = np.zeros(1 << (widths[k] - 6), np.uint64) if k in widths else None
        if level is not None:
            level[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
        out.append([] if level is None else [level])
    return out


def _source(docs: DataFrame, text_col: str, lang_col: str) -> list[Column]:
    return [F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), whole(text_col).cast("binary").alias("text")]


def frequent_phrases(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     sample: int = SAMPLE, bits: int = MAP_BITS) -> DataFrame:
    """(lang, phrase, size, n): every phrase of 1 to 4 words with at least ``least`` occurrences in its language,
    and a row of size 0 with an empty phrase that counts all words of the language.

    ``sample`` says which part of the documents proposes, ``bits`` bounds the size of the bit maps; neither changes the
    result.  A null text is empty, a null language is ``und``, and repeated rows count each.
    """
    spark = docs.sparkSession
    texts = docs.select(*_source(docs, text_col, lang_col))
    few = max(2, least // sample)  # of the sample's occurrences
    with batches_of(spark, TEXTS):
        # by id and text, so that neither copies nor a repeated id fill the sample
        drawn = written(docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(sample)) == 0)
                        .select(*_source(docs, text_col, lang_col)), "sample")
        proposed, known = None, [[] for _ in range(1, LONGEST)]
        for size in range(1, LONGEST):  # the longest are no part of others
            level = _pass(drawn, {size}, known, f"n >= {few}").select("lang", "phrase", "size")
            proposed = level if proposed is None else proposed.unionByName(level)
            known = [a + b for a, b in zip(known, _map_of(level, bits))]
        heavy = _heavy(texts, set(range(3, LONGEST + 1)), known, least, bits)
        found = _pass(texts, set(range(LONGEST + 1)), known, f"n >= {least} or size = 0", None, heavy)
        failed = checkpointed(found.filter(f"size > 0 and size < {LONGEST}").join(proposed, ["lang", "phrase", "size"], "left_anti"))
        fresh = _map_of(failed, bits)
        if not any(fresh):
            return found
        # every phrase that holds a failure is counted now, so none that this finds can be part of one that is not counted
        known = [a + b for a, b in zip(known, fresh)]
        more = _pass(texts, set(range(2, LONGEST + 1)), known, f"n >= {least}", fresh, heavy)
        return checkpointed(found.unionByName(more.join(found, ["lang", "phrase", "size"], "left_anti")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", sample: int = SAMPLE, bits: int = MAP_BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs; it is cut in two where 2000000 * a / (l + r), rounded down, is least
    (l and r: how often the parts occur), the first such cut.  A phrase inside a longer one that occurs at least 0.8
    times as often is dropped.  Equal scores rank by ``a`` and then by the phrase's bytes.  Null and empty texts
    add nothing, an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    counts = frequent_phrases(docs, least, id_col, text_col, lang_col, sample, bits)
    totals = counts.filter("size = 0").select("lang", F.col("n"))
    known = counts.filter("size > 0").select("lang", "phrase", F.col("n").alias("a"))
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = (phrases.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")))
    firsts = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = F.expr("cast(2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = (cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).withColumn("score", exact)
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))))
    inside = (phrases.filter("size > 2").withColumn("words", words).select("lang", inner.alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    dropped = inside.withColumn("around", F.col("around").cast("decimal(20,0)") * 100)
    kept = (scored.join(dropped, ["lang", "phrase"], "left")
            .filter(F.col("around").isNull() | (F.col("around") < F.col("a").cast("decimal(20,0)") * 80)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    with setting(spark, GROUP_LIMIT, str(max(top, 1000))):
        # a language may hold most phrases: first the best of each salt, then of those; a task keeps so many before either shuffle
        ranked = flat
        for keys in (["lang", "salt"], ["lang"]):
            place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
            ranked = ranked.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
        ranked = checkpointed(ranked)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') as ws from pieces),
grams as (
  select lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as phrase
  from words, (values (1), (2), (3), (4)) sizes(size) where len(ws) >= size),
freq as (select lang, size, phrase, count(*)::hugeint as f from grams group by all),
totals as (select lang, sum(f) as n from freq where size = 1 group by lang),
cand as (select lang, size, phrase, f as a, string_split(phrase, ' ') as ws from freq where size > 1 and f >= 30),
cuts as (
  select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, (2000000 * c.a) // (l.f + r.f) as score
  from (select *, unnest(range(1, size)) as k from cand) c
  join freq l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:k], ' ')
  join freq r on r.lang = c.lang and r.phrase = array_to_string(c.ws[k + 1:], ' ')),
best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, a, array_to_string(ws[i:i + m - 1], ' ') as phrase
  from (select *, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from cand))),
kept as (
  select b.* from best b left join (select lang, phrase, max(a) as around from inner_ group by all) o using (lang, phrase)
  where o.around is null or 100 * o.around < 80 * b.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
