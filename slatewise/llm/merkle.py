"""A Merkle manifest of a data set: every row gets a proof up to one root.

The rows of a tree are cut into blocks of ``fanout ** k`` consecutive leaves.  A block's part of the tree is
hashed in one task.  Above the blocks the parts exchange roots like a butterfly: in round r the ``fanout``
parts whose numbers differ only in digit r meet, and each of them hashes the parent anew from the roots that
the others brought.  After the last round every part holds the root and all siblings on its way up, so
nothing has to be passed down again.  Numbers up to the next power of ``fanout`` are filled with empty parts,
which take part as soon as a neighbour brings them a root, so that each meeting has ``fanout`` parts.

A round is one shuffle of a row per block; a meeting holds ``fanout`` rows however large the table is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.llm.common import batches_of, checkpointed, table
from slatewise.operators.skew import global_row_number

FANOUT = 2
BLOCK = 4096  # leaves of a block, drawn down to a power of the fanout
ROUNDS = 8  # rounds between two checkpoints
PATH = "array<array<string>>"


def digest(*fields: Column) -> Column:
    """H of the fields: each as its number of UTF-8 bytes, a colon and its value, or ``-`` for null."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The levels of a tree, the leaves first: ``height`` more, or as many as leave one node."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        below = out[-1]
        out.append([_hash(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[list[str]]:
    """For each level under the root: the other nodes of the run that leaf ``at`` is in."""
    out = []
    for level in tree[:-1]:
        run = at - at % fanout
        out.append(level[run:at] + level[at + 1:run + fanout])
        at //= fanout
    return out


def folded(node: str, at: int, path: list[list[str]], fanout: int) -> str:
    """The root that ``node``, the ``at``-th of its level, reaches over the siblings of each level."""
    for others in path:
        k = at % fanout
        node = _hash([*others[:k], node, *others[k:]])
        at //= fanout
    return node


def exchanged(parts: DataFrame, fanout: int, rounds: int) -> DataFrame:
    """(tree, part, root, path) of parts (tree, part, parts, node), ``parts`` being their number in the tree.

    ``rounds`` must be as many as the largest tree needs; smaller trees are done earlier and pass through.
    """
    size = F.when(F.col("parts") <= 1, 1)
    for r in range(rounds):  # the power of the fanout that holds all parts
        size = size.when(F.col("parts") <= fanout ** (r + 1), fanout ** (r + 1))
    state = parts.select("tree", "part", size.cast("long").alias("size"), "node", F.array().cast(PATH).alias("path"), "parts")
    # part b stands for the empty numbers b + parts, b + 2 * parts and so on
    empty = (state.withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda k: F.col("part") + k * F.col("parts"))))
             .filter(F.col("part") < F.col("size")).withColumns({"node": F.lit(None).cast("string"), "path": F.lit(None).cast(PATH)}))
    state = state.unionByName(empty).drop("parts")
    stride = 1
    for r in range(rounds):
        live = F.lit(stride) < F.col("size")
        meeting = F.when(live, F.floor(F.col("part") / (stride * fanout)) * stride + F.pmod("part", F.lit(stride))).otherwise(F.col("part"))
        met = (state.groupBy("tree", "size", meeting.alias("meeting"))
               .agg(F.array_sort(F.collect_list(F.struct("part", "node", "path"))).alias("m")))
        known = F.filter("m", lambda x: x["node"].isNotNull())
        up = F.sha2(F.array_join(F.transform(known, lambda x: x["node"]), ""), 256)
        met = met.withColumn("up", F.when(live & (F.size(known) > 0), up)).withColumn("x", F.explode("m"))
        others = F.transform(F.filter(known, lambda y: y["part"] != F.col("x.part")), lambda y: y["node"])
        state = met.select("tree", F.col("x.part").alias("part"), "size", F.when(live, F.col("up")).otherwise(F.col("x.node")).alias("node"),
                           F.when(live, F.concat(F.col("x.path"), F.array(others))).otherwise(F.col("x.path")).alias("path"))
        stride *= fanout
        if r % ROUNDS == ROUNDS - 1:
            state = checkpointed(state)
    return state.filter("path is not null").select("tree", "part", F.col("node").alias("root"), "path")


def _rounds(parts: int, fanout: int) -> int:
    n, size = 0, 1
    while size < parts:
        n, size = n + 1, size * fanout
    return n


def _block_roots(batches: Iterator[pa.RecordBatch], fanout: int, height: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = []
        for rows, parts in zip(b.column("rows"), b.column("parts").to_pylist()):
            leaves = rows.values.field("leaf").take(pc.array_sort_indices(rows.values.field("pos"))).to_pylist()
            nodes.append(levels(leaves, fanout, height if parts > 1 else None)[-1][0])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.string())], [*b.schema.names, "node"])


PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(batches: Iterator[pa.RecordBatch], fanout: int, height: int, id_name: str) -> Iterator[pa.RecordBatch]:
    names = [id_name, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for b in batches:
        for block in b.to_pylist():
            rows = sorted(block["rows"], key=lambda r: r["pos"])
            tree = levels([r["leaf"] for r in rows], fanout, height if block["parts"] > 1 else None)
            above, part, number = block["path"] + block["top_path"], block["part"], block["tree"]
            inner, outer = len(tree) - 1, len(block["path"])
            out = []
            for at, r in enumerate(rows):
                path = siblings(tree, at, fanout) + above
                proof = _hash([x for level in path for x in level])
                top = folded(r["leaf"] if r["found"] is None else r["found"], at, path[:inner], fanout)
                top = folded(top, part, path[inner:inner + outer], fanout)
                top = folded(top, number, path[inner + outer:], fanout)
                out.append((r["id"], r["leaf"], block["subroot"], block["root"], proof, top, top == block["root"]))
            kinds = [b.schema.field("rows").type.value_type.field("id").type, *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def manifest(docs: DataFrame, fields: list[str], found: Column | None = None, id_col: str = "doc_id", tree_col: str = "lang",
             fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``.  Leaves of one value of ``tree_col`` ascend by id and hash up to a
    subroot, ``fanout`` at a time; the subroots, in the order of the values, hash up to the root in the same
    way.  The proof of a row is the digest of its siblings from the leaf upwards.  ``found`` is the leaf as
    it is met when the manifest is checked, null or left out where it is the one written: folded over the
    siblings it must give the root.

    Nulls are values: a null id comes before all others, a null tree is a tree before all others, a null
    field has its own sign.  Rows that repeat an id are ordered by their leaves; equal rows are leaves each.
    An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(PROOF).fields])
    height = _rounds(block // fanout + 1, fanout)
    width = fanout ** height  # the largest power of the fanout up to block
    leaf = digest(*[F.col(f"`{f}`") for f in fields])
    other = F.lit(None).cast("string") if found is None else found
    leaves = checkpointed(docs.select(F.col(tree_col).alias("name"), F.col(id_col).alias("id"), leaf.alias("leaf"), other.alias("found"))
                          .withColumn("found", F.when(F.col("found") != F.col("leaf"), F.col("found"))).withColumn("place", F.monotonically_increasing_id()))
    placed = checkpointed(global_row_number(leaves, ["name", "id", "leaf", "place"], "pos", 0).drop("place"))
    names = placed.groupBy("name").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("leaves"))
    names = checkpointed(global_row_number(names, ["name"], "tree", 0).withColumn("parts", F.ceil(F.col("leaves") / width)))
    most, trees = names.agg(F.max("parts"), F.count(F.lit(1))).first()
    if not trees:
        return spark.createDataFrame([], schema)
    same = placed["name"].eqNullSafe(names["name"])
    own = F.col("pos") - F.col("first")
    cut = placed.join(names.select("name", "first", "tree", "parts"), same).select(
        "tree", F.floor(own / width).alias("part"), "parts", own.alias("pos"), "id", "leaf", "found")
    blocks = cut.groupBy("tree", "part", "parts").agg(F.collect_list(F.struct("pos", "id", "leaf", "found")).alias("rows"))
    with batches_of(spark, 16):
        blocks = checkpointed(blocks.mapInArrow(lambda b: _block_roots(b, fanout, height), T.StructType([*blocks.schema.fields, T.StructField("node", T.StringType())])))
        lower = checkpointed(exchanged(blocks.select("tree", "part", "parts", "node"), fanout, _rounds(most, fanout)))
        subroots = lower.filter("part = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("part"),
                                                   F.lit(trees).cast("long").alias("parts"), F.col("root").alias("node"))
        upper = exchanged(subroots, fanout, _rounds(trees, fanout)).select(F.col("part").alias("tree"), "root", F.col("path").alias("top_path"))
        ways = lower.withColumnRenamed("root", "subroot").join(upper, "tree")
        whole = blocks.drop("node").join(ways, ["tree", "part"])
        return checkpointed(whole.mapInArrow(lambda b: _proofs(b, fanout, height, id_col), schema))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = [F.col(f) for f in FIELDS]
    fields[FIELDS.index("n_chars")] = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, FIELDS, F.when(tampered, digest(*fields)))


SQL = """
with recursive base as (
  select doc_id, lang, n_chars, (row_number() over (partition by lang order by doc_id) - 1) as pos,
         coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-')
           || coalesce(strlen(source)::varchar || ':' || source, '-') || coalesce(strlen(lang)::varchar || ':' || lang, '-') as head,
         coalesce(strlen(text)::varchar || ':' || text, '-') as tail
  from documents),
leaves as (
  select doc_id, lang, pos,
         sha256(head || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') || tail) as leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::varchar)::varchar || ':' || (n_chars + 1)::varchar, '-') || tail) as changed,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 7 = 0 as tampered
  from base),
nodes(level, lang, idx, node, n) as (
  select 0, lang, pos, leaf, count(*) over (partition by lang) from leaves
  union all
  select level, lang, idx, node, count(*) over (partition by lang) from (
    select level + 1 as level, lang, idx // 2 as idx, sha256(string_agg(node, '' order by idx)) as node
    from nodes where n > 1 group by level, lang, idx // 2) up),
subroots as (
  select lang, node as subroot, row_number() over (order by lang nulls first) - 1 as idx from nodes where n = 1),
tops(level, idx, node, n) as (
  select 0, idx, subroot, count(*) over () from subroots
  union all
  select level, idx, node, count(*) over () from (
    select level + 1 as level, idx // 2 as idx, sha256(string_agg(node, '' order by idx)) as node
    from tops where n > 1 group by level, idx // 2) up),
heights as (select lang, max(level) as height from nodes group by lang),
steps as (
  select l.doc_id, n.level, (l.pos >> n.level) & 1 as turn, s.node as sibling
  from leaves l join nodes n on n.lang is not distinct from l.lang and n.idx = l.pos >> n.level and n.n > 1
  left join nodes s on s.lang is not distinct from l.lang and s.level = n.level and s.idx = xor(n.idx, 1)
  union all
  select l.doc_id, h.height + t.level, (r.idx >> t.level) & 1, s.node
  from leaves l join heights h on h.lang is not distinct from l.lang join subroots r on r.lang is not distinct from l.lang
  join tops t on t.idx = r.idx >> t.level and t.n > 1
  left join tops s on s.level = t.level and s.idx = xor(t.idx, 1)),
folds(doc_id, level, node) as (
  select doc_id, 0, case when tampered then changed else leaf end from leaves
  union all
  select f.doc_id, f.level + 1, sha256(case when turn = 0 then f.node || coalesce(sibling, '') else coalesce(sibling, '') || f.node end)
  from folds f join steps s on s.doc_id = f.doc_id and s.level = f.level)
select l.doc_id, l.leaf, r.subroot, t.node as root, sha256(coalesce(p.path, '')) as proof_sha256, f.node as folded_root, f.node = t.node as verified
from leaves l join subroots r on r.lang is not distinct from l.lang join tops t on t.n = 1
join (select doc_id, arg_max(node, level) as node from folds group by doc_id) f using (doc_id)
left join (select doc_id, string_agg(sibling, '' order by level) as path from steps group by doc_id) p using (doc_id)
"""
