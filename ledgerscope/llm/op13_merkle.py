"""A Merkle manifest of a dataset: levels as concatenated hex strings.

The rows of a group (a source) are numbered in order and cut into aligned blocks of ``3 ** HEIGHT`` leaves.  A block keeps each
of its levels as one string of fixed-width digests: parents are the hashes of 192-character substrings, and the siblings of a
node are the substrings beside it in its run.  The roots of the blocks are the leaves of the next tier of blocks, until each
group has one; the groups' roots, in order, form one more such tree.  No task ever holds more than a block, however large a
group is.

Nulls are fields of their own (``-``); a row without an id stands before the others of its source; rows that are equal in
every field have equal leaves, so their order does not matter; an empty table has an empty manifest.  Only the named columns
are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerscope.llm.common import read
from ledgerscope.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, HEIGHT, WIDTH = 3, 5, 64
_BLOCK = FAN ** HEIGHT


def digest(column: Column) -> Column:
    """Lowercase hex sha256, as binary: substrings of binary columns are cut without reading what stands before them."""
    return F.sha2(column, 256).cast("binary")


def leaf_of(fields: list[Column]) -> Column:
    """Hash of a row's fields: ``-`` for null, else byte count, colon and value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place within ``grp`` by ``order``, and ``size``, the number of nodes there.

    One range sort deals a group to as many tasks as it needs; the row counts of (task, group) give each task its offset, so
    no window ever sees more rows of a group than there are tasks.
    """
    ordered = materialize(nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
                          .withColumn("at", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("at", 33)
    before = Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = (ordered.groupBy("grp", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
            .select("grp", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                    F.sum("n").over(Window.partitionBy("grp")).alias("size")))
    return (ordered.withColumn("task", task).join(runs, ["grp", "task"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("at", "task", "shift"))


def parents(level: Column) -> Column:
    """The next level: the hash of every run of three digests."""
    run = FAN * WIDTH
    cut = lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int")), cut), "").cast("binary")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of ``grp, size, pos, hash, item``: ``grp, size, block, items, l0 .. l5``.

    If the group has further blocks, every level is built.  A level that is not needed, as one
    node is left already, is null.
    """
    out = (nodes.groupBy("grp", "size", F.floor(F.col("pos") / _BLOCK).alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "item"))).alias("items")))
    out = out.withColumn("l0", F.array_join(F.transform("items", lambda x: x["hash"].cast("string")), "").cast("binary"))
    for k in range(HEIGHT):
        level = F.col(f"l{k}")
        out = out.withColumn(f"l{k + 1}", F.when((F.col("size") > _BLOCK) | (F.length(level) > WIDTH), parents(level)))
    return out.select("grp", "size", "block", F.transform("items", lambda x: x["item"]).alias("items"), *[f"l{k}" for k in range(HEIGHT + 1)])


def block_root() -> Column:
    return F.coalesce(*[F.col(f"l{k}") for k in range(HEIGHT, -1, -1)])


def block_path(place: Column) -> Column:
    """Siblings ``(left, right)`` of the node at ``place`` on every level of its block that has a next one."""
    steps = []
    for k in range(HEIGHT):
        level, i = F.col(f"l{k}"), F.floor(place / F.lit(FAN ** k)).cast("int")
        mine = F.pmod(i, F.lit(FAN))
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(
            F.substring(level, (i - mine) * WIDTH + 1, mine * WIDTH).alias("left"),
            F.substring(level, (i + 1) * WIDTH + 1, (FAN - 1 - mine) * WIDTH).alias("right"))))
    return F.array_compact(F.array(*steps))


_NO_PATH = "cast(array() as array<struct<left:binary,right:binary>>)"


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``grp, size, pos, hash, item``: the roots ``grp, root`` and the lowest blocks with their way up, ``above``.

    Each tier is written; the loop ends after as many tiers as the largest group needs (log of its size to the base 243).
    """
    tiers = [materialize(blocks_of(nodes), "blocks")]
    many = F.col("size") > _BLOCK
    while not tiers[-1].where(many).isEmpty():
        upper = tiers[-1].where(many).select("grp", F.ceil(F.col("size") / _BLOCK).alias("size"), F.col("block").alias("pos"), block_root().alias("hash"), F.col("block").alias("item"))
        tiers.append(materialize(blocks_of(upper), "blocks"))
    single = [t.where(~many) for t in tiers]
    roots = [t.select("grp", block_root().alias("root")) for t in single]
    way = None
    for tier in reversed(tiers):
        tops = tier.where(~many).withColumn("above", F.expr(_NO_PATH))
        if way is not None:
            tops = tops.unionByName(tier.where(many).join(way, ["grp", "block"]))
        if tier is not tiers[0]:
            way = tops.select("grp", "above", steps_of()).select("grp", F.inline("steps"), "above").select(
                "grp", F.col("item").alias("block"), F.concat("path", "above").alias("above"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out, tops


def steps_of() -> Column:
    """``steps``: each item of a block with its path inside the block."""
    return F.transform("items", lambda item, i: F.struct(item.alias("item"), block_path(i).alias("path"))).alias("steps")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, shown: Column) -> DataFrame:
    """Per row: id, leaf, the subroot of its group, the root, its proof, and the root that ``shown`` folds to.

    ``shown`` is the leaf of the row as it is presented for checking; a row is verified when its folded root is the root.
    A null group is a group of its own, before all others.
    """
    name = F.col(group_col).cast("string")
    leaves = rows.select(F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("grp"),
                         F.col(id_col).cast("long").alias("doc_id"), leaf.alias("hash"), shown.alias("shown"))
    nodes = numbered(leaves, ["doc_id", "hash"]).select("grp", "size", "pos", "hash", F.struct("doc_id", "hash", "shown").alias("item"))
    subroots, blocks = climb(nodes)
    tops = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "root"), ["name"])
    root, top_blocks = climb(tops.select("grp", "size", "pos", F.col("root").alias("hash"), F.struct("name", "root").alias("item")))
    groups = (top_blocks.select("above", steps_of()).select(F.inline("steps"), "above")
              .select(F.col("item.name").alias("grp"), F.col("item.root").alias("subroot"), F.concat("path", "above").alias("beyond"))
              .crossJoin(F.broadcast(root.select("root"))))  # one row
    found = (blocks.join(groups, "grp").select("subroot", "root", "above", "beyond", steps_of())
             .select("subroot", "root", "above", "beyond", F.inline("steps"))
             .select("item.*", "subroot", "root", F.concat("path", "above", "beyond").alias("path")))
    siblings = F.aggregate("path", F.lit("").cast("binary"), lambda done, step: F.concat(done, step["left"], step["right"]))
    found = found.select("doc_id", "hash", "subroot", "root", digest(siblings).alias("proof"), fold(F.col("shown"), F.col("path")).alias("folded"))
    return found.select("doc_id", F.col("hash").cast("string").alias("leaf"), F.col("subroot").cast("string"), F.col("root").cast("string"),
                        F.col("proof").cast("string").alias("proof_sha256"), F.col("folded").cast("string").alias("folded_root"),
                        (F.col("folded") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; of every second one (by crc32 of its id) the text is presented without line ends."""
    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
    fields = [F.col(c) for c in FIELDS[:-1]]
    return manifest(docs, "doc_id", "source", leaf_of([*fields, text]), leaf_of([*fields, cut]))


_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in FIELDS[:-1]) + \
    " || CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0})::VARCHAR || ':' || {0} END)"
SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
          lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) & 1 AS low_bit
  FROM documents),
leaves AS (
  SELECT doc_id, source, {_LEAF.format('text')} AS leaf,
    CASE WHEN low_bit = 1 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format('text')} END AS shown
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT source, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, pos // 3),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3),
steps AS (
  SELECT p.doc_id, p.leaf, 0 AS part, t.level, (p.pos // (3 ** t.level)::BIGINT) AS mine, t.n,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (3 ** t.level)::BIGINT), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (3 ** t.level)::BIGINT), '') AS r
  FROM placed p JOIN (SELECT DISTINCT source, level, n FROM tree WHERE n > 1) t ON p.source IS NOT DISTINCT FROM t.source
  JOIN tree s ON s.source IS NOT DISTINCT FROM p.source AND s.level = t.level AND s.pos // 3 = p.pos // (3 ** t.level)::BIGINT // 3
  GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.leaf, 1, t.level, (g.pos // (3 ** t.level)::BIGINT), t.n,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < g.pos // (3 ** t.level)::BIGINT), ''),
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > g.pos // (3 ** t.level)::BIGINT), '')
  FROM placed p JOIN subroots g ON p.source IS NOT DISTINCT FROM g.source
  JOIN (SELECT DISTINCT level, n FROM top WHERE n > 1) t ON true
  JOIN top s ON s.level = t.level AND s.pos // 3 = g.pos // (3 ** t.level)::BIGINT // 3
  GROUP BY ALL),
paths AS (
  SELECT doc_id, leaf, list({{'l': l, 'r': r}} ORDER BY part, level) AS path, string_agg(l || r, '' ORDER BY part, level) AS siblings FROM steps GROUP BY doc_id, leaf),
found AS (
  SELECT p.doc_id, p.leaf, g.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': p.shown, 'r': ''}}, coalesce(q.path, [])), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root
  FROM placed p JOIN subroots g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN paths q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf)
SELECT *, folded_root = root AS verified FROM found
"""
