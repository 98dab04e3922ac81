"""Merkle manifest of a table: a digest of every row, a tree over each group of rows, and a tree over the groups.

Rows are leaves, in each group in the order of their key.  While a tree has several nodes, every `ARITY` consecutive ones
become the digest of their digests.  Trees are built in aligned buckets of `BUCKET` nodes, which many tasks take at once:

1. Spark digests the rows and numbers them over the groups (sorted ranges and their counts), so one group may hold any
   share of the rows.
2. A task gives its buckets, as Arrow tables, to DuckDB, which combines each level by an ordered string_agg and sha256;
   Spark takes the bucket roots as the nodes of the next pass, until each group has one.
3. The groups' roots are the leaves of the outer tree, which is built in the same way.
4. Downwards, each bucket gets the outer proof of its root, and DuckDB adds the siblings within the bucket.

A proof is an array of (left, right), the siblings' digests before and behind a node at each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.shared import small, written
from varloom.sources.vcf import numbered

ARITY = 3
#: Levels of a bucket, and nodes of a full one.
LEVELS = 6
BUCKET = ARITY**LEVELS
#: Nodes that DuckDB takes at once; they end with a bucket.
SHARE = 16_000

PROOF = "array<struct<left:string,right:string>>"
_PROOF_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def encoded(value: Column) -> Column:
    """A field as it is digested: `-` for null, else its bytes' number, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root to which a leaf's digest leads by its proof."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def levels_of(count: Column) -> Column:
    """How often `count` nodes are combined until one is left."""
    powers = F.array(*(F.lit(ARITY**k) for k in range(39)))  # 3 ** 39 is the largest power that a long holds
    return F.size(F.filter(powers, lambda p: p < count))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted nodes in tables of about SHARE rows, none of which ends within a bucket."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        grp, bucket = (table.column(n).to_numpy() for n in ("grp", "bucket"))
        starts = ((grp[1:] != grp[:-1]) | (bucket[1:] != bucket[:-1])).nonzero()[0] + 1
        cut = int(starts[-1]) if len(starts) else 0
        fresh = cut or not held or (held[-1].column("grp")[-1].as_py(), held[-1].column("bucket")[-1].as_py()) != (int(grp[0]), int(bucket[0]))
        if fresh and held and sum(t.num_rows for t in held) + cut >= SHARE:
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held = [table.slice(cut)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def _levels(table: pa.Table) -> duckdb.DuckDBPyConnection:
    """A connection with n0 ... n<LEVELS>: grp, idx, h and levels (those that remain) of each level's nodes."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.register("given", table)
    con.execute("CREATE TEMP TABLE n0 AS SELECT row, grp, idx, lower(hex(h)) AS h, levels FROM given WHERE idx >= 0")
    for k in range(LEVELS):
        con.execute(f"CREATE TEMP TABLE n{k + 1} AS SELECT grp, idx // {ARITY} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, min(levels) - 1 AS levels FROM n{k} WHERE levels > 0 GROUP BY grp, idx // {ARITY}")
    return con


def _numbered_rows(table: pa.Table) -> pa.Table:
    return table.append_column("row", pa.array(range(table.num_rows), pa.int64()))


_NODES = "grp long, idx long, h binary, levels int"


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each bucket, or of a group that is done: its last node."""
    done = " UNION ALL ".join([f"SELECT grp, idx, h, levels FROM n{k} WHERE levels = 0" for k in range(LEVELS)] + [f"SELECT grp, idx, h, levels FROM n{LEVELS}"])
    for table in _whole_buckets(batches):
        con = _levels(_numbered_rows(table))
        made = con.sql(f"SELECT grp, idx, unhex(h) AS h, levels::INT AS levels FROM ({done})").to_arrow_table()
        con.close()
        yield from made.cast(pa.schema([("grp", pa.int64()), ("idx", pa.int64()), ("h", pa.binary()), ("levels", pa.int32())])).to_batches()


def _in_buckets(nodes: DataFrame) -> DataFrame:
    placed = nodes.withColumn("bucket", F.floor(F.greatest("idx", F.lit(0)) / BUCKET) if "bucket" not in nodes.columns else F.col("bucket"))
    return placed.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "idx")


def climb(nodes: DataFrame) -> DataFrame:
    """The nodes of a pass (grp, idx, h, levels) above these: one for each bucket."""
    return written(_in_buckets(nodes.select("grp", "idx", "h", "levels")).mapInArrow(_climb, _NODES), "nodes")


def _descend(carry: list[str]):
    inner = f"""
SELECT n.row, list_concat(coalesce(i.proof, []), p.proof) AS proof, p.top FROM n0 n JOIN (SELECT grp, bucket, proof, top FROM given WHERE idx < 0) p ON n.grp = p.grp AND n.idx // {BUCKET} = p.bucket
LEFT JOIN (SELECT row, list({{'left': array_to_string(hs[1:pos], ''), 'right': array_to_string(hs[pos + 2:], '')}} ORDER BY k) AS proof
 FROM (SELECT row, grp, k, idx // ({ARITY} ** k)::BIGINT % {ARITY} AS pos, idx // ({ARITY} ** (k + 1))::BIGINT AS up FROM n0, range({LEVELS}) r(k) WHERE k < levels)
 JOIN ({' UNION ALL '.join(f"SELECT {k} AS k, grp, idx // {ARITY} AS up, list(h ORDER BY idx) AS hs FROM n{k} WHERE levels > 0 GROUP BY grp, idx // {ARITY}" for k in range(LEVELS))}) USING (k, grp, up) GROUP BY row) i ON n.row = i.row
ORDER BY n.row"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            table = _numbered_rows(table)
            con = _levels(table)
            made = con.sql(inner).to_arrow_table()
            con.close()
            rows = table.select(["grp", "idx", *carry]).take(made.column("row"))
            rows = rows.append_column("proof", made.column("proof").cast(_PROOF_TYPE)).append_column("top", made.column("top").cast(pa.string()))
            yield from rows.to_batches(max_chunksize=4000)

    return run


def descend(nodes: DataFrame, heads: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """grp, idx, the columns `carry`, proof and top of nodes, by the heads(grp, bucket, proof, top) of their buckets.

    A head travels to its bucket as the row ahead of its nodes, so the proof of a bucket is not repeated for each node.
    """
    schema = T.StructType([*(nodes.schema[c] for c in ("grp", "idx", *carry)), *T._parse_datatype_string(f"proof {PROOF}, top string")])
    own = nodes.select(*dict.fromkeys(("grp", "idx", "h", "levels", *carry))).withColumn("bucket", F.floor(F.col("idx") / BUCKET))
    ahead = heads.select("grp", "bucket", F.lit(-1).cast("long").alias("idx"), "proof", "top")
    both = _in_buckets(own.unionByName(ahead, allowMissingColumns=True))
    return both.mapInArrow(_descend(list(carry)), schema)


def manifest(df: DataFrame, fields: tuple[str, ...], group: str, key: str, suspect: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, suspect, subroot, root and proof of each row.

    fields: the columns that are digested, in order; group and key name the columns by which rows are put into trees and
    ordered there.  suspect: replacements of columns; the column `suspect` is the digest of a row with them, null where it
    is the same.  `fold(leaf, proof)` gives the root of an untouched row.

    Null groups are one group, ahead of the others; rows without a key come first in their group; rows with equal keys
    are ordered by their digests.  An empty table gives no rows.
    """
    spark = df.sparkSession
    columns = [F.col(f"`{f}`") for f in fields]
    own = leaf(*columns)
    other = leaf(*((suspect or {}).get(f, F.col(f"`{f}`")) for f in fields))
    leaves = df.select(F.col(f"`{group}`").alias("source"), F.col(f"`{key}`").alias("key"), F.unhex(own).alias("h"), F.unhex(other).alias("other"))
    leaves = written(leaves.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other"))), "leaves")
    placed = numbered(leaves, ["source", "key", "h"])
    sizes = written(placed.groupBy("source").agg(F.min("v").alias("grp"), F.count("*").alias("n")).withColumn("levels", levels_of(F.col("n"))), "groups")
    facts = sizes.agg(F.count("*").alias("groups"), F.max("levels").alias("levels")).first()
    if not facts["groups"]:
        return spark.createDataFrame([], T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string(f"leaf string, suspect string, subroot string, root string, proof {PROOF}")]))
    named = placed.join(small(sizes.select(F.col("source").alias("_source"), "grp", "levels")), F.col("source").eqNullSafe(F.col("_source")))
    nodes = named.select("grp", (F.col("v") - F.col("grp")).alias("idx"), "h", "levels", "key", "other")

    inner = [nodes]
    for _ in range(-(-facts["levels"] // LEVELS)):
        inner.append(climb(inner[-1]))
    outer = [numbered(inner[-1].select("grp", "h"), ["grp"], "idx").select(F.lit(0).cast("long").alias("grp"), "idx", "h", levels_of(F.lit(facts["groups"])).alias("levels"), F.col("grp").alias("group"))]
    height = 0
    while ARITY**height < facts["groups"]:
        height += 1
    for _ in range(-(-height // LEVELS)):
        outer.append(climb(outer[-1]))
    root = outer[-1].select(F.lower(F.hex("h"))).first()[0]  # one node

    heads = spark.createDataFrame([(0, 0, [], root)], f"grp long, bucket long, proof {PROOF}, top string")
    for level in reversed(outer[1:-1]):
        heads = descend(level, heads).select("grp", F.col("idx").alias("bucket"), "proof", "top")
    tops = descend(outer[0], heads, ("group", "h"))
    heads = tops.select(F.col("group").alias("grp"), F.lit(0).cast("long").alias("bucket"), "proof", F.lower(F.hex("h")).alias("top"))
    for level in reversed(inner[1:-1]):
        heads = descend(level, heads).select("grp", F.col("idx").alias("bucket"), "proof", "top")
    found = descend(nodes, heads, ("key", "h", "other"))
    return found.select("key", F.lower(F.hex("h")).alias("leaf"), F.lower(F.hex("other")).alias("suspect"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "proof")
