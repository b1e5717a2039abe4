"""Approximate nearest neighbours by cosine, from robust-pruned graphs over shards.

Every different vector is a node of one shard, dealt by its hash, so a shard is of bounded size; rows that share
a vector are its members. Each shard's graph (``graph``) is built in one task from all its vectors and written
as a table, the index. Queries go to every shard, in blocks of bounded size, walk its graph with a beam,
and send back the few nearest vectors, measured anew in double precision. Only these meet in a shuffle.

A vector needs no more members than results asked for and one more, the query itself, so a vector that a third of
all rows share is as small as any other. No vector is left out: each is a node and has its members of
smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelwise.llm import graph
from levelwise.llm.common import stored

NEAREST, EVERY = 5, 50
#: Vectors in a shard on average; queries that one task takes to a shard.
SHARD_ROWS, QUERY_BLOCK = 4096, 65_536
#: Nodes in the beam of a query, and those of them that are measured in double precision.
SEARCH_BEAM, MEASURED = 192, 32

_KEY = ["k1", "k2"]
_INDEX = "dim int, shard int, node int, k1 long, k2 long, least long, vector array<double>, edges array<int>, entry int"


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``vector`` in double precision, its length and a key of 128 bits.

    Rows without a vector, with a null or non-finite component or with zeros only are left out.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    slim = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = slim.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    return kept.select(
        "vec_id",
        "vector",
        F.size("vector").alias("dim"),
        F.xxhash64("vector").alias("k1"),
        F.xxhash64(F.reverse("vector"), F.lit(1)).alias("k2"),
    )


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which keeps its direction exactly and its squares finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]).astype(np.float32)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    return (vectors * query).sum(axis=1) / norms


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _runs(table: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows that agree in ``names``, of a table sorted by them."""
    columns = [table.column(n).to_numpy(zero_copy_only=False) for n in names]
    change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield tuple(c[a].item() for c in columns), table.slice(a, b - a)


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads vectors sorted by (dim, shard); yields the nodes of a graph for each shard."""

    def built(parts: list[pa.RecordBatch], dim: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        edges, entry = graph.build(_units(_scaled(_vectors(rows, dim))))
        offsets = pa.array(np.arange(len(edges) + 1, dtype=np.int32) * edges.shape[1])
        rows = rows.combine_chunks().to_batches()[0]
        own = {n: rows.column(n) for n in ("dim", "shard", "k1", "k2", "least", "vector")}
        more = {
            "node": pa.array(np.arange(len(edges), dtype=np.int32)),
            "edges": pa.ListArray.from_arrays(offsets, pa.array(edges.reshape(-1))),
            "entry": pa.array(np.full(len(edges), entry, dtype=np.int32)),
        }
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([(own | more)[n] for n in names], names=names)

    key, held = None, []
    for batch in batches:
        for now, rows in _runs(batch, ["dim", "shard"]):
            if now != key and held:
                yield built(held, key[0])
                held = []
            key = now
            held.append(rows)
    if held:
        yield built(held, key[0])


def _searcher(wanted: int, beam: int):
    """Reads (dim, shard, block, kind): the nodes of a shard, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, shard = None, [], None

        def opened(dim: int):
            rows = pa.Table.from_batches(nodes)
            exact = _scaled(_vectors(rows, dim))
            edges = rows.column("edges").combine_chunks().flatten().to_numpy().reshape(len(exact), -1)
            least = rows.column("least").fill_null(np.iinfo(np.int64).max).to_numpy()
            return exact, _units(exact), edges, int(rows.column("entry")[0].as_py()), least, (
                _column(rows, "k1"), _column(rows, "k2"),
            )

        def found(rows: pa.RecordBatch, dim: int) -> pa.RecordBatch:
            exact, units, edges, entry, least, (k1, k2) = shard
            queries = _scaled(_vectors(pa.Table.from_batches([rows]), dim))
            near, _ = graph.beam_search(units, edges, entry, _units(queries), beam)
            who, node, score = [], [], []
            for i, (query, met) in enumerate(zip(queries, near[:, :MEASURED])):
                met = met[met >= 0]
                value = cosines(query, exact[met])
                best = np.lexsort((least[met], -value))[:wanted]
                who.append(np.full(len(best), i))
                node.append(met[best])
                score.append(value[best])
            at, node = pa.array(np.concatenate(who)), np.concatenate(node)
            arrays = [rows.column("k1").take(at), rows.column("k2").take(at)]
            arrays += [pa.array(k1[node]), pa.array(k2[node]), pa.array(np.concatenate(score))]
            return pa.RecordBatch.from_arrays(arrays, names=["q1", "q2", "k1", "k2", "score"])

        for batch in batches:
            for now, rows in _runs(batch, ["dim", "shard", "block", "kind"]):
                if now[:3] != key:
                    key, nodes, shard = now[:3], [], None
                if now[3] == 0:
                    nodes.append(rows)
                    continue
                if shard is None:
                    shard, nodes = opened(now[0]), []
                for start in range(0, rows.num_rows, graph.TOGETHER):
                    yield found(rows.slice(start, graph.TOGETHER), now[0])

    return run


def members(rows: DataFrame, most: int) -> DataFrame:
    """Of each vector the ``most`` rows of smallest id, with their ``place``.

    Each task passes on no more rows of a vector than that, so a common vector is no hot key.
    """
    by_id = W.partitionBy(*_KEY).orderBy(F.col("vec_id").asc_nulls_last())
    return rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= most)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: a row for each different vector (dim, k1, k2, least, vector), with its edges in its shard."""
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sizes = stored(sizes.withColumnRenamed("dim", "d"), "shards")
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    spread = F.pmod("k1", "shards").cast("int").alias("shard")
    dealt = vectors.join(sizes, F.col("dim") == F.col("d")).select("dim", spread, *_KEY, "least", "vector")
    # The number of tasks follows from the work, which is large for each byte.
    sorted_rows = dealt.repartition(total, "dim", "shard").sortWithinPartitions("dim", "shard", *_KEY)
    return stored(sorted_rows.mapInArrow(_builder, _INDEX), "graph-index")


def search(
    index: DataFrame, queries: DataFrame, wanted: int, beam: int = SEARCH_BEAM, block_rows: int = QUERY_BLOCK
) -> DataFrame:
    """``q1, q2, k1, k2, score``: for each query vector the ``wanted`` nearest nodes found in each shard.

    Queries have dim, k1, k2 and vector. Vectors of another length are not compared.
    """
    shards = index.select("dim", "shard").distinct()
    shards = stored(shards.select(F.col("dim").alias("d"), "shard"), "shard-list")
    blocks = -(-queries.count() // block_rows) or 1
    total = max(1, shards.count() * blocks)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    nodes = index.select("*", block, F.lit(0).alias("kind"))
    asked = queries.withColumn("block", F.pmod("k2", F.lit(blocks)).cast("int")).join(
        shards, F.col("dim") == F.col("d")
    )
    asked = asked.select("dim", "shard", "block", *_KEY, "vector", F.lit(1).alias("kind"))
    both = nodes.unionByName(asked, allowMissingColumns=True)
    order = ["dim", "shard", "block", "kind"]
    dealt = both.repartition(total, *order[:3]).sortWithinPartitions(*order, "node", *_KEY)
    kinds = "q1 long, q2 long, k1 long, k2 long, score double"
    return dealt.mapInArrow(_searcher(wanted, beam), kinds)


def nearest_neighbours(
    table: DataFrame,
    vector: str = "embedding",
    nearest: int = NEAREST,
    every: int = EVERY,
    shard_rows: int = SHARD_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """For each row whose id is divisible by ``every`` the ``nearest`` other rows: query_id, rank, vec_id, score.

    Rows without a usable vector take no part; a null id is no query but can be found, after all others of its
    score. Repeated rows are found like any other, a query does not find itself, and vectors of different
    length are not compared. An empty table gives an empty result.
    """
    most = nearest + 1
    rows = usable(table, vector)
    kept = stored(members(rows, most), "members")
    vectors = kept.where("place = 1").select("dim", *_KEY, F.col("vec_id").alias("least"), "vector")
    index = build_index(vectors, shard_rows)
    asking = stored(rows.where(F.col("vec_id") % every == 0).select("vec_id", "dim", *_KEY, "vector"), "queries")
    once = asking.groupBy("dim", *_KEY).agg(F.first("vector").alias("vector"))
    hits = search(index, once, most, beam)

    to_member = kept.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), "vec_id", "place")
    least = to_member.where("place = 1").select("m1", "m2", F.col("vec_id").alias("least"))
    with_least = hits.join(least, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))).drop("m1", "m2")
    nearer = [F.col("score").desc(), F.col("least").asc_nulls_last()]
    by_query = W.partitionBy("q1", "q2")
    best = with_least.withColumn("r", F.row_number().over(by_query.orderBy(*nearer))).where(F.col("r") <= most)
    listed = best.join(to_member, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")))
    own = ((F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).alias("own")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    first = listed.select("q1", "q2", "vec_id", "score", own, F.row_number().over(by_query.orderBy(*order)).alias("r"))
    # At most ``most`` entries a list.
    lists = first.where(F.col("r") <= most).groupBy("q1", "q2")
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "own"))).alias("list"))
    joined = asking.select(F.col("vec_id").alias("query_id"), *_KEY).join(
        lists, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))
    )
    itself = "list_of -> list_of.own and list_of.vec_id <=> query_id"
    at = F.expr(f"coalesce(get(transform(filter(list, {itself}), x -> x.r), 0), {most})").alias("at")
    others = joined.select("query_id", "list", at).select(
        "query_id", F.posexplode(F.expr("filter(list, x -> x.r <> at)")).alias("i", "x")
    )
    return others.select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
