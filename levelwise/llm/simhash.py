"""SimHash fingerprints and exact linking of fingerprints within a Hamming distance.

Linking generalises the pigeonhole rule. The 64 bits are cut into m partitions with
thresholds t_1..t_m that sum to (distance - m + 1): two fingerprints within the
distance then differ by at most t_i bits in some partition i, for else they would
differ by the sum of (t_i + 1) = distance + 1 bits. Correlated bits share a partition, and a
dynamic programme gives larger thresholds to partitions with fewer candidates. A
fingerprint probes partition i under all values with t_i of its bits struck out, so
those within t_i bits there meet under a common key; meeting pairs are verified on all
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import identity, slices, stored, text_of
from levelwise.llm.components import components

WORDS_PER_SHINGLE, SEED, DISTANCE = 4, 42, 4

#: Sampled fingerprints for bit correlation and candidate estimates: an estimate
#: chooses among plans that all find every link.
SAMPLE = 4096
#: What one candidate costs against one probe row.
CANDIDATE_COST = 0.02

_BYTES = np.uint64(0x0101010101010101)


def majority_bits(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per group: a bit is 1 if over half of its values have it.

    ``values`` (uint64) lists the groups one after the other, ``counts`` their sizes; an
    empty group gives zero. Eight bits are counted at a time in the bytes of one word.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full].astype(np.int64)
    ends = np.cumsum(sizes)
    # A byte counts to 255, so longer groups are summed in pieces.
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(ends - sizes, pieces) + 255 * within
    for shift in range(8):
        lanes = (values >> np.uint64(shift)) & _BYTES
        sums = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
        totals = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        for lane in range(8):
            over = 2 * totals[:, lane] > sizes
            out[full[over]] |= np.uint64(1 << (8 * lane + shift))
    return out


def shingle_hashes(text: bytes, n: int = WORDS_PER_SHINGLE) -> list[int]:
    """XXH64 of every n-word shingle of a text, A to Z lower-cased, words space-joined."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    # One normalised buffer; a shingle is a slice of it and nothing is joined anew.
    line = memoryview(b" ".join(words))
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [*(s - 1 for s in starts[n:]), len(line)]
    return [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends)]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            hashes = [shingle_hashes(t) for t in texts]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            values = np.fromiter((h for hs in hashes for h in hs), np.uint64, counts.sum())
            prints = majority_bits(values, counts)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "fp"]
            )


def fingerprints(docs: DataFrame, keep: dict[str, Column], text: Column) -> DataFrame:
    """The columns of ``keep`` and ``fp``, the fingerprint of the text as a long."""
    columns = [c.alias(name) for name, c in keep.items()]
    slim = docs.select(*columns, F.encode(text, "UTF-8").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(_fingerprint_batches, f"{kinds}, fp long")


def bit_matrix(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64 bits."""
    return ((prints[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int8)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of nearly equal width, correlated bits together.

    Greedy: a partition starts with the free bit of least total correlation and
    takes the free bit most correlated with those it has.
    """
    spread = bits.std(axis=0) > 0
    corr = np.zeros((64, 64))
    if len(bits) > 1 and spread.any():
        corr[np.ix_(spread, spread)] = np.nan_to_num(np.abs(np.corrcoef(bits[:, spread].T)))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(64)), []
    for i in range(m):
        width = 64 * (i + 1) // m - 64 * i // m
        part = [min(free, key=lambda b: (corr[b, list(free)].sum(), b))]
        free.remove(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: np.ndarray, distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with the sum (distance - m + 1).

    ``costs[i][t + 1]`` is the cost of threshold t in partition i; t = -1 leaves the
    partition out at no cost. Dynamic programming over partitions and the sum so far.
    """
    m, steps = costs.shape
    goal = distance + 1  # of the t + 1
    best = {0: (0.0, [])}
    for i in range(m):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(min(steps, goal - used + 1)):
                total = cost + costs[i][t]
                if used + t not in nxt or total < nxt[used + t][0]:
                    nxt[used + t] = (total, [*chosen, t - 1])
        best = nxt
    return best.get(goal, (float("inf"), []))


def plan_probes(prints: np.ndarray, population: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with thresholds of least estimated cost for so many fingerprints."""
    bits = bit_matrix(prints)
    scale = (population / max(len(prints), 2)) ** 2 / 2
    options = []
    for m in range(2, distance + 2):
        parts = group_bits(bits, m)
        costs = np.zeros((m, min(distance, 2) + 2))
        for i, part in enumerate(parts):
            own = bits[:, part].astype(np.float32)
            ones = own.sum(axis=1)
            apart = ones[:, None] + ones[None, :] - 2 * (own @ own.T)
            for t in range(costs.shape[1] - 1):
                # Pairs less the sampled ones themselves; half a pair stands for none seen.
                near = max(float((apart <= t + 0.5).sum()) - len(prints), 0.5)
                rows = comb(len(part), t) * population
                met = min(near * scale, float(population) ** 2)
                costs[i][t + 1] = rows + CANDIDATE_COST * met
        total, chosen = allocate(costs, distance)
        options.append((total, m, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def probe_keys(prints: np.ndarray, plan: list[list[int]]) -> Iterator[np.ndarray]:
    """Arrays of keys, one for each entry of the plan: the bits that must agree.

    A key mixes the entry's number with these bits; keys that clash only bring pairs
    together that verification parts again.
    """
    for probe, agreed in enumerate(plan, 1):
        mask = sum(1 << b for b in agreed)
        key = (prints & np.uint64(mask)) + np.uint64((probe * 0x9E3779B97F4A7C15) % (1 << 64))
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield key ^ (key >> np.uint64(29))


def spanning_edges(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join all links among the fingerprints, one less than each group has.

    A search through the bucket: a fingerprint already reached is not compared again,
    so a dense group of g costs far less than g * g and gives g - 1 edges.
    """
    edges = []
    left = np.unique(prints)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(at), int(f)) for f in found]
                queue += list(found)
    return edges


def _edge_batches(distance: int):
    """Reads rows (key, fp) sorted by key; yields the edges of each key's bucket."""

    def flush(keys: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        edges = []
        # Buckets of two, the most frequent ones, are verified together.
        two = starts[sizes == 2]
        a, b = prints[two], prints[two + 1]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        edges += list(zip(a[near].tolist(), b[near].tolist()))
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            edges += spanning_edges(prints[s : s + n], distance)
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(edges):
            ends = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(ends[:, i])) for i in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                held.append((keys[:cut], prints[:cut]))
                yield out(flush(*(np.concatenate(x) for x in zip(*held))))
                held = []
            held.append((keys[cut:], prints[cut:]))
        if held:
            yield out(flush(*(np.concatenate(x) for x in zip(*held))))

    return run


Plan = list[list[int]]


def generalised_plan(prints: DataFrame, distance: int = DISTANCE) -> Plan:
    """Bit masks to probe under, from a bounded sample of the distinct fingerprints."""
    population = prints.count()
    chance = SAMPLE / max(population, 1)
    drawn = F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < int(min(1, chance) * (1 << 30))
    sample = prints.where(drawn).select("fp").limit(4 * SAMPLE).toPandas()["fp"]
    values = sample.to_numpy().astype(np.int64).view(np.uint64)
    parts = plan_probes(values, population, distance)
    return [[b for b in p if b not in out] for p, t in parts for out in combinations(p, t)]


def near_edges(prints: DataFrame, plan: Plan, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints (column ``fp``, distinct) within the distance.

    Fingerprints meet when they agree on all bits of one entry of the plan. Not every
    linked pair is listed; every linked pair is connected.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for keys in probe_keys(own, plan):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), batch.column(0)], names=["key", "fp"]
                )

    probes = prints.select("fp").mapInArrow(spread, "key long, fp long")
    met = probes.repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(_edge_batches(distance), "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``id``, ``fp``, ``row`` (its contents' number), ``component_id`` and ``root``.

    Documents link when their fingerprints differ in at most ``DISTANCE`` bits;
    ``component_id`` is the smallest id reachable. Null and empty texts have fingerprint
    zero and link like any other. Repeated rows stay. A null id never becomes a component id
    unless the component has no other, so it need not be unique to a component; ``root``, a fingerprint, is.
    """
    rows = fingerprints(
        docs,
        {"id": F.col(id_column), "row": identity(id_column, text)},
        text_of(text),
    )
    rows = stored(rows, "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_edges(distinct, generalised_plan(distinct)))
    named = distinct.join(roots, F.col("fp") == F.col("vertex"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select(F.col("fp").alias("_fp"), F.col("root").alias("_root")).join(
        least, F.col("_root") == F.col("root")
    )
    return rows.join(named, F.col("fp") == F.col("_fp")).select(
        "id", "fp", "row", "component_id", F.col("_root").alias("root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_groups(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, all columns kept.

    Of repeated rows with this id one stays, whichever; a component of null ids keeps one.
    """
    packed = docs.select(F.struct("*").alias("_row"))
    inner = packed.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_row"
    )
    found = near_groups(inner.select("doc_id", "text"))
    best = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))
    first = found.groupBy("root").agg(best.alias("best"))
    chosen = stored(first.select(F.col("best.row").alias("_k")), "representatives")
    kept = inner.withColumn("_k2", identity("doc_id", "text")).join(
        chosen, F.col("_k2") == F.col("_k"), "left_semi"
    )
    # The same row may have come several times; of those, one stays.
    return kept.dropDuplicates(["_k2"]).select("_row.*")
