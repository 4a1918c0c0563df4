"""Best-fit packing: documents into as few sequences of fixed capacity as can be.

Only lengths matter for packing, and there are at most `capacity` of them, so the plan is made on the histogram
of lengths (bounded whatever the input) by bin completion: take the largest document left, enumerate the
undominated fillings of the room beside it, those that waste least first, and branch on them; a branch ends where the waste so far and the
waste that the rest must have leave no plan better than the incumbent. Best-fit decreasing is the first incumbent, and the search stops as soon as
a plan has as few sequences as the lower bound. Fillings are enumerated lazily and in full; only the number of nodes is limited
(NODES and a share for each length), and where it is reached the best plan so far stands. A plan is a list of fillings with how
often each is used; documents of a length are then numbered (two-phase, no single task) and looked up in the plan by binary search.

Null text counts as empty (one end id). Longer documents are cut into full pieces first; only the last piece is
packed with others. Repeated rows are documents of their own; null doc_ids stay null. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import ids_and_texts, lean, settled, slices, staged
from spanloom.llm.wordbpe import WordBpe

CAPACITY = 4096
#: Nodes of the branch-and-bound: so many, and so many more for each length in the histogram (a plan takes about a node a length).
NODES, NODES_A_LENGTH = 2_000, 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document's ids (with its end id)."""

    def run(batches):
        bpe, end = WordBpe.get(tokenizer), np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts, 1_000_000):
                rows = []
                for k, ids in zip(keys[a:b], bpe.encode(texts[a:b])):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((k, p, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return ids_and_texts(docs).mapInArrow(lean(run), _PIECES)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, filling by filling: each bin takes the largest that still fits, again and again."""
    left = dict(counts)
    sizes = sorted(left)
    out = []
    while sizes:
        room, filling, use = capacity, [], {}
        top = len(sizes)
        while True:
            i = bisect.bisect_right(sizes, room, 0, top) - 1
            while i >= 0 and left[sizes[i]] - use.get(sizes[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            s = sizes[i]
            fit = min(room // s, left[s] - use.get(s, 0))
            use[s] = use.get(s, 0) + fit
            filling += [s] * fit
            room -= s * fit
            top = i + 1
        times = min(left[s] // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.remove(s)
        out.append((tuple(filling), times))
    return out


def _spread(sums: int, width: int) -> int:
    """Bits moved up by 0 to width places."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        sums |= sums << step
        done += step
    return sums


def _reachable(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Bit s of entry i: the i smallest sizes, as often as they are left, can add up to s <= room."""
    mask, out = (1 << room + 1) - 1, [1]
    for s in sizes:
        sums, n, step = out[-1], min(left[s], room // s), 1
        while n:
            step = min(step, n)
            sums |= sums << step * s & mask
            n -= step
            step *= 2
        out.append(sums)
    return out


def dominated(filling: list[int], left: dict[int, int], room: int) -> bool:
    """Could a larger document stand for some of these, or for the room that they leave? Then what the swap frees fits wherever that one did.

    left: what is there beside the largest document. A document x can stand for a part of the filling that adds up to s if
    s <= x <= s + the room left; one document of the same length is no change.
    """
    slack = room - sum(filling)
    single = several = 0
    sums = 1
    for s in filling:
        several |= (sums & ~1) << s
        single |= 1 << s
        sums |= sums << s
    spare = sum(1 << s for s, n in left.items() if s <= room and n > filling.count(s))
    better = _spread(several, slack)
    if slack:
        better |= _spread(single << 1, slack - 1) | _spread(2, slack - 1)
    return bool(better & spare)


def fillings(left: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The undominated fillings of a room as (documents, largest first; room left), those that leave least first, up to `most_waste`."""
    sizes = sorted(s for s in left if s <= room)
    reach = _reachable(sizes, left, room)

    def exactly(total: int, top: int, chosen: list[int]) -> Iterator[list[int]]:
        if not total:
            yield chosen
        for i in range(min(top, bisect.bisect_right(sizes, total)), 0, -1):
            if not reach[i] >> total & 1:
                return  # nor can fewer sizes
            s = sizes[i - 1]
            for n in range(min(left[s], total // s), 0, -1):
                yield from exactly(total - n * s, i - 1, chosen + [s] * n)

    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> room - waste & 1:
            for chosen in exactly(room - waste, len(sizes), []):
                if not dominated(chosen, left, room):
                    yield tuple(chosen), waste


#: Step functions of the lower bound: the k-th counts a document by how many of k + 1 equal parts of the capacity it fills.
STEPS = 20
#: Nodes whose enumeration is held open; that of a node further up is begun anew when the search comes back to it, so memory is bounded.
HELD = 16


def _weights(capacity: int) -> np.ndarray:
    """What a document of each length weighs, in parts of k * capacity, under each step function (Fekete and Schepers' dual feasible ones): in any
    sequence the weights add up to k * capacity at most. The first row is plain length."""
    x = np.arange(capacity + 1, dtype=np.int64)
    rows = [x]
    for k in range(1, STEPS + 1):
        rows.append(np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity))
    return np.array(rows)


def _least(counts: np.ndarray, weights: np.ndarray, capacity: int) -> int:
    """A lower bound of the sequences that these documents need: the waste that any plan must have is in it."""
    room = capacity * np.array([1, *range(1, len(weights))], np.int64)
    return int((-(-(weights @ counts) // room)).max())


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, largest first) and how often each is used, for all documents of the histogram.

    A branch uses a filling for as many sequences as can be, then for one fewer, and so on; fillings beside equal documents come in the order
    of their enumeration.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(k * v for k, v in counts.items())
    weights = _weights(capacity)
    vector = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        vector[s] = n
    least = _least(vector, weights, capacity)
    best = _best_fit(counts, capacity)
    fewest = sum(t for _, t in best)
    budget = NODES + NODES_A_LENGTH * len(counts) if nodes is None else nodes
    spare = lambda: (fewest - 1) * capacity - total  # noqa: E731  waste that a better plan may have

    def branches(left: dict[int, int], waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """(filling, times) beside the largest document left."""
        largest = max(left)
        rest = dict(left)
        _take(rest, (largest,), 1)
        for chosen, room in fillings(rest, capacity - largest, spare() - waste):
            filling = (largest, *chosen)
            times = min(left[s] // filling.count(s) for s in set(filling))
            if room:
                times = min(times, (spare() - waste) // room)
            for t in range(times, 0, -1):
                yield filling, t

    def after(left: dict[int, int], waste: int, tried: tuple[tuple[int, ...], int]) -> Iterator[tuple[tuple[int, ...], int]]:
        """The branches that come after one that was tried."""
        met = False
        for filling, t in branches(left, waste):
            if filling == tried[0]:
                met = True
                if t < tried[1]:
                    yield filling, t
            elif met:
                yield filling, t

    # one histogram for the whole search: a step takes from it, coming back puts back
    left, path, waste, used = dict(counts), [], 0, 0
    held: dict[int, Iterator] = {0: branches(dict(left), 0)}
    while fewest > least and budget > 0:
        depth = len(path)
        step = next(held[depth], None)
        if step is None:
            del held[depth]
            if not path:
                break
            filling, times = path.pop()
            for s in filling:
                left[s] = left.get(s, 0) + times
                vector[s] += times
            used, waste = used - times, waste - times * (capacity - sum(filling))
            if depth - 1 not in held:
                held[depth - 1] = after(dict(left), waste, (filling, times))
            continue
        budget -= 1
        filling, times = step
        room = capacity - sum(filling)
        _take(left, filling, times)
        for s in filling:
            vector[s] -= times
        path.append(step)
        used, waste = used + times, waste + times * room
        if not left and used < fewest:
            best, fewest = list(path), used
        if left and waste <= spare() and used + _least(vector, weights, capacity) < fewest:
            held[depth + 1] = branches(dict(left), waste)
            held.pop(depth + 1 - HELD, None)
        else:
            held[depth + 1] = iter(())
    return [(tuple(sorted(f, reverse=True)), t) for f, t in best]


def _take(left: dict[int, int], filling: tuple[int, ...], times: int) -> None:
    for s in filling:
        left[s] -= times
        if not left[s]:
            del left[s]


def slots(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, each, first sequence, offset): where documents of a length go by their rank."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in fillings:
        offset, i = 0, 0
        while i < len(filling):
            s = filling[i]
            n = filling.count(s)
            out.append((s, taken.get(s, 0), n * times, n, sequence, offset))
            taken[s] = taken.get(s, 0) + n * times
            offset += n * s
            i += n
        sequence += times
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, nodes: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to staged rows that have a `length` (and are not recomputed differently when read twice)."""
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    # bounded too: a plan has about a filling a length, and fewer than sqrt(2 * capacity) different lengths in a filling
    table = np.array(sorted(slots(plan(histogram, capacity, nodes))), np.int64).reshape(-1, 6)
    # number the rows of each length: counts by input partition, their running sums, then places within the partition
    marked = rows.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    marked = staged(marked, "packing-marked")
    before = marked.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part", "length").orderBy("__row")) - 1
    ranked = marked.withColumn("__place", place).join(before, ["__part", "length"]).withColumn("__rank", F.col("__place") + F.col("__before"))
    columns = [c for c in rows.columns]
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches):
        length, first, _, each, sequence, base = table.T
        key = length << 44 | first  # fewer than 2**44 documents of a length
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence[at] + k // each[at]), pa.array(base[at] + k % each[at] * n)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, F.col("__rank").cast("long").alias("__rank")).mapInArrow(placed, schema)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents."""
    return settled(docs.sparkSession, "packing", lambda: pack(staged(pieces(docs, tokenizer, end_id, capacity), "packing-pieces"), capacity))
