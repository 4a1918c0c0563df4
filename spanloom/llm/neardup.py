"""Near-duplicate documents by an LSH forest, confirmed on full sets.

1. Each document's set of word shingles is hashed (64 bits), made unique and described by a MinHash signature; documents with equal sets fall
   together at once (summed on the map side) and only one of each set goes on.
2. The forest: tree t orders the sets by the signature rotated to its t-th part. Each order is dealt by range, so no group lands in one
   task, and read in order; neighbours whose longest common prefix has LEAST components or more share a region. Where over CROWD
   sets of a region stand together they are also split into parts by up to four further components. Parts only find links sooner: what must
   be compared is the region.
3. Each region and each part tests one pivot (the set that meets most others in all trees, so that a hub's links are found first)
   against its other sets: at most two pairs for a row. Pairs whose signatures agree far too little (five standard deviations below the
   threshold) are dropped, the others are confirmed on their full sets.
4. Undivided regions that still hold sets of different components compare them on their full sets within tasks, in blocks of bounded
   size; only links that join something come out, so no pairs of a group are made into rows.
5. Components of the links come from alternating star contractions, cut by written tables.

Two sets at the threshold share no region with probability below 1e-7. Null and empty texts have no set and are linked with nothing. Rows with a null doc_id
keep a null component and are kept. Repeated doc_ids count as one document whose links are those of all its rows. An
empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import heavy_keys, ids_and_texts, lean, settled, skew_join, slices, staged, with_possible

SIZE, PERCENT = 5, 80  #: words of a shingle; intersection and union in percent
HASHES, TREES, LEAST, CROWD = 128, 32, 4, 256
LIKELY = 0.8 - 5 * (0.8 * 0.2 / HASHES) ** 0.5
_R = np.random.RandomState(20240501)
_BYTES = _R.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_R.randint(0, 2**31, HASHES, dtype=np.int64).astype(np.uint32) << np.uint32(1)) + np.uint32(1)
_ADD = _R.randint(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; for all texts at once, by prefix sums over their bytes."""
    data = [t.encode().lower() for t in texts]  # bytes.lower() changes A-Z only
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ends_of_docs = np.cumsum([len(d) + 1 for d in data])
    blank = _BLANK[buf]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    n = len(buf)
    down, up = np.full(n, _PINV, np.uint64), np.full(n, _P, np.uint64)
    down[0] = up[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * np.multiply.accumulate(down), dtype=np.uint64)])
    up = np.multiply.accumulate(up)
    words = _mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    last = np.searchsorted(starts, ends_of_docs)  # words before each document's end
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        k = np.uint64(pow(_P, j + 1, 1 << 64))
        grams += words[j : j + len(grams)] * k
    grams = _mix(grams)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = b"".join([bytes([b - a]), words[a:b].tobytes()])
            out.append(np.frombuffer(blake2b(whole, digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A MinHash signature for each set that isn't empty (rows of others are zero)."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    for k in range(HASHES):
        v = flat * _MUL[k] + _ADD[k]
        v ^= v >> np.uint32(15)
        out[full, k] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), at)
    return out


_SIGNED = "doc_id long, n long, key binary, sig binary"


def signed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, the set's size, its name (a digest) and its signature; null names for empty sets."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], size)
                sig = signatures(sets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(keys[a:b], pa.int64()),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "key": pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "sig": pa.array([x.tobytes() if len(s) else None for s, x in zip(sets, sig)], pa.binary()),
                    }
                )

    return ids_and_texts(docs).mapInArrow(lean(run), _SIGNED)


_TREE = "tree int, p1 long, p2 long, p3 long, p4 long, rep long"


def _rows_of_trees(batches):
    """A set's place in each tree's order: the first eight components of the rotated signature."""
    step = HASHES // TREES
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        rep = batch.column("rep")
        for t in range(TREES):
            c = sig[:, [(t * step + j) % HASHES for j in range(8)]]
            p = [((c[:, 2 * j] << np.uint64(32)) | c[:, 2 * j + 1]).view(np.int64) for j in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), *map(pa.array, p), rep], names=["tree", "p1", "p2", "p3", "p4", "rep"])


_REGION = "open boolean, rep long, region long, part long"
_REGION_ARROW = pa.schema([("open", pa.bool_()), ("rep", pa.int64()), ("region", pa.int64()), ("part", pa.int64())])


def _deeper(part: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Parts of rows in order, those of over CROWD rows told apart by a further component."""
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(part)]]))
    return np.where(np.repeat(sizes > CROWD, sizes), _mix(part.view(np.uint64) + _mix(more.view(np.uint64))).view(np.int64), part)


def _regions(batches):
    """The rows of a sorted partition that share a region with a neighbour. A first or last row without one goes out as open: its region may reach
    into the partition beside. One row at most is held from batch to batch.

    Adaptive depth: where a region has over CROWD rows in a batch, its parts have up to four further components in common. Parts order the work, so
    it doesn't matter that another batch may divide the same region otherwise.
    """
    held, last, first = None, None, True

    def out(cols, opened):
        tree, p1, p2, p3, p4, rep = cols
        name = _mix(p1.view(np.uint64) ^ _mix(p2.view(np.uint64) + tree.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(opened), pa.array(rep), pa.array(name), pa.array(_deeper(_deeper(name, p3), p4))], schema=_REGION_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("tree", "p1", "p2", "p3", "p4", "rep")]
        if held is not None and len(held[0]):
            cols, last = [np.concatenate(x) for x in zip(held, cols)], None  # a row that is held isn't as the one before it
        k = np.stack([c.astype(np.int64) for c in cols[:3]], 1)
        same = (k[1:] == k[:-1]).all(1)  # as the next one
        before = np.concatenate([[last is not None and bool((k[0] == last).all())], same])
        after = np.concatenate([same, [False]])
        take, opened = before | after, np.zeros(len(k), bool)
        end = len(k) if before[-1] else len(k) - 1  # a last row that is alone so far waits
        if first and end:
            take[0], opened[0], first = True, not before[0] and not after[0], False
        chosen = np.flatnonzero(take[:end])
        if len(chosen):
            yield out([c[chosen] for c in cols], opened[chosen])
        held, last = [c[end:] for c in cols], k[-1]
    if held is not None and len(held[0]):
        yield out(held, np.ones(1, bool))


def forest(reps: DataFrame) -> DataFrame:
    """(region, part, rep) of all regions with two sets or more; part is the region itself where it isn't crowded. reps: rep and sig."""
    order = ["tree", "p1", "p2", "p3", "p4", "rep"]
    rows = reps.mapInArrow(_rows_of_trees, _TREE)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = staged(rows.mapInArrow(lean(_regions), _REGION), "neardup-regions")
    # open rows that met no other row are alone after all; there are two a partition at most
    opened = marked.where("open").select("region").distinct()
    joint = marked.join(F.broadcast(opened), "region").groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region")
    both = marked.where("not open").unionByName(marked.where("open").join(F.broadcast(joint), "region", "left_semi").select(marked.columns))
    return both.select("region", "part", "rep")


def _pairs_from(a: str, b: str):
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def pivots(members: DataFrame, heavy: list) -> DataFrame:
    """Candidate pairs: each region's pivot with its other sets that belong to another component. members: region, rep, weight, comp."""
    best = members.groupBy("region").agg(F.max(F.struct("weight", (-F.col("rep")).alias("neg"), "comp")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    best = best.select("region", (-F.col("top.neg")).alias("pivot"), F.col("top.comp").alias("pivot_comp"))
    both = skew_join(members, best, "region", heavy=heavy).where(F.col("comp") != F.col("pivot_comp"))
    return both.select(_pairs_from("pivot", "rep").alias("p")).select("p.*").distinct()


def _joined(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """a, b and the values of both; pairs are a written table. Both joins deal the values out alike, so they are shuffled once."""
    heavy = heavy_keys(pairs, "a").with_more(heavy_keys(pairs, "b"))
    first = skew_join(pairs, values.select(F.col("rep").alias("a"), F.col(column).alias("va")), "a", heavy=heavy)
    return skew_join(first, values.select(F.col("rep").alias("b"), F.col(column).alias("vb")), "b", heavy=heavy)


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Without pairs whose signatures agree far less than they would at the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("va", "vb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= LIKELY))

    return _joined(pairs, sigs, "sig").select("a", "b", "va", "vb").mapInArrow(lean(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that are linked, by their full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _joined(pairs, sets, "set").select("a", "b", "va", "vb").mapInArrow(lean(run), "a long, b long")


#: Shingles of a block of a region; two blocks are compared in one task.
BLOCK = 400_000
#: Sets of a block at most.
BLOCK_SETS = 2_000


def local_links(comps: list[int], sets: list[np.ndarray], left: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join what isn't joined yet, at most one fewer than there are sets: each is confirmed on both full sets.

    With left > 0 only the first `left` sets are compared with the others; otherwise all with all.
    """
    m = len(sets)
    label = np.array(comps, np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    if m <= 6:
        both = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i + 1, m):
                if label[i] != label[j] and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    at = np.searchsorted(sets[j], sets[i])
                    at[at == size[j]] = 0
                    both[i, j] = (sets[j][at] == sets[i]).sum()
    else:
        # shingles that stand in one set only can't be shared; the others are columns of a matrix of zeros and ones
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column = row[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        top = left or m  # only rows that are asked for
        both = np.zeros((top, m), np.float64)
        width = 2048
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, (at, at + width))
            some = np.zeros((m, width), np.float32)
            some[row[lo:hi], column[lo:hi] - at] = 1
            both += some[:top] @ some.T  # whole numbers below 2**24: exact
        both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[: len(both), None] + size[None, :] - both)
    out = []
    for i in range(min(left, m) if left else m):
        for j in (np.flatnonzero(linked[i, max(i + 1, left) :]) + max(i + 1, left)).tolist():
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def rest(members: DataFrame, sets: DataFrame, heavy: list, percent: int = PERCENT) -> DataFrame:
    """Links between different components that a region still holds.

    A region's sets are compared within tasks, on the full sets, without making rows of pairs; only the links that
    join something come out. A region with over BLOCK shingles or BLOCK_SETS sets is dealt out as pairs of blocks; its largest component
    has blocks of its own, which needn't be compared with each other, since their sets are joined already. A group of copies makes a region of the
    same sets in many trees: of regions with equal members (told by count, shingles and 128 bits of hashes) one is compared. members: region, rep, n, comp.
    """
    of_all = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    by_comp = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), *of_all)
    mixed = by_comp.groupBy("region").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("m"), F.sum("n").alias("n"), *[F.bit_xor(h).alias(h) for h in ("h1", "h2")], F.max(F.struct("n", "m", "comp")).alias("top")).where("comps > 1")
    mixed = mixed.groupBy("m", "n", "h1", "h2").agg(F.min(F.struct("region", "top")).alias("one")).select("one.region", "one.top", "m", "n")

    def blocks(m, n):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SETS)).cast("int")

    # blocks of the other components come first, those of the largest after them; a region that fits into one block is one
    small = blocks(F.col("m"), F.col("n")) <= 1
    mixed = mixed.select(
        "region",
        F.when(small, F.lit(None)).otherwise(F.col("top.comp")).alias("main"),
        F.when(small, F.lit(1)).otherwise(blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n"))).alias("others"),
        F.when(small, F.lit(0)).otherwise(blocks(F.col("top.m"), F.col("top.n"))).alias("mains"),
    )
    rows = skew_join(members.select("region", "rep", "comp"), mixed, "region", heavy=heavy)
    is_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    place = F.xxhash64("rep")
    own = F.when(is_main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int")
    met = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))  # blocks that a set is compared with
    rows = staged(rows.select("region", "rep", "comp", own.alias("own"), met.alias("met")), "neardup-mixed")
    rows = skew_join(rows, sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("met") - 1)))
    rows = rows.select("region", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "comp", "set")
    rows = rows.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "own", "rep")

    def run(batches):
        name, held = None, []

        def links():
            x, y = name[1], name[2]
            left = sum(h[0] == x for h in held) if x != y else 0
            if len(held) < 2 or (x != y and left in (0, len(held))):
                return []
            found = local_links([h[2] for h in held], [np.frombuffer(h[3], np.uint64) for h in held], left, percent)
            return [(min(held[i][1], held[j][1]), max(held[i][1], held[j][1])) for i, j in found]

        def batch_of(pairs):
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            out = []
            for region, x, y, own, rep, comp, s in zip(*(batch.column(c).to_pylist() for c in ("region", "x", "y", "own", "rep", "comp", "set"))):
                if (region, x, y) != name:
                    if name:
                        out += links()
                    name, held = (region, x, y), []
                held.append((own, rep, comp, s))
            yield batch_of(out)
        if name:
            yield batch_of(links())

    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(rep, comp) of all linked sets: comp is the smallest id reachable. Alternating star contractions until nothing changes."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "neardup-edges")
    before = None
    for _ in range(most):
        # large star: larger neighbours of u go to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, go to the smallest
        large = staged(large, "neardup-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = skew_join(large, low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "neardup-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document, by shingles of `size` words."""
    return settled(docs.sparkSession, "neardup", lambda: _near_duplicates(docs, percent, size))


def _near_duplicates(docs: DataFrame, percent: int, size: int) -> DataFrame:
    marked = staged(signed(docs, size), "neardup-signed")
    known = marked.where("doc_id is not null and key is not null")
    reps = staged(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n")), "neardup-reps")
    # a document with several rows can be the smallest of several sets: those are one node
    nodes = reps.groupBy("rep").agg(F.first("sig").alias("sig"), F.count(F.lit(1)).alias("keys"))
    several = nodes.where("keys > 1").limit(1).count() > 0 or known.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").limit(1).count() > 0
    if several:
        return _with_repeats(docs, percent, size)
    sigs = reps.select("rep", "sig")
    members = staged(forest(sigs), "neardup-members")
    crowded, hubs = heavy_keys(members, "region"), heavy_keys(members, "rep")
    weight = skew_join(members, members.groupBy("region").agg(F.count(F.lit(1)).alias("m")), "region", heavy=crowded).groupBy("rep").agg(F.sum("m").alias("weight"))
    weight = staged(weight.join(reps.select("rep", "n"), "rep"), "neardup-weights")
    # only sets that share a region need their full hashes again
    wanted = weight.select(F.col("rep").alias("doc_id"))
    own = with_possible(ids_and_texts(docs), "doc_id", wanted).where("__possible").drop("__possible").join(wanted, "doc_id", "left_semi")

    def full(batches):
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts, 1_000_000):
                yield pa.RecordBatch.from_pydict({"rep": pa.array(keys[a:b], pa.int64()), "set": pa.array([s.tobytes() for s in shingle_sets(texts[a:b], size)], pa.binary())})

    sets = staged(own.mapInArrow(lean(full), "rep long, set binary"), "neardup-sets")
    here = staged(skew_join(members, weight.withColumn("comp", F.col("rep")), "rep", heavy=hubs), "neardup-here")
    # pivots of the parts, and of the undivided regions that have parts
    parts = pivots(here.drop("region").withColumnRenamed("part", "region"), heavy_keys(members, "part"))
    split = members.where("part <> region").select("region").distinct()
    wholes = pivots(here.drop("part").join(split, "region", "left_semi"), crowded)
    pairs = staged(likely(staged(parts.unionByName(wholes).distinct(), "neardup-candidates"), sigs), "neardup-pairs")
    links = staged(confirmed(pairs, sets, percent), "neardup-links")
    comp = _settled(weight, links)
    here = staged(skew_join(members, weight.join(comp, "rep"), "rep", heavy=hubs), "neardup-here")
    more = staged(rest(here, sets, crowded, percent), "neardup-links")
    comp = _settled(weight, links.unionByName(more))
    named = reps.select("key", "rep").join(comp, "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    return _result(marked, named)


def _settled(weight: DataFrame, links: DataFrame) -> DataFrame:
    joint = components(links)
    return staged(weight.select("rep").join(joint, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp")), "neardup-components")


def _result(marked: DataFrame, named: DataFrame) -> DataFrame:
    out = skew_join(marked.drop("sig"), named, "key", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def _with_repeats(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Where rows of one doc_id have different texts: rows are nodes first, then joined by their doc_id."""
    rows = staged(ids_and_texts(docs).withColumn("__row", F.monotonically_increasing_id()), "neardup-rows")
    parts = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), percent, size)
    found = staged(parts.withColumnRenamed("doc_id", "__row").join(rows.select("__row", "doc_id"), "__row"), "neardup-parts")
    # documents and the groups of rows that they are in, as one graph: groups have ids above all documents
    base = found.agg(F.max(F.abs("doc_id"))).first()[0]
    base = (base or 0) + 1
    links = found.where("doc_id is not null").select(F.col("doc_id").alias("a"), (F.col("component_id") + base).alias("b")).distinct()
    joint = components(links)
    out = found.select("doc_id", "n_shingles").join(joint.withColumnRenamed("rep", "doc_id"), "doc_id", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_documents(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """One document of each group, with all its columns; documents with a null doc_id stay. docs is read several times: a written table is best."""
    marked = near_duplicates(docs, percent, size)
    gone = marked.where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    split = with_possible(docs, "doc_id", gone)
    decided = split.where("__possible").join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")
    out = split.where("not __possible").unionByName(decided).select(*docs.columns)
    if marked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        repeated = out.where("doc_id is not null").dropDuplicates(["doc_id"])
        out = repeated.unionByName(out.where("doc_id is null"))
    return out
