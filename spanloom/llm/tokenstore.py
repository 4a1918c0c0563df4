"""Token-ID output: a content-addressed store of token ids.

encode -> cut -> store -> verify:

* every document's ids (with an end id) are cut where a rolling hash over the last WINDOW ids says so, so
  equal passages give equal chunks wherever they stand;
* a chunk's name is the BLAKE2b digest of its ids; a chunk is stored once;
* a document's recipe lists its chunks' digests and lengths, and their Merkle root; recipes are kept in ascending
  doc_id order with each document's start in the whole id stream, and each recipe file has a manifest
  with the Merkle root over its documents' roots.

One shuffle carries chunks (each task sends a chunk once) and recipes. Reading back checks every chunk
against its name, every recipe against its root, and every file's recipes, in their order, against its manifest: a store that lost, changed or
swapped anything raises. Document checksums come from chunk checksums by CRC's linearity, so ids needn't be shuffled again.

Null text counts as empty. Rows with a null doc_id come first in the order; repeated rows are documents of
their own and share all chunks. An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import ids_and_texts, lean, scratch, skew_join, slices
from spanloom.llm.wordbpe import WordBpe

WINDOW, LEAST, MOST, MASK_BITS = 16, 64, 1024, 8
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_ROWS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("digests", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("root", T.BinaryType()),
    ]
)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At each place the polynomial hash of the last `window` ids, modulo 2**64, by prefix sums."""
    n = len(ids)
    powers = np.full(n, _PINV, np.uint64)
    if n:
        powers[0] = 1
    c = np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers), dtype=np.uint64)
    c[window:] -= c[:-window].copy()
    up = np.full(n, _P, np.uint64)
    if n:
        up[0] = 1
    return c * np.multiply.accumulate(up)


def cut_points(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = MASK_BITS) -> list[list[int]]:
    """For documents that begin at `starts` (last entry: the end), the ends of their chunks, relative to the batch."""
    marks = np.flatnonzero(mix(rolling(ids)) >> np.uint64(64 - bits) == 0) + 1
    first = np.searchsorted(marks, starts)
    out = []
    for d in range(len(starts) - 1):
        at, end, ends = int(starts[d]), int(starts[d + 1]), []
        for m in marks[first[d] : first[d + 1]].tolist():
            while m - at > most:
                at += most
                ends.append(at)
            if m - at >= least:
                at = m
                ends.append(at)
        while end - at > most:
            at += most
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(ends)
    return out


_NOTHING = blake2b(b"", digest_size=16).digest()


class Merkle:
    """A Merkle tree's root over 16-byte digests that come one after another; an odd last node of a level goes up as it is.

    Only the whole subtrees so far are held, one a level at most, so memory and root don't depend on how the leaves come in batches.
    """

    def __init__(self):
        self.count, self.peaks = 0, []

    def add(self, leaf: bytes) -> None:
        n, node = self.count, leaf
        while n & 1:
            node = _joint(self.peaks.pop(), node)
            n >>= 1
        self.peaks.append(node)
        self.count += 1

    def root(self) -> bytes:
        """No leaves: the digest of nothing."""
        if not self.peaks:
            return _NOTHING
        node = self.peaks[-1]
        for peak in reversed(self.peaks[:-1]):
            node = _joint(peak, node)
        return node


def _joint(a: bytes, b: bytes) -> bytes:
    return blake2b(b"\x01" + a + b, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def pack(ids: np.ndarray) -> bytes:
    """Two bytes an id if all fit, else four; the first byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def _chunked(path: str, end_id: int):
    def run(batches):
        bpe, schema, end = WordBpe.get(path), _arrow(_ROWS), np.array([end_id], "<u4").tobytes()
        sent: set[bytes] = set()  # each task sends a chunk once; a bounded memory
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts, 1_000_000):
                parts = [x + end for x in bpe.encode(texts[a:b])]
                starts = np.cumsum([0] + [len(x) // 4 for x in parts])
                ids = np.frombuffer(b"".join(parts), "<u4")
                rows = []
                for d, ends in enumerate(cut_points(ids, starts)):
                    at, digests, lengths = int(starts[d]), [], []
                    for e in ends:
                        payload = pack(ids[at:e])
                        digest = blake2b(payload, digest_size=16).digest()
                        if digest not in sent:
                            sent.add(digest)
                            rows.append(("chunk", int.from_bytes(digest[:8], "little", signed=True), digest, payload, None, None, None, None, None))
                        digests.append(digest)
                        lengths.append(e - at)
                        at = e
                    root = merkle(digests)
                    rows.append(("recipe", int.from_bytes(root[:8], "little", signed=True) ^ (keys[a + d] or 0), None, None, keys[a + d], sum(lengths), b"".join(digests), np.array(lengths, "<u2").tobytes(), root))
                if len(sent) > 200_000:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _once(batches):
    """Drops repeats of a digest from rows sorted by it."""
    last = None
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d is None or d != last)
            last = d
        yield batch.filter(pa.array(keep))


_ORDERED = "doc_id long, n_tokens long, digests binary, lengths binary, root binary, file long, local long"


def _ordered(batches):
    """Numbers ids within a recipe file."""
    at = 0
    for batch in batches:
        n = np.array(batch.column("n_tokens").to_pylist(), np.int64)
        local = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes chunks/, recipes/ and manifests/ under `path`."""
    spark = docs.sparkSession
    rows = ids_and_texts(docs).mapInArrow(lean(_chunked(tokenizer, end_id)), _ROWS)
    rows = rows.repartition("bucket").sortWithinPartitions("kind", "digest").drop("bucket")
    rows.mapInArrow(_once, rows.schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(rows.schema).parquet(f"{path}/raw")
    recipes = raw.where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "lengths", "root")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.withColumn("file", F.spark_partition_id().cast("long")).mapInArrow(_ordered, _ORDERED).write.parquet(f"{path}/recipes")
    # one row a file: as many as there are partitions
    manifests = _manifests(spark, path)
    from pyspark.sql import Window

    manifests.withColumn("start", F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens")).write.parquet(f"{path}/manifests")


_MANIFEST = "file long, n_docs long, n_tokens long, root binary"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """For each recipe file, from what it holds: documents, ids, and the Merkle root over its documents' roots in order."""

    def run(batches):
        schema = pa.schema([("file", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
        name, tree, tokens = None, Merkle(), 0
        for batch in batches:
            out = []
            for f, n, r in zip(*(batch.column(c).to_pylist() for c in ("file", "n_tokens", "root"))):
                if f != name:
                    if name is not None:
                        out.append((name, tree.count, tokens, tree.root()))
                    name, tree, tokens = f, Merkle(), 0
                tree.add(r)
                tokens += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if name is not None:
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [tree.count], "n_tokens": [tokens], "root": [tree.root()]}, schema=schema)

    # a file may be read in several splits: its documents come together again, in order
    recipes = spark.read.schema(_ORDERED).parquet(f"{path}/recipes").select("file", "local", "n_tokens", "root")
    return recipes.repartition("file").sortWithinPartitions("file", "local", "root").select("file", "n_tokens", "root").mapInArrow(run, _MANIFEST)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([f for f in _ROWS if f.name != "bucket"])).parquet(f"{path}/raw").where("kind = 'chunk'").select("digest", "payload")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """file, start, intact: does each recipe file still hold what its manifest says?"""
    kept = spark.read.schema(f"{_MANIFEST}, start long").parquet(f"{path}/manifests").select("file", "start", F.struct("n_docs", "n_tokens", "root").alias("kept"))
    now = _manifests(spark, path).select("file", F.struct("n_docs", "n_tokens", "root").alias("now"))
    return kept.join(now, "file", "full").select("file", "start", F.coalesce(F.col("kept") == F.col("now"), F.lit(False)).alias("intact"))


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start in the whole stream; raises where a file isn't what its manifest says.

    Manifests are few (one a partition of the writer) and are tested first, so that a file that is gone altogether is noticed too.
    """
    broken = [r["file"] for r in verify(spark, path).where("not intact").limit(10).collect()]
    if broken:
        raise ValueError(f"recipe files {broken} don't hold what their manifests say")
    r = spark.read.schema(_ORDERED).parquet(f"{path}/recipes")
    m = spark.read.schema(f"{_MANIFEST}, start long").parquet(f"{path}/manifests").select("file", F.col("start").alias("base"))
    # one row a recipe file, so bounded by the number of partitions
    return r.join(F.broadcast(m), "file").withColumn("start", F.col("base") + F.col("local")).drop("base")


def _checked(batches):
    """Each stored chunk's length and checksum, after a test of its name."""
    for batch in batches:
        names, crcs, ns = [], [], []
        for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
            if blake2b(payload, digest_size=16).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} doesn't hold what its name says")
            ids = unpack(payload)
            names.append(digest)
            ns.append(len(ids))
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_pydict({"digest": names, "n": ns, "crc": crcs}, schema=pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())]))


def _listed(batches):
    """A recipe's chunks with the number of ids after each; tests the recipe's root."""
    schema = pa.schema([("start", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("len", pa.int64()), ("after", pa.int64())])
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for s, d, x, n, r in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_id", "digests", "lengths", "root"))):
            names = [x[i : i + 16] for i in range(0, len(x), 16)]
            if merkle(names) != r:
                raise ValueError(f"the recipe of document {d} doesn't have its root")
            lengths = np.frombuffer(n, "<u2").astype(np.int64)
            cols[0] += [s] * len(names)
            cols[1] += [d] * len(names)
            cols[2] += names
            cols[3] += lengths.tolist()
            cols[4] += (lengths.sum() - np.cumsum(lengths)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, in its reflected form."""
    out = np.zeros_like(a)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What these checksums add to the checksum of a text that goes on for n_bytes more."""
    out, left = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    power = np.array([1 << 23], np.uint32)  # x**8
    while left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            out[odd] = _times(out[odd], np.broadcast_to(power, odd.shape))
        power = _times(power, power)
        left >>= 1
    return out


def _shifted(batches):
    for batch in batches:
        crc, n, after, length = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("crc", "n", "after", "len"))
        if (n != length).any():
            raise ValueError("a chunk doesn't have the length that its recipe says")
        part = shift_crc(crc, after * 4).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("doc_id"), pa.array(n), pa.array(part)], names=["start", "doc_id", "n", "part"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored files."""
    stats = chunks(spark, path).mapInArrow(_checked, "digest binary, n long, crc long")
    listed = recipes(spark, path).select("start", "doc_id", "digests", "lengths", "root").mapInArrow(_listed, "start long, doc_id long, digest binary, len long, after long")
    joined = skew_join(listed, stats, "digest", "left").select("start", "doc_id", "crc", "n", "after", "len").fillna(-1, ["n", "crc"])
    parts = joined.mapInArrow(_shifted, "start long, doc_id long, n long, part long")
    return parts.groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves, rebuilt from chunks."""
    listed = recipes(spark, path).select("start", "doc_id", "digests", "lengths", "root").mapInArrow(_listed, "start long, doc_id long, digest binary, len long, after long")
    joined = skew_join(listed, chunks(spark, path), "digest").groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("after", "payload")), asc=False).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([unpack(p["payload"]) for p in ps]).tolist() for ps in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return joined.mapInArrow(run, "doc_id long, start long, ids array<long>")


def store(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the store to the shared folder and reads it back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokenstore")
    write_store(docs, path, tokenizer, end_id)
    return read_back(spark, path)
