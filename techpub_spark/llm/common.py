"""Helpers shared by the training-data operators: shared storage, text keys, components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session, as in tests, may do without the setting: it gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_techpub_shared", None)
        if path is None:
            path = spark._techpub_shared = "file://" + tempfile.mkdtemp(prefix="techpub-")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/techpub/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffles that made it are of no more use.  Spark frees their files once the driver's heap is
    collected, which a large idle heap seldom is; after ``heavy`` ones it is asked to.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if heavy:
        freed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def freed(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more."""
    gc.collect()  # Python's references to plans keep theirs
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sorts both sides.  Neither is broadcast, whatever its size: a broadcast is built in the driver's
    memory, and dozens of tables that are each just small enough for it are more than a driver holds."""
    return left.join(right.hint("merge"), on, how)


def text_digest(text: Column) -> Column:
    """128-bit key of a text, as 32 hex digits; equal texts and only they (up to md5) share it."""
    return F.md5(F.coalesce(text, F.lit("")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body`` (a higher-order let binding)."""
    return F.transform(F.array(value), body)[0]


def _is_stars(edges: DataFrame) -> bool:
    """Every node points at one root, and no root points anywhere: one aggregate."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return odd.count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    ``edges``: columns ``a`` and ``b`` of one orderable type; loops and nulls are dropped, direction and
    repeats do not matter.  Returns ``node``, ``root`` (the smallest node of its component) for every
    node that has an edge; an empty input gives an empty table.  Each round is one job of distributed
    joins and aggregates written to the shared folder; it ends once the edges are stars.  Nothing is
    collected but one count, and a node with very many neighbours is only ever the key of a minimum or of
    a splittable join.
    """
    cur = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _is_stars(cur):
            break
        # large star: every larger neighbour points at the smallest of the neighbourhood
        both = cur.union(cur.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        large = sorted_join(both, low, F.col("u") == F.col("lu")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))  # no more rows than edges
        # small star: smaller neighbours and the node itself point at the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("lu"), "m")
        joined = sorted_join(large, low, F.col("a") == F.col("lu"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low).distinct()
        cur, old = stored(small, "edges", heavy=True), cur
        dropped(old)
    else:
        raise RuntimeError("components did not settle")
    out = stored(cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b"), F.col("b")).distinct()), "components")
    dropped(cur)
    return out


#: Slots of the table of token frequencies that orders tokens from rare to frequent: a fixed size, whatever the data.
SLOTS = 1 << 18


def _token_sets(tokens, texts: pa.Array) -> Iterator[np.ndarray]:
    """The tokens of each text; ``tokens.many``, if there is one, makes those of a list of texts at once."""
    many = getattr(tokens, "many", None)
    for at in range(0, len(texts), 256):
        some = texts.slice(at, 256).to_pylist()
        yield from many(some) if many else map(tokens, some)


def _slot_counts(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for t in _token_sets(tokens, batch.column("text")):
                np.add.at(total, (_images(t) % np.uint32(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run


def _marks(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for t in _token_sets(tokens, batch.column("text")):
                sizes.append(len(t))
                sketches.append(parity_sketch(t))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "size", "sketch"])

    return run


def _able(threshold: float, most_apart) -> Column:
    """Whether (sizea, w0_a, ...) and (sizeb, w0_b, ...) can reach ``threshold``: sizes, then bits of the parity sketches."""
    bits = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(SKETCH // 64)), F.lit(0))
    return (F.least("sizea", "sizeb") >= F.lit(threshold) * F.greatest("sizea", "sizeb") - 1e-9) & (bits <= most_apart(F.col("sizea"), F.col("sizeb")) + 1e-9)


def able_pairs(pairs: DataFrame, marks: DataFrame, threshold: float, most_apart) -> DataFrame:
    """Those of the pairs (a, b) that their sizes and parity sketches (``marks``) don't rule out; none that links is left out.

    Pairs meet the marks of b as one row per b, which has few partners, and those of a under the test, so
    that only pairs that pass it are made and get their texts.
    """
    side = lambda s: marks.select(F.col("id").alias(f"i{s}"), F.col("size").alias(f"size{s}"), *[F.get("sketch", F.lit(k)).alias(f"w{k}_{s}") for k in range(SKETCH // 64)])
    heads = sorted_join(pairs.groupBy("b").agg(F.collect_set("a").alias("partners")), side("b"), F.col("b") == F.col("ib"))
    met = heads.withColumn("a", F.explode("partners")).drop("partners", "ib")
    return sorted_join(met, side("a"), (F.col("a") == F.col("ia")) & _able(threshold, most_apart)).select("a", "b")


def prefix_length(size: int, threshold: float) -> int:
    """Tokens of a set of ``size`` of which one is shared with every set that has ``threshold`` of the larger in common."""
    return size - math.ceil(threshold * size - 1e-9) + 1


#: Bits of the parity sketch of a token set.
SKETCH = 1024


def _images(t: np.ndarray) -> np.ndarray:
    """Different 32-bit images of the tokens."""
    return np.unique((t >> np.uint64(32)).astype(np.uint32))


def parity_sketch(t: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits as 64-bit integers: bit k is the parity of the number of tokens that fall on it.

    The sketches of two sets differ in at most as many bits as the sets differ in tokens.
    """
    odd = np.bincount((t % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(tokens, threshold: float, often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches, lists = [], [], []
            for t in _token_sets(tokens, batch.column("text")):
                x = _images(t)
                x = x[np.lexsort((x, often.value[x % np.uint32(SLOTS)]))].view(np.int32)
                sizes.append(len(t))
                sketches.append(parity_sketch(t))
                lists.append(x[: prefix_length(len(t), threshold)] if len(t) else x)
            cols = [batch.column("id"), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["pid", "size", "sketch", "prefix"])

    return run


def _key_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        at = _key_places(batch.column(0).to_numpy())
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    yield _full_words(table)


def _key_places(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint32) % np.uint32(BITS)).astype(np.int64)


def _shared_prefixes(table: Broadcast):
    """Prefixes without the tokens that the table does not have, and the places of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            ends, keys = prefix.offsets.to_numpy().astype(np.int64), prefix.values.to_numpy()
            keys, ends = keys[ends[0] : ends[-1]], ends - ends[0]
            at = _key_places(keys)
            keep = (table.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            place = np.arange(len(keys)) - np.repeat(ends[:-1], np.diff(ends))
            cut = pa.array(np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x[keep].astype(np.int32))) for x in (keys, place)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "own", "size", "sketch")] + lists, names=["id", "own", "size", "sketch", "prefix", "places"])

    return run


def prefix_pairs(apart: DataFrame, texts: DataFrame, tokens, threshold: float, most_apart) -> DataFrame:
    """Pairs (a, b) of different components that can reach ``threshold``; none that can is left out.

    ``apart``: ``id``, ``own`` (component); ``texts``: ``id``, ``text``; ``tokens`` maps a text to its different
    tokens as 64-bit integers.  A link must imply that the two token sets have ``threshold`` of the larger
    set in common, and that they differ in at most ``most_apart(size, size)`` tokens (of columns).

    Under any fixed order of tokens, the first ``prefix_length`` tokens of two linked sets share one; only
    pairs that share one are looked at.  Rare tokens come first, by a table of ``SLOTS`` counts: what many
    members have in common stands at the end and joins nothing.  Of the pairs that meet, those are made
    whose parity sketches differ in no more bits than the sets may differ in tokens: a test of a few
    integers that rejects nearly all pairs under the threshold and none above it.  A pair is made at the
    first token that its prefixes share, so that the join gives it once; the tokens before it have no
    part in what the two share, so a pair that meets too late is not made either.  Tokens that one
    member alone has in its prefix are not joined (``shared``: a table of bits of fixed size).

    Prefix tokens are compared by 32-bit images.  Where two tokens of one text have one image, a prefix of
    the same length still holds a shared image; so images and the table cost speed, not pairs.
    """
    spark = apart.sparkSession
    members = apart.groupBy("id").agg(F.min("own").alias("own"))
    texts = stored(sorted_join(texts, members.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_semi"), "texts")
    counts = texts.mapInArrow(_slot_counts(tokens), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    made = texts.select("id", "text").mapInArrow(_prefixes(tokens, threshold, spark.sparkContext.broadcast(often)), "pid binary, size int, sketch array<long>, prefix array<int>")
    words = [F.get("sketch", F.lit(k)).alias(f"w{k}") for k in range(SKETCH // 64)]
    each = stored(sorted_join(members, made, F.col("id") == F.col("pid")).select("id", "own", "size", "sketch", "prefix"), "prefixes")
    shared = _joined_bits(each.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").mapInArrow(_key_words, "word long, bits long"))
    kept = stored(each.mapInArrow(_shared_prefixes(shared), "id binary, own binary, size int, sketch array<long>, prefix array<int>, places array<int>"), "shared", heavy=True)
    words = [F.get("sketch", F.lit(k)).alias(f"w{k}") for k in range(SKETCH // 64)]
    live = kept.select(F.posexplode("prefix").alias("nth", "key"), "prefix", "places", "id", "own", "size", *words)
    live = live.select("key", F.get("places", F.col("nth")).alias("at"), F.slice("prefix", F.lit(1), F.col("nth")).alias("before"), "id", "own", "size", *[f"w{k}" for k in range(SKETCH // 64)])
    names = ["key", "at", "before", "id", "own", "size", *[f"w{k}_" for k in range(SKETCH // 64)]]
    left, right = live.toDF(*[f"{n}a" for n in names]), live.toDF(*[f"{n}b" for n in names])
    least = lambda x, y: (F.col(x) + F.col(y) - most_apart(F.col(x), F.col(y))) / 2 - 1e-9  # tokens that a linked pair has in common
    left = left.where(F.col("sizea") - F.col("ata") >= least("sizea", "sizea"))  # a is the smaller one
    early = F.least(F.col("sizea") - F.col("ata"), F.col("sizeb") - F.col("atb")) >= least("sizea", "sizeb")
    order = (F.col("sizea") < F.col("sizeb")) | ((F.col("sizea") == F.col("sizeb")) & (F.col("ida") < F.col("idb")))
    able = order & early & _able(threshold, most_apart) & (F.col("owna") != F.col("ownb")) & ~F.arrays_overlap("beforea", "beforeb")  # last: few pairs get so far
    found = sorted_join(left, right, (F.col("keya") == F.col("keyb")) & able).select(F.least("ida", "idb").alias("ida"), F.greatest("ida", "idb").alias("idb"))
    out = stored(found.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "pairs", heavy=True)
    dropped(each, kept, texts)
    return out


#: Bits of the table of wanted ids: a fixed size, whatever the data.  Where it is full it keeps nothing out.
BITS = 1 << 25


def _places(ids: pa.Array) -> np.ndarray:
    """Bit of each 16-byte id."""
    return (_halves(ids)[:, 0] % np.uint64(BITS)).astype(np.int64)


def _halves(ids: pa.Array) -> np.ndarray:
    """The two 64-bit halves of each 16-byte id."""
    if not len(ids):
        return np.zeros((0, 2), np.uint64)
    _, ends, data = ids.buffers()
    first = np.frombuffer(ends, np.int32)[ids.offset]
    return np.frombuffer(data, np.uint64, 2 * len(ids), int(first)).reshape(-1, 2)


def _bit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        at = _places(batch.column(0))
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    yield _full_words(table)


def _full_words(table: np.ndarray) -> pa.RecordBatch:
    words = table.view(np.int64)
    full = np.flatnonzero(words)
    return pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full])], names=["word", "bits"])


def wanted_bits(ids: DataFrame) -> Broadcast:
    """A table of ``BITS`` bits in which the bits of all ``ids`` (one column of 16-byte ids) are set.

    It lets a scan drop most rows that no id asks for before they are shuffled; an exact join follows it.
    """
    return _joined_bits(ids.mapInArrow(_bit_words, "word long, bits long"))


def _joined_bits(words: DataFrame) -> Broadcast:
    """The table of bits that the parts (word, bits) make together."""
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def has_bit(table: np.ndarray, ids: pa.Array) -> np.ndarray:
    at = _places(ids)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: Ranges of buckets that members are dealt by (a power of two), and members that are combined at once before.
RANGES, COMBINED = 4096, 1 << 20


def _stars(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (bucket, id's two halves) to the centre of each bucket, in order, and rays (bucket, centre, id).

    The centre is the smallest id; every different other id has a ray.
    """
    members = members[np.argsort(members[:, 0], kind="stable")]
    new = np.ones(len(members), bool)
    new[1:] = members[1:, 0] != members[:-1, 0]
    several = ~new | ~np.append(new[1:], True)
    part = members[several]
    if not len(part):
        return members, np.zeros((0, 5), np.uint64)
    high, low = part[:, 1].byteswap(), part[:, 2].byteswap()  # bytes in order
    part = part[np.lexsort((low, high, part[:, 0]))]
    first = np.ones(len(part), bool)
    first[1:] = part[1:, 0] != part[:-1, 0]
    again = np.zeros(len(part), bool)
    again[1:] = (part[1:] == part[:-1]).all(axis=1)
    centre = part[np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))]
    ray = ~first & ~again
    rays = np.concatenate([centre[ray], part[ray, 1:]], axis=1)
    members[several] = centre
    return members[new], rays


def _packed(parts: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """Rows in runs of one part each to a blob a run."""
    at = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    offsets = np.append(at, len(rows)) * rows.shape[1] * 8
    blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
    return pa.RecordBatch.from_arrays([pa.array(parts[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), blobs], names=["part", "kind", "rows"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, buckets) to blobs: the rays of what meets here already (kind 0), and one member of each bucket (kind 1)."""
    held, size = [], 0

    def out():
        centres, rays = _stars(np.concatenate(held))
        yield _packed((centres[:, 0] >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), centres, 1)
        if len(rays):  # dealt anyhow: a large bucket's rays are not for one task
            yield _packed((np.arange(len(rays)) // 4096 + int(rays[0, 2] % np.uint64(RANGES))) % RANGES, rays, 0)

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            lists = some.column("buckets")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            rows = np.empty((int(n.sum()), 3), np.uint64)
            rows[:, 0] = lists.flatten().to_numpy().view(np.uint64)
            rows[:, 1:] = np.repeat(_halves(some.column("id")), n, axis=0)
            held.append(rows)
            size += len(rows)
            if size >= COMBINED:
                yield from out()
                held, size = [], 0
    if size:
        yield from out()


def _ray_rows(rays: np.ndarray) -> pa.RecordBatch:
    ids = [pa.Array.from_buffers(pa.binary(), len(rays), [None, pa.py_buffer(np.arange(0, 16 * len(rays) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rays[:, k : k + 2]))]) for k in (1, 3)]
    return pa.RecordBatch.from_arrays([pa.array(rays[:, 0].copy().view(np.int64)), *ids], names=["bucket", "centre", "id"])


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs in order of part to rows (bucket, centre, id): the rays in them, and those between the members left of a bucket."""
    part, held = None, []
    for batch in batches:
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k, blob in enumerate(batch.column(2)):
            rows = np.frombuffer(blob.as_buffer(), np.uint64)
            if kinds[k] == 0:
                yield _ray_rows(rows.reshape(-1, 5))
                continue
            if parts[k] != part and held:
                yield _ray_rows(_stars(np.concatenate(held))[1])
                held = []
            part = parts[k]
            held.append(rows.reshape(-1, 3))
    if held:
        yield _ray_rows(_stars(np.concatenate(held))[1])


def star(members: DataFrame, rows=None) -> DataFrame:
    """(bucket, centre, id): every different id of a bucket but one, with a smaller id of the bucket to compare it with.

    ``members``: ``id`` and ``bucket`` or an array ``buckets``, or what ``rows`` makes those from, batch by batch:
    in the same Python worker, as a step of its own would take a second one a task.  Each task makes the rays of what it has
    and sends one member of each bucket on, packed by ranges of buckets.  So what a bucket of any size
    sends grows with the blocks of ``COMBINED`` members, not with the bucket; its centres are compared with the smallest.
    """
    lists = members.select("id", F.array("bucket").alias("buckets")) if "bucket" in members.columns else members
    combine = _combined if rows is None else lambda batches: _combined(rows(batches))
    dealt = lists.mapInArrow(combine, "part int, kind int, rows binary").repartition("part").sortWithinPartitions("part")
    raw = dealt.mapInArrow(_star_rows, "bucket long, centre binary, id binary")
    return stored(raw.groupBy("bucket", "id").agg(F.min("centre").alias("centre")).select("bucket", "centre", "id"), "star", heavy=True)


#: Members of a bucket that meet each other; larger buckets are split at random.  Buckets that are compared by shifts, rows of a tile.
PART, SMALL, TILE = 4096, 8, 64


def _tiles(own: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float, bound) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) in a group in order of size, i < j, of different ``own`` that can link, and the bits that differ, by tiles."""
    half = sketch.shape[1] // 2
    for at in range(0, len(size), TILE):
        rows = np.arange(at, min(at + TILE, len(size)))
        cols = np.arange(at, np.searchsorted(size, (size[rows[-1]] + 1e-9) / threshold, "right"))
        use = (own[rows][:, None] != own[cols]) & (rows[:, None] < cols) & (size[rows][:, None] >= threshold * size[cols] - 1e-9)
        if 4 * np.count_nonzero(use) > use.size:
            bits = np.zeros(use.shape, np.int32)
            for w in range(half):
                bits += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[cols, w])
            use &= bits <= bound(size[rows][:, None], size[cols]) + 1e-9
        i, j = np.nonzero(use)
        i, j = rows[i], cols[j]
        bits = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        use = bits <= bound(size[i], size[j]) + 1e-9
        if use.any():
            yield i[use], j[use], bits[use]


def _first_of_each(i: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest by ``by`` of each i."""
    order = np.lexsort((by, i))
    run = i[order]
    new = np.append(True, run[1:] != run[:-1])
    since = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    return order[since < n]


def _near(threshold: float, bound, near_by: int, whole: bool):
    """Rows (bucket, part, n, id, own, size, sketch) in order of bucket and part to the pairs (a, b) of a part that can link.

    If they are more than ``near_by`` a member, and not ``whole``, each member gives its first and its nearest
    ones among those at least as large.  What is linked whole is joined by that; the bucket is named in a row
    of its own, as one to come back to.  So are buckets of several parts.
    """

    def group(own, size, sketch, order):
        m, full, some = len(size), [], []
        by_size = np.argsort(size, kind="stable")
        own, size, sketch, order = own[by_size], size[by_size], sketch[by_size], order[by_size]
        most = None if whole else near_by * m
        for i, j, bits in _tiles(own, size, sketch, threshold, bound):
            if most is not None:
                some.append(np.stack([i, j], 1)[np.unique(np.append(_first_of_each(i, order[j], (near_by + 1) // 2), _first_of_each(i, bits, near_by // 2)))])
                most -= len(i)
            if most is None or most >= 0:
                full.append(np.stack([i, j], 1))
        cut = most is not None and most < 0
        got = some if cut else full
        return by_size[np.concatenate(got)] if got else np.zeros((0, 2), np.int64), cut

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        bucket, part, n, size = (table[c].to_numpy() for c in ("bucket", "part", "n", "size"))
        ids, halves = table["id"].chunk(0), _halves(table["id"].chunk(0))
        own = np.unique(_halves(table["own"].chunk(0)), axis=0, return_inverse=True)[1].ravel()
        size, sketch = size.astype(np.int64), table["sketch"].chunk(0).flatten().to_numpy().view(np.uint64).reshape(len(size), -1)
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))
        starts = np.append(np.flatnonzero(new), len(bucket))
        run, count = np.cumsum(new), np.repeat(np.diff(starts), np.diff(starts))
        found, again = [], [bucket[n > PART]] if not whole else []
        for k in range(1, SMALL):
            i = np.arange(len(bucket) - k)
            i = i[(run[i] == run[i + k]) & (count[i] <= SMALL)]
            j = i + k
            use = (own[i] != own[j]) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9)
            i, j = i[use], j[use]
            use = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= bound(size[i], size[j]) + 1e-9
            found.append(np.stack([i[use], j[use]], 1))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > SMALL:
                order = np.empty(b - a, np.int64)
                order[np.lexsort((halves[a:b, 1], halves[a:b, 0]))] = np.arange(b - a)
                got, cut = group(own[a:b], size[a:b], sketch[a:b], order)
                found.append(got + a)
                if cut:
                    again.append(bucket[a : a + 1])
        both, left = np.concatenate(found), np.unique(np.concatenate(again)) if again else np.zeros(0, np.int64)
        none = [pa.nulls(len(left), pa.binary())] * 2
        a, b = (pa.concat_arrays([ids.take(pa.array(both[:, k])), none[k]]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(left, pa.int64())])], names=["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table])
            if not table.num_rows:
                continue
            bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
            at = int(np.flatnonzero((bucket == bucket[-1]) & (part == part[-1]))[0])  # the last group may go on
            if at:
                yield from pairs(table.slice(0, at))
            tail = table.slice(at)
        if tail is not None:
            yield from pairs(tail)

    return run


def near_pairs(members: DataFrame, marks: DataFrame, threshold: float, bound, near_by: int, seed: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of members of a part of a bucket, of different components, that can link; see ``_near``.

    ``members``: ``bucket``, ``id``, ``own``, ``n`` (members of the bucket).  A bucket of at most ``PART`` is one part, a
    larger one is split at random, so a member meets a bounded number of others, by its size and sketch alone.
    """
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / PART))
    work = sorted_join(members, marks.select(F.col("id").alias("of"), "size", "sketch"), F.col("id") == F.col("of"))
    work = work.select("bucket", part.alias("part"), "n", "id", "own", "size", "sketch")
    work = work.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return work.mapInArrow(_near(threshold, bound, near_by, whole), "a binary, b binary, bucket long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after ``links`` (a, b) between nodes, which may be new."""
    name = labels.select(F.col("node").alias("of"), F.col("root").alias("label"))
    work = sorted_join(links, name, F.col("a") == F.col("of"), "left").select("a", "b", F.coalesce("label", "a").alias("la"))
    work = stored(sorted_join(work, name, F.col("b") == F.col("of"), "left").select("la", F.coalesce("label", "b").alias("lb")), "links")
    found = components(work.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    top = found.select(F.col("node").alias("of"), F.col("root").alias("top"))
    alone = sorted_join(found, labels.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_anti")
    out = stored(sorted_join(labels, top, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone), "labels")
    dropped(work, labels, found)
    freed(labels.sparkSession)
    return out


def bucket_components(members: DataFrame, verify, threshold: float, texts, tokens, most_apart, near_by: int = 2, rounds: int = 4, bound=None, rows=None) -> DataFrame:
    """Components (``node``, ``root``) of all verified links within buckets, without all pairs.

    ``members``: ``id`` (16 bytes) and ``bucket`` (long) or an array ``buckets``, or see ``star`` for ``rows``; ``verify`` maps distinct pairs (a, b) and a table of
    texts (``id``, ``text``) to (a, b, sim); ``texts`` maps a table of ids (``of``) to ``id``, ``text`` and is
    called once, with all that met another; ``tokens`` and ``most_apart`` as for ``prefix_pairs``; ``bound`` is
    ``most_apart`` for numpy arrays (if there is none, what ``threshold`` of the larger set in common implies).

    1. Each member is compared with one centre of its bucket: a star, linear in the bucket.
    2. In buckets that are still in several components, the sizes and parity sketches of members of
       different components are compared, within parts of about ``PART`` members: linear too.  The pairs that can
       link are verified, all of them where they are at most ``near_by`` a member, else that many, up to
       ``rounds`` times, as long as that links one in 20.
    3. For buckets with more pairs than that, or of more than ``PART`` members, that are still apart, an exact
       prefix join finds every pair of different components that can still link, and makes it once.

    Members of one component need no more comparison, so no link that would change a component is lost.
    The tables made on the way are deleted; the result is a stored table.
    """
    spark, rays = members.sparkSession, star(members, rows)
    bound = bound or (lambda x, y: x + y - 2 * threshold * np.maximum(x, y))
    ids = rays.select(F.col("id").alias("of")).union(rays.select("centre")).distinct()
    ids = stored(ids, "ids")
    if ids.isEmpty():
        dropped(rays, ids)
        return stored(ids.sparkSession.createDataFrame([], "node binary, root binary"), "components")
    met = stored(texts(ids), "met", heavy=True)
    marks = stored(met.select("id", "text").mapInArrow(_marks(tokens), "id binary, size int, sketch array<long>"), "marks")
    tested = stored(rays.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "tested", heavy=True)
    linking = lambda pairs: verify(pairs, met).where(F.col("sim") >= threshold).select("a", "b")
    got = stored(linking(able_pairs(tested, marks, threshold, most_apart)), "verified", heavy=True)
    comp = components(got)
    label = lambda s: comp.select(F.col("node").alias(f"of{s}"), F.col("root").alias(f"label{s}"))
    named = sorted_join(sorted_join(tested, label("a"), F.col("a") == F.col("ofa"), "left"), label("b"), F.col("b") == F.col("ofb"), "left")
    cut = named.where(F.coalesce("labela", "a") != F.coalesce("labelb", "b")).select("a", "b")  # a bucket's rays join all of it
    torn = sorted_join(rays, cut, (F.col("centre") == F.col("a")) & (F.col("id") == F.col("b")), "left_semi").select(F.col("bucket").alias("torn")).distinct()
    opened = stored(sorted_join(rays, torn, F.col("bucket") == F.col("torn"), "left_semi").select("bucket", "centre", "id"), "open", heavy=True)
    every = opened.select("bucket", "id").union(opened.select("bucket", "centre").distinct()).distinct()
    dropped(rays, ids, got)
    old, seed, whole, used = opened, 0, False, [met, marks, tested]
    while True:
        named = sorted_join(every, label(""), F.col("id") == F.col("of"), "left").select("bucket", "id", F.coalesce("label", "id").alias("own"))
        size = named.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n"))
        size = size.where(F.col("lo") != F.col("hi")).select(F.col("bucket").alias("of"), "n")
        apart = stored(sorted_join(named, size, F.col("bucket") == F.col("of")).select("bucket", "id", "own", "n"), "apart", heavy=True)
        dropped(old)
        old = apart
        if not (left := apart.count()):
            break
        if whole:
            pairs = prefix_pairs(apart, met, tokens, threshold, most_apart)
            more = stored(linking(sorted_join(pairs, tested, ["a", "b"], "left_anti")), "verified", heavy=True)
            if not more.isEmpty():
                comp = merged(comp, more)
            used += [pairs, more]
            break
        found = stored(near_pairs(apart, marks, threshold, bound, near_by, seed, False), "near", heavy=True)
        used.append(found)
        pairs = found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stored(sorted_join(pairs, tested, ["a", "b"], "left_anti"), "pairs")
        more = stored(linking(pairs), "verified", heavy=True)
        if linked := more.count():
            comp = merged(comp, more)
        used += [pairs, more]
        again = found.where("bucket is not null").select(F.col("bucket").alias("again")).distinct()
        if again.isEmpty():
            break
        every = sorted_join(apart.select("bucket", "id"), again, F.col("bucket") == F.col("again"), "left_semi")
        tested, seed = tested.union(pairs), seed + 1
        whole = seed == rounds or linked * 20 < left
    dropped(old, *used)
    freed(spark)
    return comp
