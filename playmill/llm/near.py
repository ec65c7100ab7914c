"""Operator 7: near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Texts become sets of hashed word shingles.  One pass makes each set's digest, MinHash bands and odd sketch (a bitmap in
which every MinHash sample flips one bit).  Equal sets collapse into classes first.  Classes that share a band meet in
a bucket, and two steps find all links that the components need:

1. Stars.  Every class of a bucket is tried against the bucket's smallest class.  Odd sketches drop pairs whose
   estimate is far below the threshold (six standard deviations); the others are confirmed on the full sets.
2. Blocks.  Where a bucket still holds several components, its classes outside the bucket's largest component are
   attached to that component.  Each attached class is then tried against all members of the component and all other
   classes attached to it, block by block, so every pair that shares a band is tried unless it is already in one
   component.  Odd sketches drop pairs here as well, and the rest are counted on full sets.  Blocks are cut by their
   rows and by the number of shingles; rows are copied once for each block, not for each pair, and a block returns at
   most one link for each class it joins.

The chance that a pair at the threshold shares none of the ``bands`` bands of ``rows`` rows is
(1 - 0.8 ** 5) ** 40 = 1e-7.

Cases: texts without words (null, empty, white space) have no shingles and are linked with nothing; very long texts
give sets of all their shingles; repeated rows have equal results; rows of one doc_id with different texts are linked
each by its own text, under the one id; rows without a doc_id are linked with nothing, have no component_id and are
kept; ties go to the smaller doc_id; other columns are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmill.llm.common import arrow_map, drop_scratch, join_hot, materialize, restrict, scratch_scope

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORDS_64 = 8


@dataclass(frozen=True)
class NearSettings:
    """Shingle width, threshold (percent), banding, least sketch estimate worth a trial, shingles and rows in a block."""

    width: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 5
    doubt: float = 0.5
    block: int = 400_000
    block_rows: int = 512


#: What near-duplicate operators and stages take unless they are told otherwise.
FIVE_WORDS = NearSettings(width=5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Whether a byte is ASCII white space.
WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


class Shingler:
    """Sets of hashed shingles; words are runs of bytes other than ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width = width

    @staticmethod
    def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, and the number of words up to the end of each text; all texts are laid end to end."""
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        codes = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        white = WHITE[codes]
        edge = np.flatnonzero(np.diff(white, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        counts = np.searchsorted(starts, np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64)))
        if not len(starts):
            return np.zeros(0, np.uint64), counts
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.uint64) - np.repeat(first.astype(np.uint64), lengths)
        # sums of the bytes, each scrambled with its place
        return mix(np.add.reduceat(mix((codes[~white].astype(np.uint64) << np.uint64(32)) ^ ((place + np.uint64(1)) * MIX2)), first)), counts

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One ascending array of distinct 64-bit shingles for each text."""
        with np.errstate(over="ignore"):
            h, ends = self._words(texts)
            whole = self._rolled(h, self.width)
            out, at = [], 0
            for end in ends.tolist():
                n = end - at
                rolled = whole[at : end - self.width + 1] if n >= self.width else self._rolled(h[at:end], n)
                out.append(np.unique(rolled))
                at = end
        return out

    @staticmethod
    def _rolled(h: np.ndarray, k: int) -> np.ndarray:
        """The hash of every k words in a row; nothing where there are none."""
        rolled = np.full(max(0, len(h) - k + 1) if k else 0, np.uint64(k + 1))
        for j in range(k if len(rolled) else 0):
            rolled = mix(rolled * MIX2 + h[j : len(h) - k + 1 + j])
        return rolled


def signatures(docs: DataFrame, s: NearSettings) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, bands and odd sketch (eight 64-bit words)."""
    samples = s.bands * s.rows

    def make():
        shingler, rng = Shingler(s.width), np.random.default_rng(7)
        factor = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 2**63, samples, dtype=np.uint64)
        number = mix(np.arange(1, samples + 1, dtype=np.uint64))

        def smallest(values: np.ndarray) -> np.ndarray:
            out = np.full(samples, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(values), 1024):
                np.minimum(out, (np.multiply.outer(values[at : at + 1024], factor) + shift).min(axis=0), out=out)
            return out

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingler.sets(batch.column(1).to_pylist())
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            with np.errstate(over="ignore"):
                least = np.stack([smallest(x) for x in sets]) if sets else np.zeros((0, samples), np.uint64)
                key = np.tile(mix(np.arange(1, s.bands + 1, dtype=np.uint64)), (len(sets), 1))
                for j in range(s.rows):
                    key = mix(key * MIX1 + least[:, j :: s.rows])
                bit = mix(least + number) >> np.uint64(55)
            odd = np.zeros((len(sets), 64 * WORDS_64), dtype=np.int64)
            for j in range(samples):
                odd[np.arange(len(sets)), bit[:, j].astype(np.int64)] ^= 1
            words = np.packbits(odd.astype(np.uint8), axis=1).view(">u8").astype(np.uint64).view(np.int64)
            key = key.view(np.int64)
            some = sizes > 0
            return pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_shingles": pa.array(sizes),
                "digest": pa.array([_digest(x) for x in sets], pa.binary()),
                "bands": pa.array([k if ok else [] for k, ok in zip(key, some)], pa.list_(pa.int64())),
                "sketch": pa.array(list(words), pa.list_(pa.int64())),
            })

        return apply

    return arrow_map(_rows(docs), make, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>", rows=512)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _estimate(samples: int):
    """Similarity by the odd sketches of columns sketch_u and sketch_v; one bit in two set says nothing but "low"."""
    bits = 64 * WORDS_64
    odd = reduce(lambda a, b: a + b, [F.bit_count(F.get("sketch_u", F.lit(i)).bitwiseXOR(F.get("sketch_v", F.lit(i)))) for i in range(WORDS_64)])
    left = F.greatest(F.lit(1.0 / bits), F.lit(1.0) - F.lit(2.0 / bits) * odd)
    return F.lit(1.0) + F.log(left) * F.lit(bits / 2 / (2 * samples))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, heads: DataFrame, s: NearSettings) -> DataFrame:
    """(node, shingles): the ascending shingles, as bytes, of the ``heads`` (digest, node) that stand in ``docs``."""

    def make():
        shingler = Shingler(s.width)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingler.sets(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "shingles"])

        return apply

    found = arrow_map(_rows(docs), make, "digest binary, shingles binary", rows=512)
    return found.join(heads.select("digest", "node"), "digest").dropDuplicates(["digest"]).select("node", "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, s: NearSettings, heavy: int = 500) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold.

    A v with many pairs has its set copied once for each ``heavy`` of them, so no task gets all of them.
    """

    def run(batches):
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2), batch.column(3)
            keep_u, keep_v, last, held = [], [], None, None
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                if v[i] != last:
                    last, held = v[i], np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                at = np.searchsorted(held, a)
                both = int((held[np.minimum(at, len(held) - 1)] == a).sum()) if len(held) else 0
                if both and 100 * both >= s.percent * (len(a) + len(held) - both):
                    keep_u.append(u[i])
                    keep_v.append(v[i])
            yield pa.RecordBatch.from_arrays([pa.array(keep_u, pa.int64()), pa.array(keep_v, pa.int64())], ["u", "v"])

    salts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("__n"), F.ceil(F.count(F.lit(1)) / F.lit(heavy)).cast("int").alias("__salts"))
    held = sets.select(F.col("node").alias("v"), F.col("shingles").alias("right")).join(salts, "v").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts", "__n")
    dealt = join_hot(pairs, salts, "v", "__n", F.col("u")).withColumn("__salt", F.pmod(F.xxhash64("u"), F.col("__salts")).cast("int")).drop("__salts")
    joined = dealt.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("left")), "u").join(held, ["v", "__salt"])
    return joined.select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u > v): the smallest node reachable.

    First every node keeps only its smallest neighbour and passes the other links on to it, until the links are a
    forest; then each node jumps to its parent's parent until all point at roots.  Tables of earlier rounds are deleted.
    """
    spark, old = edges.sparkSession, []

    def round_of(links: DataFrame) -> DataFrame:
        with scratch_scope() as new:
            out = materialize(links, "links")
        drop_scratch(spark, old)
        old[:] = new
        return out

    held = round_of(edges.where("u > v").distinct())
    several = lambda e: not e.groupBy("u").count().where("count > 1").isEmpty()
    while several(held):
        least = held.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        passed = least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = round_of(least.select("u", F.col("m").alias("v")).unionByName(passed).distinct())
    while True:
        above = held.select(F.col("u").alias("v"), F.col("v").alias("w"))
        # parents with their own parent, if any, and the number of their children, of which a root may have very many
        parents = held.groupBy("v").agg(F.count(F.lit(1)).alias("children")).join(above, "v", "left")
        held = round_of(join_hot(held.select("u", "v"), parents, "v", "children", F.col("u")).select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")))
        if held.where("moved").isEmpty():
            break
    roots = held.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = materialize(held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    drop_scratch(spark, old)
    return out


def _likely(left: np.ndarray, right: np.ndarray, samples: int, doubt: float) -> np.ndarray:
    """Which pairs of odd sketches (rows of 64-bit words) leave an estimate of ``doubt`` or more, as ``_estimate`` does."""
    bits = 64 * WORDS_64
    odd = np.zeros((len(left), len(right)), dtype=np.int64)
    for i in range(WORDS_64):
        odd += np.bitwise_count(left[:, i : i + 1] ^ right[:, i])
    return 1.0 + np.log(np.maximum(1.0 / bits, 1.0 - 2.0 / bits * odd)) * (bits / 2 / (2 * samples)) >= doubt


def solve_block(table: pa.Table, s: NearSettings) -> pa.Table:
    """Links of one block: rows of kind 1 are tried against rows of kind 0, of which ``inside`` ones are connected already.

    Pairs that their odd sketches rule out are left; an inverted index over the shingles of kind 1 gives the
    intersections of one set with all of them at once.
    """
    kind, node = table.column("kind").to_numpy(), table.column("node").to_numpy()
    inside, raw = table.column("inside").to_numpy(zero_copy_only=False), table.column("shingles").to_pylist()
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(kind), -1).view(np.uint64)
    sets = [np.frombuffer(r, dtype=np.uint64) for r in raw]
    asked, held = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
    u, v = [], []
    if len(asked) and len(held):
        likely = _likely(sketch[held], sketch[asked], s.bands * s.rows, s.doubt) & (node[held][:, None] != node[asked])
        sizes = np.array([len(sets[k]) for k in asked])
        values, owner = np.concatenate([sets[k] for k in asked]), np.repeat(np.arange(len(asked)), sizes)
        order = np.argsort(values, kind="stable")
        owner = owner[order]
        distinct, begin = np.unique(values[order], return_index=True)
        count = np.diff(np.append(begin, len(owner)))
        root = {"inside": "inside"} | {int(node[k]): int(node[k]) for k in range(len(node))}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in np.flatnonzero(inside):
            root[int(node[k])] = "inside"
        for h in sorted(np.flatnonzero(likely.any(axis=1)), key=lambda h: (not inside[held[h]], node[held[h]])):
            k = held[h]
            mine = find(int(node[k]))
            at = np.searchsorted(distinct, sets[k])
            at = np.minimum(at, len(distinct) - 1)
            at = at[distinct[at] == sets[k]]
            n = count[at]
            where = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, dtype=np.int64)
            both = np.bincount(owner[where], minlength=len(asked))
            for j in np.flatnonzero(likely[h] & (both > 0) & (100 * both >= s.percent * (len(sets[k]) + sizes - both))):
                other = int(node[asked[j]])
                if find(other) != (mine := find(int(node[k]))):
                    a, b = (find(other), mine) if mine == "inside" else (mine, find(other))
                    root[a] = b
                    u.append(max(other, int(node[k])))
                    v.append(min(other, int(node[k])))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def star_pairs(buckets: DataFrame, sketches: DataFrame, s: NearSettings) -> DataFrame:
    """(u, v): each class of a bucket with the bucket's smallest, where sizes and odd sketches leave a chance."""
    centre = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "n_shingles")).alias("c"))
    pairs = join_hot(buckets, centre, "band", "members", F.xxhash64("node")).where("node <> c.node")
    pairs = pairs.where(f"100 * least(n_shingles, c.n_shingles) >= {s.percent} * greatest(n_shingles, c.n_shingles)")
    pairs = materialize(pairs.select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct(), "stars")
    centres = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("members")).join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sketch_v")), "v")
    ends = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("sketch_u")), "u")
    return join_hot(ends, centres, "v", "members", F.col("u")).where(_estimate(s.bands * s.rows) >= s.doubt).select("u", "v")


def attached(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(home, node): classes of buckets with several components, each with the largest component there but its own.

    Buckets of two have had their only pair tried.
    """
    marked = buckets.join(comps, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    parts = marked.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    homes = parts.groupBy("band").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("home"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"))
    homes = materialize(homes.where("parts > 1 and size > 2").drop("parts"), "homes")
    return join_hot(marked, homes, "band", "size", F.xxhash64("node")).where("component <> home").select("home", "node").distinct()


def block_links(outside: DataFrame, comps: DataFrame, heads: DataFrame, docs: DataFrame, s: NearSettings) -> DataFrame:
    """Links of attached classes with their home component and with each other."""
    homes = outside.select("home").distinct()
    if homes.count() <= 2_000_000:
        homes = F.broadcast(homes)
    members = comps.join(homes.withColumnRenamed("home", "component"), "component", "left_semi").select(F.col("component").alias("home"), "node", F.lit(True).alias("inside"))
    alone = homes.join(comps.select(F.col("component").alias("home")).distinct(), "home", "left_anti").select("home", F.col("home").alias("node"), F.lit(True).alias("inside"))
    rows = materialize(members.unionByName(alone).unionByName(outside.withColumn("inside", F.lit(False))).join(heads.select("node", "doc_id", "n_shingles", "sketch"), "node"), "blocks")

    # 32 blocks a side where a home has the rows for it, so that middling homes spread as well as large ones
    a_block = F.greatest(F.lit(min(64, s.block_rows)), F.least(F.lit(s.block_rows), F.count(F.lit(1)) / F.lit(32)))

    def parts(counted):
        by_size = F.sum(F.when(counted, F.col("n_shingles")).otherwise(0)) / F.lit(s.block)
        return F.ceil(F.greatest(F.lit(1.0), by_size, F.count_if(counted) / a_block)).cast("int")

    cuts = rows.groupBy("home").agg(F.count(F.lit(1)).alias("members"), parts(F.lit(True)).alias("chunks"), parts(~F.col("inside")).alias("asked"))
    sets = shingle_sets(restrict(docs, rows.select("doc_id").distinct()), heads, s)
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = materialize(join_hot(rows, cuts, "home", "members", F.col("node")).join(sets, "node"), "sets")
    held = full.select("home", place("chunks").alias("i"), every("asked").alias("j"), F.lit(0).alias("kind"), "node", "inside", "sketch", "shingles")
    asked = full.where("not inside").select("home", every("chunks").alias("i"), place("asked").alias("j"), F.lit(1).alias("kind"), "node", "inside", "sketch", "shingles")
    return held.unionByName(asked).groupBy("home", "i", "j").applyInArrow(lambda t: solve_block(t, s), "u long, v long")


def class_heads(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: digest, node, doc_id (the smallest with that set), copies, n_shingles, bands, sketch.

    ``node`` is the doc_id.  Where a doc_id is the smallest of several sets (it came with several texts), all but the
    set with the smallest digest get numbers below all doc_ids.
    """
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    heads = named.join(classes, ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    repeated = classes.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("n"))
    if repeated.where("n > 1").isEmpty():
        return heads.withColumn("node", F.col("doc_id"))
    low = classes.agg(F.min("doc_id")).first()[0]
    first = repeated.select("digest", F.lit(True).alias("first"))
    return heads.join(first, "digest", "left").withColumn("node", F.when(F.col("first"), F.col("doc_id")).otherwise(F.lit(low) - 1 - F.monotonically_increasing_id())).drop("first")


def near_duplicates(docs: DataFrame, s: NearSettings = FIVE_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs, s), "signatures")
    heads = materialize(class_heads(signed), "heads")
    with scratch_scope() as done:
        buckets = materialize(_shared(heads.select(F.explode("bands").alias("band"), "node", "n_shingles")), "buckets")
        pairs = materialize(star_pairs(buckets, heads.select("node", "sketch"), s), "pairs")
        needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        wanted = heads.join(needed, "node", "left_semi").select("doc_id").distinct()
        sets = materialize(shingle_sets(restrict(docs, wanted), heads, s), "sets")
        edges = materialize(confirm(pairs, sets, s), "edges")
    with scratch_scope() as first:
        comps = components(edges)
    with scratch_scope() as late:
        outside = materialize(attached(buckets, comps), "attached")
        more = None if outside.isEmpty() else materialize(block_links(outside, comps, heads, docs, s), "edges")
    if more is not None and not more.isEmpty():
        comps = components(edges.unionByName(more))
        done += first
    drop_scratch(spark, done + late)
    apart = heads.where("node <> doc_id")
    if not apart.isEmpty():  # some nodes are no doc_ids: the smallest doc_id of each component stands for it
        least = comps.join(heads.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
        comps = comps.join(least, "component").select("node", F.col("least").alias("component"))
    solid = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    found = join_hot(signed.where(solid).select("doc_id", "n_shingles", "digest"), heads.select("digest", "copies", "node", F.col("doc_id").alias("class_id")), "digest", "copies", F.concat(F.lit("hot"), F.col("doc_id").cast("string")).cast("binary"))
    linked = join_hot(found, comps.join(heads.select("node", "copies"), "node"), "node", "copies", F.col("doc_id"))
    linked = linked.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    out = linked.unionByName(signed.where(~solid).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows of the bands that more than one row has."""
    many = buckets.groupBy("band").count().where("count > 1").select("band")
    return buckets.join(many, "band")
