"""Operator 13: a Merkle manifest of a dataset, with a proof for every row.

Rows become leaves, the leaves of a group a tree of ``fanout``, the roots of the groups another one.  A tree is built in
aligned blocks of ``fanout ** levels`` nodes: a block's leaves are one contiguous matrix of 64 hex bytes a row, which is
reshaped by the fanout and hashed row by row, level by level; every sibling of every leaf is found by index arithmetic.
The blocks' roots are the nodes of the next tier, until a tree has one.  Paths then come down the tiers: each block
extends the path of its root by those inside it.  Spark ranks, groups and joins; a block is all that a task holds.

Cases: null fields are hashed as ``-``, apart from empty ones; a null doc_id comes first and its row is never tampered
with; rows of one source and doc_id stand by their leaf, and repeated rows, whose leaves are equal, get places and proofs of
their own; a null source is a source of its own and the first; very long texts are hashed whole; columns beyond the five
named ones are not read, whatever their names; a lone leaf of a lone source is the root and its proof is empty; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import materialize, parts_for, range_rank

HEX = 64
#: What a node of a block carries: leaves have an id and the leaf shown for verification, roots of groups a name.
NODE = ["rank", "node", "id", "name", "shown"]
PATH = "grp string, rank long, node string, id long, name string, shown string, subroot string, root string, proof binary, steps binary"


def field_text(value: Column) -> Column:
    """A field as the leaf hashes it: ``-`` for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields."""
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def hash_runs(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: one digest for every ``fanout`` rows of a matrix of hex digests; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = [*np.ascontiguousarray(nodes[: whole * fanout]).reshape(whole, fanout * HEX), *([nodes[whole * fanout :].ravel()] if len(nodes) % fanout else [])]
    return digests(runs)


def digests(rows: list) -> np.ndarray:
    """Hex digests of byte strings, as a matrix."""
    return np.frombuffer(b"".join(hashlib.sha256(r).hexdigest().encode() for r in rows), dtype=np.uint8).reshape(-1, HEX)


def block_levels(leaves: np.ndarray, fanout: int, levels: int | None) -> list[np.ndarray]:
    """All levels of a block: ``levels`` above the leaves, or as many as it takes to one node."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append(hash_runs(out[-1], fanout))
    return out


def places(levels: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top: of every leaf the start of its run, its place there and the run's length."""
    at = np.arange(len(levels[0]))
    for nodes in levels[:-1]:
        start = at // fanout * fanout
        yield start, at - start, np.minimum(fanout, len(nodes) - start)
        at = at // fanout


def block_proofs(levels: list[np.ndarray], fanout: int) -> tuple[list[bytes], list[bytes]]:
    """Of every leaf of a block the siblings up to the block's root, and (place, length) of each run on the way."""
    n, slots = len(levels[0]), np.arange(fanout - 1)
    if len(levels) == 1:
        return [b""] * n, [b""] * n
    found, held, steps = [], [], []
    for nodes, (start, place, length) in zip(levels, places(levels, fanout)):
        which = start[:, None] + slots + (slots >= place[:, None])
        found.append(nodes[np.minimum(which, len(nodes) - 1)])
        held.append(slots < length[:, None] - 1)
        steps.append(np.stack([place, length], axis=1))
    found, held = np.concatenate(found, axis=1), np.concatenate(held, axis=1)
    steps = np.concatenate(steps, axis=1).astype(np.uint8)
    return [f[h].tobytes() for f, h in zip(found, held)], [s.tobytes() for s in steps]


def fold_block(levels: list[np.ndarray], fanout: int, shown: np.ndarray) -> np.ndarray:
    """What the block's root would be if each leaf, alone, were the one shown."""
    every = np.arange(len(shown))
    for nodes, (start, place, length) in zip(levels, places(levels, fanout)):
        runs = nodes[np.minimum(start[:, None] + np.arange(fanout), len(nodes) - 1)]
        runs[every, place] = shown
        runs = runs.reshape(len(shown), -1)
        shown = digests([r[: k * HEX] for r, k in zip(runs, length)])
    return shown


def fold(leaf: bytes, proof: bytes, steps: bytes) -> bytes:
    """The root that a hex leaf, its siblings and (place, length) of each run lead to."""
    at = 0
    for place, length in zip(steps[::2], steps[1::2]):
        left, right = at + place * HEX, at + (length - 1) * HEX
        leaf = hashlib.sha256(proof[at:left] + leaf + proof[left:right]).hexdigest().encode()
        at = right
    return leaf


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of hex digests as a matrix of bytes."""
    column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, HEX)


def _texts(rows: np.ndarray) -> pa.Array:
    """A matrix of hex digests as a column."""
    ends = np.arange(0, rows.size + 1, HEX, dtype=np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes()))


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.StructArray]]:
    """Rows of batches one by one, with the nodes of the block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, row.column("members").flatten()


def _block_roots(fanout: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, nodes in _blocks_in(batches):
            top = block_levels(_matrix(nodes.field("node")), fanout, None if row["alone"][0].as_py() else levels)[-1]
            yield pa.RecordBatch.from_arrays([row["grp"], row["block"], row["alone"], row["nodes"], _texts(top)], names=["grp", "block", "alone", "nodes", "node"])

    return run


def _block_paths(fanout: int, levels: int):
    """Nodes of blocks with their paths to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, nodes in _blocks_in(batches):
            n = len(nodes)
            all_levels = block_levels(_matrix(nodes.field("node")), fanout, None if row["alone"][0].as_py() else levels)
            proofs, steps = block_proofs(all_levels, fanout)
            above, turns = row["proof"][0].as_py(), row["steps"][0].as_py()
            whole = [pa.array([row[c][0].as_py()] * n, pa.string()) for c in ("grp", "subroot", "root")]
            own = [nodes.field(c) for c in NODE]
            ends = [pa.array([p + above for p in proofs], pa.binary()), pa.array([s + turns for s in steps], pa.binary())]
            yield pa.RecordBatch.from_arrays([whole[0], *own, *whole[1:], *ends], names=["grp", *NODE, "subroot", "root", "proof", "steps"])

    return run


def _block_verdicts(fanout: int, levels: int, with_proof: bool):
    """Leaves of blocks with the digest of their proof and the root that the leaf shown leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, nodes in _blocks_in(batches):
            n, known = len(nodes), {}
            leaves = _matrix(nodes.field("node"))
            all_levels = block_levels(leaves, fanout, None if row["alone"][0].as_py() else levels)
            proofs, steps = block_proofs(all_levels, fanout)
            above, turns = row["proof"][0].as_py(), row["steps"][0].as_py()
            reached = [r.tobytes() for r in fold_block(all_levels, fanout, _matrix(nodes.field("shown")))]
            for r in set(reached):
                known[r] = fold(r, above, turns).decode()
            proofs = [p + above for p in proofs]
            columns = [nodes.field("id"), nodes.field("node"), pa.array([row["subroot"][0].as_py()] * n, pa.string()), pa.array([row["root"][0].as_py()] * n, pa.string())]
            columns += [_texts(digests(proofs)), pa.array([known[r] for r in reached], pa.string())]
            names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            if with_proof:
                columns += [pa.array(proofs, pa.binary()), pa.array([s + turns for s in steps], pa.binary())]
                names += ["proof", "steps"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _grown(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over ``nodes`` (grp, nodes in all, and NODE), and the root of each group: (grp, node)."""
    wide, tiers, tops = fanout**levels, [], None
    while True:
        keyed = nodes.select("grp", F.expr(f"rank div {wide}").alias("block"), (F.col("nodes") <= wide).alias("alone"), "nodes", F.struct(*NODE).alias("member"))
        tiers.append(materialize(keyed.groupBy("grp", "block", "alone", "nodes").agg(F.sort_array(F.collect_list("member")).alias("members")), "blocks"))
        found = tiers[-1].select("grp", "block", "alone", "nodes", "members").mapInArrow(_block_roots(fanout, levels), "grp string, block long, alone boolean, nodes long, node string")
        found = materialize(found, "block-roots")
        done = found.where("alone").select("grp", "node")
        tops = done if tops is None else tops.unionByName(done)
        nodes = found.where("not alone").select("grp", F.expr(f"(nodes + {wide - 1}) div {wide}").alias("nodes"), F.col("block").alias("rank"), "node", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("shown"))
        if nodes.isEmpty():
            return tiers, tops


def _descended(tiers: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The lowest tier's blocks with the path of each block's root; ``tops``: (grp, subroot, root, proof, steps) of the groups."""
    ends = tops.withColumn("block", F.lit(0).cast("long")).withColumn("alone", F.lit(True))
    above = None
    for tier in reversed(tiers):
        paths = ends if above is None else ends.unionByName(above)
        met = tier.join(paths, ["grp", "block", "alone"])
        if tier is not tiers[0]:
            above = met.mapInArrow(_block_paths(fanout, levels), PATH).select("grp", F.col("rank").alias("block"), F.lit(False).alias("alone"), "subroot", "root", "proof", "steps")
    return met


def merkle_manifest(leaves: DataFrame, fanout: int = 3, levels: int = 7, with_proof: bool = False, rows: int | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of every leaf; ``with_proof`` adds proof and steps, as ``fold`` takes them.

    ``leaves``: (grp string, not null, id long, leaf, shown), the last the leaf that is verified against the proof.  Leaves
    of a group stand by id and leaf, groups by grp.  A block has at most ``fanout ** levels`` nodes, so the default 2,187.
    """
    leaves = materialize(leaves.select("grp", "id", F.col("leaf").alias("node"), "shown"), "leaves")
    parts = parts_for(leaves.count() if rows is None else rows)
    ranked = range_rank(leaves, "grp", ["id", "node"], parts).withColumnRenamed("members", "nodes").withColumn("name", F.lit(None).cast("string"))
    tiers, subroots = _grown(ranked, fanout, levels)
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("shown"))
    groups, roots = _grown(range_rank(named, "grp", ["name"], parts).withColumnRenamed("members", "nodes"), fanout, levels)
    empty = F.lit(b"").cast("binary")
    start = roots.select("grp", F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), empty.alias("proof"), empty.alias("steps"))
    paths = _descended(groups, start, fanout, levels).mapInArrow(_block_paths(fanout, levels), PATH)
    tops = paths.select(F.col("name").alias("grp"), F.col("node").alias("subroot"), "root", "proof", "steps")
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof binary, steps binary" * with_proof
    return _descended(tiers, tops, fanout, levels).mapInArrow(_block_verdicts(fanout, levels, with_proof), schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents``, and those shown: without line feeds in the text where crc32(doc_id) is even."""
    fields = lambda text: [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text]
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), leaf_of(fields(F.translate("text", "\n", ""))))
    leaf = leaf_of(fields(F.col("text")))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("id"),
        leaf.alias("leaf"),
        F.coalesce(tampered, leaf).alias("shown"),
    )


def document_manifest(docs: DataFrame, fanout: int = 3, levels: int = 7, with_proof: bool = False) -> DataFrame:
    """The manifest of ``documents`` by source: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = merkle_manifest(document_leaves(docs), fanout, levels, with_proof)
    rest = ["proof", "steps"] if with_proof else []
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *rest)
