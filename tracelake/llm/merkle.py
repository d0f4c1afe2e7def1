"""Merkle manifest of a dataset: a tree over the rows of each language, and one over the languages.

Leaves of a language ascend by doc_id; aligned blocks of BLOCK leaves are reduced each in one step, as a contiguous matrix
of 64-byte hex digests that is reshaped by the fanout and hashed row by row, level after level; the blocks' roots are
leaves of the next round, until each language has one root. On the way back every block gets the path from its root to the
dataset's root, and a leaf's siblings follow from its index: its run at level k starts at index // fanout**k rounded down
to a multiple of the fanout. A proof holds a run's other members, level by level, left to right.

A block is a power of the fanout, so blocks meet whole runs; the last block of a language that has several goes through
as many levels as the others, its last run shorter, even of one node. Positions come from a range partitioning, so that a
language with a third of all rows is dealt over many tasks. Neither the driver nor a task sees more than a block.

Defined results: null fields count as `-` and are unlike empty ones; a null doc_id comes first; rows that repeat a doc_id
are in order of their leaves, and equal rows are leaves each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import cut, ranked, table

FANOUT = 2
#: Leaves of a block at most; a block has the largest power of the fanout below it.
BLOCK = 1024
#: Bytes of a digest as hex text.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def depth_of(fanout: int) -> int:
    """Levels of a whole block."""
    return max(1, int(np.log(BLOCK) / np.log(fanout) + 1e-9))


def matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, HEX)


def _hashed(rows: np.ndarray) -> list[bytes]:
    """The digest of each row of a contiguous matrix."""
    data, wide = memoryview(np.ascontiguousarray(rows)).cast("B") if rows.size else memoryview(b""), rows.shape[1]
    return [digest(data[i * wide : (i + 1) * wide]) for i in range(rows.shape[0])]


def levels(leaves: np.ndarray, fanout: int, depth: int | None) -> list[np.ndarray]:
    """The matrices of a block, leaves first: so many levels above them, or as many as leave one node."""
    out = [leaves]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        below = out[-1]
        whole = len(below) // fanout
        above = _hashed(below[: whole * fanout].reshape(whole, fanout * HEX))
        if len(below) % fanout:
            above.append(digest(below[whole * fanout :].tobytes()))
        out.append(matrix(b"".join(above)))
    return out


def sibling_paths(block: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each leaf of a block its path: for each level the place in its run, the number of others, and their digests."""
    out = []
    for leaf in range(len(block[0])):
        path, node = [], leaf
        for nodes in block[:-1]:
            place, start = node % fanout, node - node % fanout
            run = nodes[start : start + fanout]
            path += [bytes((place, len(run) - 1)), run[:place].tobytes(), run[place + 1 :].tobytes()]
            node //= fanout
        out.append(b"".join(path))
    return out


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(place in the run, digests of the others) of each level of a path."""
    at = 0
    while at < len(path):
        place, others = path[at], path[at + 1] * HEX
        yield place, path[at + 2 : at + 2 + others]
        at += 2 + others


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path give."""
    for place, others in steps(path):
        node = digest(others[: place * HEX] + node + others[place * HEX :])
    return node


def block_proofs(block: list[np.ndarray], leaves: np.ndarray, fanout: int, path: bytes) -> tuple[list[bytes], list[bytes]]:
    """(digest of the siblings, root recomputed from `leaves`) of each leaf of a block whose root has the path given.

    All leaves go up together: level by level a matrix of their runs, with the node at its own place.
    """
    n = len(leaves)
    index, now = np.arange(n), leaves
    proofs: list[list[bytes]] = [[] for _ in range(n)]
    for nodes in block[:-1]:
        place = index % fanout
        runs = (index - place)[:, None] + np.arange(fanout)
        there = runs < len(nodes)
        wide = nodes[np.minimum(runs, len(nodes) - 1)]
        others = there.copy()
        others[np.arange(n), place] = False
        for i, (row, keep) in enumerate(zip(wide, others, strict=True)):
            proofs[i].append(row[keep].tobytes())
        wide[np.arange(n), place] = now
        now = matrix(b"".join(digest(row[keep].tobytes()) for row, keep in zip(wide, there, strict=True)))
        index = index // fanout
    above = b"".join(others for _, others in steps(path))
    known: dict[bytes, bytes] = {}
    roots = []
    for row in now:
        node = row.tobytes()
        if node not in known:
            known[node] = folded(node, path)
        roots.append(known[node])
    return [digest(b"".join(p) + above) for p in proofs], roots


def field(col: str | Column) -> Column:
    """A field of a leaf: `-` if it is null, else its bytes in UTF-8, a colon and its value."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[str | Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (g, rank, total, digest) as blocks (g, block, total, members, nodes, root): total counts the group's blocks,
    members the nodes of one, whose digests stand in a row."""
    depth = depth_of(fanout)
    size = fanout**depth
    kind = nodes.schema["g"].dataType.simpleString()

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        digests = "".join(part.column("digest").to_pylist()).encode()
        total, first = part.column("total")[0].as_py(), part.column("rank")[0].as_py()
        root = levels(matrix(digests), fanout, depth if total > size else None)[-1].tobytes()
        row = [part.column("g").slice(0, 1).combine_chunks(), pa.array([first // size]), pa.array([-(-total // size)]), pa.array([part.num_rows]), pa.array([digests]), pa.array([root.decode()])]
        return pa.Table.from_arrays(row, ["g", "block", "total", "members", "nodes", "root"])

    return nodes.withColumn("block", F.floor(F.col("rank") / size).cast("long")).groupBy("g", "block").applyInArrow(pack, f"g {kind}, block long, total long, members long, nodes binary, root string")


def grown(blocks: DataFrame, fanout: int) -> DataFrame:
    """(g, block, path, root) of each block of each group: its path to the group's root, and that root."""
    rounds = [blocks]
    while (rounds[-1].agg(F.max("total").alias("n")).first()["n"] or 0) > 1:
        rounds.append(cut(_blocks(rounds[-1].select("g", F.col("block").alias("rank"), "total", F.col("root").alias("digest")), fanout)))
    paths = rounds[-1].select("g", "block", F.lit(b"").alias("path"), "root")
    depth = depth_of(fanout)
    kind = blocks.schema["g"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, members, several, digests, path = (batch.column(k)[i].as_py() for k in (1, 2, 3, 4, 5))
                own = levels(matrix(digests), fanout, depth if several else None)
                made = [p + path for p in sibling_paths(own, fanout)]
                same = lambda k: pa.concat_arrays([batch.column(k).slice(i, 1)] * members)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(0), pa.array(range(block * fanout**depth, block * fanout**depth + members), pa.int64()), pa.array(made, pa.binary()), same(6)], ["g", "block", "path", "root"])

    for above in reversed(rounds[1:]):
        met = _met(above.drop("root"), paths).select("g", "block", "members", (F.col("total") > 1).alias("several"), "nodes", "path", "root")
        paths = met.mapInArrow(spread, f"g {kind}, block long, path binary, root string")
    return paths


def _met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """blocks with the path and root of each."""
    paths = paths.withColumnsRenamed({"g": "__g", "block": "__b"})
    return blocks.join(paths, blocks["g"].eqNullSafe(paths["__g"]) & (blocks["block"] == paths["__b"])).drop("__g", "__b")


def _unfolded(blocks: DataFrame, columns: list[str], kinds: str, make: Callable[[dict], list]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(make({c: batch.column(c)[i].as_py() for c in batch.schema.names}), columns)

    return blocks.mapInArrow(run, kinds)


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of rows (g, id, leaf, presented): `leaf` goes into the tree of
    its group g, whose root is `subroot`; the groups in order (null first) make the tree of `root`. `folded_root` is
    recomputed from `presented`, if it isn't null, else from the leaf, with the siblings of the tree."""
    depth = depth_of(fanout)
    size = fanout**depth
    kind = rows.schema["g"].dataType.simpleString()

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        digests = "".join(part.column("leaf").to_pylist()).encode()
        total, first = part.column("total")[0].as_py(), part.column("rank")[0].as_py()
        root = levels(matrix(digests), fanout, depth if total > size else None)[-1].tobytes().decode()
        values = [[first // size], [-(-total // size)], [part.num_rows], [digests], [root], [part.column("id").to_pylist()], [part.column("presented").to_pylist()]]
        made = [part.column("g").slice(0, 1).combine_chunks(), *(pa.array(v, t) for v, t in zip(values, types, strict=True))]
        return pa.Table.from_arrays(made, ["g", "block", "total", "members", "nodes", "root", "ids", "presented"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    placed = ranked(rows.select("g", F.col("id").cast("long").alias("id"), "leaf", "presented"), "g", ["id", "leaf"]).withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    blocks = cut(placed.groupBy("g", "block").applyInArrow(pack, f"g {kind}, block long, total long, members long, nodes binary, root string, ids array<long>, presented array<string>"))
    paths = cut(grown(blocks.select("g", "block", "total", "members", "nodes", "root"), fanout))

    subroots = paths.where("block = 0").select(F.lit(0).alias("g"), F.col("g").alias("key"), F.col("root").alias("digest"))
    tops = cut(ranked(subroots, "g", ["key"]))
    whole = cut(_blocks(tops.select("g", "rank", "total", "digest"), fanout))

    def each_path(row: dict) -> list:
        own = levels(matrix(row["nodes"]), fanout, depth if row["total"] > 1 else None)
        ranks = pa.array(range(row["block"] * size, row["block"] * size + row["members"]), pa.int64())
        return [ranks, pa.array([p + row["path"] for p in sibling_paths(own, fanout)], pa.binary()), pa.array([row["root"]] * row["members"])]

    above = _unfolded(_met(whole.drop("root"), grown(whole, fanout)), ["rank", "above", "top"], "rank long, above binary, top string", each_path)
    above = tops.join(above, "rank").select(F.col("key").alias("__key"), "above", "top")
    found = _met(blocks.drop("root"), paths)
    found = found.join(above, found["g"].eqNullSafe(above["__key"])).drop("g", "__key")

    def each_leaf(row: dict) -> list:
        leaves = matrix(row["nodes"])
        own = levels(leaves, fanout, depth if row["total"] > 1 else None)
        shown = leaves.copy()
        for i, given in enumerate(row["presented"]):
            if given is not None:
                shown[i] = np.frombuffer(given.encode(), np.uint8)
        proofs, roots = block_proofs(own, shown, fanout, row["path"] + row["above"])
        n = len(leaves)
        return [pa.array(row["ids"], pa.int64()), pa.array([x.tobytes().decode() for x in leaves]), pa.array([row["root"]] * n), pa.array([row["top"]] * n), pa.array([p.decode() for p in proofs]), pa.array([r.decode() for r in roots])]

    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return _unfolded(found, names, ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in names), each_leaf)


def tampered(doc_id: str = "doc_id") -> Column:
    """Rows of which the query presents another n_chars: those whose id's crc32 is divisible by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bent = leaf([(F.col("n_chars") + 1) if f == "n_chars" else f for f in FIELDS])
    rows = docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), leaf(list(FIELDS)).alias("leaf"), F.when(tampered(), bent).alias("presented"))
    return manifest(rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
