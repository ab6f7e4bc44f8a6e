"""Near-duplicate documents by a chosen-path similarity join.

Documents with equal shingle sets form one class. TREES independent trees branch
the classes by minwise tokens: in each tree a class goes down one path, its next
step being the minwise value at the coordinate chosen for that tree and level. Two
sets of Jaccard similarity J share a step with probability J, and unrelated ones
hardly ever, so most nodes are small after the first level.

* In a large node, the members are paired with the one most like the others: of each
  coordinate the value that most members have is counted, and the member with most of
  these leads. Large groups of copies are found by this with as many pairs as members.
* Nodes whose members are all linked by then need no more.
* Small nodes are compared exhaustively, between different components; a set of members
  that several trees bring together is compared once. So are nodes of
  any size with few members outside their main component: in parts of bounded size,
  each with all of those few. Sketches tell which members may be linked at all; their
  full sets are compared in one task, which returns no more links than members.
* The others branch on. They are never gathered in a task.
* A pair at the threshold shares a path of LEVELS steps with probability 0.75 ** LEVELS
  only, so no node goes deeper: what is still large at the last level is compared
  exhaustively too, in parts of two tiles each.

Links are confirmed on the full sets, made anew from the texts. A pair at the threshold
is missed by all trees with probability (1 - 0.75 ** LEVELS) ** TREES, which is 5e-5, however
large its nodes are, and its sketch fails with about 1e-5.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.llm.components import components
from effectspark.llm.shingles import Shingler, linked
from effectspark.llm.tables import partitions, row_key
from effectspark.sources.store import Stored, Workspace

PERCENT = 75
TREES = 12
LEVELS = 2  # of each tree
COORDINATES = 128
# Sketch coordinates that must agree: 4 standard deviations below the 96 expected at similarity 0.75.
AGREE = 76
SMALL = 2048  # members of a part that is compared exhaustively in one task
MODES = 16  # coordinates by which the leader of a large node is found
BITS_HELD = 1 << 29  # bits of the incidence matrix of a comparison; beyond, sets are compared two by two
_BLOCK = 2048  # shingles times coordinates worked on at once, in units of coordinates

# Least values are small; this spreads them before a byte is taken.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 63, TREES + COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, TREES + COORDINATES, dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), _BLOCK):
        part = shingles[start : start + _BLOCK]
        for k in range(0, len(_FACTORS), 20):
            values = part[None, :] * _FACTORS[k : k + 20, None] + _OFFSETS[k : k + 20, None]
            np.minimum(least[k : k + 20], values.min(1), out=least[k : k + 20])
    return least


def near_duplicates(docs: DataFrame, ws: Workspace, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, kept), a row per input row; ``key`` is its :func:`row_key`.

    Documents are linked if 100 * intersection >= percent * union of their shingle
    sets; ``component_id`` is the least doc_id reachable by links. A text without
    words, or NULL, has no shingles and is linked with nothing. A NULL doc_id comes
    after all others and is never a component's id unless all its members have none.
    Rows that repeat a doc_id and text are one document. Other columns are ignored.
    """
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    rows = ws.save(_summaries(keyed), "shingle-sets").df
    classes = ws.save(
        rows.filter("n_shingles > 0").groupBy("class").agg(
            F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
            F.first("paths").alias("paths"),
        ),
        "classes",
    ).df
    roots = _link(keyed, classes, ws, percent)

    members = rows.join(roots, F.col("class") == F.col("node"), "left").select(
        "key", "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("root", "class")).otherwise(F.unhex("key")).alias("component"),
    )
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "component").select(
        "key", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _summaries(keyed: DataFrame) -> DataFrame:
    """Per row the size and digest of its set, its sketch, and its first step in each tree."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sizes, classes, sketches, paths = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingler.hashes(text)
                least = minwise(found)
                sizes.append(len(found))
                classes.append(_digest(found))
                sketches.append(((least[TREES:] * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes())
                paths.append(least[:TREES].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(classes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                ["key", "doc_id", "n_shingles", "class", "sketch", "paths"],
            )

    return keyed.mapInArrow(
        task, f"key string, doc_id {kind}, n_shingles bigint, class binary, sketch binary, paths array<bigint>"
    )


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _link(keyed: DataFrame, classes: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked to another."""
    nothing = classes.select(F.col("class").alias("node"), F.col("class").alias("root")).filter("false")
    paths = ws.save(
        classes.select(F.col("class").alias("node"), F.posexplode("paths").alias("tree", "step")).select(
            "tree", F.xxhash64("tree", "step").alias("path"), "node"
        ),
        "paths",
    ).df
    first = ws.save(_inner_nodes(paths), "nodes").df
    texts = _class_texts(keyed, classes, first, ws)
    links, inner = _Links(nothing), first
    try:
        for level in range(1, LEVELS + 1):
            star = _star(inner.filter(F.col("members") > SMALL), classes, ws)
            if star is not None:
                links.confirm(_by_sketch(links.apart(star), classes, percent), texts, ws, percent)
            mixed = _mixed_nodes(inner, links.roots, ws, level)
            parts = _parts(mixed.df)
            if level == LEVELS:
                parts = parts.unionByName(_tiles(mixed.df))
            links.add(ws.save(_exhaustive(parts, classes, texts, percent), "links"), ws)
            inner = _branch(mixed.df.filter(~_comparable()), classes, ws, level) if level < LEVELS else None
            if inner is None:
                break
    finally:
        texts.drop()
    return links.roots


def _star(large: DataFrame, classes: DataFrame, ws: Workspace) -> DataFrame | None:
    """Pairs (a, b) of each large node's leader and its other members; None without a large node."""
    sketched = ws.save(
        large.join(classes.select(F.col("class").alias("node"), "sketch"), "node").select("path", "node", "sketch"), "large"
    )
    if not sketched.rows:
        return None
    rows = sketched.df
    step = COORDINATES // MODES
    value = lambda k: F.substring("sketch", k * step + 1, 1)
    # at most 256 values each, whatever the size of the node
    modes = rows.groupBy("path").agg(*[F.mode(value(k), True).alias(f"mode_{k}") for k in range(MODES)])
    alike = sum(
        (F.when(F.col(f"mode_{k}") == value(k), 1).otherwise(0) for k in range(1, MODES)),
        F.when(F.col("mode_0") == value(0), 1).otherwise(0),
    )
    leaders = rows.join(modes, "path").groupBy("path").agg(F.max_by("node", F.struct(alike, "node")).alias("leader"))
    led = rows.select("path", "node").join(leaders, "path").filter("node <> leader")
    return led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def _inner_nodes(branches: DataFrame) -> DataFrame:
    """The members of nodes that hold more than one class, with the node's size.

    Of small nodes with the same members, in different trees, one is kept: it is compared
    as a whole.
    """
    own = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("own")
    nodes = branches.groupBy("path").agg(F.count(F.lit(1)).alias("members"), own).filter("members > 1")
    once = F.when(F.col("members") > SMALL, F.col("path")).otherwise(F.lit(0))
    kept = nodes.groupBy("members", "own", once.alias("apart")).agg(F.min("path").alias("path")).select("path", "members")
    return branches.join(kept, "path")


def _mixed_nodes(inner: DataFrame, roots: DataFrame, ws: Workspace, level: int) -> Stored:
    """The members, with their component, of nodes whose members are not all linked yet.

    ``main`` is the node's largest component, ``outside`` the number of members beyond it.
    """
    placed = inner.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("path", "members", "root").agg(F.count(F.lit(1)).alias("n"))
    nodes = (
        sizes.groupBy("path")
        .agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.max("members") - F.max("n")).alias("outside"))
        .filter("outside > 0")
    )
    return ws.save(placed.join(nodes, "path"), f"mixed-{level}")


def _comparable() -> Column:
    return (F.col("members") <= SMALL) | (F.col("outside") <= SMALL)


def _parts(mixed: DataFrame) -> DataFrame:
    """Members of comparable nodes in parts of about SMALL; who is outside the main component is in every part."""
    parts = F.ceil(F.col("members") / SMALL).cast("int")
    one = F.when(F.col("root") == F.col("main"), F.array(F.pmod(F.xxhash64("node"), parts).cast("int")))
    each = F.when(F.col("members") <= SMALL, F.array(F.lit(0))).otherwise(
        F.coalesce(one, F.sequence(F.lit(0), parts - 1))
    )
    return mixed.filter(_comparable()).select("path", "node", "root", F.explode(each.cast("array<bigint>")).alias("part"))


def _tiles(mixed: DataFrame) -> DataFrame:
    """Members of the nodes that are not comparable, in parts of two tiles of SMALL / 2 members.

    Every two tiles meet, but for two of the main component: all pairs are compared of
    which one is outside it.
    """
    half = SMALL // 2
    outer = F.ceil(F.col("outside") / half).cast("bigint")
    inner = F.ceil((F.col("members") - F.col("outside")) / half).cast("bigint")
    hashed, is_main = F.xxhash64("node"), F.col("root") == F.col("main")
    own = F.when(is_main, outer + F.pmod(hashed, inner)).otherwise(F.pmod(hashed, outer))
    placed = mixed.filter(~_comparable()).select("path", "node", "root", is_main.alias("is_main"), outer.alias("outer"), (outer + inner).alias("tiles"), own.alias("own"))
    part = "CASE WHEN is_main THEN transform(sequence(0L, outer - 1), x -> x * tiles + own) " \
           "ELSE transform(sequence(0L, tiles - 1), x -> least(x, own) * tiles + greatest(x, own)) END"
    # parts of comparable nodes count from 0, these from -1 downwards
    return placed.select("path", "node", "root", F.explode(F.expr(part)).alias("part")).withColumn("part", -F.col("part") - 1)


def _branch(large: DataFrame, classes: DataFrame, ws: Workspace, level: int) -> DataFrame | None:
    """The inner nodes one step down in each tree, by the sketch coordinate chosen for this tree and level."""
    joined = large.select("tree", "path", "node").join(classes.select(F.col("class").alias("node"), "sketch"), "node")
    coordinate = F.pmod(F.col("tree") * 11 + F.lit(level * 17), F.lit(COORDINATES)) + 1
    step = F.substring(F.col("sketch"), coordinate, F.lit(1))
    paths = ws.save(joined.select("tree", F.xxhash64("path", step).alias("path"), "node"), "paths")
    found = ws.save(_inner_nodes(paths.df), "nodes") if paths.rows else paths
    return found.df if found.rows else None


def _by_sketch(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link and whose sketches agree enough."""
    left, right = (
        classes.select(F.col("class").alias(c), F.col("key").alias(f"k{c}"), F.col("n").alias(f"n{c}"),
                       F.col("sketch").alias(f"s{c}"))
        for c in ("a", "b")
    )
    joined = pairs.join(right, "b").join(left, "a").filter(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c)) for c in ("sa", "sb"))
            keep = pa.array((a == b).sum(1) >= AGREE)
            yield batch.select(["a", "b", "ka", "kb"]).filter(keep)

    return joined.select("a", "b", "ka", "kb", "sa", "sb").mapInArrow(task, _PAIR)


_PAIR = "a binary, b binary, ka string, kb string"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _exhaustive(parts: DataFrame, classes: DataFrame, texts: _class_texts, percent: int) -> DataFrame:
    """Links (a, b) that join the components which meet in a part.

    Members that may be linked to another component, by size and sketch, are gathered in
    clusters; a cluster that several trees find is compared once.
    """
    member = F.struct("node", "root", "key", "n", "sketch")
    joined = parts.join(classes.select(F.col("class").alias("node"), "key", "n", "sketch"), "node")
    # at most SMALL members, or SMALL and as many again that are outside the main component
    grouped = joined.groupBy("path", "part").agg(F.collect_list(member).alias("members")).select("members")
    rows = grouped.mapInArrow(_cluster(percent), "cluster binary, node binary, root binary, key string")
    members = texts.of(rows.dropDuplicates(["cluster", "node"]), "key", "text")
    return members.select("cluster", "node", "root", "text").groupBy("cluster").applyInArrow(_link_cluster(percent), _LINK)


_LINK = "a binary, b binary"


def _cluster(percent: int):
    """Members with a possible link to another component of their part, by connected cluster."""

    def clusters(members: list[dict]) -> Iterator[dict]:
        members.sort(key=lambda m: m["node"])
        sketches = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(-1, COORDINATES)
        sizes = np.array([m["n"] for m in members])
        _, root = np.unique(np.array([m["root"].hex() for m in members]), return_inverse=True)
        label, active = np.arange(len(members)), np.zeros(len(members), bool)
        for i in range(len(members) - 1):
            n = sizes[i + 1 :]
            near = (root[i + 1 :] != root[i]) & (np.minimum(n, sizes[i]) * 100 >= np.maximum(n, sizes[i]) * percent)
            at = np.flatnonzero(near) + i + 1
            at = at[(sketches[at] == sketches[i]).sum(1) >= AGREE] if len(at) else at
            if len(at):
                active[at] = active[i] = True
                met = np.unique(label[np.append(at, i)])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        for name in np.unique(label[active]):
            own = [members[k] for k in np.flatnonzero(active & (label == name))]
            # the components are part of the name: they decide which pairs are compared
            cluster = hashlib.blake2b(b"".join(m["node"] + m["root"] for m in own), digest_size=16).digest()
            for m in own:
                yield {"cluster": cluster, "node": m["node"], "root": m["root"], "key": m["key"]}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("cluster", pa.binary()), ("node", pa.binary()), ("root", pa.binary()), ("key", pa.string())])
        for batch in batches:
            for members in batch.column(0):
                rows = list(clusters(members.as_py()))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return task


def _link_cluster(percent: int):
    """Links on the full sets, one for each two components that they join."""

    def solve(table: pa.Table) -> pa.Table:
        shingler = Shingler()
        nodes = table.column("node").to_pylist()
        sets = [shingler.hashes(t) for t in table.column("text").to_pylist()]
        _, label = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)
        out = [(nodes[i], nodes[j]) for i, j in join_sets(sets, label, percent)]
        a, b = ([p[k] for p in out] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return solve


def join_sets(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of linked sets that join the labelled components, each pair once two that were apart.

    Sets most like the others come first, so that a component soon holds what belongs to
    it; only sets of different components are compared.
    """
    label = label.copy()
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-(np.bincount(owner, count[column], len(sets)) / np.maximum(sizes, 1)), kind="stable")
    shared = count > 1
    width = -(-int(shared.sum()) // 64)
    bits = None
    if len(sets) * width * 64 <= BITS_HELD:
        # which of the shingles that occur more than once each set has, as bits
        place = np.cumsum(shared) - 1
        held = shared[column]
        at, row = place[column[held]], owner[held]
        bits = np.zeros(len(sets) * max(width, 1), np.uint64)
        np.bitwise_or.at(bits, row * max(width, 1) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        bits = bits.reshape(len(sets), -1)
    done, pairs = np.zeros(len(sets), bool), []
    for i in order:
        others = np.flatnonzero((label != label[i]) & ~done)
        done[i] = True
        if not len(others):
            continue
        if bits is not None:
            common = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
            good = others[100 * common >= percent * (sizes[others] + sizes[i] - common)]
        else:
            good = np.array([j for j in others if linked(sets[i], sets[j], percent)], dtype=int)
        for j in good:
            if label[j] != label[i]:
                pairs.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return pairs


class _class_texts:
    """One text per class that shares a node, bucketed by its row's key: joins with it move only the pairs."""

    def __init__(self, keyed: DataFrame, classes: DataFrame, inner: DataFrame, ws: Workspace):
        self.ws, self.name = ws, f"class_texts_{uuid.uuid4().hex}"
        wanted = inner.select(F.col("node").alias("class")).distinct().join(classes.select("class", "key"), "class")
        # rows with one key are the same row over again
        rows = keyed.select("key", "text").join(wanted.select("key"), "key").dropDuplicates(["key"])
        (rows.write.option("path", ws.path("class-texts")).bucketBy(partitions(ws.spark), "key")
         .format("parquet").saveAsTable(self.name))
        self.df = ws.spark.table(self.name)

    def of(self, keys: DataFrame, key: str, text: str) -> DataFrame:
        return keys.join(self.df.select(F.col("key").alias(key), F.col("text").alias(text)), key)

    def drop(self) -> None:
        """The table's name; its files go with the workspace."""
        self.ws.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class _Links:
    """The components that the links found so far make: (node, root) of every class with a link."""

    def __init__(self, nothing: DataFrame):
        self.roots, self.known = nothing, False

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose ends are not yet in one component."""
        if not self.known:
            return pairs
        of_a, of_b = (
            self.roots.select(F.col("node").alias(c), F.col("root").alias(f"__r{c}")) for c in ("a", "b")
        )
        joined = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
        return joined.filter(F.coalesce("__ra", "a") != F.coalesce("__rb", "b")).select("a", "b")

    def confirm(self, pairs: DataFrame, texts: _class_texts, ws: Workspace, percent: int) -> None:
        """Add the pairs (a, b, ka, kb) that hold on the full sets, and update the components."""
        found = ws.save(pairs, "candidates")
        if not found.rows:
            return
        # few texts stand on the left, each in many pairs; popular ones are split by the skew join
        left = texts.of(found.df.select("ka").distinct(), "ka", "ta")
        both = texts.of(found.df, "kb", "tb").join(left, "ka").select("a", "b", "ta", "tb")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, name, own = Shingler(), None, None
            for batch in batches:
                keep = []
                for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb"))):
                    if a != name:
                        name, own = a, shingler.hashes(ta)
                    keep.append(linked(own, shingler.hashes(tb), percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        self.add(ws.save(both.mapInArrow(task, _LINK), "links"), ws)

    def add(self, links: Stored, ws: Workspace) -> None:
        """Take in links (a, b) and update the components: those that the links join become one."""
        if not links.rows:
            return
        if not self.known:
            self.roots, self.known = components(links.df, ws).df, True
            return
        of_a, of_b = (self.roots.select(F.col("node").alias(c), F.col("root").alias(f"__r{c}")) for c in ("a", "b"))
        met = links.df.join(of_a, "a", "left").join(of_b, "b", "left")
        joined = components(met.select(F.coalesce("__ra", "a").alias("a"), F.coalesce("__rb", "b").alias("b")), ws).df
        above = joined.select(F.col("node").alias("root"), F.col("root").alias("__top"))
        old = self.roots.join(above, "root", "left").select("node", F.coalesce("__top", "root").alias("root"))
        new = joined.join(self.roots.select("node"), "node", "left_anti")
        self.roots = ws.save(old.unionByName(new), "roots").df
