"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct runs of ``k`` words. Documents with equal sets form a class.
Of each class's set ``SKETCH`` minwise values are kept. In every tree a node chooses sketch
positions by a hash of its own path, one or two so that 1 / threshold are expected, and a
class goes to one child per chosen position, named by its value there. At a pair of that
similarity the expected number of shared children is 1 at every depth, while less similar
pairs die out. Nodes of at most ``LEAF`` classes are compared exhaustively: sketches leave
groups of possible partners, whose full sets are then compared. Larger nodes branch further;
those still large after ``GENERATIONS`` generations hold crowds of sets that are alike in every
value chosen, and ``crowds`` finds their links exactly. ``trees`` independent trees bring a
pair's chance to meet near 1. Links join into components.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, blank_words, gram_hashes, grouped, mix, prepare, side_by_side, sieved
from locuskit.llm.components import components
from locuskit.llm.crowds import crowd_links

SKETCH = 128
LEAF, LEAF_SHINGLES = 256, 1 << 21
GENERATIONS = 3
_RNG = np.random.default_rng(20240607)
_FACTORS = (_RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of all words if there are fewer."""
    words = blank_words(text)
    return np.unique(gram_hashes(words, min(k, len(words)))) if words else np.empty(0, np.uint64)


def class_key(values: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return (values.sum(dtype=np.uint64).tobytes() + mix(values ^ np.uint64(0x5851F42D4C957F2D))
            .sum(dtype=np.uint64).tobytes())


def sketch(values: np.ndarray) -> np.ndarray:
    """32 bits of the least of each multiplied hash."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(least, (_FACTORS[:, None] * values[None, at:at + 512]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def described(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, n_shingles, cls, sketch, crc); ``cls`` and ``sketch`` are null for an empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, cls, sk, crc = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, k)
                n.append(len(s))
                crc.append(zlib.crc32((t or "").encode()))
                cls.append(class_key(s) if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sk, pa.binary()),
                 pa.array(crc, pa.int64())], names=[key, "n_shingles", "cls", "sketch", "crc"])
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles bigint, cls binary, sketch binary, crc bigint")


def _marked(classes: DataFrame) -> DataFrame:
    """(cls, n_shingles, marks): the lowest byte of each sketch value.

    Enough to compare two sketches in a leaf, at a quarter of the size.
    """
    def run(batches):
        for batch in batches:
            marks = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())],
                                             names=["cls", "n_shingles", "marks"])
    return classes.select("cls", "n_shingles", "sketch").mapInArrow(run, "cls binary, n_shingles bigint, marks binary")


def _chosen(node: np.ndarray, rate: float) -> list[np.ndarray]:
    """Sketch positions chosen by each node: always one, sometimes a second one."""
    h = mix(node)
    first = (h % np.uint64(SKETCH)).astype(np.int64)
    second = ((first + 1 + ((h >> np.uint64(8)) % np.uint64(SKETCH - 1)).astype(np.int64)) % SKETCH)
    draw = (h >> np.uint64(32)).astype(np.float64) / float(1 << 32)
    return [first, np.where(draw < rate - 1, second, -1)]


def _children(node: np.ndarray, row: np.ndarray, sketches: np.ndarray, rate: float):
    """(child, row) of the next generation."""
    kids, rows = [], []
    for at in _chosen(node, rate):
        has = at >= 0
        value = sketches[row[has], at[has]].astype(np.uint64)
        kids.append(mix(mix(node[has] + np.uint64(0x632BE59BD9B4E019)) ^ (value << np.uint64(8) | at[has].astype(np.uint64))))
        rows.append(row[has])
    return np.concatenate(kids), np.concatenate(rows)


def _roots(trees: int) -> np.ndarray:
    return mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _grow(frontier: DataFrame, rate: float, trees: int | None, generations: int) -> DataFrame:
    """(parent, node, cls, n_shingles) for so many generations below each node.

    A path is a function of the node and the sketch alone, so a class finds its own way.
    With ``trees`` every class starts at all roots, each of which chooses one position.
    """
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            raw = batch.column(names.index("sketch"))
            sketches = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(n, SKETCH)
            if trees:
                row, node = np.repeat(np.arange(n), trees), np.tile(_roots(trees), n)
            else:
                row = np.arange(n)
                node = batch.column(names.index("node")).to_numpy().view(np.uint64)
            out = []
            for depth in range(1, generations + 1):
                kids, rows = _children(node, row, sketches, 1.0 if trees else rate)
                second = np.zeros(len(node), bool) if trees else _chosen(node, rate)[1] >= 0
                out.append((np.concatenate([node, node[second]]), kids, rows, np.full(len(kids), depth, np.int32)))
                node, row = kids, rows
            up, kids, rows, depth = (np.concatenate(x) for x in zip(*out))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(up.view(np.int64)), pa.array(kids.view(np.int64)), pa.array(depth),
                 batch.column(names.index("cls")).take(take), batch.column(names.index("n_shingles")).take(take)],
                names=["parent", "node", "depth", "cls", "n_shingles"])
    return frontier.mapInArrow(run, "parent bigint, node bigint, depth int, cls binary, n_shingles bigint")


def _batches(rows, names: list[str], size: int = 4096):
    """Record batches of binary columns from tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], names=names)


def _clusters(num: int, den: int, slack: float):
    """Groups of a leaf's classes that sketches and sizes allow to be linked."""
    least = (num / den - slack) * SKETCH

    def found(batches):
        for _, rows in grouped(batches, "node", "cls", "n_shingles", "marks"):
            held = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
            names, n = [r[1] for r in held], len(held)
            sketches = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(n, SKETCH)
            sizes, mark = np.array([r[2] for r in held]), np.arange(n)
            for i in range(n - 1):
                near = (sketches[i + 1:] == sketches[i]).sum(axis=1) >= least
                near &= den * np.minimum(sizes[i + 1:], sizes[i]) >= num * np.maximum(sizes[i + 1:], sizes[i])
                for j in np.flatnonzero(near) + i + 1:
                    if mark[i] != mark[j]:
                        mark[mark == mark[j]] = mark[i]
            for g in np.flatnonzero(np.bincount(mark, minlength=n) > 1):
                inside = [names[i] for i in np.flatnonzero(mark == g)]
                members = hashlib.blake2b(b"".join(inside), digest_size=16).digest()
                yield from ((members, c) for c in inside)

    return lambda batches: _batches(found(batches), ["members", "cls"])


def _links(num: int, den: int):
    """Links of a group, full sets compared; pairs that are joined already are skipped."""
    def found(batches):
        for _, rows in grouped(batches, "members", "cls", "values"):
            held = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
            n, mark = len(held), np.arange(len(held))
            sets = [np.frombuffer(r[2], np.uint64) for r in held]
            sizes = np.array([len(s) for s in sets])
            if n == 2:
                shared = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
            else:
                values, at = np.unique(np.concatenate(sets), return_inverse=True)
                owner = np.repeat(np.arange(n), sizes)
                order = np.argsort(at, kind="stable")
                at, owner, both = at[order], owner[order], np.zeros((n, n))
                for lo in range(0, len(values), 4096):  # incidence in blocks of shingles
                    a, b = np.searchsorted(at, [lo, lo + 4096])
                    block = np.zeros((n, 4096), np.float32)
                    block[owner[a:b], at[a:b] - lo] = 1
                    both += block @ block.T
                shared = np.rint(both).astype(np.int64)
            linked = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
            for i, j in zip(*np.nonzero(np.triu(linked, 1))):
                if mark[i] != mark[j]:
                    mark[mark == mark[j]] = mark[i]
                    yield held[i][1], held[j][1]

    return lambda batches: _batches(found(batches), ["a", "b"])


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(cls, values): the full set of each wanted class, from one of its texts."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "values"])
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.crc32(F.col(text).cast("binary")).alias("crc"))
    own = sieved(own, F.struct("k", "crc"), wanted, F.struct("pick.key", "pick.crc"))
    # merged at every size: the list of wanted classes grows with the input
    picked = wanted.alias("w").hint("merge").join(
        own.alias("d"), F.col("w.pick.key").eqNullSafe(F.col("d.k")) & (F.col("w.pick.crc") == F.col("d.crc")))
    one = picked.groupBy("w.cls").agg(F.any_value("d.t").alias("t"))
    return one.select("cls", "t").mapInArrow(run, "cls binary, values binary")


def _descend(classes: DataFrame, rate: float, trees: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(leaves (node, cls) to compare by sketches, crowds (crowd, cls) that stay large).

    The first pass makes one generation below the roots, the second ``GENERATIONS`` more below
    the nodes that are still large. What is large after those is alike in all of them: a crowd,
    named by its least class, so that the same crowd of several trees is one.
    """
    small = (F.col("n") <= 2) | ((F.col("n") <= LEAF) & (F.col("total") <= LEAF_SHINGLES))

    def grow(frontier: DataFrame, roots: int, generations: int):
        grown = scratch.store(_grow(frontier, rate, roots, generations), "nodes")
        sizes = grown.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
        sizes = scratch.store(sizes.filter("n > 1").select("node", small.alias("small")), "node-sizes")
        # merged at every size: the lists of nodes grow with the input
        return grown, grown.drop("n_shingles").join(sizes.hint("merge"), "node"), sizes

    grown, placed, sizes = grow(classes, trees, 1)
    first = scratch.store(placed.select("node", "cls", "small"), "placed")
    wide = first.filter("not small").select("node", "cls")
    frontier = scratch.store(wide.join(sieved(classes.select("cls", "n_shingles", "sketch"), F.col("cls"), wide, F.col("cls")), "cls"), "frontier")
    scratch.drop(grown, sizes)
    grown, placed, sizes = grow(frontier, 0, GENERATIONS)
    many = sizes.filter("not small").select(F.col("node").alias("parent")).hint("merge")
    placed = scratch.store(placed, "placed")
    leaf = placed.filter("small")  # below a node that is still large, else it is another leaf's affair
    leaf = leaf.filter("depth = 1").unionByName(leaf.filter("depth > 1").join(many, "parent", "left_semi").select(leaf.columns))
    leaves = scratch.store(first.filter("small").select("node", "cls").unionByName(leaf.select("node", "cls")), "leaves")
    last = placed.filter((F.col("depth") == GENERATIONS) & ~F.col("small")).select("node", "cls")
    names = last.groupBy("node").agg(F.xxhash64(F.min("cls")).alias("crowd"))
    crowds = scratch.store(last.join(names, "node").select("crowd", "cls").distinct(), "crowd-members")
    scratch.drop(first, grown, placed, sizes, frontier)
    return leaves, crowds


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (85, 100), k: int = 5, trees: int = 10,
                    slack: float = 0.14, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Rows are linked when ``den * intersection >= num * union`` with ``threshold`` (num, den);
    rows with equal sets always are. ``component_id`` is the least key reachable. Null and
    empty texts have an empty set and stay alone. Rows with equal keys stay apart; a null key
    never names a component with other keys, and where all are null it is null and the row
    counts as kept. Very long texts have all their runs in their set, an empty table gives an empty
    result, and other columns take no part, whatever their names. ``slack`` is how far (4.4 standard deviations) a sketch may fall below
    the threshold before full sets are no longer compared.
    """
    num, den = threshold
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.store(described(docs, key, text, k), "sketches")
    classes = scratch.store(rows.filter("cls is not null").groupBy("cls").agg(
        F.min(key).alias("least"), F.min(F.struct(F.col(key).alias("key"), "crc")).alias("pick"),
        F.min("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch")), "classes")
    named_rows = scratch.store(rows.select(key, "n_shingles", "cls"), "rows")
    scratch.drop(rows)
    leaves, crowds = _descend(classes, den / num, trees, scratch)
    groups = scratch.store(side_by_side(leaves.join(_marked(classes), "cls"), "node").mapInArrow(
        _clusters(num, den, slack), "members binary, cls binary").distinct(), "groups")
    wanted = scratch.store(groups.select("cls").unionByName(crowds.select("cls")).distinct().join(
        classes.select("cls", "pick"), "cls"), "wanted")
    sets = scratch.store(_full_sets(docs, wanted, key, text, k), "sets")
    links = scratch.store(side_by_side(groups.join(sets, "cls"), "members").mapInArrow(
        _links(num, den), "a binary, b binary"), "links")
    more = crowd_links(crowds, sets, num, den, scratch)
    scratch.drop(leaves, groups, wanted, crowds, sets)
    named = scratch.store(components(links.unionByName(more)).join(
        classes.select(F.col("cls").alias("node"), "least"), "node"), "components")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    several = named.join(roots, "root").select(F.col("node").alias("cls"), "component_id")
    of_class = scratch.store(classes.select("cls", "least").join(several, "cls", "left").select(
        "cls", F.coalesce("component_id", "least").alias("component_id")), "class-components")
    scratch.drop(links, named, classes)
    out = named_rows.join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))
