"""Near-duplicate documents: MinHash bands for candidates, odd sketches to check them, full sets to confirm them.

Documents with one set of shingles are one class, and only classes are compared. A class's MinHash samples are cut into
bands; classes that agree on a band meet in a bucket. The samples are also folded into an odd sketch: a bitmap in which
each sample flips a bit, so the XOR of two sketches holds the parity of just the samples they do not share. Its bits tell
a high similarity very precisely, and candidates far below the threshold go no further.

Classes of a bucket are compared by sketch with its smallest one, and where that leaves several families, with a few more
drawn from the bucket, and what then is outside the largest with all. A family (what such candidates connect) is then confirmed on full sets, in cells of bounded size: first every group of
its classes by itself and with the first group, then those still outside the largest component with all others. A cell
puts out no pairs, only what connects its classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.llm.components import components
from railbird.llm.text import SPACED, U, annotate, mixed, numbers, runs_of, texts, word_hashes
from railbird.operators.groups import durable

BITS = 512  # of an odd sketch
MISS = 1e-8  # the chance that two classes just at the threshold share no band
PIVOTS = 4  # classes drawn from a bucket in a round
ROUNDS = 2
SMALL = 16  # classes of a bucket that are paired at once
CELL = 256  # classes of a group with their sets; a cell holds two groups
SKETCH_CELL = 1024  # classes of a group with their sketches
BLOCK = 1 << 15  # shingles that a cell compares at a time
FILTER_BITS = 26
SIGMAS = 5.0


@dataclass(frozen=True)
class Near:
    """Shingles of ``width`` words; sets are linked if ``percent`` of their union is common to both."""

    width: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5

    @cached_property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def samples(self) -> int:
        return self.rows * self.bands

    @property
    def far(self) -> int:
        """Bits in which the sketches of two linked sets differ at most, up to ``SIGMAS`` standard deviations twice over."""
        t, k = self.percent / 100, self.samples
        apart = 2 * (k * (1 - t) + SIGMAS * math.sqrt(k * t * (1 - t)))
        odd = (1 - (1 - 2 / BITS) ** apart) / 2
        return math.ceil(BITS * odd + SIGMAS * math.sqrt(BITS * odd * (1 - odd)) / 2)

    def shingles(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingles, as hashes."""
        return np.unique(runs_of(word_hashes(text, SPACED), self.width))

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        factors, shifts = ((numbers(seed, self.samples) >> U(32)).astype(np.uint32) for seed in (21, 22))
        factors |= np.uint32(1)
        best = np.full(self.samples, 0xFFFFFFFF, dtype=np.uint32)
        values = (shingles >> U(32)).astype(np.uint32)
        for start in range(0, len(values), 4096):
            part = values[None, start : start + 4096] * factors[:, None]
            part += shifts[:, None]
            np.minimum(best, part.min(axis=1), out=best)
        return best

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        order = np.arange(self.samples, dtype=U) << U(32)
        places = (mixed(samples.astype(U) | order) % U(BITS)).astype(np.int64)
        return np.packbits(np.bincount(places, minlength=BITS) & 1).view(np.int64)

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        table = samples.astype(U).reshape(self.bands, self.rows)
        factors = numbers(23, self.rows) | U(1)
        return mixed((table * factors).sum(axis=1, dtype=U) + numbers(24, self.bands)).view(np.int64)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for a set: two sets share them by a chance of 2**-64."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


SIGNED = "n_shingles long, node long, odd array<long>, bands array<long>"


def signatures(docs: DataFrame, text: str, near: Near) -> DataFrame:
    """Add to each document the size of its set, the key of the set, its odd sketch and its band keys (null if empty)."""

    def work(batch: pa.RecordBatch) -> list:
        sizes, keys, odd, bands = [], [], [], []
        for data in texts(batch.column(text)):
            found = near.shingles(data)
            sizes.append(len(found))
            samples = near.minhash(found) if len(found) else None
            keys.append(set_key(found) if len(found) else None)
            odd.append(None if samples is None else near.odd_sketch(samples))
            bands.append(None if samples is None else near.band_keys(samples))
        longs = pa.list_(pa.int64())
        return [pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(odd, longs), pa.array(bands, longs)]

    return annotate(docs, SIGNED, work)


def _positions(nodes: np.ndarray) -> np.ndarray:
    return (mixed(nodes.view(U)) >> U(64 - FILTER_BITS)).astype(np.int64)


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds all ``nodes`` and few others."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(batch.column("node").to_numpy())
            yield pa.RecordBatch.from_pydict({"word": at >> 6, "bit": (U(1) << (at & 63).astype(U)).view(np.int64)})

    words = nodes.select("node").mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most 2**(FILTER_BITS - 6) rows, whatever the input
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(U)


def full_sets(docs: DataFrame, text: str, near: Near, nodes: DataFrame) -> DataFrame:
    """``node`` and ``shingles`` (the full set) for at least the given nodes, once each."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(nodes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, done = sent.value, set()
        for batch in batches:
            keys, sets = [], []
            for data in texts(batch.column(text)):
                found = near.shingles(data)
                if not len(found):
                    continue
                key = set_key(found)
                at = int(_positions(np.array([key], dtype=np.int64))[0])
                if key not in done and int(wanted[at >> 6]) >> (at & 63) & 1:
                    done.add(key)
                    keys.append(key)
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return docs.select(text).mapInArrow(work, "node long, shingles array<long>").dropDuplicates(["node"])


def _apart(a: str, b: str) -> Column:
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def _possible(near: Near, a: str = "a", b: str = "b") -> Column:
    """Whether the sizes and the odd sketches of two classes allow a link."""
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (small * 100 >= large * near.percent) & (_apart(f"{a}_odd", f"{b}_odd") <= near.far)


def _side(table: DataFrame, side: str, *columns: str) -> DataFrame:
    short = {"node": side, "n_shingles": f"{side}_n"}
    return table.select(*[F.col(c).alias(short.get(c, f"{side}_{c}")) for c in columns])


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and sketches allow a link."""
    columns = ("node", "n_shingles", "odd")
    sides = pairs.join(_side(classes, "a", *columns), "a").join(_side(classes, "b", *columns), "b")
    return sides.select("a", "b", "a_n", "b_n", "a_odd", "b_odd")


def families(classes: DataFrame, near: Near) -> DataFrame | None:
    """``node`` and ``component``: classes that share a band and may be linked, directly or by others. None if there are none.

    ``classes`` has ``node, n_shingles, odd, bands``, each class once.
    """
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    members = durable(rows.join(shared, "bucket"))
    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    met = durable(sketched(stars, classes).where(_possible(near)).select("a", "b"))
    # with two classes, all are compared by now
    left = members.where("size > 2").select("bucket", "node")
    for number in range(ROUNDS + 1):
        if left.isEmpty():
            break
        apart = durable(_still_apart(left, met))
        if apart.isEmpty():
            break
        if number == ROUNDS:
            met = durable(met.union(_across(apart, classes, near)))
            break
        draw = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(1 << 30)) * F.col("size") < PIVOTS * (1 << 30)
        drawn = apart.where(draw).select("bucket", F.col("node").alias("pivot"), F.col("component").alias("_component"))
        pairs = apart.join(drawn, "bucket").where("component != _component")
        pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        met = durable(met.union(sketched(pairs, classes).where(_possible(near)).select("a", "b")))
        # buckets of which every class was drawn are done
        left = apart.where(F.col("size") > PIVOTS).select("bucket", "node")
    return None if met.isEmpty() else components(met)


def _still_apart(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``bucket, node, component, size`` of the buckets whose classes lie in several components of ``edges``."""
    placed = members.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("bucket").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("size")
    )
    return placed.join(several.where("_low < _high").select("bucket", "size"), "bucket")


def _across(apart: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """Pairs of classes of one bucket and different components whose sketches allow a link.

    A large bucket's classes outside its largest component are compared with all of it, in cells of two groups of about
    ``SKETCH_CELL`` classes. A cell puts out what connects its components and no more.
    """
    kept = ("node", "n_shingles", "odd", "component")
    told = apart.join(classes.select("node", "n_shingles", "odd"), "node")
    few = told.where(F.col("size") <= SMALL)
    a, b = (few.select("bucket", *[F.col(c).alias({"node": s, "n_shingles": f"{s}_n"}.get(c, f"{s}_{c}")) for c in kept]) for s in "ab")
    met = a.join(b, "bucket").where((F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")) & _possible(near))

    def meet(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        sizes, component = (table.column(c).to_numpy()[first] for c in ("n_shingles", "component"))
        bits = np.array(table.column("odd").to_pylist(), dtype=np.int64).view(U)[first]
        linked = component[:, None] == component[None, :]
        for i in range(len(nodes)):
            far = np.bitwise_count(bits ^ bits[i]).sum(axis=1)
            low, high = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
            linked[i] |= (far <= near.far) & (low * 100 >= high * near.percent)
        label = connected(linked)
        _, one = np.unique(component, return_index=True)
        one = one[component[one] != component[label[one]]]
        return pa.table({"a": nodes[one], "b": nodes[label[one]]})

    large = told.where(F.col("size") > SMALL).withColumn("groups", F.ceil(F.col("size") / SKETCH_CELL).cast("int"))
    cells = _outside_with_all(large, "bucket", SKETCH_CELL)
    found = cells.groupBy("bucket", "part", "group").applyInArrow(meet, "a long, b long")
    return met.select("a", "b").union(found).distinct()


def _outside_with_all(placed: DataFrame, key: str, cell: int) -> DataFrame:
    """For each key the classes outside its largest component, in parts, with all its classes, in groups: cells
    (``part, group``) of about ``cell`` classes of each. ``placed`` has ``node, component, groups`` besides."""
    counted = placed.groupBy(key, "component").agg(F.count("*").alias("_n"))
    main = counted.groupBy(key).agg(
        F.max_by("component", F.struct("_n", "component")).alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")
    )
    main = main.where("_all > _most").withColumn("_parts", F.ceil((F.col("_all") - F.col("_most")) / cell).cast("int"))
    known = placed.join(main.select(key, "_main", "_parts"), key)
    part = F.pmod(F.xxhash64("node", F.lit(-3)), F.col("_parts")).cast("int")
    group = F.pmod(F.xxhash64("node", F.lit(-2)), F.col("groups")).cast("int")
    working = ["_main", "_parts", "groups"]
    rest = known.where("component != _main").withColumn("part", part).withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
    every = known.withColumn("group", group).withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)")))
    return rest.drop(*working).unionByName(every.drop(*working))


def connected(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row it is connected with."""
    count = len(linked)
    label = np.arange(count)
    while True:
        least = np.where(linked, label[None, :], count).min(axis=1)
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def connect(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set that links connect it with, by the full sizes of all intersections.

    A shingle of one set only is in no intersection. The others are numbered, and each set is a row of bits over a block
    of them.
    """
    count, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    rows = np.repeat(np.arange(count), sizes)
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often > 1
    number = np.where(common, np.cumsum(common) - 1, -1)[number]
    rows, number = rows[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    rows, number = rows[order], number[order]
    both = np.zeros((count, count), dtype=np.int64)
    total = int(common.sum())
    for start in range(0, total, BLOCK):
        width = min(BLOCK, -(-(total - start) // 64) * 64)
        run = slice(*np.searchsorted(number, [start, start + width]))
        marks = np.zeros((count, width), dtype=bool)
        marks[rows[run], number[run] - start] = True
        bits = np.packbits(marks, axis=1).view(U)
        for i in range(count - 1):
            both[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
    both += both.T
    linked = both * 100 >= (sizes[:, None] + sizes[None, :] - both) * percent
    return connected(linked)


def _connected(cells: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links ``a, b`` that connect what is connected within each cell (rows of ``node, shingles``)."""

    def work(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        nodes, first = np.unique(nodes, return_index=True)
        sets = table.column("shingles").combine_chunks()
        label = connect([sets[int(i)].values.to_numpy().view(U) for i in first], percent)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": nodes[moved], "b": nodes[label[moved]]})

    return cells.select(*keys, "node", "shingles").groupBy(*keys).applyInArrow(work, "a long, b long")


def confirmed(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect all that is linked within each family (``node, component``), confirmed on full sets.

    A family of several groups: each group is compared with itself and with the first, which takes work in proportion to
    its size and commonly connects nearly all of it. The classes outside its largest component are then compared with
    every group.
    """
    sizes = family.groupBy("component").agg(F.count("*").alias("size"))
    groups = F.ceil(F.col("size") / CELL).cast("int")
    dealt = family.join(sizes, "component").withColumn("groups", groups)
    dealt = durable(dealt.withColumn("group", F.pmod(F.xxhash64("node", F.lit(-2)), F.col("groups")).cast("int")))
    to = F.when(F.col("group") == 0, F.expr("sequence(0, groups - 1)")).otherwise(F.array("group"))
    cells = dealt.select("component", "node", F.explode(to).alias("cell")).join(sets, "node")
    links = durable(_connected(cells, ["component", "cell"], percent))
    large = dealt.where("groups > 1")
    if large.isEmpty():
        return links
    family_of = large.select("node", F.col("component").alias("family"), "groups")
    if links.isEmpty():
        placed = family_of.withColumn("component", F.col("node"))
    else:
        placed = family_of.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    outside = durable(_outside_with_all(placed, "family", CELL).select("family", "part", "group", "node").distinct())
    if outside.isEmpty():
        return links
    return links.union(_connected(outside.join(sets, "node"), ["family", "part", "group"], percent))


def links(docs: DataFrame, text: str, near: Near, classes: DataFrame) -> DataFrame | None:
    """Links between classes, enough to connect all that any links connect; None if there are none."""
    family = families(classes, near)
    if family is None:
        return None
    family = durable(family)
    return confirmed(family, durable(full_sets(docs, text, near, family)), near.percent)


def near_duplicates(docs: DataFrame, near: Near | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its id, ``n_shingles``, ``component_id`` (the smallest id that links reach) and ``kept``.

    Words are runs without white space, A-Z as a-z; fewer words than the width are one shingle. A null text or one
    without words has no shingles, is linked with nothing and kept. Rows may repeat, ids may be of any type with an
    order, and a null id is kept only where all ids of its component are null. No documents give no rows.
    """
    near = near or Near()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    signed = durable(signatures(rows, "_text", near).drop("_text"))
    some = signed.where("n_shingles > 0")
    classes = durable(
        some.groupBy("node", "n_shingles").agg(
            F.min("_id").alias("smallest"), F.first("odd").alias("odd"), F.first("bands").alias("bands")
        )
    )
    found = links(rows, "_text", near, classes)
    own = classes.select("node", "smallest")
    if found is not None:
        placed = own.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
        own = placed.join(least, "component").select("node", "component_id")
    else:
        own = own.withColumnRenamed("smallest", "component_id")
    grouped = signed.select("_id", "n_shingles", "node").join(own, "node", "left")
    reached = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return grouped.select(
        F.col("_id").alias(doc_id), "n_shingles", reached.alias("component_id"), F.col("_id").eqNullSafe(reached).alias("kept")
    )
