"""Near-duplicate groups by SuperMinHash, banding, verification and connected components.

SuperMinHash walks one pseudo-random permutation of the signature's places per element and keeps
the least (step + fraction) of every place; it stops as soon as no later step can lower any
place. Equal sets meet first and are one class from then on. The classes' signatures are cut
into bands; classes that share a band are candidates. Candidates are confirmed on their full
shingle sets, and the confirmed links' components are found by alternating star steps.

No bucket is turned into all its pairs. In every bucket each class is first held against the
bucket's centre (its smallest class), which settles a group of copies with one row per member.
Classes of one bucket that the centres leave in different components become a pair only where
three exact bounds leave a link possible: the set sizes; the distances to the shared centre
(Jaccard distance is a metric, so |d(x, c) - d(y, c)| <= d(x, y)); and the parity bitmaps (each
element flips one of PARITY bits, so the bits that differ are at most the elements that differ).
The first two are join keys as well, as ranges of which a pair shares one or lies in two that
touch, so classes that differ in size or distance never meet. That second step is exact and has no cap.

The bands find a pair of similarity s with probability 1 - (1 - s^ROWS)^BANDS: 1 - 4e-7 at the
contract's 0.85, 1 - 5e-5 at 0.8 and more above.

Defined cases: a document without words has the empty set and is its own component; fewer words
than a shingle make one shingle of them all; equal texts and repeated rows share a component; a
null doc_id takes the component of equal texts that have an id, else null; different texts under
one doc_id count as linked; texts are read whole; an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, in_arrow, let, lower_ascii, parted, rekeyed, text_of, words_of, written
from quarry.llm.graph import components

BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Bits of a set's parity bitmap.
PARITY = 1024
#: Elements whose permutations a worker holds at once.
BLOCK = 60_000
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def golden(times: int) -> np.uint64:
    return np.uint64(int(GOLDEN) * times % (1 << 64))


def shingles_of(text: Column, size: int) -> Column:
    """The distinct hashes of the runs of ``size`` words, A-Z in lower case."""

    def of(words: Column) -> Column:
        last = F.size(words) - size
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
        few = F.array(F.xxhash64(F.array_join(words, " ")))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(last < 0, few).otherwise(F.array_distinct(runs))

    return let(words_of(lower_ascii(text)), of)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, one row of PLACES numbers for each set.

    ``values`` holds the sets' elements one after another. All sets take a step together; a
    set drops out when its largest place is below the step, as no later step can lower it.
    """
    n = len(sizes)
    least = np.full(n * PLACES, np.inf)
    owner = np.repeat(np.arange(n), sizes)
    seed = mixed(values.view(np.uint64) + GOLDEN)
    first = (seed % np.uint64(PLACES)).astype(np.int64)
    draw = mixed(seed + GOLDEN)
    np.minimum.at(least, owner * PLACES + first, (draw >> np.uint64(11)) * 2.0**-53)
    table = least.reshape(n, PLACES)
    going = (table.max(axis=1) >= 1) & (sizes > 0)
    ends = np.cumsum(sizes)
    which = np.flatnonzero(going)
    while len(which):
        upto = max(1, int(np.searchsorted(np.cumsum(sizes[which]), BLOCK, "right")))
        part, which = which[:upto], which[upto:]
        rows = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in part])
        table[part] = later_steps(table[part], seed[rows], first[rows], np.repeat(np.arange(upto), sizes[part]))
    return table


def later_steps(table: np.ndarray, seed: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The steps from the second on, for sets that have places without a value of the first."""
    least = table.ravel()
    places = np.tile(np.arange(PLACES, dtype=np.int16), (len(seed), 1))
    places[np.arange(len(seed)), first] = 0
    for step in range(1, PLACES):
        going = (least.reshape(table.shape).max(axis=1) >= step)[owner]
        if not going.all():
            places, seed, owner = places[going], seed[going], owner[going]
        if not len(seed):
            break
        every = np.arange(len(seed))
        draw = mixed(seed + golden(2 * step))
        at = step + (draw % np.uint64(PLACES - step)).astype(np.int64)
        place = places[every, at]
        places[every, at] = places[every, step]
        np.minimum.at(least, owner * PLACES + place, step + (mixed(draw + GOLDEN) >> np.uint64(11)) * 2.0**-53)
    return least.reshape(table.shape)


def band_hashes(table: np.ndarray) -> np.ndarray:
    """BANDS 64-bit hashes a row, each of ROWS neighbouring places and the band's number."""
    bits = table.view(np.uint64).reshape(len(table), BANDS, ROWS)
    key = np.tile(mixed(np.arange(BANDS, dtype=np.uint64) + GOLDEN), (len(table), 1))
    for r in range(ROWS):
        key = mixed(key ^ bits[:, :, r])
    return key.view(np.int64)


def parities(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parity bitmaps of the sets, PARITY / 64 numbers a row."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mixed(values.view(np.uint64) + golden(5)) % np.uint64(PARITY)).astype(np.int64)
    flips = np.bincount(owner * PARITY + bit, minlength=len(sizes) * PARITY) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(sizes), PARITY // 64)


def with_bands(sets: DataFrame) -> DataFrame:
    """(doc_id, shingles) to (doc_id, n_shingles, s1, s2, bands, parity); s1 and s2 tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy()
            while at < len(column):  # about a million elements at a time
                to = min(at + 2_000, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1))
                values, cuts = flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                sizes = np.diff(cuts)
                full = np.flatnonzero(sizes)
                sums = np.zeros((2, to - at), np.uint64)
                bands = np.zeros((to - at, BANDS), np.int64)
                if len(full):
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mixed(values.view(np.uint64) + golden(k + 7)), cuts[:-1][full])
                    bands[full] = band_hashes(np.ascontiguousarray(signatures(values, sizes)[full]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]), pa.int32()), pa.array(bands[full].ravel(), pa.int64()))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1) * (PARITY // 64), pa.int32()), pa.array(parities(values, sizes).ravel(), pa.int64()))
                columns = [batch.column(0).slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists, bits]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "bands", "parity"])
                at = to

    return in_arrow(sets, run, f"doc_id {sets.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, parity array<bigint>")


def groups(docs: DataFrame, percent: int = 85, shingle: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked at ``percent`` or more, transitively."""
    docs = docs.select("doc_id", "text")
    signed = written(with_bands(docs.select("doc_id", shingles_of(text_of(), shingle).alias("shingles"))), "signed")
    same = ["n_shingles", "s1", "s2"]
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    reps = full.filter("doc_id is not null").select("doc_id", "n_shingles", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).filter("members > 1").drop("members")
    members = written(banded.join(rekeyed(buckets, "band"), "band"), "members")

    # only classes that share a bucket have their sets worked out again, from the whole texts
    wanted = members.select("rep").distinct()
    near, _ = parted(docs, ["doc_id"], wanted)
    sets = near.join(wanted, near["doc_id"] == wanted["rep"], "left_semi").select(F.col("doc_id").alias("rep"), shingles_of(text_of(), shingle).alias("shingles"))
    sets = written(sets, "sets")
    starred = written(similar(members.filter("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), sets), "starred")
    linked = starred.filter(passes(percent)).select("a", "b")
    first = components(linked)

    # buckets that still hold several components: cross pairs that the bounds allow
    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    around = starred.select(F.col("a").alias("centre"), F.col("b").alias("rep"), (F.lit(1.0) - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("d"))
    rest = placed.join(open_, "band", "left_semi").join(around, ["centre", "rep"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    bits = full.select(F.col("doc_id").alias("rep"), "n_shingles", "parity")
    rest = rest.select("band", "rep", F.col("n").alias("n_shingles"), "component", "d").join(bits, ["rep", "n_shingles"]).withColumnRenamed("n_shingles", "n")
    rest = written(rest, "rest")
    slack = 1 - percent / 100 + 1e-9
    # in units of the most that a pair may differ by, a range is two wide, and so lies within one of the two ranges around its partner
    units = {"by_size": F.log(F.col("n")) / -math.log(percent / 100), "by_distance": F.col("d") / slack}
    x = rest.select("*", *[F.floor(v / 2).alias(c) for c, v in units.items()]).alias("x")
    y = rest
    for c, v in units.items():
        y = y.withColumn(c, F.explode(F.sequence(F.floor((v - 1.0001) / 2), F.floor((v + 1.0001) / 2))))
    y = y.alias("y")
    differ = sum((F.bit_count(F.get("x.parity", F.lit(i)).bitwiseXOR(F.get("y.parity", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    possible = (
        (F.col("x.component") != F.col("y.component"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.abs(F.col("x.d") - F.col("y.d")) <= slack)
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.col("x.d") > 0)
        & (F.col("y.d") > 0)
        & (differ * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
    )
    keys = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "by_size", "by_distance")]
    pairs = x.join(y, functools.reduce(lambda a, b: a & b, keys) & possible).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    late = similar(pairs, sets).filter(passes(percent)).select("a", "b")
    joined = first.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = components(joined.unionByName(late)).select(F.col("node").alias("rep"), F.col("component"))
    dropped(members, sets, starred, rest)

    by_class = classes.join(found, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    return signed.join(by_class, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) to (a, b, na, nb, both): the sizes of the full sets and of their intersection."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))


def passes(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
