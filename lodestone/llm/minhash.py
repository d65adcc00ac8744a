"""MinHash near-duplicates: documents whose sets of 3-word shingles have a similarity of 0.85 or more.

Method: circulant MinHash. One permutation of 2**32 places, SIGMA, shuffles the shingles of a set; a second one, PI, is
shifted round by k places for coordinate k, whose value is the least that the shifted permutation gives to a place of the set. So two permutations make all
COORDINATES of a signature, of which 16 bits each are kept. Runs of ROWS coordinates are bands; classes of equal sets that share a band are candidates where
their signatures agree in enough coordinates, and every link is confirmed on the whole sets.

Both are permutations of 32-bit integers (a 64-bit one whose upper half is the place; multiplications and shifts that can be undone).
Two sets with a similarity of s share no band with a chance of about (1 - s**4)**24: 2e-8 at 0.85. Agreement is asked to be
within six standard deviations of its mean, which a linked pair misses with a chance under 1e-7. A candidate is also ruled out
where the parities of SKETCH counts differ in more bits than the sets may in shingles: that bound is never wrong.

Copies are one class. In each band the class that meets most others is the middle; each class is first compared with the middle that its signature is nearest to.
What is left is completed in rounds: components propose the nearest pairs between them, twice in the first round and GROWTH times as many in each that
follows; those not tried before are verified and components contract. The rounds end when no component has an untried candidate in another one.
So links inside a component that is already connected are not all verified, and none between components is lost.
Pairs meet inside tasks; classes of a band that more than HOT hold are dealt over many tasks, those outside its largest component against all.

Defined results: null and empty texts (no words) have no shingles, are linked with nothing and are their own component; fewer than three words are
one shingle; rows repeated or with equal sets are one class; a null doc_id keeps its row and is never a component's name unless all members are null, and
such a row is kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, SPACES, Workspace, chunks, components, grams, map_arrow, mix, parallelism, word_hashes, word_spans
from lodestone.llm.ngram_join import bitmap, class_of, in_filter, met_pairs, nearest

WORDS, PERCENT = 3, 85
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
SIGMA = np.uint64(0xC2B2AE3D27D4EB4F)
SKETCH = 2_048  # bits
HOT = 1_000  # classes of one band that a task pairs with others
FIRST, GROWTH = 2, 8  # pairs that a component proposes in the first round, and how that grows
PIECE = 1 << 14  # pairs that one vectorised step looks at
PROFILE = "doc_id long, th long, cls long, n long, sig binary, sketch binary"


def sets_in(column: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """For each step of texts the sorted set of each text's shingle hashes."""
    for a, b, flat, offsets in chunks(column):
        flat = LOWER[flat]
        starts, ends, first = word_spans(flat, offsets, SPACES)
        each = word_hashes(flat, starts, ends)
        runs = grams(each, words)
        out = []
        for i in range(b - a):
            n = int(first[i + 1] - first[i])
            s = np.sort(runs[first[i] : first[i + 1] - words + 1] if n >= words else grams(each[first[i] : first[i + 1]], n) if n else each[:0])
            out.append(s[np.append(True, s[1:] != s[:-1])] if n else s)
        yield out


def pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit integers; ``x`` is written over."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES 16-bit values for each set; of an empty one they mean nothing."""
    size = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    out = np.zeros((len(sets), COORDINATES), np.uint16)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    place = (mix(np.concatenate(sets) ^ SIGMA) >> np.uint64(32)).astype(np.uint32)
    begin = (np.cumsum(size) - size)[some]
    for k in range(COORDINATES):
        out[some, k] = pi(np.minimum.reduceat(pi(place - np.uint32(k)), begin)).astype(np.uint16)
    return out


def sketch(s: np.ndarray) -> bytes:
    """SKETCH bits, each the parity of how many tokens fall on it: sketches of sets differ in at most as many bits as the sets in tokens."""
    bit = (mix(s + SIGMA) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def least_agreement(percent: int) -> int:
    """Coordinates in which a linked pair's signatures agree at least: six standard deviations under the mean."""
    s = percent / 100
    return math.floor(COORDINATES * s - 6 * math.sqrt(COORDINATES * s * (1 - s)))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(1, dtype=np.int64)


def candidates(n: np.ndarray, m: np.ndarray, sketches: list[np.ndarray], sigs: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be linked, and in how many coordinates each pair's signatures differ. Two sets of n and m with a similarity of p % differ in (n + m)(100 - p) / (100 + p)."""
    ok, far = np.zeros(len(n), bool), np.zeros(len(n), np.int64)
    for i in range(0, len(n), PIECE):
        j = slice(i, i + PIECE)
        bits = np.bitwise_count(sketches[0][j] ^ sketches[1][j]).sum(1, dtype=np.int64)
        far[j] = COORDINATES - agreement(sigs[0][j], sigs[1][j])
        ok[j] = ((100 + percent) * bits <= (100 - percent) * (n[j] + m[j])) & (far[j] <= COORDINATES - least_agreement(percent))
    return ok, far


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def bits_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def profile(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """A row for each document: its number, hash of its text, class (hash of its set), size of the set, signature and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, sig, bits = [], [], [], []
            for sets in sets_in(batch.column(1), words):
                cls += map(class_of, sets)
                n += map(len, sets)
                sig += [s.tobytes() for s in signatures(sets)]
                bits += map(sketch, sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "th", "cls", "n", "sig", "sketch"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")), run, PROFILE)


def bands(classes: DataFrame) -> DataFrame:
    """(band, cls): a hash of each run of ROWS coordinates and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = unpacked(batch.column(1)).view(np.uint64)
            key = mix(mix(runs) + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["band", "cls"])

    return map_arrow(classes.select("cls", "sig"), run, "band long, cls long")


def sets_of(docs: DataFrame, doc_id: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(cls, toks) of the documents ``wanted`` (doc_id, th) and of few others: a filter of at most 32 MB goes to the texts, which are not shuffled."""
    keys = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("doc_id", "th").alias("h"))))
    given = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in sets_in(batch.column(0).filter(in_filter(keys.value, batch.column(1))), words):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "toks"])

    return map_arrow(given, run, "cls long, toks binary")


def middles(met: DataFrame, known: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """(a, b): each class with that middle of its bands (met: band, cls, size) whose signature agrees most with its own, where sizes and agreement allow."""
    central = met.groupBy("cls").agg(F.sum("size").alias("central"))
    hubs = ws.save(met.join(central, "cls").groupBy("band").agg(F.max(F.struct("central", "cls"))["cls"].alias("hub")), "hubs")
    pairs = met.join(hubs, "band").where("hub <> cls").select("cls", "hub").distinct()
    other = known.select(F.col("cls").alias("hub"), F.col("n").alias("m"), F.col("sig").alias("sig_of"), F.col("sketch").alias("sketch_of"))
    both = pairs.join(known.select("cls", "n", "sig", "sketch"), "cls").join(other, "hub").where(f"100 * n >= {percent} * m AND 100 * m >= {percent} * n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok, far = candidates(n, m, [bits_of(batch.column(j)) for j in (4, 5)], [unpacked(batch.column(j)) for j in (6, 7)], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(-far)], ["cls", "hub", "agree"]).filter(pa.array(ok))

    best = map_arrow(both.select("cls", "hub", "n", "m", "sketch", "sketch_of", "sig", "sig_of"), run, "cls long, hub long, agree long").groupBy("cls").agg(F.max(F.struct("agree", "hub"))["hub"].alias("hub"))
    return best.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok) of distinct pairs: whether the whole sets are as similar as asked."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("toks").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("toks").alias("y")), "b").select("a", "b", "x", "y")

    def ok(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ok(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "ok"])

    return map_arrow(both, run, "a long, b long, ok boolean")


def proposed(met: DataFrame, known: DataFrame, comp: DataFrame, ws: Workspace, most: int, percent: int, parts: int, name: str) -> DataFrame:
    """(a, b), a < b: of the candidate pairs between components, the ``most`` nearest of each component in each task.

    A row of nulls says that a task had more of them.
    """
    rows = met.select("band", "cls").join(comp, "cls")
    per = rows.groupBy("band", "comp").agg(F.count("*").alias("c")).groupBy("band").agg(F.sum("c").alias("holders"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"))
    # written, so that Spark can split a band that many classes hold when they meet
    across = ws.save(per.where("comps > 1").select("band", "holders", F.col("top.comp").alias("main"), (F.col("holders") - F.col("top.c")).alias("minor")), f"across-{name}")
    rows = rows.join(across, "band").join(known.select("cls", "n", "sig", "sketch"), "cls")
    cold = F.expr(f"array(struct(pmod(xxhash64(band), {parts}) AS g, 0 AS side))")
    all_blocks, minor_blocks = f"holders div {HOT}", f"minor div {HOT}"
    outside = F.expr(f"IF(comp = main, slice(array(struct(0L AS g, 1 AS side)), 1, 0), transform(sequence(0L, {all_blocks}), j -> struct(xxhash64(band, pmod(xxhash64(cls, 1), {minor_blocks} + 1), j) AS g, 1 AS side)))")
    every = F.expr(f"transform(sequence(0L, {minor_blocks}), i -> struct(xxhash64(band, i, pmod(xxhash64(cls, 2), {all_blocks} + 1)) AS g, 2 AS side))")
    dealt = rows.withColumn("x", F.explode(F.when(F.col("holders") <= HOT, cold).otherwise(F.concat(outside, every))))

    def run(table: pa.Table) -> pa.Table:
        a, b, more = best_pairs(table, most, percent)
        a, b = (pa.array(x).cast(pa.int64()) for x in (np.minimum(a, b), np.maximum(a, b)))
        mark = pa.nulls(int(more), pa.int64())
        return pa.table({"a": pa.concat_arrays([a, mark]), "b": pa.concat_arrays([b, mark])})

    return dealt.select("x.g", "x.side", "band", "cls", "comp", (F.col("comp") == F.col("main")).alias("in_main"), "n", "sig", "sketch").groupBy("g").applyInArrow(run, "a long, b long").distinct()


def best_pairs(table: pa.Table, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Classes of the pairs that one task proposes, and whether it left some out."""
    band, side, cls, comp, n, in_main = (table.column(x).to_numpy() for x in ("band", "side", "cls", "comp", "n", "in_main"))
    by = np.lexsort((side, band))
    band, side, cls, comp, n, in_main = (x[by] for x in (band, side, cls, comp, n, in_main))
    sig, bits = unpacked(table.column("sig"))[by], bits_of(table.column("sketch"))[by]
    found, more = [np.zeros(0, np.int64)] * 3, False
    for x, y in met_pairs(band, side):
        keep = (comp[x] != comp[y]) & (100 * n[x] >= percent * n[y]) & (100 * n[y] >= percent * n[x])
        keep &= (side[x] == 0) | in_main[y] | (cls[x] < cls[y])  # two rows outside the largest component meet twice
        x, y = x[keep], y[keep]
        keep, far = candidates(n[x], n[y], [bits[x], bits[y]], [sig[x], sig[y]], percent)
        found = [np.concatenate(z) for z in zip(found, (x[keep], y[keep], far[keep]), strict=True)]
        once = nearest(comp, cls, *found, len(found[0]) + 1)
        found = [z[once] for z in found]
        best = nearest(comp, cls, *found, most)
        more |= len(best) < len(found[0])
        found = [z[best] for z in found]
    return cls[found[0]], cls[found[1]], more


def contracted(ws: Workspace, comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(cls, comp) after the components that ``links`` (a, b) of classes connect have become one, named by the smallest class."""
    ends = links.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("v")), "b")
    to = components(ws, ends.select(F.col("u").alias("a"), F.col("v").alias("b")), f"cc-{name}")
    return ws.save(comp.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")), f"comp-{name}")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, known, links).

    members (doc_id, th, cls, n, sig, sketch) has a row for each document; known (cls, low, n, component) one for each class that is not empty, low being its
    smallest doc_id and component the smallest class reachable; links (a, b) are the verified pairs of classes that connect each component.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    parts = parallelism(docs)
    members = ws.save(profile(docs, doc_id, text, words), "members")
    known = members.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    known = ws.save(known.select("cls", "one.doc_id", "one.th", "low", "n", "sig", "sketch"), "known")
    held = bands(known)
    shared = ws.save(held.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    met = ws.save(held.join(shared, "band"), "met")
    some = met.select("cls").distinct()
    sets = ws.save(sets_of(docs, doc_id, text, words, known.join(some, "cls", "left_semi").select("doc_id", "th")).join(some, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    checked = ws.save(verified(middles(met, known, ws, percent), sets, percent), "checked-middles")
    comp = contracted(ws, sets.select("cls", F.col("cls").alias("comp")), checked.where("ok"), "middles")
    most = FIRST
    for step in itertools.count():
        told = ws.save(proposed(met, known, comp, ws, most, percent, parts, str(step)), f"proposed-{step}")
        more = not told.where("a IS NULL").isEmpty()
        new = ws.save(verified(told.where("a IS NOT NULL").join(checked.select("a", "b"), ["a", "b"], "left_anti"), sets, percent), f"checked-{step}")
        checked, most = checked.unionByName(new), most * GROWTH
        if not new.where("ok").isEmpty():
            comp = contracted(ws, comp, new.where("ok"), str(step))
        elif not more and new.isEmpty():
            break
    ws.drop("shared", "met", "sets", "hubs")
    all_of = known.join(comp, "cls", "left").select("cls", "low", "n", F.coalesce("comp", "cls").alias("component"))
    return members, all_of, checked.where("ok").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable; of an empty set its own), kept (whether that is its own)."""
    members, known, _ = classes(docs)
    ws = Workspace(docs.sparkSession, "minhash-names")
    # small rows, one a class: named before documents meet them, so that the join of a large class's documents can be split
    names = ws.save(known.join(known.groupBy("component").agg(F.min("low").alias("name")), "component").select("cls", "name"), "names")
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    out = members.join(names, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
