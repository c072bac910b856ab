"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; no such pair is missed.

First come the links of the SimHash operator (`simhash.links`: fingerprints of three-word shingles, buckets by the
generalised pigeonhole, 3 or fewer differing bits). Fingerprints that near may belong to texts below 0.8, so each of its
links is decided by the two whole sets before it counts. Of the pairs at 0.8 and more it knows those with near
fingerprints; the rest come by an exact way.

There candidates come by prefixes: with the shingles of all texts in one order, two sets of n and m shingles with
a similarity of 0.8 or more share one of their first n // 5 + 1 and m // 5 + 1. Any order is right. This one has
shingles that are common in a sample of the texts last, then goes by hash, so that boilerplate and shared
passages are seldom in a prefix. In a bucket of equal shingles a pair is passed over only if its sizes, or the
shingle's places in both sets, rule 0.8 out. Every set has a sketch of as many bits as it has shingles, rounded
up to a power of two (`SKETCH` at least), each the parity of how many shingles fall on it; of two lengths the longer is
folded. Two sets differ in at least as many shingles as their sketches do in bits, so a pair whose sketches differ in
more than 0.8 leaves room for is passed over too. Every other pair is decided by the two whole sets.

Equal sets are one vertex (so copies cost nothing). Candidates are decided in rounds, each of pairs that stand
further apart in their buckets, with texts brought to pairs; a pair whose ends are joined already is left out: it can't change a group. A
bucket with more than `BLOCK` members is dealt out as pairs of its blocks, so a task holds two blocks at most.

Sets are of 64-bit hashes, and a vertex is a 64-bit hash of its set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, U64, Scratch, buffers, chunks, mix, span_hashes, swept, windows, words
from .components import star_edges

WIDTH, BLOCK, SKETCH = 5, 1024, 512
#: The order of shingles only: one in so many texts is counted, and so many of the most common shingles are told to every task.
SAMPLE, COMMON = 16, 1 << 18
#: Distances of pairs in a bucket, by rounds.
ROUNDS = ((1, 9), (9, 2 * BLOCK * BLOCK))
#: Bits of the filter that texts pass before they are dealt out to pairs, in words of 64: 2^19 rows at most.
FILTER = 1 << 25


def shingles(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct runs of `width` lower-cased words, and where each text's begin."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offs)
    n = np.diff(first)
    h = span_hashes(buf, starts, ends, 0x51)
    run = windows(h, width) if len(h) >= width else np.zeros(0, U64)
    count = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    edge = np.concatenate([[0], np.cumsum(count)])
    a = np.arange(edge[-1]) - np.repeat(edge[:-1], count) + np.repeat(first[:-1], count)
    out = np.zeros(len(a), U64)
    full = np.repeat(n >= width, count)
    out[full] = run[a[full]]
    for k in np.flatnonzero((n > 0) & (n < width)):  # fewer words: the whole sequence
        x = U64(n[k])
        for w in h[first[k] : first[k + 1]]:
            x = mix(np.array([x ^ w], U64))[0]
        out[edge[k]] = x
    text = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(n)))]).astype(np.int64)


def vertices(s: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    n = np.diff(edge)
    total = np.zeros(len(n), U64)
    some = np.flatnonzero(n)
    if len(some):
        total[some] = np.add.reduceat(mix(s ^ U64(0x9E3779B97F4A7C15)), edge[:-1][some])
    return mix(total + n.astype(U64)).view(np.int64)


def sketches(s: np.ndarray, edge: np.ndarray) -> pa.ListArray:
    """Each set's sketch in signed 64-bit lanes: the parity of the shingles that fall on each bit."""
    n = np.diff(edge)
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(first[:-1], n) + (mix(s) & np.repeat(bits - 1, n).astype(U64)).astype(np.int64)
    odd = (np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(first // 64, pa.int32()), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ, both as long as the shorter one: a half of a sketch is exclusive-ored with the other to fold it."""
    n = F.least(F.size(a), F.size(b))

    def folded(c: Column) -> Column:
        times = F.floor(F.size(c) / n).cast("int")
        lane = lambda i: F.aggregate(F.sequence(F.lit(0), times - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(c, i + j * n)))
        return F.transform(F.sequence(F.lit(0), n - 1), lane)

    bits = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda x, y: x + y)


def common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of the distinct texts, sorted, and how many of its texts have each."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.record_batch({"s": pa.array(shingles(*buffers(part.column("text")))[0].view(np.int64))})

    some = texts.where(f"pmod(h, {SAMPLE}) = 0").select("text").distinct()
    got = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").cast("int").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    s, n = got["s"].to_numpy(np.int64).view(U64), got["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def signatures(texts: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, h, key, vertex, n, prefix, sketch, fp): the size of each text's set, its first shingles, its sketch, and the text's SimHash."""
    often, count = known

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                s, edge = shingles(*buffers(part.column("text")))
                n = np.diff(edge)
                vertex, bits = vertices(s, edge), sketches(s, edge)
                weight = np.zeros(len(s), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    weight = np.where(often[at] == s, count[at], 0)
                s = s[np.argsort(np.repeat(np.arange(len(n)), n) << 32 | weight, kind="stable")]
                size = np.where(n > 0, n // 5 + 1, 0)
                s = s[np.arange(len(s)) - np.repeat(edge[:-1], n) < np.repeat(size, n)]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(s.view(np.int64)))
                yield pa.record_batch({"id": part.column("id"), "h": part.column("h"), "key": part.column("key"), "vertex": pa.array(vertex), "n": pa.array(n, pa.int32()), "prefix": prefix, "sketch": bits, "fp": simhash.packed(simhash.exact_fingerprints(*buffers(part.column("text")), 3))})

    return texts.mapInArrow(run, "id long, h long, key long, vertex long, n int, prefix array<long>, sketch array<long>, fp binary")


def candidates(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(u, v) from buckets' pairs `low` to `high` - 1 apart that may reach 0.8; rows: (token, part, n, vertex, pos, label), sorted so."""
    names = ("token", "part", "n", "vertex", "pos", "label")

    def pairs(token, part, n, vertex, pos, label):
        at, s = np.arange(len(token)), low
        while s < high:
            at = at[at + s < len(token)]
            # sizes rise in a bucket, so who is too small for one is too small for all that follow
            at = at[(token[at] == token[at + s]) & (part[at] == part[at + s]) & (5 * n[at] >= 4 * n[at + s])]
            if not len(at):
                break
            to = at + s
            # before the first common shingle there is none, and after it no more than what is left of either set
            go = (label[at] != label[to]) & (9 * np.minimum(n[at] - pos[at], n[to] - pos[to]) >= 4 * (n[at] + n[to]))
            u, v = vertex[at[go]], vertex[to[go]]
            if len(u):
                yield pa.record_batch({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})
            s += 1

    def run(batches):
        # rows come sorted; what is held back is the last bucket, which has two blocks at most
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = tuple(batch.column(k).to_numpy().astype(np.int64) for k in names)
            if rest is not None:
                got = tuple(np.concatenate(x) for x in zip(rest, got))
            token, part = got[:2]
            last = int(np.argmax((token == token[-1]) & (part == part[-1])))
            if last:
                yield from pairs(*(x[:last] for x in got))
            rest = tuple(x[last:] for x in got)
        if rest is not None:
            yield from pairs(*rest)

    return rows.select(*names).mapInArrow(run, "u long, v long").distinct()


def alike(rows: DataFrame) -> DataFrame:
    """The pairs with a similarity of 0.8 or more; rows: (u, v, text) with a text of each end, a pair's together."""

    def run(batches):
        held: dict[tuple, dict] = {}
        for batch in batches:
            good = []
            for part in chunks(batch, "text"):
                s, edge = shingles(*buffers(part.column("text")))
                ends = zip(part.column("u").to_pylist(), part.column("v").to_pylist())
                for k, (pair, vertex) in enumerate(zip(ends, vertices(s, edge).tolist())):
                    if pair not in held:
                        held = {pair: {}}  # a pair's rows stand together
                    other = held[pair]
                    if vertex not in pair or vertex in other:
                        continue
                    other[vertex] = s[edge[k] : edge[k + 1]].copy()
                    if len(other) == 2:
                        both = np.sort(np.concatenate([*other.values()]))
                        if 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both):
                            good.append(pair)
            yield pa.record_batch({"u": pa.array([x for x, _ in good], pa.int64()), "v": pa.array([x for _, x in good], pa.int64())})

    return rows.mapInArrow(run, "u long, v long")


def possible(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, u, v): both ends' texts of the pairs whose sketches leave room for 0.8."""
    ends = [keys.select(F.col("vertex").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in keys.columns[1:])) for name in ("u", "v")]
    differ = apart(F.col("u_sketch"), F.col("v_sketch"))
    both = pairs.join(ends[0], "u").join(ends[1], "v").where(9 * differ <= F.col("u_n") + F.col("v_n"))
    return both.select("u", "v", F.explode(F.array("u_key", "v_key")).alias("key")).select("key", "u", "v")


def sifted(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in wanted (`key`), few others where wanted keys are few and never one less; and the other rows.

    Rows stay where they are: tasks get the wanted keys as a filter, whose size is bounded by FILTER.
    """

    def placed(k: Column) -> tuple[Column, Column]:
        place = F.pmod(k, F.lit(FILTER))
        return F.floor(place / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))

    word, bit = placed(F.col("key"))
    words = wanted.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    word, bit = placed(key)
    both = rows.join(F.broadcast(words), word == F.col("__word"), "left")
    may = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return both.where(may).drop("__word", "__bits"), both.where(~may).drop("__word", "__bits")


def by_simhash(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): pairs of vertices with equal or linked fingerprints, enough to join all of these; prints: (vertex, fp)."""
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("vertex").alias("node")), "fps")
    equal = prints.join(nodes, "fp").where("vertex <> node").select(F.col("node").alias("u"), F.col("vertex").alias("v"))
    pairs = simhash.links(nodes, 3, 8, simhash.PARTS).unionByName(equal)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links(texts: DataFrame, scratch: Scratch, found: DataFrame) -> DataFrame:
    """(u, v): v is the least vertex of u's group, for every u that isn't the least itself. found: `signatures`."""
    nodes = scratch.write(found.groupBy("vertex").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")), "nodes")
    scratch.drop("signatures")
    swept(texts.sparkSession)
    entries = nodes.select("vertex", "n", F.posexplode("prefix").alias("pos", "token"))
    counts = scratch.write(entries.groupBy("token").agg(F.count("*").alias("count")).where("count > 1"), "counts")
    swept(texts.sparkSession)
    shared = scratch.write(entries.join(counts, "token"), "shared")
    keys = scratch.write(nodes.select("vertex", "key", "n", "sketch"), "keys")
    prints = scratch.write(nodes.select("vertex", "fp"), "prints")
    scratch.drop("nodes")
    scratch.drop("counts")

    def decided(pairs: DataFrame, name: str) -> DataFrame:
        wanted = scratch.write(possible(pairs, keys), f"wanted{name}")
        rows = sifted(texts, F.col("key"), wanted)[0].join(wanted, "key").select("u", "v", "text").repartition("u", "v").sortWithinPartitions("u", "v")
        good = scratch.write(alike(rows), f"good{name}")
        scratch.drop(f"wanted{name}")
        return good

    swept(texts.sparkSession)
    stars = star_edges(decided(scratch.write(by_simhash(prints, scratch), "linked"), "linked"), Scratch(texts.sparkSession))
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.greatest(j, own) * F.col("blocks") + F.least(j, own))
    for k, (low, high) in enumerate(ROUNDS):
        swept(texts.sparkSession)
        # only buckets that still have two groups
        label = shared.join(stars.select(F.col("u").alias("vertex"), F.col("v").alias("root")), "vertex", "left").withColumn("label", F.coalesce("root", "vertex")).drop("root")
        left = scratch.write(label, f"label{k}")
        mixed = scratch.write(left.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token"), f"mixed{k}")
        left = left.join(mixed, "token", "left_semi")
        rows = left.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("part", F.explode(pair))
        rows = rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "vertex")
        pairs = scratch.write(candidates(rows, low, high), f"pairs{k}")
        good = decided(pairs, str(k))
        for old in ("label", "mixed", "pairs"):
            scratch.drop(f"{old}{k}")
        stars = star_edges(good.unionByName(stars), Scratch(texts.sparkSession))
    return stars


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, component, least): for each row its id, the XXH64 of its text, its group, and the group's least id, null if it has none.

    Texts without words are one group. Rows without an id are members like others.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "h"))
    found = scratch.write(signatures(texts, common(texts)), "signatures")
    rows_of = scratch.write(found.select("id", "h", "vertex"), "rows")
    stars = scratch.write(links(texts, scratch, found), "stars")
    rows = rows_of.groupBy("vertex").agg(F.min("id").alias("least")).join(stars.select(F.col("u").alias("vertex"), F.col("v").alias("root")), "vertex", "left")
    named = scratch.write(rows.select("vertex", "least", F.coalesce("root", "vertex").alias("component")), "vertices")
    least = scratch.write(named.groupBy("component").agg(F.min("least").alias("least")), "components")
    named = scratch.write(named.select("vertex", "component").join(least, "component"), "named")
    return rows_of.join(named, "vertex").select("id", "h", "component", "least")
