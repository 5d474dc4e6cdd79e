"""Near-duplicate records with small edits (problem 5).

Every record becomes the set of its runs of three words; equal sets form a class and are represented by the least id.
A representative's set is condensed to a SetSketch: register i holds the exponentially spaced, truncated minimum
K_i = clip(floor(1 - log_b(min of Exp(1) over the set))); registers of a union are maxima of registers, so sketches of
parts can be merged (`merge`). Registers are cut into bands; representatives that agree in a whole band become a
candidate pair, whose similarity is estimated jointly by maximum likelihood from a part of the registers and the two
cardinalities. What stays is verified on the sets themselves.

The minima come from a marked Poisson process: an element's points arrive at rate m, each at a random register, so the
first arrival at every register is Exp(1), independent of the others. Points are drawn, for all elements at once, only
up to the time by which every register has surely been hit.

Misses: a pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS; at s = 0.63 that is below 1e-4, at
0.7 below 1e-8. The likelihood test lets a pair go only if it lies 5 standard deviations below the threshold.

Skew: equal records are collapsed before anything else; a class that has many of the rows is joined by weight. Band
values that are frequent in a sample of representatives are split by hash into blocks of about `BUCKET` members before
anything is shuffled; of the others the sample let through, one with more members than that is streamed as 16-byte rows
and then split likewise. Blocks are compared with each other in different tasks, so no group is ever held whole and none
is capped; which way a value goes decides who compares, never what is compared.

The texts are read once: sketches, bands and the sets themselves (as 40-bit hashes, for the verification) are written to
a table in the shared folder, from which each later step reads only the columns it needs.

Defined cases: null messages, null and empty texts, and records of fewer than three words are in no pair; repeated
records (equal sets) have similarity 1; ids are assumed unique; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.skew import join_by_weight
from ..session import cut, map_arrow, scratch_path, spread
from .components import components
from .texts import strings

THRESHOLD = 0.60
BANDS, ROWS = 144, 6
BASE = 1.001
#: Registers kept for the estimate.
KEPT = 128
#: Members of a band value that are compared within one task.
BUCKET = 256
#: Representatives in the sample, about, and how many of them must share a band value for it to be split at once. The
#: values found are broadcast: at most SAMPLE * BANDS / FREQUENT of them, 2 MB.
SAMPLE, FREQUENT = 20_000, 20

_LONE = "々-〇぀-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
WORD = re.compile(rf"[{_LONE}]|[^\W{_LONE}]+")

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Shingler:
    """Sorted, distinct 64-bit hashes of a text's runs of three words."""

    MEMO = 400_000

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = WORD.findall(text.lower())
        if len(words) < 3:
            return np.empty(0, _U)
        memo = self.memo
        try:
            ids = [memo[w] for w in words]
        except KeyError:
            if len(memo) > self.MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
            ids = [memo[w] for w in words]
        h = np.array(ids, np.int64).view(_U)
        return np.unique(_mix(h[:-2] * _U(0x9E3779B97F4A7C15) + _mix(h[1:-1] * _U(0xC2B2AE3D27D4EB4F) + _mix(h[2:] * _U(0x165667B19E3779F9)))))


def sketches(sets: list[np.ndarray], m: int, base: float = BASE) -> np.ndarray:
    """Registers, one row for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    if not len(sets):
        return np.empty((0, m), np.uint16)
    rows = np.repeat(np.arange(len(sets)), sizes)
    least = np.full(len(sets) * m, np.inf)
    until = (math.log(m) + 6) / sizes
    seed, at, count = np.concatenate(sets), np.zeros(len(rows)), _U(0)
    while len(rows):
        count += _U(1)
        r = _mix(seed + _U(int(count) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((r >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / m
        going = at < until[rows]
        rows, seed, at, r = rows[going], seed[going], at[going], r[going]
        r = _mix(r + _U(0xD1B54A32D192ED03))
        np.minimum.at(least, rows * m + ((r >> _U(32)) * _U(m) >> _U(32)).astype(np.int64), at)
        if not len(rows):  # every element is past its time; go on with those sets of which a register is still empty
            open_rows = np.nonzero(np.isinf(least.reshape(len(sets), m)).any(1))[0]
            if len(open_rows):
                rest = sketches_until([sets[i] for i in open_rows], m, 4 * until[open_rows])
                least.reshape(len(sets), m)[open_rows] = rest
    k = np.floor(1 - np.log(least) / math.log(base)) + 20_000
    return np.clip(k, 0, 65_535).astype(np.uint16).reshape(len(sets), m)


def sketches_until(sets: list[np.ndarray], m: int, until: np.ndarray) -> np.ndarray:
    """Minima for sets whose points have to be drawn for longer."""
    out = np.empty((len(sets), m))
    for i, (s, end) in enumerate(zip(sets, until)):
        while True:
            least, seed, at, count = np.full(m, np.inf), s, np.zeros(len(s)), _U(0)
            while len(seed):
                count += _U(1)
                r = _mix(seed + _U(int(count) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                at = at - np.log(((r >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / m
                going = at < end
                seed, at, r = seed[going], at[going], _mix(r[going] + _U(0xD1B54A32D192ED03))
                np.minimum.at(least, ((r >> _U(32)) * _U(m) >> _U(32)).astype(np.int64), at)
            if not np.isinf(least).any():
                break
            end *= 4
        out[i] = least
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_values(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each sketch and band."""
    parts = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(_U)
    h = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=_U)), (len(registers), bands)).copy()
    for i in range(rows):
        h = _mix(h * _U(0x100000001B3) + parts[:, :, i])
    return h.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 101)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float = BASE) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity, given registers (one pair a row) and cardinalities.

    With u and v the shares of the two sizes in their sum, a register of the first set is the greater one with
    probability p(u - vJ) and the lesser one with p(v - uJ), where p(x) = -log_b(1 - x (b - 1) / b); else they are equal.
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, None) * (base - 1) / base) / math.log(base)
    up, down = p(u - v * j), p(v - u * j)
    likely = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, None))
    return np.take_along_axis(j, likely.argmax(1)[:, None], 1)[:, 0]


def _prints(s: np.ndarray) -> bytes:
    """A sorted set as 5-byte hashes, in order, each once."""
    t = s >> _U(24)
    t = t[np.concatenate(([True], t[1:] != t[:-1]))]
    return t.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _sketch(bands: int, rows: int):
    """(id, texts) -> (id, set hash, size, kept registers, band values, the set as 5-byte hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingle, m = Shingler(), bands * rows
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            todo: list[tuple[int, np.ndarray]] = []
            weight = 0
            for n, (i, t) in enumerate(zip(ids, texts)):
                if len(s := shingle(t)):
                    todo.append((i, s))
                    weight += len(s)
                if todo and (weight > 60_000 or n == len(ids) - 1):
                    sets = [s for _, s in todo]
                    k = sketches(sets, m)
                    values = band_values(k, bands, rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for i, _ in todo], pa.int64()),
                            pa.array([xxh3_128_digest(s) for s in sets], pa.binary()),
                            pa.array([len(s) for s in sets], pa.int32()),
                            pa.array([r.tobytes() for r in k[:, :KEPT]], pa.binary()),
                            pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(values.ravel())),
                            pa.array([_prints(s) for s in sets], pa.binary()),
                        ],
                        names=["id", "same", "size", "registers", "bands", "prints"],
                    )
                    todo, weight = [], 0

    return run


def _texts(records: DataFrame, key: str) -> DataFrame:
    text = F.concat_ws("\n", strings(F.col("messages")))
    return records.where(f"`{key}` IS NOT NULL").select(F.col(key).cast("long").alias("id"), text.alias("text")).where("text <> ''")


def _estimate(threshold: float):
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_000):
                part = batch.slice(at, 4_000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, KEPT) for c in (4, 5))
                na, nb = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 3))
                keep = pa.array(similarity(a, b, na, nb) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(keep)

    return run


def _stream_buckets(limit: int):
    """Band rows in the order of their value -> pairs of ids, and the members of values with more than `limit` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, members, out, over = None, [], [], []

        def close():
            if 1 < len(members) <= limit:
                some = sorted(set(members))
                out.extend((a, b) for i, a in enumerate(some) for b in some[i + 1 :])
            elif len(members) > limit:
                over.extend((value, x) for x in members)

        def flush():
            a = [*(p[0] for p in out), *(p[1] for p in over)]
            b = [*(p[1] for p in out), *([None] * len(over))]
            k = [*([None] * len(out)), *(p[0] for p in over)]
            out.clear()
            over.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["value", "a", "b"])

        for batch in batches:
            values, ids = (c.to_numpy() for c in batch.columns)
            # Values that occur once, inside a batch, meet nobody.
            edge = np.concatenate(([True], values[1:] != values[:-1], [True]))
            alone = edge[:-1] & edge[1:]
            alone[0] = alone[-1] = False
            for v, i in zip(values[~alone].tolist(), ids[~alone].tolist()):
                if v != value:
                    close()
                    value, members = v, []
                members.append(i)
                if len(members) > limit + 4096:  # a long one is handed on as it comes, but stays known as long
                    over.extend((value, x) for x in members[limit + 1 :])
                    del members[limit + 1 :]
                if len(out) + len(over) > 50_000:
                    yield flush()
        close()
        if out or over:
            yield flush()

    return run


def _frequent(sketched: DataFrame, total: int, bucket: int, sample: int, frequent: int) -> DataFrame:
    """(value, blocks): band values that a sample of `sketched`, by hash of the id, shows to be frequent."""
    span = 1 << 30
    share = min(1.0, sample / max(1, total))
    some = sketched.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(span)) < int(span * share))
    counts = some.select(F.explode("bands").alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= frequent)
    return counts.select("value", F.ceil(F.col("n") / F.lit(share * bucket)).cast("int").alias("blocks"))


def candidates(sketched: DataFrame, total: int, bucket: int = BUCKET, sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """(a, b), a < b, each once: representatives that agree in a band. `sketched` has (id, bands) and `total` rows."""
    rows = sketched.select("id", F.explode("bands").alias("value")).select("value", "id")
    known = cut(_frequent(sketched, total, bucket, sample, frequent))
    marked = rows.join(F.broadcast(known), "value", "left")
    rest = marked.where("blocks IS NULL").select("value", "id")
    found = cut(map_arrow(rest.repartition("value").sortWithinPartitions("value"), _stream_buckets(bucket), "value bigint, a bigint, b bigint").distinct())
    pairs = found.where("value IS NULL").select("a", "b")
    over = found.where("value IS NOT NULL").select("value", F.col("a").alias("id"))
    counts = over.groupBy("value").agg(F.ceil(F.count("*") / bucket).cast("int").alias("blocks"))
    large = marked.where("blocks IS NOT NULL").select("value", "id", "blocks").unionByName(over.join(counts, "value"))
    # Block i against block j <= i: a member of block x goes to all (max(x, y), min(x, y)).
    placed = (
        large.withColumn("own", F.pmod(F.xxhash64("id", "value"), F.col("blocks")).cast("int"))
        .select("value", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("value", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"))
        .agg(F.collect_list(F.struct("own", "id")).alias("members"))
    )
    left = F.explode(F.expr("transform(filter(members, m -> m.own = i), m -> m.id)")).alias("x")
    blocked = placed.select("i", "j", "members", left).select(
        "x", F.explode(F.expr("transform(filter(members, m -> m.own = j AND (i <> j OR m.id > x)), m -> m.id)")).alias("y")
    )
    return pairs.unionByName(blocked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _verify(threshold: float):
    def unpack(x: bytes) -> np.ndarray:
        out = np.zeros((len(x) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
        return out.view(_U)[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, score = [], [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = unpack(x), unpack(y)
                common = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
                if (v := common / (len(s) + len(t) - common)) >= threshold:
                    a.append(i)
                    b.append(j)
                    score.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


#: Bits of the fixed-size filter that keeps records out of joins; a full filter costs work, not results.
FILTER_BITS = 1 << 23


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` with `_may`, whether their id may be among `ids`; false only if it is not. By a filter of FILTER_BITS bits
    (1 MB), which is all that is broadcast."""
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("_bits"))
    marked = rows.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6)).join(F.broadcast(words), "_word", "left")
    return marked.withColumn("_may", F.expr("coalesce((_bits & shiftleft(1L, cast(_p % 64 AS int))) <> 0, false)")).drop("_word", "_bits", "_p")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` whose id is not among `ids`; only those that the filter lets through are shuffled to find out."""
    marked = _marked(rows, ids)
    unsure = marked.where("_may").drop("_may").join(ids, "id", "left_anti")
    return marked.where("NOT _may").drop("_may").unionByName(unsure)


def sketch_table(records: DataFrame, key: str = "row_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, same, size, registers, bands, prints) of every record that has a set, as a table in the shared folder."""
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "sketches")
    made = map_arrow(spread(_texts(records, key), "id"), _sketch(bands, rows), "id bigint, same binary, size int, registers binary, bands array<bigint>, prints binary")
    made.write.option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def similar(records: DataFrame, key: str = "row_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Membership (id, rep) of every record that has a set, and pairs (a, b, similarity) of representatives, a < b."""
    sketched = sketch_table(records, key, bands, rows)
    classes = cut(sketched.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    members = cut(join_by_weight(sketched.select("id", "same"), classes, ["same"], "n", "id").select("id", "rep"))
    found = candidates(_without(sketched.select("id", "bands"), members.where("id <> rep").select("id")), classes.count())
    kept = sketched.select("id", "size", "registers")
    both = (
        found.join(kept.toDF("a", "size_a", "registers_a"), "a")
        .join(kept.toDF("b", "size_b", "registers_b"), "b")
        .select("a", "b", "size_a", "size_b", "registers_a", "registers_b")
    )
    likely = cut(map_arrow(both, _estimate(threshold), "a bigint, b bigint"))
    prints = _marked(sketched.select("id", "prints"), likely.select(F.explode(F.array("a", "b")).alias("id"))).where("_may").drop("_may")
    pairs = likely.join(prints.toDF("a", "prints_a"), "a").join(prints.toDF("b", "prints_b"), "b").select("a", "b", "prints_a", "prints_b")
    return members, map_arrow(pairs, _verify(threshold), "a bigint, b bigint, similarity double")


def row_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), a < b: the pairs of representatives and the classes, written out row by row. As many rows as
    there are pairs; where copies abound, `search` and `groups` say the same in less."""
    left, right = members.toDF("x", "a"), members.toDF("y", "b")
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
    shared = members.where("id <> rep").select("rep").distinct()
    copies = members.join(shared, "rep", "left_semi").select("id", "rep")
    within = copies.toDF("x", "rep").join(copies.toDF("y", "rep"), "rep").where("x < y").select(F.col("x").alias("row_id_a"), F.col("y").alias("row_id_b"))
    return across.unionByName(within)


def search(members: DataFrame, pairs: DataFrame, every: int = 100) -> DataFrame:
    """(query_id, row_id, similarity): every row similar to a query, a row whose id is divisible by `every`; equal texts
    have similarity 1."""
    queries = members.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "rep")
    pairs = pairs.select("a", "b", "similarity")
    near = queries.select("rep").distinct().select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")).unionByName(
        pairs.toDF("rep", "other", "similarity").unionByName(pairs.select("b", "a", "similarity").toDF("rep", "other", "similarity"))
    )
    hits = queries.join(near, "rep").join(members.select(F.col("id").alias("row_id"), F.col("rep").alias("other")), "other")
    return hits.where("query_id <> row_id").select("query_id", "row_id", "similarity")


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id, class_id, group_id, links): the representative of a record's class, the least id of its group, and to
    how many other classes the class is linked."""
    pairs = cut(pairs)
    roots = components(pairs, "a", "b").toDF("rep", "group_id")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(roots, "rep", "left").join(links, "rep", "left")
        .select(F.col("id").alias("row_id"), F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
