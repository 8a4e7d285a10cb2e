"""N-gram Jaccard join (operator 9): exact links and components of documents by shared word shingles.

1. Scan one: every text becomes its set of shingles (64-bit hashes, sorted). Equal sets are one class from here
   on, named by its smallest document. Each set has a parity signature of 1024 bits. Shingles that are
   common within a task's texts are gathered, and the commonest, a bounded list, rank last below.
2. Scan two: two sets with the least allowed similarity share a shingle among the first n - ceil(t n) + 1
   of each, in any one order. The order is: common ones last, then by hash. Rows (shingle, document) of
   these prefixes are stored; shingles are counted with partial sums, and the rows of those met once go in a join,
   which Spark splits where one shingle has very many rows.
3. Each prefix shingle links its documents to its first one, a star, so candidates grow with rows and
   not with pairs. Candidates pass the bound on sizes, then the signatures' bit counts: the bits that differ
   bound the symmetric difference from below and so the overlap from above. The rest are verified by
   intersecting the sorted arrays. Verified links give components.
4. What stars alone miss is found exactly: where a shingle still joins several components, its classes are
   laid in tiles of size bands (sets of a band link only with that and the next one), and all pairs of unlike
   components within meet the same two bounds. A shingle of more than PART rows is split into parts whose pairs
   are tiles; the rows of its largest component, which can be nearly all, meet those of the others only.
   Sets that link share a least number of prefix shingles, which follows from both sizes: pairs met in fewer
   tiles go, the rest are verified. No similar pair of unlike components is left out, and pairs inside a
   component need no test, as they change no component.

Hashes of 64 bits are compared only within pairs, where a chance collision has a probability of n*n / 2**64.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; very long texts are shingled whole; rows with a null id link only to equal sets and
else have a null component; rows that repeat an id are one document when links are followed, and each gets its row;
of sets that tie for the name of a class the smallest id wins; an empty table gives no rows; other columns, of
whatever name, are ignored (kept by `deduplicated`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweft.llm.components import components
from scanweft.llm.shared import arrow_rows, buffer_of, column, gram_hash, grouped, mix, on_disk, plain, span_hash, steps, stored, texts, words_of

#: Bits of the small signature that every comparison starts with, and at most of the wide one.
BITS, MOST_BITS = 512, 1 << 17
#: Common shingles in the broadcast list, at most (8 bytes each), and how often in a step's texts one must stand.
COMMON, COMMON_IN_STEP = 200_000, 3
#: Ids up to which a set of them is broadcast to filter a scan (under 100 bytes each in memory), and pairs up to which
#: their roles are (under 200 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS, BROADCAST_PAIRS = 300_000, 150_000
#: Classes of a tile's part, and pairs of a document that one task verifies.
PART, STAR = 1024, 128
#: Sets that a worker remembers having sent.
MET = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Rule(NamedTuple):
    """Words of a shingle; link if den * overlap >= num * union."""

    k: int = 4
    num: int = 85
    den: int = 100

    def least(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of a set of n with any set that it links with."""
        return -(-self.num * n // self.den)

    def links(self, n: np.ndarray, m: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        """Whether sets of n and m link if they share `overlap`, or could if that is an upper bound."""
        return (self.den + self.num) * overlap >= self.num * (n + m)


class Sets(NamedTuple):
    row: np.ndarray
    shingle: np.ndarray
    size: np.ndarray


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Sets:
    """The sorted distinct shingles of each text, A-Z taken as a-z."""
    n = len(offsets) - 1
    starts, ends, row = words_of(raw, offsets)
    words = span_hash(_LOWER[raw], starts, ends)
    count = np.bincount(row, minlength=n)
    inside = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if len(row) >= k else np.zeros(0, np.int64)
    grams, owner = gram_hash(words, k)[inside], row[inside]
    first = np.cumsum(count) - count
    for short in range(1, k):
        mine = np.flatnonzero(count == short)
        if len(mine):
            total = np.zeros(len(mine), np.uint64)
            for j in range(short):
                total = mix(total * np.uint64(3) + words[first[mine] + j] + np.uint64(short))
            grams, owner = np.concatenate([grams, total]), np.concatenate([owner, mine])
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    edges = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[fresh]
    return Sets(owner, grams[fresh], np.bincount(owner, minlength=n).astype(np.int64))


def signatures(s: Sets) -> tuple[list[bytes], list[bytes]]:
    """Per set, for each of so many classes of shingles, whether it holds an odd number of them: small, and wide.

    The wide one has a power of two of classes, 1.5 times the set or more. One half of a signature laid on
    the other is the signature of half as many classes, so those of unlike sets can be compared.
    """
    place = (s.shingle >> np.uint64(20)).astype(np.int64)
    out = []
    for width in (np.full(len(s.size), BITS), np.clip(1 << np.ceil(np.log2(1.5 * np.maximum(s.size, 1))).astype(np.int64), BITS, MOST_BITS)):
        ends = np.cumsum(width)
        at = (ends - width)[s.row] + (place & (width[s.row] - 1))
        odd = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8))
        out.append([odd[(e - w) // 8 : e // 8].tobytes() for e, w in zip(ends.tolist(), width.tolist(), strict=True)])
    return out[0], out[1]


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, each folded to `size` bytes."""
    out = np.empty((len(bits), size // 8), np.uint64)
    lengths = np.array([len(b) for b in bits], np.int64)
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        rows = np.frombuffer(b"".join([bits[i] for i in mine.tolist()]), np.uint64).reshape(len(mine), -1)
        while rows.shape[1] > size // 8:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[mine] = rows
    return out


def set_keys(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set together with its size."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0x2545F4914F6CDD1D):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s.shingle + np.uint64(salt)))])
        ends = np.cumsum(s.size)
        out.append((total[ends] - total[ends - s.size]).view(np.int64))
    return out[0], out[1]


_SETS = {"doc_id": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "small": pa.binary(), "wide": pa.binary(), "common": pa.list_(pa.int64()), "often": pa.list_(pa.int64())}
SETS = "doc_id long, n long, k1 long, k2 long, small binary, wide binary, common array<long>, often array<long>"


def _scan_sets(named: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            s = shingle_sets(*buffer_of(step.column(1)), rule.k)
            k1, k2 = set_keys(s)
            value, often = np.unique(s.shingle, return_counts=True)
            common = often >= COMMON_IN_STEP
            rest = [None] * (step.num_rows - 1)
            small, wide = signatures(s)
            yield arrow_rows({"doc_id": step.column(0), "n": s.size, "k1": k1, "k2": k2, "small": small, "wide": wide, "common": [value[common].view(np.int64).tolist(), *rest], "often": [often[common].tolist(), *rest]}, _SETS)

    return named.mapInArrow(run, SETS)


def _common(sets: DataFrame) -> np.ndarray:
    """The commonest shingles, sorted: a bounded list that only orders prefixes; any list gives right results."""
    pairs = sets.where("common is not null").select(F.explode(F.arrays_zip("common", "often")).alias("x")).groupBy("x.common").agg(F.sum("x.often").alias("n"))
    return np.sort(np.array([r[0] for r in pairs.orderBy(F.desc("n"), "common").limit(COMMON).collect()], np.int64).view(np.uint64))


def _prefixes(named: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """Rows (shingle, doc_id) of the prefix of every set; a set that a task has met before is left out.

    Rows with a null id send none, so they come out first: they must not stand for a set that others send.
    """
    sent = named.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = sent.value, set()
        for step in steps(batches):
            s = shingle_sets(*buffer_of(step.column(1)), rule.k)
            n = s.size
            new = np.ones(len(n), bool)
            for i, key in enumerate(zip(n.tolist(), *(k.tolist() for k in set_keys(s)), strict=True)):
                new[i] = key not in met
                met.add(key)
            new &= n > 0
            if len(met) > MET:
                met.clear()
            late = np.zeros(len(s.row), bool)
            if len(last):
                at = np.minimum(np.searchsorted(last, s.shingle), len(last) - 1)
                late = last[at] == s.shingle
            first = np.cumsum(n) - n
            lates = np.concatenate([[0], np.cumsum(late)])
            before = lates[:-1] - lates[first[s.row]]
            early = n - (lates[first + n] - lates[first])
            rank = np.where(late, early[s.row] + before, np.arange(len(s.row)) - first[s.row] - before)
            take = (rank < (n - rule.least(n) + 1)[s.row]) & new[s.row]
            yield arrow_rows({"shingle": s.shingle[take].view(np.int64), "doc_id": step.column(0).take(pa.array(s.row[take]))}, {"shingle": pa.int64(), "doc_id": pa.int64()})

    return named.where("doc_id is not null").mapInArrow(run, "shingle long, doc_id long")


def _met_again(prefixes: DataFrame) -> DataFrame:
    """Rows (shingle, doc_id) of prefixes whose shingle has two or more, with its first document and how many it has."""
    heads = grouped(prefixes, "shingle", F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    return prefixes.join(heads, "shingle").select("shingle", "doc_id", "first", "rows")


_PAIR = {"a": pa.int64(), "b": pa.int64()}


def _bounded(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b): those that sizes, small signatures and then wide ones don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            size = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64)
            ok = np.zeros(len(n), bool)
            for width in np.unique(size).tolist():
                mine = np.flatnonzero(size == width)
                own = mine.tolist()
                ok[mine] = rule.links(n[mine], m[mine], _overlap_bound(n[mine], m[mine], folded([x[i] for i in own], width), folded([y[i] for i in own], width)))
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    for bits in ("small", "wide"):
        one, two = classes.select(F.col("rep").alias("a"), "n", F.col(bits).alias("x")), classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col(bits).alias("y"))
        sized = pairs.join(one, "a").join(two, "b").where(f"{rule.den} * least(n, m) >= {rule.num} * greatest(n, m)")
        pairs = sized.select("n", "m", "x", "y", "a", "b").mapInArrow(run, "a long, b long")
    return pairs


def _bit_rows(column: pa.Array, bits: int) -> np.ndarray:
    raw, _ = buffer_of(column)
    return raw.reshape(len(column), bits // 8).view(np.uint64)


def _overlap_bound(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Every bit that differs is owed to another shingle of one set alone."""
    return (n + m - np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)) // 2


def _verified(pairs: DataFrame, named: DataFrame, rule: Rule) -> DataFrame:
    """The links among candidate pairs (a, b), by intersecting sorted arrays.

    A pair goes to the task of its document with more pairs (the centre); the centre's array is sent once for
    every STAR of its pairs, so a centre of very many is split over tasks and no pair carries two arrays.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    degree = grouped(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", F.count("*").alias("d"))
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    swap = (F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a")))
    stars = pairs.join(da, "a").join(db, "b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("doc_id"), F.greatest("da", "db").alias("d"))
    stars = stored(stars.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("d") / STAR)).cast("int")).select("centre", "part", "doc_id"), "stars")

    centres = stars.select(F.col("centre").alias("doc_id"), "centre", "part").distinct()
    roles = centres.withColumn("member", F.lit(False)).unionByName(stars.withColumn("member", F.lit(True)))
    roles = roles.groupBy("doc_id").agg(F.collect_list(F.struct("centre", "part", "member")).alias("roles"))  # at most a document's own pairs
    few = stars.count() <= BROADCAST_PAIRS

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            s = shingle_sets(*buffer_of(step.column(1)), rule.k)
            ends = np.cumsum(s.size)
            raw = [s.shingle[e - n : e].tobytes() for e, n in zip(ends.tolist(), s.size.tolist(), strict=True)]
            lists = step.column(2)
            row = np.repeat(np.arange(step.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            for at in range(0, len(row), 500):
                own = row[at : at + 500]
                yield pa.RecordBatch.from_arrays([*flat.slice(at, 500).flatten(), step.column(0).take(pa.array(own)), pa.array([raw[i] for i in own.tolist()], pa.binary())], names=["centre", "part", "member", "doc_id", "shingles"])

    rows = named.join(F.broadcast(roles) if few else roles, "doc_id").select("doc_id", "text", "roles").mapInArrow(arrays, "centre long, part int, member boolean, doc_id long, shingles binary")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            a, b = [], []
            for centre, part, member, doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not member:
                    held = [*held, own] if at == (centre, part) else [own]
                    at = (centre, part)
                    continue
                for other in held if at == (centre, part) else []:
                    small, large = (own, other) if len(own) <= len(other) else (other, own)
                    if not len(small):
                        continue
                    to = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    if rule.links(len(own), len(other), int((large[to] == small).sum())):
                        a.append(centre)
                        b.append(doc)
                        break
            yield arrow_rows({"a": a, "b": b}, _PAIR)

    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "member").mapInArrow(intersect, "a long, b long")


def near_pairs(group: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, bits: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups that sizes, components, sides and signatures let link.

    Rows are sorted by group (numbers from 0) and size. Side 0 pairs with all, 1 and 2 with each other only.
    """
    # the rows after each, of its group, that aren't too large for it
    key = group * (int(n.max()) + 2) + n
    span = np.searchsorted(key, group * (int(n.max()) + 2) + np.minimum(rule.den * n // rule.num, int(n.max()) + 1), side="right") - np.arange(1, len(n) + 1)
    ends, most, first = np.cumsum(span), max(1, (16 << 20) // (8 * bits.shape[1])), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        own = span[first:last]
        i = np.repeat(np.arange(first, last), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        ok = (component[j] != component[i]) & ((side[j] == 0) | (side[j] != side[i]))
        i, j = i[ok], j[ok]
        ok = rule.links(n[i], n[j], _overlap_bound(n[i], n[j], bits[i], bits[j]))
        if ok.any():
            yield i[ok], j[ok]
        first = last


def _tile_pairs(table: pa.Table, key: list[str], rule: Rule) -> Iterator[np.ndarray]:
    """Candidate pairs of whole groups, sorted by key and size."""
    keys = np.column_stack([table.column(k).to_numpy() for k in key])
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    group = np.cumsum(fresh) - 1
    component, rep = table.column("component").to_numpy(), table.column("rep").to_numpy()
    start = np.flatnonzero(fresh)
    mixed = (np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start))[group]
    mixed[1:] &= (rep[1:] != rep[:-1]) | fresh[1:]  # a class that several tasks have sent
    if not mixed.any():
        return
    table = table.filter(pa.array(mixed)).combine_chunks()
    group, component, rep, n = group[mixed], component[mixed], rep[mixed], table.column("n").to_numpy()
    side = table.column("side").to_numpy() if "side" in table.column_names else np.zeros(len(n), np.int64)
    for i, j in near_pairs(group, n, component, side, _bit_rows(table.column("small"), BITS), rule):
        yield np.column_stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])])


class Tally:
    """Pairs of a task with how often each was met, so that a pair of many tiles is a few rows."""

    def __init__(self, most: int = 400_000):
        self.held: list[np.ndarray] = []
        self.rows, self.most = 0, most

    def add(self, pairs: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for p in pairs:
            self.held.append(p)
            self.rows += len(p)
            if self.rows > self.most:
                yield from self.out()

    def out(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.rows:
            pairs, shared = np.unique(np.concatenate(self.held), axis=0, return_counts=True)
            yield pairs[:, 0], pairs[:, 1], shared
        self.held, self.rows = [], 0


def _whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy() for k in key])
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = int(cut[-1]) if len(cut) else 0
        if held and (last or (keys[0] != held_key).any()):
            if last:
                held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
        held_key = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _compared(rows: DataFrame, key: list[str], rule: Rule) -> DataFrame:
    """The candidate pairs of tiles of at most two parts each, and in how many tiles of a task each was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for a, b, shared in found:
                yield arrow_rows({"a": a, "b": b, "shared": shared}, _PAIR | {"shared": pa.int64()})

        tally = Tally()
        for table in _whole_groups(batches, key):
            yield from rows_of(tally.add(_tile_pairs(table, key, rule)))
        yield from rows_of(tally.out())

    return rows.repartition(*key).sortWithinPartitions(*key, "n", "rep").mapInArrow(run, "a long, b long, shared long")


def _tiles(met: DataFrame, of: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs of unlike components that share enough prefix shingles.

    A shingle of at most PART rows is a tile. Larger ones are cut into size bands (a set meets its own band and
    the next one only) and bands into parts, and pairs of parts are tiles. The largest component of a shingle has
    parts of its own, which meet those of the others but not each other, so a group of copies costs no more than its
    rows. A pair that links shares a number of prefix shingles that follows from both sizes, so pairs found in
    fewer tiles go.
    """
    base = float(np.log(rule.den / rule.num))
    rows = met.join(of, "doc_id").select("shingle", "rows", "n", "rep", "component", "small")
    pairs = _compared(rows.where(F.col("rows") <= PART).drop("rows"), ["shingle"], rule)
    large = rows.where(F.col("rows") > PART)
    if met.where(F.col("rows") > PART).take(1):
        large = stored(large.dropDuplicates(["shingle", "rep"]).drop("rows").withColumn("band", F.floor(F.log("n") / base + 1e-9).cast("long")), "large-tiles")
        most = grouped(large.groupBy("shingle", "component").count(), "shingle", F.max_by("component", F.struct("count", "component")).alias("major"), F.count("*").alias("unlike"))
        own = large.join(most.where("unlike > 1"), "shingle").withColumn("kind", 2 * F.col("band") + (F.col("component") == F.col("major")).cast("long")).drop("major", "unlike")
        size = stored(own.groupBy("shingle", "kind").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts")), "bands")
        other = size.select("shingle", F.col("kind").alias("its"), F.col("parts").alias("others"))
        # kinds: two for each band, the odd one for the largest component
        meet = (F.abs(F.floor(F.col("its") / 2) - F.col("band")) <= 1) & ((F.col("its") % 2 == 0) | (F.col("kind") % 2 == 0))
        own = own.join(size, ["shingle", "kind"]).withColumn("me", F.col("kind") * (1 << 32) + F.pmod(F.xxhash64("rep"), "parts"))
        own = own.join(other, "shingle").where(meet).withColumn("it", F.explode(F.sequence(F.col("its") * (1 << 32), F.col("its") * (1 << 32) + F.col("others") - 1)))
        side = F.when(F.col("me") == F.col("it"), 0).when(F.col("me") < F.col("it"), 1).otherwise(2).cast("long")
        tiled = own.select("shingle", F.least("me", "it").alias("low"), F.greatest("me", "it").alias("high"), side.alias("side"), "n", "rep", "component", "small")
        pairs = pairs.union(_compared(tiled, ["shingle", "low", "high"], rule))
    counted = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(sizes.withColumnRenamed("rep", "a"), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("m")), "b")
    # both prefixes hold the first shared shingles for as long as those that only one set has leave room
    up = F.ceil(F.lit(rule.num) * (F.col("n") + F.col("m")) / (rule.num + rule.den) - 1e-9)  # the least overlap
    least = up + 1 - F.ceil(F.lit(rule.num) * F.greatest("n", "m") / rule.den - 1e-9)
    return counted.where(F.col("shared") >= least).select("a", "b")


class Join(NamedTuple):
    """rows: doc_id, n_shingles, component_id of every document; links: verified pairs (a, b) of class names, enough to
    connect what is linked and not all that there are, as pairs inside a component need no test."""

    rows: DataFrame
    links: DataFrame


def joined(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> Join:
    """The components of docs, and links that connect them."""
    named = texts(docs, column(id_col).cast("long").alias("doc_id"), text=text_col)
    sets = on_disk(_scan_sets(named, rule))
    common = _common(sets)
    key = ["n", "k1", "k2"]
    classes = stored(sets.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("small").alias("small"), F.any_value("wide").alias("wide")), "classes")
    reps = classes.where("rep is not null").select("rep", "n", "small", "wide")
    own = stored(sets.select("doc_id", *key), "sets")
    sets.unpersist()
    to_rep = own.where("n > 0 and doc_id is not null").join(classes.select(*key, "rep"), key).select("doc_id", "rep")
    met = stored(_met_again(stored(_prefixes(named, rule, common), "prefixes")), "met")
    moved = stored(to_rep.where("doc_id <> rep"), "moved")
    stars = met.where("doc_id <> first").select("doc_id", "first").distinct()
    one, two = moved.select("doc_id", F.col("rep").alias("a")), moved.select(F.col("doc_id").alias("first"), F.col("rep").alias("b"))
    stars = stars.join(one, "doc_id", "left").join(two, "first", "left").select(F.coalesce("a", "doc_id").alias("a"), F.coalesce("b", "first").alias("b"))
    stars = stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(_verified(_bounded(stars, reps, rule), named, rule), "star-links")
    parts = stored(components(links), "parts").select(F.col("node").alias("doc_id"), "component")
    of = to_rep.join(parts.withColumnRenamed("doc_id", "rep"), "rep", "left").join(classes.select("rep", "n", "small"), "rep").select("doc_id", "rep", "n", "small", F.coalesce("component", "rep").alias("component"))
    rest = stored(_tiles(met.select("shingle", "doc_id", "rows"), of, reps.select("rep", "n"), rule), "rest")
    if rest.take(1):
        more = stored(_verified(_bounded(rest, reps, rule), named, rule), "tile-links")
        links = links.union(more)
        parts = stored(components(links), "parts").select(F.col("node").alias("doc_id"), "component") if more.take(1) else parts
    of = parts.withColumnRenamed("doc_id", "rep")
    whole = classes.join(of, "rep", "left").select(*key, F.coalesce("component", "rep").alias("class_component"))
    rows = own.join(whole, key, "left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_component", "doc_id").alias("component_id"))
    return Join(rows, links)


def deduplicated(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of the smallest id; rows without an id all stay.

    Of rows that repeat an id, which are one document, one stays, or none where another document of the component has a
    smaller id. Texts are shuffled only if too many rows go to broadcast their ids.
    """
    own, (own_id, own_text) = plain(docs, id_col, text_col)
    rows = stored(joined(own, rule, own_id, own_text).rows, "components")
    gone = rows.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = own.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(own_id).cast("long") == F.col("gone"), "left_anti")
    twice = rows.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice"))
    if twice.take(1):
        single = kept.join(twice, F.col(own_id).cast("long") == F.col("twice"), "left_anti")
        again = kept.join(twice, F.col(own_id).cast("long") == F.col("twice"), "left_semi").dropDuplicates([own_id])
        kept = single.unionByName(again)
    return kept.toDF(*docs.columns)
