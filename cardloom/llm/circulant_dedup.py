"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Shingles are five words.  One random permutation of a universe of 2^20 places
scatters the shingles; a second one, read from k places further on (circularly), is the
k-th hash function, so all coordinates of a signature come from two permutations
(X. Li, P. Li: C-MinHash, 2022).  In memory the coordinates of a shingle are one
contiguous run of the second permutation.

Rows and bands of a signature follow from the threshold: as many rows as keep a pair at the threshold from being
missed with a probability of more than ``MISS``.  Documents with equal shingle sets are put together first.  Of the others, those that
share a band of the signature are candidates.  Pairs are never listed for a whole
bucket: a round compares each member of a bucket with one hub, components are formed
from the confirmed links, and only buckets that still hold several components go on,
with other hubs.  The first round looks at a few bands alone, which puts most copies of a
large group together before the other bands are dealt out.  At last, what is not
in the largest component of such buckets is compared with all their members, block by
block: signatures sort out pairs far from the threshold, and no pair becomes a row but
a confirmed one.  Where that would be many blocks (a bucket of many documents that are not alike), its members are
dealt out again by longer bands, and texts are only sent to blocks in which their signatures are near.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.frames import Rounds, cut, parts, skew_join
from cardloom.llm.workers import in_batches
from cardloom.llm.words import Words, flat, slices

#: Words of a shingle.
WORDS = 5
#: A pair at the threshold shares no band with a probability of at most this; most coordinates and rows of all bands.
MISS, MOST_COORDINATES, MOST_ROWS = 1e-6, 128, 6
#: Bands of the first round; coordinates in all (those without a band serve to estimate); coordinates and rows of the longer
#: bands by which members of overfull buckets are dealt out again.
FIRST_BANDS, COORDINATES, LONG_COORDINATES, LONG_ROWS = 4, 256, 1536, 8
UNIVERSE = 1 << 20
SEED = 20220607
#: Members are dealt out to tasks in lots of about so many documents and shingles.
LOT, LOT_SHINGLES = 1000, 500_000
#: Rows that say which text goes where, and bucket numbers, are broadcast up to so many (up to 40 bytes
#: each); beyond that they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rounds with hubs; one that confirms a smaller share of its pairs than this is the last one.
HUB_ROUNDS, LEAST_YIELD = 4, 0.1
#: Pairs whose estimate of 256 coordinates is so many standard deviations below the threshold are not compared in blocks
#: (a chance of 1e-8 at the threshold); ``exact`` compares them too.
DEVIATIONS = 5.5
#: Buckets that take more blocks than this are dealt out again.
MOST_BLOCKS = 64
#: Families of buckets are compared as wholes up to so many estimates, else each bucket by itself.
MOST_ESTIMATES = 10**10
#: Links are joined in one task up to so many (16 bytes each); beyond that by rounds over the cluster.
ONE_TASK_LINKS = 1_000_000

_U = np.uint64


@functools.cache
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all circular shifts of the other as rows of a view."""
    rng = np.random.default_rng(SEED)
    scatter = rng.permutation(UNIVERSE).astype(np.uint32)
    other = rng.permutation(UNIVERSE).astype(np.uint32)
    around = np.concatenate((other, other[: coordinates - 1]))
    return scatter, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def bands_needed(share: int, rows: int) -> int:
    """How many bands of so many rows miss a pair at ``share`` percent with a probability of at most ``MISS``."""
    return 1 if share >= 100 else math.ceil(math.log(MISS) / math.log1p(-((share / 100) ** rows)))


def banding(share: int) -> tuple[int, int]:
    """Bands and rows for a threshold: the most rows (so the fewest candidates) whose bands fit in the coordinates."""
    fitting = [r for r in range(1, MOST_ROWS + 1) if 0 < share <= 100 and bands_needed(share, r) * r <= MOST_COORDINATES]
    if not fitting:
        raise ValueError(f"no banding finds links from {share} percent")
    return max(bands_needed(share, fitting[-1]), FIRST_BANDS), fitting[-1]


def least_estimate(share: int) -> float:
    """The least share of equal coordinates with which a pair is compared."""
    j = share / 100
    return j - DEVIATIONS * math.sqrt(j * (1 - j) / COORDINATES)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes.

    A-Z are lower-cased.  With fewer words the whole sequence is one shingle; without
    words the set is empty.
    """
    data, offsets = flat(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    w = Words(data, offsets)
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, w.distinct.to_pylist()), _U, len(w.distinct))[w.code]
    counts = w.counts()
    powers = _mix(np.arange(1, words + 1, dtype=_U)) | _U(1)
    with np.errstate(over="ignore"):
        n = len(names)
        total = np.zeros(max(n - words + 1, 0), _U)
        for k in range(words):
            total += names[k : n - words + 1 + k] * powers[k] if n >= words else total
        hashed = _mix(total)
        out = []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if counts[i] >= words:
                out.append(np.unique(hashed[a : b - words + 1]))
            elif counts[i]:
                short = (names[a:b] * powers[: b - a]).sum(dtype=_U) + _U(int(counts[i])) * _U(0x9E3779B97F4A7C15)
                out.append(_mix(np.array([short], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The coordinates of a non-empty set."""
    scatter, shifts = _permutations(coordinates)
    place = scatter[(shingles & _U(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(coordinates, UNIVERSE, np.uint32)
    step = max(1, (1 << 20) // coordinates)
    for a in range(0, len(place), step):
        np.minimum(least, shifts[place[a : a + step]].min(axis=0), out=least)
    return least


def banded(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A name for each band of a signature."""
    row, band = _mix(np.arange(1000, 1000 + rows, dtype=_U)) | _U(1), _mix(np.arange(1, bands + 1, dtype=_U))
    with np.errstate(over="ignore"):
        return _mix((least[: bands * rows].reshape(bands, rows) * row).sum(axis=1, dtype=_U) ^ band).view(np.int64)


SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>"


def signatures(docs: DataFrame, share: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (low, high), and its bands."""
    n_bands, n_rows = banding(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            sizes, low, high, bands = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column("text")):
                    sizes.append(len(s))
                    low.append(s.sum(dtype=_U))
                    high.append(_mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U))
                    bands.append(banded(signature(s), n_bands, n_rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(low, _U).view(np.int64)), pa.array(np.array(high, _U).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "low", "high", "bands"],
            )

    return in_batches(docs, run, SIGNED)


def alike(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Do two ascending sets have at least ``share`` percent of their union in common?"""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < share * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= share * (len(x) + len(y) - both)


def _lots(members: DataFrame) -> DataFrame:
    """key, main, all_lots, asked_lots: of each key with several components the largest, and how many lots its members make.

    Those outside the largest component are asked (every pair of components has one of them) against all members.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")).where("k > 1")
    lots = f"cast(greatest(ceil(%s / {LOT}), ceil(%s / {LOT_SHINGLES})) as int)"
    top = sizes.select("key", "component", F.col("m").alias("tm"), F.col("w").alias("tw"))
    keys = largest.withColumn("component", F.col("top.component")).join(top, ["key", "component"])
    return cut(_few(keys.select("key", F.col("component").alias("main"), F.expr(lots % ("m", "w")).alias("all_lots"), F.expr(lots % ("(m - tm)", "(w - tw)")).alias("asked_lots"), F.col("m").alias("members"))))


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The documents whose ids are among the reps of ``members``."""
    reps = cut(_few(members.select("rep").distinct()))
    if reps.count() <= BROADCAST_ROWS:
        reps = F.broadcast(reps)
    return docs.join(reps, docs["doc_id"] == reps["rep"], "left_semi")


def _redealt(members: DataFrame, keys: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """Members of overfull keys under new keys, one for each long band they share within their key; the others as they are."""
    over = keys.where(F.col("all_lots") * F.col("asked_lots") > MOST_BLOCKS).select("key", "members")
    if not over.limit(1).count():
        return members
    n_bands = bands_needed(share, LONG_ROWS)
    rows_of = LONG_ROWS
    while n_bands * rows_of > LONG_COORDINATES:  # a low threshold: shorter bands
        rows_of -= 1
        n_bands = bands_needed(share, rows_of)
    mine = cut(skew_join(members, over, ["key"], "members"))
    rest = members.join(F.broadcast(over.select("key")) if over.count() <= BROADCAST_ROWS else over.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            reps, keep = batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"))
            long = [(rep, band) for rep, own in zip(reps, keep, strict=True) if len(own) for band in banded(signature(own, n_bands * rows_of), n_bands, rows_of).tolist()]
            yield pa.RecordBatch.from_pydict({"rep": pa.array([x[0] for x in long], pa.int64()), "band": pa.array([x[1] for x in long], pa.int64())})

    bands = in_batches(_texts_of(docs, mine), run, "rep long, band long").distinct()
    again = mine.join(bands, "rep").select(F.xxhash64("key", "band").alias("key"), "rep", "component", "n").distinct()
    return cut(rest.select("key", "rep", "component", "n").unionByName(again))


def compared(members: DataFrame, docs: DataFrame, share: int, exact: bool = False) -> DataFrame:
    """Links (a, b) between members of one key but different components.

    ``members``: key, rep, component, n (a computed table).  Of each key, those outside its largest
    component are asked (every pair of components has one of them) against all members, in blocks
    of a lot of the one and a lot of the other.  ``exact``: no pair is left out by its signatures' estimate, and no key dealt out again.
    """
    n = parts(members.sparkSession)
    least = -1.0 if exact else least_estimate(share)
    keys = _lots(members)
    if not exact:
        members = _redealt(members, keys, docs, share)
        keys = _lots(members)
    rows = skew_join(members, keys, ["key"], "members")
    asked = rows.where("component <> main").withColumn("q", F.expr("cast(pmod(xxhash64(rep), asked_lots) as int)")).withColumn("r", F.explode(F.expr("sequence(0, all_lots - 1)"))).withColumn("role", F.lit(0))
    against = rows.withColumn("r", F.expr("cast(pmod(xxhash64(rep, 1), all_lots) as int)")).withColumn("q", F.explode(F.expr("sequence(0, asked_lots - 1)"))).withColumn("role", F.lit(1))
    wanted = ["key", "q", "r", "role", "rep", "component"]
    roles = cut(_few(asked.unionByName(against).select(*wanted, (F.col("all_lots") > 1).alias("blocks"))))
    if not exact and roles.where("blocks").limit(1).count():
        roles = cut(_few(roles.where("not blocks").select(*wanted).unionByName(_near(roles.where("blocks").select(*wanted), docs, least))))
    roles = roles.select(*wanted)
    if roles.count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    rows = docs.join(roles, docs["doc_id"] == roles["rep"]).select(*wanted, "text")
    rows = rows.repartition(n, "key", "q", "r").sortWithinPartitions("key", "q", "r", "role", "rep")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, table, done = None, [], None, set()
        for batch in (part for b in batches for part in slices(b, "text")):
            found_a, found_b = [], []
            columns = [batch.column(c).to_pylist() for c in wanted]
            for key, q, r, role, rep, component, own in zip(*columns, shingle_sets(batch.column("text")), strict=True):
                if (key, q, r) != block:
                    block, asked, table, done = (key, q, r), [], None, set()
                if not len(own):
                    continue
                if role == 0:
                    asked.append((rep, component, own, signature(own)))
                    continue
                if table is None:
                    table = np.array([x[3] for x in asked]).reshape(len(asked), COORDINATES)
                near = np.flatnonzero(np.count_nonzero(table == signature(own), axis=1) >= least * COORDINATES) if len(asked) else []
                for i in near:
                    other, its, theirs, _ = asked[i]
                    # one link between a document and a component is enough
                    if its != component and (i, component) not in done and alike(own, theirs, share):
                        done.add((i, component))
                        found_a.append(other)
                        found_b.append(rep)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return cut(_few(in_batches(rows, check, "a long, b long").distinct()))


def _near(roles: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The roles of members that have, in their block, a signature of another component near theirs.

    Each signature is computed once; blocks get signatures (1 kB), not texts.
    """
    n, wanted = parts(roles.sparkSession), ["key", "q", "r", "role", "rep", "component"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            signed = [(rep, signature(own).tobytes()) for rep, own in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True) if len(own)]
            yield pa.RecordBatch.from_pydict({"rep": pa.array([x[0] for x in signed], pa.int64()), "signature": pa.array([x[1] for x in signed], pa.binary())})

    signed = cut(in_batches(_texts_of(docs, roles), sign, "rep long, signature binary"))
    rows = roles.join(signed, "rep").select(*wanted, "signature").repartition(n, "key", "q", "r").sortWithinPartitions("key", "q", "r", "role", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, table, of, hit = None, [], None, None, None
        kinds = pa.schema([("key", pa.int64()), ("q", pa.int32()), ("r", pa.int32()), ("role", pa.int32()), ("rep", pa.int64()), ("component", pa.int64())])

        def told(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds.field(i).type) for i in range(6)], schema=kinds)

        def asked_hits() -> list:
            return [(*block, 0, *names[i]) for i in np.flatnonzero(hit).tolist()] if hit is not None else []

        for batch in batches:
            out = []
            for key, q, r, role, rep, component, s in zip(*(batch.column(c).to_pylist() for c in [*wanted, "signature"]), strict=True):
                if (key, q, r) != block:
                    out += asked_hits()
                    block, names, table, hit = (key, q, r), [], [], None
                own = np.frombuffer(s, np.uint32)
                if role == 0:
                    names.append((rep, component))
                    table.append(own)
                    continue
                if hit is None:
                    table, of, hit = np.array(table).reshape(len(names), COORDINATES), np.array([x[1] for x in names], np.int64), np.zeros(len(names), bool)
                near = (np.count_nonzero(table == own, axis=1) >= least * COORDINATES) & (of != component)
                if near.any():
                    hit |= near
                    out.append((key, q, r, 1, rep, component))
            yield told(out)
        yield told(asked_hits())

    return in_batches(rows, run, "key long, q int, r int, role int, rep long, component long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """Of distinct pairs (a, b) of doc_ids (a computed table), those whose full sets have ``share`` percent in common.

    Texts of b are dealt out with their a, in lots, and each task streams a lot: it
    holds the set of one a at a time.
    """
    n = parts(pairs.sparkSession)
    lots = cut(pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(1) / {LOT}) as int)").alias("lots"), F.count(F.lit(1)).alias("members")))
    members = skew_join(pairs, lots, ["a"], "members").select("a", F.expr("cast(pmod(xxhash64(b), lots) as int)").alias("lot"), F.lit(1).alias("role"), "b")
    hubs = lots.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("role"), F.col("a").alias("b"))
    roles = cut(_few(hubs.unionByName(members)))
    if roles.count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    # Each text goes once to each lot that needs it.
    rows = docs.join(roles, docs["doc_id"] == roles["b"]).select("a", "lot", "role", "b", "text")
    rows = rows.repartition(n, "a", "lot").sortWithinPartitions("a", "lot", "role", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sets = None, []  # of rows that share the hub's doc_id, all sets
        for batch in (part for b in batches for part in slices(b, "text")):
            found_a, found_b = [], []
            a_col, b_col, roles = (batch.column(c).to_pylist() for c in ("a", "b", "role"))
            for a, b, role, own in zip(a_col, b_col, roles, shingle_sets(batch.column("text")), strict=True):
                if role == 0:
                    sets = [*sets, own] if of == a and sets and not sets_closed else [own]
                    of, sets_closed = a, False
                    continue
                sets_closed = True
                for hub in sets:
                    if alike(own, hub, share):
                        found_a.append(a)
                        found_b.append(b)
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return cut(_few(in_batches(rows.select("a", "b", "role", "text"), check, "a long, b long").distinct()))


def _few(df: DataFrame) -> DataFrame:
    """A table far smaller than the documents, in fewer partitions."""
    return df.coalesce(max(8, parts(df.sparkSession) // 16))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the least node that is reachable."""
    edges = cut(_few(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v")))
    return cut(_union_find(edges) if edges.count() <= ONE_TASK_LINKS else _stars(edges.distinct()))


def _union_find(edges: DataFrame) -> DataFrame:
    """All in one task, for links whose number is known to be small."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "component": pa.array([find(x) for x in nodes], pa.int64())})

    return in_batches(edges.coalesce(1), join, "node long, component long")


def _stars(edges: DataFrame) -> DataFrame:
    """Any number of links (u > v), by rounds.

    Alternates two steps until nothing changes: every node's larger neighbours
    move to its least neighbour (large star), then its smaller ones and itself do (small star).
    (R. Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)
    """
    rounds = Rounds(edges.sparkSession)
    edges, state = rounds.written(edges), None
    while True:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        # in the end all edges of a component share its least node
        least = rounds.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("k")))
        large = rounds.written(skew_join(both, least, ["u"], "k").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct())
        least = rounds.written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")))
        moved = skew_join(large, least, ["u"], "k").select(F.explode(F.expr("array(struct(v as u, m as v), struct(u as u, m as v))")).alias("e")).select("e.u", "e.v")
        edges = rounds.written(moved.where("u <> v").distinct())
        rounds.drop(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.selectExpr("u as node", "v as component").unionByName(edges.selectExpr("v as node", "v as component").distinct())
        state = now


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add the component of each rep; without links it is the rep itself."""
    if labels is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(labels, rows["rep"] == labels["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node")


def _families(rows: DataFrame) -> DataFrame:
    """key, rep, component, n: members of open buckets; buckets that share members have one key.

    If families would take too many estimates, each bucket is a key of its own.
    """
    least = cut(rows.groupBy("bucket").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("members")))
    chains = components(skew_join(rows.select("bucket", "rep"), least, ["bucket"], "members").select(F.col("rep").alias("a"), "b").distinct())
    members = rows.select("rep", "component", "n").distinct().join(chains, F.col("rep") == chains["node"]).select(chains["component"].alias("key"), "rep", rows["component"], "n")
    members = cut(members)
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max("m").alias("t"))
    if (sizes.agg(F.sum(F.col("m").cast("double") * (F.col("m") - F.col("t")))).first()[0] or 0) <= MOST_ESTIMATES:
        return members
    return cut(rows.select(F.col("bucket").alias("key"), "rep", "component", "n").distinct())


def near_duplicates(docs: DataFrame, share: int = 75, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if their shingle sets have at least ``share`` percent of their union
    in common; component_id is the least doc_id that links reach.  Bands and estimates follow from ``share``; ``exact`` confirms
    candidates without looking at their estimate.

    Edge cases: a text without words (or null) has an empty set and no link; a row without
    a doc_id is linked with nothing, has no component and is kept; rows that share a
    doc_id are one document and are linked; an empty table gives an empty result; other
    columns are ignored.  A ``share`` for which no banding exists (under 11) is refused.
    """
    banding(share)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(signatures(docs, share))
    linked = signed.where("doc_id is not null and n_shingles > 0")
    sets = linked.groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    sets = cut(sets)

    tried = links = labels = rows = None
    yields = 1.0
    for step in range(HUB_ROUNDS + 1):
        # Members of the buckets that hold several components.
        if step < 2:
            bands = F.slice("bands", 1, FIRST_BANDS) if step == 0 else F.col("bands")
            dealt = _labelled(sets.select("rep", "n", bands.alias("bands")), labels).select("rep", "n", "component", F.explode("bands").alias("bucket"))
        else:
            dealt = _labelled(rows.select("rep", "n", "bucket"), labels)
        open_ = cut(dealt.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")).where("x < y").select("bucket", "members"))
        if open_.count() <= BROADCAST_ROWS:
            rows = cut(dealt.join(F.broadcast(open_.select("bucket")), "bucket"))
        else:
            rows = cut(skew_join(dealt, open_, ["bucket"], "members"))
        # How many pairs between components are left, counted over buckets.
        sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
        left = sizes.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2), F.lit(0)).alias("pairs"), F.coalesce(F.sum("m"), F.lit(0)).alias("rows")).first()
        if not left["pairs"]:
            if step:
                break
            continue
        last = step and (step == HUB_ROUNDS or left["pairs"] <= 4 * left["rows"] or yields < LEAST_YIELD)
        if last:
            new = compared(_families(rows), docs, share, exact)
            links = new if links is None else links.unionByName(new)
            labels = components(links)
            break
        # One hub a bucket, and of its buckets' hubs each member meets one.
        order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
        hubs = cut(rows.groupBy("bucket").agg(F.min_by(F.struct("rep", "component"), order).alias("h"), F.count(F.lit(1)).alias("members")))
        pairs = skew_join(rows, hubs, ["bucket"], "members").where("component <> h.component").groupBy("rep").agg(F.min("h.rep").alias("a")).select("a", F.col("rep").alias("b"))
        # a pair may come from several buckets, either way round; a stays the hub
        pairs = pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).dropDuplicates(["x", "y"])
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = cut(_few(pairs))
        new = confirmed(pairs.select("a", "b"), docs, share)
        tried = pairs.select("x", "y") if tried is None else tried.unionByName(pairs.select("x", "y"))
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        yields = new.count() / max(1, pairs.count())

    # rows that share a doc_id but not a text are one document
    several = cut(_few(linked.groupBy("doc_id").agg(F.countDistinct("low", "high").alias("k")).where("k > 1").select("doc_id")))
    if several.limit(1).count():
        own = linked.join(several, "doc_id", "left_semi").select("doc_id", "low", "high").distinct().join(sets.select("low", "high", "rep"), ["low", "high"])
        own = own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
        labels = components(own if links is None else links.unionByName(own))
    # What is known of a set goes to all its copies, however many they are.
    known = cut(_labelled(sets.select("low", "high", "rep", "copies"), labels).select("low", "high", "component", "copies"))
    out = skew_join(linked.select("doc_id", "n_shingles", "low", "high"), known, ["low", "high"], "copies").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    others = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
