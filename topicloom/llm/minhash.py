"""Near dedup by b-bit MinHash.

1. Each document becomes the set of its distinct ``SHINGLE``-word shingles
   (64-bit hashes of lower-cased words). Documents of equal sets form a class,
   and only the smallest id of each class goes on, so copies are never paired.
2. Of ``BANDS * ROWS`` minima each, a band's full minima give the bucket key; of
   each minimum the lowest ``BITS`` bits are kept and packed into the signature.
3. Candidates: every member of a bucket meets the bucket's smallest id, so a
   bucket of n gives n - 1 pairs. A pair goes on where the similarity estimated
   from equal signature bits, corrected for chance collisions, is within
   ``MARGIN`` standard errors of the threshold.
4. Candidates are confirmed on full sets; confirmed links give components.
5. Members of a bucket that are still in different components might be linked
   without the smallest id being linked to either. Blocks of a bucket are
   compared by signature and give a spanning forest of the estimated pairs, not
   the pairs. Its trees, over all buckets, are clusters. Each document is in one
   cluster at most, so its full set is sent once per pair of blocks of that
   cluster, however many buckets it shares; links between different components
   are confirmed there. See :func:`cross_blocks` for the size of this step.

A pair at the threshold 0.85 shares no band with probability (1 - 0.85**4)**24,
about 2e-8, and is estimated too low with probability of about 1e-9 at a margin
of 6 standard errors. The stage ``keep_one`` links from 0.80 on, where a pair
shares no band with probability of about 3e-6.

Defined cases: a null text, or one without words, has the empty set and is linked
with nothing; a text of fewer words than a shingle is one shingle of them all;
every row is a document of its own, whether its id is null or repeated (rows are
then told apart by their place among the sorted ids, null ones last, and a
component is named by the id of its first row); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.shared import Words, Workspace, bounded_batches, by_hash, grams, lookup, mix, proper_ids, signed, with_row_key

SHINGLE, BANDS, ROWS, BITS, MARGIN = 5, 24, 4, 4, 6.0
PERCENT = 85  # of near_dedup
STAGE_PERCENT = 80  # of keep_one
BLOCK, WEIGHT, SALTS = 512, 2**20, 16  # members and shingles of a block
EMPTY = b""

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the permutations of 32-bit values."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words([t.translate(_UPPER) for t in texts])
    every = grams(words.hash, size)
    out = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(grams(words.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The minimum of each permutation over each set, none of which is empty."""
    mult, add = _factors(count)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(x * mult[k] + add[k], starts)
    return out


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """Signatures: the lowest bits of each minimum, bit plane after bit plane."""
    planes = [np.packbits((low >> np.uint32(b)) & np.uint32(1), axis=1) for b in range(bits)]
    return np.concatenate(planes, axis=1)


def similarity(a: np.ndarray, b: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Similarity estimated by bit counts: minima whose bits all agree, corrected for those that agree by chance."""
    differ = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], bits, -1)
    unlike = np.bitwise_count(np.bitwise_or.reduce(differ, axis=-2)).sum(axis=-1, dtype=np.int64)
    chance = 0.5**bits
    return ((1 - unlike / count) - chance) / (1 - chance)


def least_estimate(percent: int, count: int, bits: int, margin: float) -> float:
    t, chance = percent / 100, 0.5**bits
    p = t + (1 - t) * chance
    return t - margin * (p * (1 - p) / count) ** 0.5 / (1 - chance)


def _document_rows(size: int, bands: int, rows: int, bits: int):
    """id, number of shingles, digest of the set, signature, bucket keys. Columns: id, text. Equal sets of a batch share one signature."""

    def batches(it):
        for batch in it:
            sets = shingle_sets(_texts(batch.column(1)), size)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else EMPTY for s in sets]
            place, own = {EMPTY: -1}, []
            for d, s in zip(digests, sets, strict=True):
                if d not in place:
                    place[d] = len(own)
                    own.append(s)
            sigs, lists = [EMPTY], [[]]
            if own:
                low = minima(own, bands * rows)
                keys = np.zeros((len(own), bands), np.uint64)
                for k in range(rows):
                    keys = mix(keys ^ low[:, k::rows].astype(np.uint64)) + np.uint64(k)
                keys = signed(mix(keys + np.arange(bands, dtype=np.uint64)))
                sigs, lists = [s.tobytes() for s in packed(low, bits)] + sigs, [*keys, *lists]
            at = [place[d] for d in digests]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([sigs[k] for k in at], pa.binary()), pa.array([lists[k] for k in at], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "sig", "keys"])

    return batches


def _own_sets(size: int):
    def batches(it):
        for batch in it:
            sets = shingle_sets(_texts(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    return batches


def _estimated(count: int, bits: int, least: float):
    """Pairs whose estimate is high enough. Columns: a, b, chunk, sig_a, sig_b."""

    def batches(it):
        for batch in it:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (3, 4))
            if batch.num_rows:
                yield batch.select(["a", "b", "chunk"]).filter(pa.array(similarity(a, b, count, bits) >= least))

    return batches


def _confirmed(percent: int):
    """Pairs whose sets are similar. Columns: a, b, set of a, set of b."""

    def batches(it):
        for batch in it:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return batches


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(id, component) of all linked ids: least label of the neighbours, with pointer jumping, until nothing changes.

    A hub's label reaches its neighbours through :func:`lookup`, as one id may have most of the links.
    """
    edges = work.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = work.table(edges.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = lookup(edges, "b", labels.withColumnRenamed("id", "b"), by_hash("a")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        new = lookup(new, "to", jump, by_hash("id")).select("id", "old", F.least("to", "far").alias("component"))
        new = work.table(new, "labels")
        labels = new.select("id", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def cross_blocks(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Rows dealt to pairs of blocks (i, j), so that members of one group but different components meet.

    rows: group, salt, id, component, and the rest. Members of a group's largest
    component need no comparison with each other: side 0 of a block pair holds
    the other members, side 1 all of them. With r members outside the largest
    component, each member is sent to about r / ``BLOCK`` pairs. ``size`` weighs
    a member; blocks hold about ``WEIGHT`` and at most about ``BLOCK`` members.
    """
    parts = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("w"))
    most = F.max(F.struct("n", "w", "component"))
    whole = parts.groupBy(group).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w"), most.alias("most")).filter("parts > 1")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(w / WEIGHT)).cast("int")
    whole = whole.select(group, F.col("most.component").alias("major"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("outer"), blocks(F.col("n"), F.col("w")).alias("inner"))
    whole = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.join(whole, [group, "salt"]).withColumn("_h", F.xxhash64("id"))
    one = "transform(sequence(0, outer - 1), x -> struct(x as i, cast(pmod(_h, inner) as int) as j, 1 as side))"
    two = "if(component = major, array(), transform(sequence(0, inner - 1), x -> struct(cast(pmod(_h, outer) as int) as i, x as j, 0 as side)))"
    return met.withColumn("at", F.explode(F.expr(f"concat({one}, {two})"))).select(group, "at.i", "at.j", "at.side", *[c for c in rows.columns if c not in (group, "salt")])


def _forest(count: int, bits: int, least: float):
    """Trees of members that pairs of different components, estimated to be similar, connect: each member with its tree's smallest id.

    Buckets that share members mostly share that id as well, so few of these pairs are different.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group.side == 0], group[group.side == 1]
        if len(a) and len(b):
            sig_a, sig_b = (np.frombuffer(b"".join(x.sig), np.uint8).reshape(len(x), -1) for x in (a, b))
            ids_a, ids_b, comps_a, comps_b = a.id.to_numpy(), b.id.to_numpy(), a.component.to_numpy(), b.component.to_numpy()
            tree, tree_a = np.arange(len(b)), np.full(len(a), -1)
            step = max(1, 2**16 // len(b))
            for at in range(0, len(a), step):
                some = slice(at, at + step)
                like = (similarity(sig_a[some, None], sig_b[None], count, bits) >= least) & (comps_a[some, None] != comps_b[None])
                for k in np.flatnonzero(like.any(axis=1)):
                    trees = np.unique(tree[like[k]])
                    if len(trees) > 1:
                        tree[np.isin(tree, trees)] = trees[0]
                    tree_a[at + k] = np.flatnonzero(like[k])[0]  # a place in b, whose tree may still change
            met = tree_a >= 0
            member = pd.DataFrame({"tree": np.concatenate([tree, tree[tree_a[met]]]), "b": np.concatenate([ids_b, ids_a[met]])})
            member["a"] = member.groupby("tree")["b"].transform("min")
            return member[member.a < member.b][["a", "b"]]
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return compare


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence matrices of ``width`` shingles at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    sides = []
    for sets in (a, b):
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(common, every)
        place[place == len(common)] = 0
        hit = common[place] == every if len(common) else np.zeros(len(every), bool)
        order = np.argsort(place[hit], kind="stable")
        sides.append((row[hit][order], place[hit][order]))
    for at in range(0, len(common), width):
        ms = []
        for (row, place), sets in zip(sides, (a, b), strict=True):
            lo, hi = np.searchsorted(place, [at, at + width])
            m = np.zeros((len(sets), min(width, len(common) - at)), np.float32)
            m[row[lo:hi], place[lo:hi] - at] = 1
            ms.append(m)
        out += (ms[0] @ ms[1].T).astype(np.int64)
    return out


def _block_links(percent: int):
    """Links between two blocks, found on full sets: as many as join the components that they connect, so fewer than members."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group.side == 0], group[group.side == 1]
        found, parent = [], {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        if len(a) and len(b):
            sets_a, sets_b = ([np.frombuffer(x, np.uint64) for x in side.shingles] for side in (a, b))
            both = intersections(sets_a, sets_b)
            sizes = np.array([len(x) for x in sets_a])[:, None] + np.array([len(x) for x in sets_b])[None]
            ids_a, ids_b, comps_a, comps_b = a.id.to_numpy(), b.id.to_numpy(), a.component.to_numpy(), b.component.to_numpy()
            for x, y in np.argwhere((100 * both >= percent * (sizes - both)) & (comps_a[:, None] != comps_b[None])):
                p, q = root(int(comps_a[x])), root(int(comps_b[y]))
                if p != q:
                    parent[q] = p
                    found.append((min(ids_a[x], ids_b[y]), max(ids_a[x], ids_b[y])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return compare


def _components_of(own: DataFrame, size: int, percent: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(id, n, component) of rows (id, text) whose ids are present and distinct."""
    spark = own.sparkSession
    bounded_batches(spark)
    work = Workspace(spark, "near-dedup")
    count, least = bands * rows, least_estimate(percent, bands * rows, bits, MARGIN)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = work.table(own.mapInArrow(_document_rows(size, bands, rows, bits), "id long, n long, digest binary, sig binary, keys array<long>"), "documents")
    classes = work.table(sized.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    firsts = work.table(sized.filter("n > 0").select("id", "n", "sig", "keys").join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "signatures")
    sig = firsts.select("id", "sig")
    # buckets of at least two members, with their smallest id; a bucket's members are spread over salts
    members = firsts.select("id", F.explode("keys").alias("bucket")).withColumn("salt", by_hash("id", SALTS))
    hubs = members.groupBy("bucket", "salt").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.min("a").alias("a"), F.sum("n").alias("members")).filter("members > 1")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = work.table(members.join(hubs, ["bucket", "salt"]), "buckets")
    # each member with its bucket's smallest; a hub's pairs come in chunks
    stars = shared.filter("a < id").groupBy("a", F.col("id").alias("b")).agg(F.max("members").alias("members"))
    stars = stars.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BLOCK)).alias("chunk"))
    stars = lookup(stars, "a", sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), F.col("chunk")).join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = work.table(stars.select("a", "b", "chunk", "sig_a", "sig_b").mapInArrow(_estimated(count, bits, least), "a long, b long, chunk long"), "stars")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), own, size, work)
    both = lookup(pairs, "a", sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), F.col("chunk")).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = work.table(both.select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    labels = components(links, work)
    # members of a bucket that are in different components: clusters of those that may be similar
    placed = shared.filter("members > 2").select("bucket", "salt", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("one", F.lit(0))
    blocks = cross_blocks(placed, "bucket", "one").join(sig, "id")
    keys = ["bucket", "i", "j"]
    forest = work.table(blocks.repartition(parts, *keys).groupBy(*keys).applyInPandas(_forest(count, bits, least), "a long, b long").distinct(), "forest")
    if not forest.isEmpty():
        clusters = components(forest, work).withColumnRenamed("component", "cluster").withColumn("salt", by_hash("id", SALTS))
        sets = _sets_of(clusters.select("id"), own, size, work)
        full = clusters.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).join(firsts.select("id", "n"), "id")
        full = cross_blocks(full, "cluster", "n").join(sets, "id")
        keys = ["cluster", "i", "j"]
        more = work.table(full.repartition(parts, *keys).groupBy(*keys).applyInPandas(_block_links(percent), "a long, b long"), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more), work)
    ends = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    found = lookup(sized.filter("n > 0").select("id", "n", "digest"), "digest", ends, by_hash("id")).select("id", "n", "component")
    return work.keep(found.unionByName(sized.filter("n = 0").select("id", "n", F.col("id").alias("component"))), "near-groups")


def _sets_of(ids: DataFrame, own: DataFrame, size: int, work: Workspace) -> DataFrame:
    """(id, shingles): the full sets of some documents, each read and sent once."""
    return work.table(own.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_own_sets(size), "id long, shingles binary"), "sets")


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    own = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"))
    if proper_ids(own, "own"):
        found = _components_of(own.withColumnRenamed("own", "id"), size, percent, bands, rows, bits)
        return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    keyed = with_row_key(own, "own", "id")
    found = _components_of(keyed.select("id", "text"), size, percent, bands, rows, bits).join(keyed.select("id", F.col("own").alias("doc_id")), "id")
    named = lookup(found, "component", keyed.select(F.col("id").alias("component"), F.col("own").alias("component_id")), by_hash("id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = STAGE_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, the first by id; every row is a document of its own, those of null id come last."""
    rows = with_row_key(docs, id_col, "_row")
    own = rows.select(F.col("_row").alias("id"), F.col(text_col).alias("text"))
    gone = _components_of(own, SHINGLE, percent, BANDS, ROWS, BITS).filter("id <> component").select(F.col("id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(docs.columns)
