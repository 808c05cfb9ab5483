"""MinHash near-dedup by tensored banding, with exact verification.

A document's set holds its distinct shingles of words. Twelve small collections of two minhashes each are computed, and a table's key combines two
collections: 24 minhashes give the 66 tables (of four minhashes each) for which plain banding would compute 264. Two documents meet if two of their
twelve collections agree; at a similarity of 0.8 all tables miss a pair once in about ten thousand, and more rarely above.

Documents with equal sets are one representative, so exact copies cost nothing further. Of a representative's collections only those
count that another one shares. Each table's bucket of two is a pair; in larger ones every member is paired with the smallest
first. Pairs that can be similar by their sizes are verified on full sets, and verified links make components. Where a bucket
still holds several components, its members of different ones are compared as well, so that no link is lost: pair by pair in
buckets of up to SMALL members, in larger ones by blocks of sets (a product of matrices a pair of blocks, which sends a root a
member). Members of one component are not compared again, and no pair of different ones is left out by a limit.

Null texts and texts without words have an empty set and link with nothing; nor do rows without an id, which get a null component.
An id is one document: rows that repeat it are linked, whatever their texts, and each has the size of its own set. Ties don't arise,
since the smallest id names a component and results don't depend on the order of rows. Whole texts count, of any length. An
empty table gives an empty result, and columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, map_batches, remembered, slices, stored
from .graph import components
from .neighbours import settle

COLLECTIONS, HASHES = 12, 2
#: Members of a bucket up to which they are compared pair by pair; sets of a block.
SMALL, BLOCK = 32, 256
#: Shingles for which a set takes one of a block's places; larger ones take several.
UNIT = 4_096
REMEMBERED = 300_000


class Words(dict):
    """Remembers the 64-bit hash of each word it has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of width words; of fewer words the whole sequence is one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(remembered(Words, Words).__getitem__, found), np.uint64, len(found))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * _MIX[0] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def minhashes(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """A row of least hashes a set, none of which may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(mixed(flat * a + b), starts) for a, b in seeds], 1)


def seeds_of(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, (COLLECTIONS * HASHES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """docs: id, text and digest. id, digest, n (size of the set), key (of the set; null if it is empty) and collections."""
    seeds = seeds_of(seed)

    def run(columns: list) -> Iterator[tuple]:
        ids, digests, texts = columns
        for a in range(0, len(ids), 256):
            sets = [shingles(t, width) for t in texts[a : a + 256]]
            full = [s for s in sets if len(s)]
            least = iter(minhashes(full, seeds) if full else [])
            for i, d, s in zip(ids[a : a + 256], digests[a : a + 256], sets, strict=True):
                if not len(s):
                    yield i, d, 0, None, None
                    continue
                row = next(least).reshape(COLLECTIONS, HASHES)
                both = np.zeros(COLLECTIONS, np.uint64)
                for k in range(HASHES):
                    both = mixed(both * _MIX[0] + row[:, k])
                yield i, d, len(s), set_key(s), both.view(np.int64).tolist()

    return map_batches(docs.select("id", "digest", "text"), run, "id bigint, digest bigint, n bigint, key binary, collections array<bigint>")


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """id and set (binary) of the representatives in reps (id, doc, key): shingled anew, for those that need it only."""

    def run(columns: list) -> Iterator[tuple]:
        for i, key, text in zip(*columns, strict=True):
            s = shingles(text, width)
            if set_key(s) == bytes(key):
                yield i, s.tobytes()

    # merged at every size, so that a small table's plan and figures are those of a large one
    rows = docs.select(F.col("id").alias("doc"), "text").join(reps.select("id", "doc", "key").hint("merge"), "doc").select("id", "key", "text")
    return map_batches(rows, run, "id bigint, set binary").groupBy("id").agg(F.first("set").alias("set"))


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                a, b, sa, sb = [c.to_pylist() for c in part.columns]
                hit = []
                for x, y in zip(sa, sb, strict=True):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = np.concatenate([x, y])
                    both.sort()
                    hit.append(bool(similar(np.count_nonzero(both[1:] == both[:-1]), len(x), len(y), percent)))
                kept = [pa.array([i for i, h in zip(side, hit, strict=True) if h], pa.int64()) for side in (a, b)]
                yield pa.RecordBatch.from_arrays(kept, ["a", "b"])

    side = lambda k: sets.select(F.col("id").alias(k), F.col("set").alias(f"s{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets of two lists, by products of 0/1 matrices over the elements that both lists have."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for sets, flat in ((x, fx), (y, fy)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        good = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == flat) if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[good], kind="stable")
        sides.append((row[good][order], at[good][order]))
    for a in range(0, len(shared), columns):
        m = []
        for (row, at), sets in zip(sides, (x, y), strict=True):
            k = slice(np.searchsorted(at, a), np.searchsorted(at, a + columns))
            one = np.zeros((len(sets), min(columns, len(shared) - a)), np.float32)
            one[row[k], at[k] - a] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def by_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: bucket, id, n (size of its set) and component. Links a, b between all ids of different components that share a
    bucket, as a root a member and pair of blocks.

    Ids go to blocks by their smallest bucket, so a bucket lies in few of them. Many ids of one bucket and component have blocks
    of their own (by the hash of the id), so that members of one component don't meet; the others of a bucket share blocks, or those
    of several buckets do, if they are few. A block holds about BLOCK sets, fewer if they are large. Blocks meet if a bucket is in both.
    """
    # what a set takes of a block
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") / UNIT)).cast("bigint")
    order = members.groupBy("id").agg(F.min("bucket").alias("first"), F.first("component").alias("component"), F.first("n").alias("n"))
    order = stored(order.withColumn("w", weight))
    by_component = order.groupBy("first", "component").agg(F.sum("w").alias("w_component"))
    large = by_component.where(F.col("w_component") >= BLOCK // 2)
    small = by_component.where(F.col("w_component") < BLOCK // 2).groupBy("first").agg(F.sum("w_component").alias("w_first"))
    few = small.where(F.col("w_first") < BLOCK // 2).agg(F.coalesce(F.sum("w_first"), F.lit(0)).alias("w_few"))
    rows = order.join(large, ["first", "component"], "left").join(small, "first", "left").crossJoin(F.broadcast(few))
    share = lambda key, w: F.pmod(F.xxhash64(key), F.ceil(w / BLOCK).cast("bigint"))
    own = F.col("w_component").isNotNull()
    block = (
        F.when(own, F.xxhash64(F.lit(2), "first", "component", share("id", F.col("w_component"))))
        .when(F.col("w_first") >= BLOCK // 2, F.xxhash64(F.lit(1), "first", share("id", F.col("w_first"))))
        .otherwise(F.xxhash64(F.lit(0), share("first", F.col("w_few"))))
    )
    of_id = stored(rows.select("id", "component", block.alias("block"), F.when(own, F.col("component")).alias("only")))
    rows = of_id.join(sets, "id").groupBy("block").agg(F.first("only").alias("only"), F.array_sort(F.collect_list(F.struct("id", "component", "set"))).alias("x"))
    each = lambda f, name: F.transform("x", lambda x: x[f]).alias(name)
    blocks = stored(rows.select("block", "only", each("id", "ids"), each("component", "components"), each("set", "sets")))
    of = members.join(of_id.select("id", "block", "only"), "id").select("bucket", "block", "only").distinct()
    one, two = [of.select("bucket", F.col("block").alias(f"b{k}"), F.col("only").alias(f"only{k}")) for k in (1, 2)]
    apart = F.col("only1").isNull() | F.col("only2").isNull() | (F.col("only1") != F.col("only2"))
    meet = one.join(two, "bucket").where((F.col("b1") <= F.col("b2")) & apart).select("b1", "b2").distinct()
    side = lambda k: blocks.select(F.col("block").alias(f"b{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("ids", "components", "sets")])
    pairs = meet.join(side(1), "b1").join(side(2), "b2").select("ids1", "components1", "sets1", "ids2", "components2", "sets2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids1, c1, sets1, ids2, c2, sets2 = [c[k].as_py() for c in batch.columns]
                x, y = [[np.frombuffer(x, "<u8") for x in s] for s in (sets1, sets2)]
                sizes = [np.array([len(s) for s in z]) for z in (x, y)]
                hit = similar(overlaps(x, y), sizes[0][:, None], sizes[1][None, :], percent)
                hit &= np.array(c1)[:, None] != np.array(c2)[None, :]
                ids = np.unique(np.array([*ids1, *ids2], np.int64))
                root = np.arange(len(ids))
                i, j = np.nonzero(hit)
                settle(root, np.searchsorted(ids, np.array(ids1)[i]), np.searchsorted(ids, np.array(ids2)[j]))
                at = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_pydict({"a": ids[root[at]], "b": ids[at]})

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 1, small: int = SMALL) -> DataFrame:
    """Per row of docs: the id, n_shingles long, component_id (the smallest id reachable by links, itself included) and kept.
    A link has 100 * intersection >= percent * union. Ids are whole numbers."""
    rows = grouped(docs, id_col=id_col, text_col=text_col, width=width, percent=percent, seed=seed, small=small)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 1, small: int = SMALL) -> DataFrame:
    """Stored, per row of docs: id, digest (xxhash64 of its text), n, component, and one: whether its set is the one that stands for the
    component, which is of the smallest id."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    seen = stored(sketches(docs, width, seed))
    full = seen.where("key IS NOT NULL AND id IS NOT NULL")
    # a representative a set, with a number of its own: an id may come with several texts
    reps = full.groupBy("key").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("collections").alias("collections"))
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()))
    size = reps.select("id", "n")
    # only collections that two representatives share can put them into one bucket
    own = reps.select("id", F.explode(F.transform("collections", lambda v, k: F.xxhash64(k, v))).alias("c"))
    shared = own.groupBy("c").agg(F.count("*").alias("members")).where("members > 1").select("c")
    live = own.join(shared, "c", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("live"))
    live = stored(live.where(F.size("live") > 1))
    rest = lambda k: F.slice("live", k + 2, F.size("live"))
    tables = F.flatten(F.transform("live", lambda x, k: F.transform(rest(k), lambda y: F.xxhash64(x, y))))
    entries = live.select("id", F.explode(tables).alias("bucket"))
    buckets = stored(entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("first"), F.max("id").alias("last")).where("members > 1"))
    members = stored(entries.join(buckets.where("members > 2").select("bucket", "members", "first"), "bucket"))
    twos = buckets.where("members = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = stored(sized(twos.unionByName(stars).distinct(), size, percent))
    # texts are read once more, for all that may be compared: by pairs here, and within large buckets below
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct()
    needed = stored(reps.join(needed, "id").select("id", "doc", "key"))
    sets = stored(sets_of(docs, needed, width))
    freed(live, buckets, needed)
    links = stored(verified(pairs, sets, percent))
    known = components(links)
    all_members = members
    members = members.join(known, "id", "left").select("bucket", "id", "members", F.coalesce("component", "id").alias("component"))
    open_ = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    members = stored(members.join(open_, "bucket").join(size, "id"))
    freed(all_members, known)
    few = members.where(F.col("members") <= small)
    x, y = [few.select("bucket", F.col("id").alias(s), F.col("component").alias(f"c{s}")) for s in "ab"]
    cross = sized(x.join(y, "bucket").where("a < b AND ca <> cb").select("a", "b").distinct(), size, percent)
    cross = stored(cross.join(pairs, ["a", "b"], "left_anti"))
    many = members.where(F.col("members") > small).select("bucket", "id", "n", "component")
    more = stored(verified(cross, sets, percent).unionByName(by_blocks(many, sets, percent)))
    freed(sets, members, cross, pairs)
    found = components(links.unionByName(more).unionByName(_of_one_id(full, reps)))
    freed(links, more)
    out = stored(_named(seen, reps, found))
    freed(seen, reps, found)
    return out


def _of_one_id(full: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs a, b of representatives that share an id: a document with several texts."""
    h = F.xxhash64("key")
    several = full.groupBy("id").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select(F.col("id").alias("doc"))
    of = full.select(F.col("id").alias("doc"), "key").join(several, "doc", "left_semi").distinct().join(reps.select("key", "id"), "key")
    first = of.groupBy("doc").agg(F.min("id").alias("a"))
    return of.join(first, "doc").where("id <> a").select("a", F.col("id").alias("b"))


def _named(seen: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """Components of representatives (found) as the smallest ids of their documents, a row a row of seen."""
    of = found.join(reps.select("id", "doc"), "id")
    least = of.groupBy("component").agg(F.min(F.struct("doc", "id")).alias("least"))
    of_rep = reps.select("key", "id", "doc").join(found, "id", "left").join(least, "component", "left")
    of_rep = of_rep.select("key", "doc", F.coalesce("least.doc", "doc").alias("component"), F.coalesce(F.col("least.id") == F.col("id"), F.lit(True)).alias("stands"))
    full = seen.where("key IS NOT NULL AND id IS NOT NULL").join(of_rep, "key")
    full = full.select("id", "digest", "n", "component", (F.col("stands") & (F.col("id") == F.col("doc"))).alias("one"))
    rest = seen.where("key IS NULL OR id IS NULL")
    return full.unionByName(rest.select("id", "digest", "n", F.col("id").alias("component"), F.lit(True).alias("one")))


def sized(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose sizes allow the similarity."""
    rows = pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return rows.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")

