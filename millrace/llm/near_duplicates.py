"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is its set of distinct 5-word shingles (64-bit hashes). Sets fall into size bands whose bounds
grow by 1/0.8, so linked sets lie in one band or two neighbouring ones; each set signs for both
pairs of bands that it belongs to. In a pair of bands, linked sets differ in at most k shingles. The hash domain
is cut into n1 partitions of three parts each; as n1 > k / 2, some partition differs in at most one
part, so enumerating the two-part subsets of every partition gives a signature in common. Signatures
of two empty parts are left out: a set for which that could break the guarantee also signs by the shingles of its prefix (in hash
order), and two such sets meet there. So no link is lost.

Candidates are never expanded to all pairs of a group. Documents with equal sets are one class.
Within a block of a scan, classes that share a signature are compared with the least of them at
once; those that match travel no further, so a huge group of near copies sends one row per
block and signature. In the shuffle, a bucket of at most HOT classes gives its few pairs. One of more comes from a group of near copies or from a passage that many
documents share. A class whose other signatures still keep the guarantee leaves such buckets; only classes that
depend on them are joined among themselves by the rarest shingles of their prefixes (rarity counted exactly
over them), each paired with the least class of a shingle only. So a common passage pairs nothing, and a group of near
copies does not expand to all pairs. Candidates pass an exact lower bound on the difference (parities of 1,024
buckets), then the sets themselves are compared. A class that its star leaves in another component is
then compared with the others of that star, less those that the triangle inequality rules
out. That completes the join: links within a component that is already joined need not be known.

Defined cases: null and empty texts (or white space alone) have no shingles and are components of
their own; a null id has a null component and links nothing; repeated rows are exact copies, and rows of one id share its
component's name though their texts differ; very long texts are read whole; ties go to the least id; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.bpe import blocks
from millrace.llm.common import Scratch, cut, gathered, lean, packed, release, small_or_not, stored, table
from millrace.llm.components import connected_components
from millrace.llm.line_dedup import prefix_length, shared_tokens

WORDS, LEAST, OF = 5, 80, 100
#: Linked sets differ in at most LEAST_SUM / OF_SUM of their summed sizes.
LEAST_SUM, OF_SUM = OF - LEAST, OF + LEAST
PARTS, SKETCH_BITS = 3, 1024
#: Classes in a bucket beyond which it is left to those that depend on it.
HOT = 8
COLD, KNOWN, CROWDED, SLACK = range(4)
#: Classes of a star that meet all the others first, before the rest do.
PIVOTS = (32,)
MEASURED = ["a", "b", "n_a", "n_b", "differ", "linked"]
#: Ids that may be broadcast to pick documents out of the scan; beyond it they are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Pairs of classes, and classes, that may be broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 400_000
#: Bytes of signatures that one task of the shuffle should read.
TASK_BYTES = 8_000_000
#: Characters of text whose sets a task holds at once.
BLOCK_CHARS = 1_500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; words are divided by ASCII white space, A-Z are lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(len(words), size)
    if not n:
        return h
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _ODD[i]
    return np.unique(mixed(total))


def set_key(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles in SKETCH_BITS places, as 64-bit integers."""
    at = (s & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def least_different(a: str, b: str) -> Column:
    """A lower bound of the difference of two sets by their sketches: places with other parity."""
    words = (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64))
    return sum(words, F.lit(0)).cast("long")


def linked(common: int, a: int, b: int) -> bool:
    return OF * common >= LEAST * (a + b - common)


def most_different(total: int) -> int:
    """Most shingles in which two linked sets of `total` shingles together can differ."""
    return total * (OF - LEAST) // (OF + LEAST)


def band_tops() -> np.ndarray:
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * OF // LEAST))
    return np.array(tops, dtype=np.int64)


TOPS = band_tops()


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of one set for the band pairs (band - 1, band) and (band, band + 1), and how many of
    them may be left out without loss (negative: the set also signs by its prefix and needs all)."""
    band = int(np.searchsorted(TOPS, len(s)))
    out, slack = [], 1 << 40
    for pair in (band, band + 1):
        k = most_different(2 * int(TOPS[pair]))
        n1 = k // 2 + 1 + (k // 20 + 1 if k else 0)
        seed = mixed(np.array([pair], dtype=np.uint64))[0]
        at = (mixed(s ^ seed) % np.uint64(PARTS * n1)).astype(np.int64)
        count = np.bincount(at, minlength=PARTS * n1).reshape(n1, PARTS)
        total = np.zeros(PARTS * n1, dtype=np.uint64)
        np.add.at(total, at, mixed(s + seed))
        total = total.reshape(n1, PARTS)
        # a signature is a partition without one of its parts
        rest = total.sum(axis=1, dtype=np.uint64)[:, None] - total
        full = count.sum(axis=1)[:, None] - count > 0
        place = np.arange(PARTS * n1, dtype=np.uint64).reshape(n1, PARTS) * _ODD[0] + seed
        out.append(mixed(rest + mixed(place))[full])
        spare = int(full.all(axis=1).sum()) - k // 2 - 1
        slack = min(slack, spare)
        if spare < 0:
            prefix = s[: len(s) - (-(-len(s) * LEAST // OF)) + 1]
            out.append(mixed(prefix ^ mixed(np.array([pair + (1 << 20)], dtype=np.uint64))[0]))
    return np.unique(np.concatenate(out)), slack


def _sets(batches) -> Iterator[tuple]:
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column("text")
        for begin, end in blocks(pc.binary_length(texts).fill_null(0).to_pylist(), BLOCK_CHARS):
            yield batch, begin, end, [shingles(t) for t in texts.slice(begin, end - begin).to_pylist()]


def document_sets(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key of the set (null if empty), its parity sketch."""

    def run(batches):
        import pyarrow as pa

        for batch, begin, end, sets in _sets(batches):
            columns = [
                batch.column("doc_id").slice(begin, end - begin),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "sketch"])

    return documents.mapInArrow(lean(run), "doc_id long, n_shingles long, key long, sketch array<bigint>")


def local_links(keys: np.ndarray, sets: list[np.ndarray], sigs: list[np.ndarray]):
    """Of one block's classes: rows to shuffle (owner by index, signature, classes it stands for), verified
    (least, other, difference) with the two by index, and the rows that each class left out.

    Only buckets of over HOT classes in this block alone are thinned out: those are crowded in any case.
    """
    size = np.array([len(x) for x in sigs], dtype=np.int64)
    owner, sig = np.repeat(np.arange(len(sigs)), size), np.concatenate(sigs)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    order = np.lexsort((rank[owner], sig))
    owner, sig = owner[order], sig[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    count = np.diff(np.append(first, len(sig)))
    bucket = np.repeat(np.arange(len(first)), count)
    others = np.flatnonzero((count[bucket] > HOT) & (np.arange(len(sig)) != first[bucket]))
    weight, left_out = np.ones(len(sig), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    if not len(others):
        return owner, sig, weight, np.zeros((0, 3), np.int64), left_out
    head = first[bucket[others]]
    distinct, place = np.unique(owner[head] * len(keys) + owner[others], return_inverse=True)
    match, differ = np.zeros(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=np.int64)
    for i, p in enumerate(distinct.tolist()):
        a, b = sets[p // len(keys)], sets[p % len(keys)]
        if LEAST * max(len(a), len(b)) <= OF * min(len(a), len(b)):
            common = len(np.intersect1d(a, b, assume_unique=True))
            match[i], differ[i] = linked(common, len(a), len(b)), len(a) + len(b) - 2 * common
    gone = others[match[place]]
    np.add.at(weight, head[match[place]], 1)
    np.add.at(left_out, owner[gone], 1)
    keep = np.ones(len(sig), dtype=bool)
    keep[gone] = False
    found = distinct[match]
    pairs = np.stack([found // len(keys), found % len(keys), differ[match]], axis=1)
    return owner[keep], sig[keep], weight[keep], pairs, left_out


def owner_number(task: int, block: int) -> int:
    """Of the first class of a task's block; a block has fewer than 2 ** 24 classes."""
    return (task << 38) + (block << 24)


def block_links(documents: DataFrame, parts: int) -> DataFrame:
    """Rows (part, kind, a, b, c) of packed integers: COLD has owners (the block's number, then each class's place in it), their
    signatures of that part and how many classes each stands for, KNOWN links found within a block and their differences,
    SLACK classes, their slack and their owner numbers."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen: set[int] = set()
        task = TaskContext.get().partitionId()  # the same if the task is run again
        for block, (_, _, _, sets) in enumerate(_sets(batches)):
            first = owner_number(task, block)
            new = {}
            for s in sets:
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    new[key] = s
            if not new:
                continue
            keys = np.array(list(new), dtype=np.int64)
            signed = [signatures(s) for s in new.values()]
            slack = np.array([x for _, x in signed], dtype=np.int64)
            owner, sig, weight, pairs, left_out = local_links(keys, list(new.values()), [x for x, _ in signed])
            slack -= left_out  # all that was left out stood in crowded buckets
            del signed
            part = (sig % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part * len(keys) + owner, kind="stable")
            owner, sig, weight, part = owner[order].astype(np.int32), sig[order], weight[order], part[order]
            edge = np.append(0, np.flatnonzero(np.diff(part)) + 1)
            rows = [
                (int(p), COLD, np.int64(first).tobytes() + o.tobytes(), x.tobytes(), w.tobytes())
                for p, o, x, w in zip(part[edge], *(np.split(v, edge[1:]) for v in (owner, sig, weight)), strict=True)
            ]
            own = int(keys[0]) % parts
            rows.append((own, SLACK, keys.tobytes(), slack.tobytes(), (first + np.arange(len(keys))).tobytes()))
            if len(pairs):
                rows.append((own, KNOWN, keys[pairs[:, 0]].tobytes(), keys[pairs[:, 1]].tobytes(), pairs[:, 2].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "kind", "a", "b", "c"]
            )

    return documents.mapInArrow(lean(run), "part long, kind int, a binary, b binary, c binary")


def bucket_stars(rows: DataFrame) -> DataFrame:
    """Rows (kind, a, b, c): COLD two owners of a bucket of at most HOT; KNOWN a verified link of classes and its
    difference; CROWDED a signature and an owner of a bucket over HOT; SLACK a class, its slack and its owner number."""

    def run(batches):
        import pyarrow as pa

        def out(kind, a, b, c=None):
            c = np.zeros(len(a), np.int64) if c is None else c
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), *[pa.array(x, pa.int64()) for x in (a, b, c)]],
                names=["kind", "a", "b", "c"],
            )

        cold, n = [], 0
        for batch in batches:
            for kind, *places in zip(batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4)), strict=True):
                # views of the batch's own bytes: nothing is copied before all is known
                owners, *places = (x.as_buffer() for x in places)
                b, c = (np.frombuffer(x, dtype=np.int64) for x in places)
                if kind == COLD:
                    cold.append((int(np.frombuffer(owners, np.int64, 1)[0]), np.frombuffer(owners, np.int32, offset=8), b, c))
                    n += len(b)
                elif len(b):
                    yield out(kind, np.frombuffer(owners, dtype=np.int64), b, c)
        if not n:
            return
        sig = np.concatenate([b for _, _, b, _ in cold])
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        key = np.concatenate([first + at.astype(np.int64) for first, at, _, _ in cold])
        weight = np.concatenate([c.astype(np.int32) for _, _, _, c in cold])
        del cold, batch
        equal = sig[1:] == sig[:-1]
        many = np.flatnonzero(np.append(equal, False) | np.append(False, equal) | (weight[order] > 1))
        if not len(many):
            return
        sig, key, weight = sig[many], key[order[many]], weight[order[many]]
        order = np.lexsort((key, sig))
        sig, key, weight = sig[order], key[order], weight[order]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(first, len(sig)))
        crowd = np.repeat(np.add.reduceat(weight, first), size) > HOT
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))  # a class may come from several tasks
        bucket = np.repeat(np.arange(len(first)), size)[fresh]
        sig, key, crowd = sig[fresh], key[fresh], crowd[fresh]
        yield out(CROWDED, sig[crowd], key[crowd])
        bucket, key = bucket[~crowd], key[~crowd]
        near = [np.zeros((0, 2), np.int64)]
        for d in range(1, HOT):
            at = np.flatnonzero(bucket[d:] == bucket[:-d])
            near.append(np.unique(np.stack([key[at], key[at + d]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(near), axis=0)
        yield out(COLD, pairs[:, 0], pairs[:, 1])

    return rows.mapInArrow(lean(run), "kind int, a long, b long, c long")


class Verifier:
    """Which candidate pairs of classes are links. classes: key, n_shingles, sketch, doc (its least id)."""

    def __init__(self, documents: DataFrame, classes: DataFrame):
        self.documents, self.classes = documents, classes

    def measure(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_a, n_b, differ, linked of every pair, cut. differ: shingles in one of the two only; where a
        lower bound shows that the pair is no link, that bound."""
        rough = gathered(self._rough(pairs))
        near = rough.where("linked")
        need = gathered(near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "key"))
        sets = self.sets(need)
        a, b = (sets.select(F.col("key").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
        # the pairs go to the sets of b; each then travels once, to the set of its a
        few = small_or_not(near.select("a", "b", "n_a", "n_b"), near.count(), BROADCAST_PAIRS)
        heads = gathered(near.select("a").distinct())
        a = a.join(small_or_not(heads, heads.count(), BROADCAST_PAIRS), "a", "left_semi")
        common = F.size(F.array_intersect("set_a", "set_b"))
        differ = F.col("n_a") + F.col("n_b") - 2 * common
        # the sets stay columns here: two of them a row would make large batches for Python
        exact = (
            b.join(few, "b")
            .join(a, "a")
            .select("a", "b", "n_a", "n_b", differ.alias("differ"))
            .withColumn("linked", OF_SUM * F.col("differ") <= LEAST_SUM * (F.col("n_a") + F.col("n_b")))
        )
        return gathered(exact.unionByName(rough.where("not linked")))

    def _rough(self, pairs: DataFrame) -> DataFrame:
        """The pairs with a lower bound of their difference; linked: it does not rule a link out."""
        a, b = (
            self.classes.select(F.col("key").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
            for c in "ab"
        )

        differ = F.greatest(least_different("s_a", "s_b"), F.abs(F.col("n_a") - F.col("n_b")))
        return (
            pairs.join(b, "b")
            .join(a, "a")
            .select("a", "b", "n_a", "n_b", differ.alias("differ"))
            .withColumn("linked", OF_SUM * F.col("differ") <= LEAST_SUM * (F.col("n_a") + F.col("n_b")))
        )

    def sets(self, need: DataFrame) -> DataFrame:
        """key, members of the classes in need(key)."""
        n = need.count()
        picked = self.classes.join(need, "key").select(F.col("doc").alias("doc_id"), "key")

        def run(batches):
            import pyarrow as pa

            for batch, begin, end, sets in _sets(batches):
                wanted = batch.column("key").slice(begin, end - begin).to_pylist()
                rows = {k: s.view(np.int64) for k, s in zip(wanted, sets, strict=True) if len(s) and set_key(s) == k}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.int64()))], names=["key", "members"]
                )

        texts = self.documents.join(small_or_not(picked, n, BROADCAST_IDS), "doc_id").select("key", "text")
        found = cut(texts.mapInArrow(lean(run), "key long, members array<bigint>"))
        # only repeated rows of an id give a set twice; else there is nothing to shuffle
        return found if found.count() <= n else found.dropDuplicates(["key"])


def component_of(df: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """df with c_<column>: the component of that node, itself if it has no link yet."""
    named = components.select(F.col("node").alias(column), F.col("component").alias("__c"))
    return df.join(named, column, "left").withColumn(f"c_{column}", F.coalesce("__c", column)).drop("__c")


def apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    both = component_of(component_of(pairs, components, "a"), components, "b")
    return both.where("c_a <> c_b").drop("c_a", "c_b")


def cold_pairs(stars: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes, a the lesser, that share a bucket of at most HOT."""
    named = stars.where(F.col("kind") == SLACK).select(F.col("a").alias("key"), F.col("c").alias("owner"))
    x, y = (named.select(F.col("key").alias(f"key_{c}"), F.col("owner").alias(c)) for c in "ab")
    both = stars.where(F.col("kind") == COLD).select("a", "b").distinct().join(x, "a").join(y, "b")
    pairs = both.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    return pairs.where("a <> b").distinct()


def dependent_classes(stars: DataFrame, local: DataFrame) -> DataFrame:
    """key: classes that sign in more crowded buckets than their slack, and those that stand for one that does."""
    crowded = stars.where(F.col("kind") == CROWDED).select(F.col("b").alias("owner"))
    used = crowded.groupBy("owner").agg(F.count(F.lit(1)).alias("used"))
    slack = stars.where(F.col("kind") == SLACK).select(F.col("a").alias("key"), F.col("b").alias("slack"), F.col("c").alias("owner"))
    depends = slack.join(used, "owner", "left").where(F.coalesce("used", F.lit(0)) > F.col("slack")).select("key").distinct()
    behind = local.join(depends.withColumnRenamed("key", "b"), "b", "left_semi").select(F.col("a").alias("key"))
    return depends.union(behind).distinct()


def rare_prefix_stars(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Star pairs (a, b) of sets(id, t) by the shingles of their prefixes, rarest first.

    Shingles of one set only have no partner; the rest of a prefix is what remains after them.
    """
    sized = sets.select("id", F.size("t").alias("n"), "t")
    ordered = sized.select("id", "n").join(shared_tokens(sized, scratch), "id")
    left = prefix_length(F.col("n")) - (F.col("n") - F.size("s"))
    rows = ordered.where(left > 0).select("id", F.explode(F.slice("s", F.lit(1), left)).alias("x")).select("id", "x.token")
    rows = scratch.stored(rows)
    heads = rows.groupBy("token").agg(F.min("id").alias("a"))
    return rows.join(heads, "token").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def class_links(documents: DataFrame, classes: DataFrame, shingle_total: int) -> DataFrame:
    """Components (node, component) of the linked classes; classes without a link are left out."""
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(tasks, -(-shingle_total * 16 // TASK_BYTES))
    # a class signs once, by its first document
    firsts = small_or_not(classes.select(F.col("doc").alias("doc_id")), classes.count(), BROADCAST_IDS)
    signing = documents.join(firsts, "doc_id", "left_semi")
    rows = block_links(signing, parts).repartition(parts, "part")
    stars = stored(bucket_stars(rows), "stars")
    del rows
    release(spark)  # the shuffled signatures are the largest thing here
    behind = gathered(stars.where(F.col("kind") == KNOWN).select("a", "b", F.col("c").alias("differ")).distinct())
    local = behind.select("a", "b")
    verify = Verifier(documents, classes)
    depends = gathered(dependent_classes(stars, local))
    scratch = Scratch(spark, "dependent")
    dependent = verify.sets(depends).select(F.col("key").alias("id"), F.col("members").alias("t"))
    crowded = gathered(rare_prefix_stars(dependent, scratch))
    del dependent
    pairs = gathered(cold_pairs(stars).union(crowded).distinct())
    release(spark)

    def grown(links: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of the same reach as links and those measured, one a node, and their components."""
        components = gathered(connected_components(links.union(measured.where("linked").select("a", "b"))))
        links = components.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        release(spark)
        return links, F.broadcast(components) if components.count() <= BROADCAST_PAIRS else components

    # first each class with its least partner only: most groups are then joined
    least = verify.measure(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links, components = grown(local, least)
    rest = pairs.join(least, ["a", "b"], "left_anti")
    left = verify.measure(apart(rest, components))
    if not left.where("linked").isEmpty():
        links, components = grown(links, left)
    release(spark)
    known = least.unionByName(left)
    open_stars = known.where("not linked").join(crowded, ["a", "b"], "left_semi")
    failed = gathered(apart(open_stars.select("a", "b", "n_b", "differ"), components))
    if failed.isEmpty():
        return components
    # the stars of the hubs that a class failed to join, measured whole
    hubs = failed.select("a").distinct()
    star = crowded.join(hubs, "a", "left_semi")
    unknown = star.join(known, ["a", "b"], "left_anti")
    star = gathered(known.join(star, ["a", "b"], "left_semi").unionByName(verify.measure(unknown)))
    upper = F.when(F.col("linked"), F.col("differ")).otherwise(F.col("n_a") + F.col("n_b"))
    sizes = classes.select(F.col("key").alias("b"), F.col("n_shingles").alias("n"))
    # a class with those that stood behind it in its block, each at its difference from the class
    group = gathered(behind.join(sizes, "b").select(F.col("a").alias("x"), F.col("b").alias("y"), "n", "differ"))

    def with_group(df: DataFrame, sign: int) -> DataFrame:
        """df(hub, x, n, d) and the same for all that stood behind x, d less or more their difference."""
        more = df.select("hub", "x", "d").join(group, "x")
        return df.unionByName(more.select("hub", F.col("y").alias("x"), "n", (F.col("d") + sign * F.col("differ")).alias("d")))

    outer = with_group(
        failed.select(F.col("a").alias("hub"), F.col("b").alias("x"), F.col("n_b").alias("n"), F.col("differ").alias("d")), -1
    )
    hub_itself = star.select(F.col("a").alias("hub"), F.col("a").alias("x"), F.col("n_a").alias("n"), F.lit(0).cast("long").alias("d"))
    members = star.select(F.col("a").alias("hub"), F.col("b").alias("x"), F.col("n_b").alias("n"), upper.alias("d"))
    inner = with_group(hub_itself.distinct().unionByName(members), 1)
    sketches = classes.select(F.col("key").alias("x"), F.col("sketch").alias("s"))
    outer, inner = gathered(outer.join(sketches, "x")), gathered(inner.join(sketches, "x"))
    tested = known.select("a", "b").unionByName(star.select("a", "b"))
    by_hash = W.partitionBy("hub").orderBy(F.xxhash64("x_o"), "x_o")
    for pivots in (*PIVOTS, None):
        o, i = (
            component_of(df.select("hub", *[F.col(c).alias(f"{c}_{k}") for c in ("x", "n", "d", "s")]), components, f"x_{k}")
            for df, k in ((outer, "o"), (inner, "i"))
        )
        # those that are still apart from their hub; a few of them first, as most others join through these
        o = component_of(o, components, "hub").where("c_hub <> c_x_o").drop("c_hub")
        if pivots:
            o = o.withColumn("turn", F.row_number().over(by_hash)).where(F.col("turn") <= pivots).drop("turn")
        met = (
            o.join(i, "hub")
            .where(F.col("c_x_o") != F.col("c_x_i"))
            .where(OF_SUM * (F.col("d_o") - F.col("d_i")) <= LEAST_SUM * (F.col("n_o") + F.col("n_i")))
            .where(OF_SUM * least_different("s_o", "s_i") <= LEAST_SUM * (F.col("n_o") + F.col("n_i")))
            .select(F.least("x_o", "x_i").alias("a"), F.greatest("x_o", "x_i").alias("b"))
            .distinct()
        )
        met = gathered(met.join(tested, ["a", "b"], "left_anti"))
        if met.isEmpty():
            continue
        found = verify.measure(met)
        tested = tested.unionByName(met)
        if not found.where("linked").isEmpty():
            links, components = grown(links, found)
    return components


def near_duplicate_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(document_sets(docs))
    classes = gathered(
        sets.where("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("doc"),
            F.count(F.lit(1)).alias("rows"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        )
    )
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return sets.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    components = class_links(docs.where("doc_id is not null"), classes, total)
    joined = component_of(classes.select("key", "doc", "rows"), components, "key")
    least = joined.groupBy("c_key").agg(F.min("doc").alias("component_id"), F.sum("rows").alias("rows"))
    # only classes of more than one document need a row here; the rest are their own components
    known = (
        joined.select("key", "c_key")
        .join(least.where("rows > 1"), "c_key")
        .select("key", "component_id")
    )
    return sets.join(known, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of documents less near duplicates: of each component the row of the least doc_id stays (null ids last).

    A row is known by its id and its text, so rows of one id with other texts are apart, and of equal
    rows one stays. Rows without a shingle stay.
    """
    docs = packed(documents, F.col("doc_id"), F.xxhash64("doc_id", "text").alias("node"), F.col("text"))
    found = near_duplicate_components(docs.select(F.col("node").alias("doc_id"), "text")).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("node")).agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("rows"))
    crowds = found.groupBy("component").agg(F.sum("rows").alias("rows")).where("rows > 1").select("component")
    ids = docs.select("node", "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    # only groups of more than one row need a row here
    members = gathered(found.join(crowds, "component").join(ids, "node").select("component", "node", "rows", "doc_id", rank.alias("rank")))
    first = members.groupBy("component").agg(F.min("rank").alias("first"))
    marked = members.join(first, "component").where("rank <> first or rows > 1")
    marked = gathered(marked.select(F.col("doc_id").alias("m_id"), F.col("node").alias("m_node"), (F.col("rank") == F.col("first")).alias("kept")))
    same = (F.col("node") == F.col("m_node")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    joined = docs.join(small_or_not(marked, marked.count(), BROADCAST_IDS), same, "left").select("row", "doc_id", "node", "kept")
    row = [F.col("row")[c].alias(c) for c in documents.columns]
    rest = joined.where("kept is null").select(*row)
    again = marked.where("kept")
    if again.isEmpty():
        return rest
    # repeated rows: the first that a task meets, then one of those
    once = joined.where("kept").groupBy("doc_id", "node").agg(F.first("row").alias("row"))
    return rest.unionByName(once.select(*row))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))
