"""Near-duplicates by min-max hashing.

Every document is a set of word shingles.  Each of ``hashes`` permutations is evaluated
once per shingle and leaves two signature values, the smallest and the largest image; both
are unbiased, so half the evaluations give a signature of 2 x ``hashes`` values.  Bands of
``rows`` values (minima and maxima in bands of their own) name candidates.

Equal sets are one class from the start.  Each bucket names a few leaders, and every
document is held against the few leaders with which it shares most buckets; the full sets
decide.  Linked documents become one component, and only then are pairs of the same
bucket but of different components tried, each pair once however many buckets it shares;
shingles that no other candidate has and longer signatures drop those out of reach, the
full sets decide again.  So no group of copies is expanded into its pairs, and no likely
link between components stays untested.  There a document is one row with all it has to meet in
a bucket, not a row per pair, and documents linked on the way are not tried again.  With 128 values in bands of 4, a pair of
similarity 0.8 shares no bucket with probability 5e-8; the signature filter stands six
standard deviations below the wanted similarity and only matters where a link is the only
one between two components.

Defined cases: null or word-less texts have no shingles, link with nothing and keep
themselves; a text of fewer words than a shingle has is one shingle; rows of one doc_id
are one document, compared by one of its texts; a row without doc_id stays, with no component;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm.common import batches, components, mix64, stored, text_slices, word_hashes

HASHES = 64
ROWS = 4
_CHUNK = 1 << 15


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text."""
    h, starts, _ = word_hashes(texts)
    out = []
    mult = [np.uint64(x) for x in mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)]
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        w = h[lo:hi]
        n = min(size, len(w))
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        s = np.full(len(w) - n + 1, np.uint64(n))
        for k in range(n):
            s = s + w[k:len(w) - n + 1 + k] * mult[k]
        out.append(np.unique(mix64(s)))
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima): one row of ``hashes`` values per non-empty set."""
    turn = mix64(np.arange(1000, 1000 + hashes, dtype=np.uint64))
    mult = mix64(np.arange(5000, 5000 + hashes, dtype=np.uint64)) | np.uint64(1)
    low, high = np.empty((len(sets), hashes), np.uint64), np.empty((len(sets), hashes), np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= _CHUNK):
            n += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        at = np.cumsum([0, *map(len, sets[i:j - 1])])
        for k in range(hashes):
            v = (flat ^ turn[k]) * mult[k]
            low[i:j, k], high[i:j, k] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
        i = j
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """One key per band; minima and maxima have bands of their own."""
    keys = []
    for side, sig in enumerate((low, high)):
        for b in range(sig.shape[1] // rows):
            k = np.full(len(sig), np.uint64(2 * b + side + 1))
            for c in range(b * rows, (b + 1) * rows):
                k = mix64(k + sig[:, c])
            keys.append(k)
    return np.stack(keys, axis=1).view(np.int64)


def _sign(size: int, hashes: int, rows: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(it):
        def out():
            for b in it:
                ids = b.column(0).to_pylist()
                for lo, _, texts in text_slices(b.column(1)):
                    sets = shingle_sets(texts, size)
                    full = [i for i, s in enumerate(sets) if len(s)]
                    low, high = signatures([sets[i] for i in full], hashes)
                    keys = band_keys(low, high, rows)
                    place = dict(zip(full, range(len(full))))
                    for i, s in enumerate(sets):
                        j = place.get(i)
                        if j is None:
                            yield ids[lo + i], 0, None, None
                        else:
                            yield ids[lo + i], len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys[j]

        yield from batches(out(), kinds, 4096)

    return run


def _linked(size: int, percent: int):
    """Keep pairs (a, b) whose texts have similar enough full sets."""

    def run(it):
        for b in it:
            ok = []
            for lo, hi, texts in text_slices(b.column(2)):
                # the other side of a pair is of similar size, or the pair is no link
                others = (t for _, _, some in text_slices(b.column(3).slice(lo, hi - lo)) for t in some)
                for p, q in zip(shingle_sets(texts, size), (shingle_sets([t], size)[0] for t in others)):
                    both = np.concatenate([p, q])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _items(size: int):
    def run(it):
        for b in it:
            ids = b.column(0).to_pylist()
            for lo, hi, texts in text_slices(b.column(1)):
                sets = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids[lo:hi], np.int64), [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], ["id", "item"])

    return run


def _long_signatures(size: int, hashes: int):
    """One byte of each minimum and maximum, for documents that a short signature cannot tell apart."""

    def run(it):
        for b in it:
            ids = b.column(0).to_pylist()
            for lo, hi, texts in text_slices(b.column(1), 128):
                sets = [(i, s) for i, s in zip(ids[lo:hi], shingle_sets(texts, size)) if len(s)]
                if sets:
                    sig = np.concatenate(signatures([s for _, s in sets], hashes), axis=1)
                    sig = (mix64(sig) & np.uint64(255)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "long_sig"])

    return run


def _across(least: int, percent: int, block: int = 4096):
    """In sorted rows (bucket, id, component, n, common, keys, signature): what of a bucket has to be held against what.

    ``common`` counts the shingles that some other candidate has as well: no intersection is
    larger.  A pair is named in the first of the buckets it shares only.  There is one row per
    document and part of a bucket, however many others it meets there: (bucket, part, id,
    others), and one with no others for a document that only others name.  A part has at most
    2 x ``block`` documents.
    """
    kinds = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("id", pa.int64()), ("others", pa.list_(pa.int64()))])

    def group(bucket, ids, comp, n, common, keys, sig):
        band = (keys == bucket).argmax(axis=1)
        held: dict = {}
        for i in range(len(ids) - 1):
            most = np.minimum(common[i + 1:], common[i])
            other = i + 1 + np.flatnonzero((comp[i + 1:] != comp[i]) & (100 * most >= percent * (n[i + 1:] + n[i] - most)))
            other = other[(sig[other] == sig[i]).sum(axis=1) >= least]
            if len(other):
                other = other[(keys[other] == keys[i]).argmax(axis=1) == band[i]]
            for q in np.unique(other // block).tolist():
                held.setdefault((i // block, q), {})[i] = other[other // block == q]
        for (p, q), met in held.items():
            part = (p << 32) + q
            for i, other in met.items():
                yield int(bucket), part, int(ids[i]), ids[other].tolist()
            for j in np.setdiff1d(np.concatenate(list(met.values())), list(met)).tolist():
                yield int(bucket), part, int(ids[j]), []

    def flush(bucket, rows):
        if len(rows) > 1:
            ids, comp, n, common, keys, sig = zip(*rows)
            yield from group(bucket, np.array(ids), np.array(comp), np.array(n), np.array(common), np.array(keys), np.frombuffer(b"".join(sig), np.uint8).reshape(len(ids), -1))

    def run(it):
        def out():
            key, rows = None, []
            for b in it:
                for bucket, *r in zip(*(c.to_pylist() for c in b.columns)):
                    if bucket != key:
                        yield from flush(key, rows)
                        key, rows = bucket, []
                    rows.append(r)
            yield from flush(key, rows)

        yield from batches(out(), kinds, 8192, weigh=lambda r: 8 * len(r[3]))

    return run


_MEET = "bucket long, part long, id long, others array<long>"


def _settled(size: int, percent: int):
    """In sorted rows (bucket, part, id, others, text): links between the documents of a part, decided on their full sets.

    Documents that are linked in the part already are not held against each other again, so a
    part gives fewer links than it has documents.
    """
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(ids, others, sets):
        place = {i: k for k, i in enumerate(ids)}
        n = np.array([len(s) for s in sets])
        ends = np.cumsum(n)
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mine = np.zeros(int(code.max()) + 1, bool)
        comp = np.arange(len(ids))
        for i, some in enumerate(others):
            met = np.array([place[x] for x in some], np.int64)
            met = met[comp[met] != comp[i]]
            if not len(met):
                continue
            mine[code[ends[i] - n[i]:ends[i]]] = True
            inter = np.array([np.count_nonzero(mine[code[ends[j] - n[j]:ends[j]]]) for j in met.tolist()])
            mine[code[ends[i] - n[i]:ends[i]]] = False
            for j in met[100 * inter >= percent * (n[i] + n[met] - inter)].tolist():
                if comp[i] != comp[j]:
                    comp[comp == comp[j]] = comp[i]
                    yield max(ids[i], ids[j]), min(ids[i], ids[j])

    def run(it):
        def out():
            key, ids, others, sets = None, [], [], []
            for b in it:
                at = list(zip(*(b.column(c).to_pylist() for c in range(4))))
                for lo, hi, texts in text_slices(b.column(4)):
                    for (bucket, part, i, some), s in zip(at[lo:hi], shingle_sets(texts, size)):
                        if (bucket, part) != key:
                            if ids:
                                yield from settle(ids, others, sets)
                            key, ids, others, sets = (bucket, part), [], [], []
                        ids.append(i)
                        others.append(some)
                        sets.append(s)
            if ids:
                yield from settle(ids, others, sets)

        yield from batches(out(), kinds, 8192)

    return run


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, hashes: int = HASHES, rows: int = ROWS, leaders: int = 4, long_hashes: int = 768,
                    few: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; documents of similarity ``percent``/100 or more are linked.

    Up to ``few`` ids of texts to compare are broadcast to the scan; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_sign(size, hashes, rows), "doc_id long, n long, digest binary, keys array<long>"), "signed")
    # one node per distinct set, named by its smallest id
    heads = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("id"))
    nodes = stored(signed.join(heads, "digest").where(F.col("doc_id") == F.col("id")).select("id", "n", "keys").dropDuplicates(["id"]), "nodes")
    banded = nodes.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = stored(banded.join(shared, "key", "left_semi"), "members")
    mean = percent / 100
    least = max(0, int(2 * long_hashes * (mean - 6 * (mean * (1 - mean) / (2 * long_hashes)) ** 0.5)))

    def picked(ids: DataFrame) -> DataFrame:
        """The texts of some ids, one each."""
        if ids.limit(few + 1).count() <= few:
            ids = F.broadcast(ids)
        some = texts.join(ids, "doc_id", "left_semi")
        return some.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else some

    def linked(pairs: DataFrame) -> DataFrame:
        some = picked(pairs.select("a").union(pairs.select("b")).toDF("doc_id").distinct())
        a, b = some.toDF("a", "va"), some.toDF("b", "vb")
        return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(_linked(size, percent), "a long, b long"), "links")

    repeated = not texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    edges = spark.createDataFrame([], "a long, b long")
    comp = spark.createDataFrame([], "id long, comp long")
    for turn in ("leaders", "rest"):
        of = members.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array(
            *[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(leaders)]).alias("leads")).where("lo < hi")
        if turn == "leaders":
            votes = of.join(mixed, "key").select("id", F.explode(F.array_distinct("leads")).alias("lead")).where("id <> lead").groupBy("id", "lead").count()
            best = W.partitionBy("id").orderBy(F.desc("count"), "lead")
            pairs = votes.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= leaders).select(
                F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
            edges = edges.union(linked(stored(pairs, "pairs")))
        else:
            left = stored(of.join(mixed.select("key"), "key", "left_semi"), "left")
            # shingles that no other candidate has are in no intersection: they rule most pairs out
            open_texts = picked(left.select(F.col("id").alias("doc_id")).distinct())
            shingles = open_texts.mapInArrow(_items(size), "id long, item long")
            signs = open_texts.mapInArrow(_long_signatures(size, long_hashes), "id long, long_sig binary")
            alone = shingles.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
            able = nodes.join(alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).where(100 * F.col("common") >= percent * F.col("n"))
            groups = left.join(able.join(signs, "id"), "id").select("key", "id", "comp", "n", "common", "keys", "long_sig")
            meet = stored(groups.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_across(least, percent), _MEET), "meet")
            held = meet.join(picked(meet.select(F.col("id").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "id"), "id").select("bucket", "part", "id", "others", "text")
            links = held.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id").mapInArrow(_settled(size, percent), "a long, b long")
            edges = edges.union(stored(links, "links"))
        comp = components(edges)
    named = heads.join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("component"))
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
