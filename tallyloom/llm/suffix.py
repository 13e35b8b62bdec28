"""Exact substring dedup with run-length compressed suffix indexes.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier in
the corpus.  A document equal to an earlier one goes whole and takes no further part.  Every such string (window) has an anchor: its leftmost ``mer``-byte string of
smallest hash.  Equal windows have equal anchors, so windows travel as runs that share an
anchor (segments), and only segments whose anchor occurs at least twice travel at all.

Segments of an anchor meet in one place.  Equal segments are settled by order: all but the
first go whole.  Different segments of an anchor are split into an earlier and a later
half, again and again; the earlier halves of many anchors become one run-length index: a
run-compressed Burrows-Wheeler transform that keeps, per run, its first and last suffix
position and the image of its head.  The later halves are streamed against it from right
to left and their matching statistics say which windows start earlier.

Texts and anchors that hold a large share of all rows are joined in parts.  Anchors with more than ``hot`` occurrences are dealt out by document; what is first in its
share of such an anchor is settled by window hash in a second, map-side combined pass, so
neither a frequent string nor a frequent passage gathers in one task.

Defined cases: null texts are empty; rows that repeat a doc_id are judged as one document
each, in the order of their SHA-256, and whole repeated rows alike (once); ids too large for
that (about 2^62 over the most rows of one id) raise an overflow; rows without doc_id
are never earlier than others and stay as they are; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.common import _TABLE, batches, mix64, stored

_ROOT = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_PART = 1 << 18
_POS = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(_PART + 4096, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


_UP, _DOWN = _powers(_ROOT), _powers(_INVERSE)


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:len(data)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, lo: np.ndarray | slice, hi: np.ndarray | slice, at: np.ndarray) -> np.ndarray:
    return (prefix[hi] - prefix[lo]) * _DOWN[at]


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    r, k = v, 1
    while 2 * k <= width:
        r = np.minimum(r[:-k], r[k:])
        k *= 2
    return np.minimum(r[:len(v) - width + 1], r[width - k:width - k + len(v) - width + 1]) if k < width else r


def runs(data: np.ndarray, length: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one text in runs of equal anchor: (anchor hash, anchor position, first window, last window)."""
    n = len(data) - length + 1
    out = []
    for lo in range(0, max(0, n), _PART - length):
        part = data[lo:lo + _PART]
        m = len(part) - length + 1
        if m <= 0:
            break
        p = _prefix(part)
        k = len(part) - mer + 1
        h = mix64((p[mer:] - p[:k]) * _DOWN[:k])
        best = _smallest((h & ~_LOW) | np.arange(k, dtype=np.uint64), length - mer + 1)
        at = (best & _LOW).astype(np.int64)
        edge = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge - 1, [m - 1]])
        out.append((h[at[first]], at[first] + lo, first + lo, last + lo))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    a, at, first, last = (np.concatenate(x) for x in zip(*out))
    same = np.flatnonzero(at[1:] == at[:-1])  # a run cut by a part border
    if len(same):
        keep = np.ones(len(at), bool)
        keep[same + 1] = False
        ends = np.append(np.flatnonzero(keep)[1:] - 1, len(at) - 1)
        a, at, first, last = a[keep], at[keep], first[keep], last[ends]
    return a, at, first, last


class RunIndex:
    """Run-length Burrows-Wheeler index of some strings, with suffix positions sampled at both ends of each run."""

    def __init__(self, strings: list[np.ndarray], letters: int = 256):
        codes, self.stops = [], letters  # codes from ``letters`` on end strings, each its own
        stop = self.stops
        for s in strings:
            codes += [s.astype(np.int64), np.array([stop])]
            stop += 1
        text = np.concatenate(codes)
        n = len(text)
        self.plain = np.concatenate([text.astype(np.int32), np.full(512, stop, np.int32)])
        bits = int(stop).bit_length()
        step = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        padded = np.concatenate([text + 1, np.zeros(step, np.int64)])
        for j in range(step):
            key = (key << bits) | padded[j:n + j] if bits * step < 63 else key
        k = step
        while True:
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            if fresh[order[-1]] == n - 1:
                break
            ahead = np.concatenate([fresh[k:] + 1, np.zeros(min(k, n), np.int64)])[:n]
            key = (fresh << 31) | ahead
            k *= 2
        last = text[order - 1]  # the transform; position 0 looks back to the end
        jump = np.empty(n, np.int64)
        jump[np.argsort(last, kind="stable")] = np.arange(n)
        self.n = n
        self.start = np.concatenate([[0], np.flatnonzero(np.diff(last)) + 1])
        end = np.append(self.start[1:], n) - 1
        self.char = last[self.start]
        self.image = jump[self.start]
        self.head, self.tail, self.end = order[self.start], order[end], end
        self.by_char = np.argsort(self.char, kind="stable")
        self.key = self.char[self.by_char] * (len(self.start) + 1) + self.by_char

    def common(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Length of the common beginning of suffixes, up to ``most``; looked at in growing pieces."""
        out, live, at, piece = np.zeros(len(x), np.int64), np.arange(len(x)), 0, 8
        while len(live) and at < most:
            span = np.arange(at, min(most, at + piece))
            left = self.plain[x[live, None] + span]
            bad = (left != self.plain[y[live, None] + span]) | (left >= self.stops)
            stop = bad.any(axis=1)
            out[live] = at + np.where(stop, bad.argmax(axis=1), len(span))
            live, at, piece = live[~stop], at + piece, 4 * piece
        return out

    def statistics(self, queries: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, position, matched length from there, up to ``most``) for each step of a stream from right to left."""
        sizes = np.array([len(q) for q in queries])
        flat, heads = np.concatenate(queries).astype(np.int64), np.cumsum(sizes) - sizes
        q = np.zeros(len(queries), np.int64)
        at = np.full(len(queries), self.head[0])
        length = np.zeros(len(queries), np.int64)
        runs_n = len(self.start)
        order = np.argsort(-sizes, kind="stable")
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = order[:int(np.searchsorted(-sizes[order], -back, side="right"))]
            pos = sizes[live] - back
            c = flat[heads[live] + pos]
            run = np.searchsorted(self.start, q[live], side="right") - 1
            hit = self.char[run] == c
            nq, na, nl = q[live].copy(), at[live].copy(), length[live].copy()
            miss = np.flatnonzero(~hit)
            if len(miss):
                want = c[miss] * (runs_n + 1) + run[miss]
                after = np.searchsorted(self.key, want)
                up_ok = (after > 0) & (self.char[self.by_char[np.maximum(after - 1, 0)]] == c[miss])
                down_ok = (after < runs_n) & (self.char[self.by_char[np.minimum(after, runs_n - 1)]] == c[miss])
                up, down = self.by_char[np.maximum(after - 1, 0)], self.by_char[np.minimum(after, runs_n - 1)]
                known = nl[miss] > 0
                l_up, l_down = np.zeros(len(miss), np.int64), np.zeros(len(miss), np.int64)
                for ok, side, sample, got in ((up_ok, up, self.tail, l_up), (down_ok, down, self.head, l_down)):
                    use = np.flatnonzero(ok & known)
                    if len(use):
                        got[use] = np.minimum(self.common(sample[side[use]], na[miss[use]], most), nl[miss[use]])
                take_up = up_ok & (~down_ok | (l_up >= l_down))
                none = ~up_ok & ~down_ok
                nl[miss] = np.where(none, -1, np.where(take_up, l_up, l_down))
                nq[miss] = np.where(none, 0, np.where(take_up, self.end[up], self.start[down]))
                na[miss] = np.where(none, self.head[0], np.where(take_up, self.tail[up], self.head[down]))
                run = run.copy()
                run[miss] = np.where(none, 0, np.where(take_up, up, down))
            lost = nl < 0
            length[live] = np.minimum(nl + 1, most)
            q[live] = np.where(lost, 0, self.image[run] + nq - self.start[run])
            at[live] = np.where(lost, self.head[0], np.maximum(na - 1, 0))
            yield live, pos, length[live]


def earlier(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each string of each group (in order of first occurrence): which of its windows a string before it in the group has."""
    data = [[np.frombuffer(s, np.uint8).astype(np.int64) for s in g] for g in groups]
    sizes = [max(0, len(s) - length + 1) for g in data for s in g]
    places = np.cumsum([0, *sizes])
    firsts = np.cumsum([0, *map(len, data)])
    flat = np.zeros(int(places[-1]), bool)
    todo = [(i, 0, len(g)) for i, g in enumerate(data) if len(g) > 1]
    while todo:
        index, queries, owner, rest = [], [], [], []
        for node, (i, lo, hi) in enumerate(todo):
            mid = (lo + hi) // 2
            letters = 256 * node  # halves of different ranges never match each other
            index += [s + letters for s in data[i][lo:mid]]
            queries += [s + letters for s in data[i][mid:hi]]
            owner += range(firsts[i] + mid, firsts[i] + hi)
            rest += [(i, a, b) for a, b in ((lo, mid), (mid, hi)) if b - a > 1]
        home = places[np.array(owner)]
        for some, pos, got in RunIndex(index, 256 * len(todo)).statistics(queries, length):
            hit = got >= length
            flat[home[some[hit]] + pos[hit]] = True
        todo = rest
    parts = np.split(flat, places[1:-1])
    return [parts[a:b] for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]


def may_share(group: list[tuple], length: int, mer: int, cuts: int = 4) -> list[tuple]:
    """Segments (.., body, anchor's place last) that may share a window with another of the group.

    A shared window reaches some way left and the rest of the way right of the anchor, so
    two segments that share one agree on one of a few stretches around it.
    """
    rest = length - mer
    step = -(-(rest + 1) // cuts)
    seen: dict[tuple, int] = {}
    keys = []
    for n, (*_, body, at) in enumerate(group):
        mine = []
        for c in range(cuts):
            left, right = c * step, max(0, rest - (c + 1) * step + 1)
            if at >= left and at + mer + right <= len(body):
                mine.append((c, body[at - left:at + mer + right]))
        keys.append(mine)
        for k in mine:
            seen[k] = seen.get(k, 0) + 1
    return [g for g, mine in zip(group, keys) if any(seen[k] > 1 for k in mine)]


def _spans(mark: np.ndarray, start: int, length: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield start + lo, start + hi - 1 + length


def _anchors(length: int, mer: int, rows: bool):
    counted = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(it):
        for b in it:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            held = []
            for i, t in zip(ids, texts):
                a, at, _, _ = runs(np.frombuffer(t, np.uint8), length, mer)
                if len(a):
                    held.append((i, a.view(np.int64), at))
            if not held:
                continue
            flat = np.concatenate([a for _, a, _ in held])
            if rows:
                n = [len(a) for _, a, _ in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([i for i, _, _ in held], n)), pa.array(flat), pa.array(np.concatenate([p for _, _, p in held]))], ["doc", "anchor", "pos"])
            else:
                u, n = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], schema=counted)

    return run


_SEGMENT = pa.schema([("place", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_()), ("digest", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("body", pa.binary()), ("at", pa.int32())])


def _segments(length: int, mer: int, shares: int):
    def run(it):
        def out():
            for b in it:
                for doc, text, places in zip(*(c.to_pylist() for c in b.columns)):
                    data = np.frombuffer(text, np.uint8)
                    a, at, first, last = runs(data, length, mer)
                    wanted = {p >> 1: bool(p & 1) for p in places}
                    for k in np.flatnonzero(np.isin(at, np.fromiter(wanted, np.int64, len(wanted)))).tolist():
                        hot, lo = wanted[int(at[k])], int(first[k])
                        body = text[lo:int(last[k]) + length]
                        anchor = int(a[k].view(np.int64))
                        # the anchor's place in the segment is part of its identity: equal bytes, equal place
                        digest = hashlib.blake2b(body, digest_size=12, salt=int(at[k] - lo).to_bytes(4, "little")).digest()
                        yield (doc % shares if hot else -1), anchor, hot, digest, doc, lo, body, int(at[k]) - lo

        yield from batches(out(), _SEGMENT, 8192)

    return run


_FOUND = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("window", pa.binary())])


def _settle(length: int, mer: int, batch_bytes: int = 1 << 21, batch_strings: int = 15_000):
    """Sorted segments to removed spans; windows of first segments of hot anchors go on to the second pass."""

    def run(it):
        def out():
            groups: list[list[tuple]] = []
            group: list[tuple] = []
            size = count = 0
            key = digest = None
            for b in it:
                for place, anchor, hot, dg, doc, start, body, at in zip(*(c.to_pylist() for c in b.columns)):
                    if (anchor, place) != key:
                        if len(group) > 1 and len(group := may_share(group, length, mer)) > 1:
                            groups.append(group)
                            size += sum(len(g[2]) for g in group)
                            count += len(group)
                        if size >= batch_bytes or count >= batch_strings:
                            yield from flush(groups)
                            groups, size, count = [], 0, 0
                        key, digest, group = (anchor, place), None, []
                    if dg == digest:
                        yield doc, start, start + len(body), None
                        continue
                    digest = dg
                    if hot:
                        for i in range(len(body) - length + 1):
                            yield doc, start + i, start + i + length, hashlib.blake2b(body[i:i + length], digest_size=16).digest()
                    else:
                        group.append((doc, start, body, at))
            if len(group := may_share(group, length, mer)) > 1:
                groups.append(group)
            yield from flush(groups)

        def flush(groups):
            groups = [sorted(g) for g in groups]
            for g, marks in zip(groups, earlier([[x[2] for x in g] for g in groups], length)):
                for (doc, start, *_), m in zip(g, marks):
                    for lo, hi in _spans(m, start, length):
                        yield doc, lo, hi, None

        yield from batches(out(), _FOUND, 8192)

    return run


def _cut(it):
    kinds = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def out():
        for b in it:
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                text, merged = text or b"", []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                digest, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    digest.update(text[at:lo])
                    at = hi
                digest.update(text[at:])
                yield doc, len(text), sum(hi - lo for lo, hi in merged), len(merged), digest.hexdigest(), merged

    yield from batches(out(), kinds, 4096)


def spread_join(left: DataFrame, counts: DataFrame, key: str, by: str, share: int = 1000, parts: int = 64) -> DataFrame:
    """``left`` with the ``n`` of its ``key`` from ``counts`` (unique keys, stored); rows of heavy keys are dealt by ``by``.

    A key is heavy if it holds over 1/``share`` of the counted rows, so there are fewer than ``share`` of them.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("n") * share > total).select(key, F.lit(parts).alias("_parts")))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).otherwise(0)
    dealt = left.join(heavy, key, "left").withColumn("_part", part).drop("_parts")
    shown = counts.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(shown, [key, "_part"]).drop("_part")


def whole_copies(texts: DataFrame) -> DataFrame:
    """(doc, n): documents each of whose texts is, byte for byte, that of a smaller doc; n is the longest text's bytes."""
    sums = texts.select("doc", F.length("body").alias("size"), F.unhex(F.sha2("body", 256)).alias("sum"))
    heads = stored(sums.groupBy("sum").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    later = spread_join(sums, heads, "sum", "doc").where("doc > head").select("doc", "size", F.lit(1).alias("copied"))
    rows = sums.select("doc", "size", F.lit(0).alias("copied")).union(later)
    return rows.groupBy("doc").agg(F.max("size").alias("n"), F.sum("copied").alias("copied"), F.count(F.lit(1)).alias("all")).where("copied * 2 = all").select("doc", "n")


def repeated_spans(texts: DataFrame, length: int = 100, mer: int = 24, hot: int = 50_000, shares: int = 64) -> DataFrame:
    """(doc, lo, hi): byte spans of ``texts`` (doc long in corpus order, body binary) that start earlier as well; spans may overlap."""
    long_ones = texts.where(F.length("body") >= length).select("doc", "body")
    copies = stored(whole_copies(long_ones), "copies")
    counts = stored(long_ones.mapInArrow(_anchors(length, mer, False), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "counts")
    placed = long_ones.mapInArrow(_anchors(length, mer, True), "doc long, anchor long, pos long")
    met_twice = spread_join(placed, counts, "anchor", "doc")
    places = met_twice.select("doc", (F.col("pos") * 2 + F.when(F.col("n") > hot, 1).otherwise(0)).alias("p")).groupBy("doc").agg(F.collect_list("p").alias("places"))
    places = stored(places.join(copies, "doc", "left_anti"), "places")
    segments = long_ones.join(places, "doc").select("doc", "body", "places").mapInArrow(
        _segments(length, mer, shares), "place long, anchor long, hot boolean, digest binary, doc long, start long, body binary, at int")
    met = segments.repartition("anchor", "place").sortWithinPartitions("anchor", "place", "digest", "doc", "start")
    found = stored(met.mapInArrow(_settle(length, mer), "doc long, lo long, hi long, window binary"), "found")
    windows = found.where(F.col("window").isNotNull())
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, "window").where(F.struct("doc", "lo") != F.col("first")).select("doc", "lo", "hi")
    whole = copies.select("doc", F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))
    return found.where(F.col("window").isNull()).select("doc", "lo", "hi").union(later).union(whole)


def _own_keys(texts: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Texts by a key of their own where an id repeats: the id shifted by ``bits``, plus the place of the text's digest among the id's."""
    rows = texts.withColumn("sum", F.unhex(F.sha2("body", 256)))
    order = Window.partitionBy("doc").orderBy("sum")
    places = rows.where(F.col("doc").isNotNull()).select("doc", "sum").distinct().select("doc", "sum", (F.row_number().over(order) - 1).alias("place"))
    keyed = rows.join(places, ["doc", "sum"], "left").select((F.col("doc") * (1 << bits) + F.col("place")).alias("doc"), "body")
    keyed = stored(keyed, "keyed")
    return keyed.where(F.col("doc").isNotNull()).dropDuplicates(["doc"]), keyed


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte bounds of what goes) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    named = texts.where(F.col("doc").isNotNull())
    most = named.groupBy("doc").count().agg(F.max("count")).first()[0] or 1
    bits = int(most - 1).bit_length()
    if bits:
        named, texts = _own_keys(texts, bits)
    spans = repeated_spans(named, length, **options).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    joined = texts.join(spans, "doc", "left").select("doc", "body", "cuts")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>"
    return joined.mapInArrow(_cut, schema).withColumn("doc", F.shiftright("doc", bits)).withColumnRenamed("doc", id_col)
