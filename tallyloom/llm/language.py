"""Language identification with segmentation-marginalised unigram pieces.

Pieces come from a fixed public vocabulary.  Each language has a probability per piece; a
word's probability is the sum over all its segmentations into pieces, computed by the
forward algorithm, and a text's is the product over its words (no piece crosses white
space).  Piece probabilities are learned by expectation maximisation: expected piece
counts come from the forward and backward sums of each distinct word, weighted by how
often the word occurs in training texts of the language.

Training takes a hash sample of about ``sample_docs`` texts per language (a documented
bound); counting, expectations and scoring are distributed, only the model (languages x
pieces) passes the driver.  Every text is scored whole.

Defined cases: null text or no letters gives ``und`` with score 0, as does every text if
there is nothing to learn from; unknown letters use the vocabulary's unknown piece;
rows may repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tallyloom.llm.common import batches, discard, id_crc, mix64, stored, strings, text_slices

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"
_LETTER = re.compile(r"[^\W\d_]")
_SLOTS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Vectorised lookup of substrings in the vocabulary (id 0 is the unknown piece)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        known = {sp.id_to_piece(i): i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.longest = max(map(len, known))
        self.key = np.zeros(self.size, np.uint64)
        hashes, ids = np.array([self._hash(p) for p in known], np.uint64), np.fromiter(known.values(), np.int32)
        self.key[ids] = hashes
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        # tables without collisions: what does not fit in one goes to the next, looked up at other bits
        self.tables, rest = [], np.arange(len(ids))
        while len(rest):
            shift = np.uint64(20 * (len(self.tables) % 3))
            slot = ((hashes[rest] >> shift) & np.uint64(_SLOTS - 1)).astype(np.int64)
            table = np.zeros(_SLOTS, np.int32)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = ids[rest[first]]
            self.tables.append((shift, table))
            rest = np.delete(rest, first)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = mix64((h + np.uint64(ord(c))) * _STEP)
        return h[0]

    def lattice(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> piece id of each word of equal length; -1 where it is no piece."""
        n = chars.shape[1]
        out, h = {}, np.zeros_like(chars, dtype=np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            m = n - k + 1
            h = mix64((h[:, :m] + chars[:, k - 1:]) * _STEP)
            ids = np.full(h.shape, -1, np.int32)
            for shift, table in self.tables:
                got = table[(h >> shift) & np.uint64(_SLOTS - 1)]
                hit = (got > 0) & (self.key[got] == h)
                ids[hit] = got[hit]
            if k == 1:
                ids[ids < 0] = 0
            for j in range(m):
                if k == 1 or (ids[:, j] >= 0).any():
                    out[j, j + k] = ids[:, j]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str], rows: int = 4096):
    """(positions, matrix of code points) for runs of words of equal length; each word opens with the start mark."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for n in np.unique(sizes):
        at = order[np.searchsorted(sizes[order], n):np.searchsorted(sizes[order], n, side="right")]
        step = max(1, min(rows, (1 << 18) // (int(n) + 1)))
        for lo in range(0, len(at), step):
            some = at[lo:lo + step]
            flat = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), n)
            yield some, np.concatenate([np.full((len(some), 1), ord(START), np.uint64), flat.astype(np.uint64)], axis=1)


def log_scores(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language: (words, languages); ``prob`` is (pieces + 1, languages), last row 0."""
    out = np.empty((len(words), prob.shape[1]))
    for at, chars in by_length(words):
        n = chars.shape[1]
        edges = pieces.lattice(chars)
        alpha = {0: np.ones((len(at), prob.shape[1]))}
        logs = np.zeros((len(at), prob.shape[1]))
        for i in range(1, n + 1):
            a = np.zeros((len(at), prob.shape[1]))
            for j in range(max(0, i - pieces.longest), i):
                if (ids := edges.get((j, i))) is not None:
                    a += alpha[j] * prob[ids]
            alpha[i] = a
            alpha.pop(i - pieces.longest, None)
            if i % 16 == 0:  # keep long words within the range of doubles
                logs += np.log(a)
                for j in alpha:
                    alpha[j] = alpha[j] / a
                alpha[i] = np.ones_like(a)
        out[at] = np.log(alpha[n]) + logs
    return out


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in the words of one language.

    Sums at each place are kept as a share of 1 with the logarithm of their scale, so that
    words of any length and of the rarest pieces stay within the range of doubles.
    """
    total = np.zeros(pieces.size)
    for at, chars in by_length(words):
        n = chars.shape[1]
        edges = pieces.lattice(chars)
        p = {e: prob[ids] for e, ids in edges.items()}
        up, down = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
        for i in range(1, n + 1):
            up[i] = up[i - 1] + np.log(sum(np.exp(up[j] - up[i - 1]) * p[j, i] for j in range(max(0, i - pieces.longest), i) if (j, i) in p))
        for j in range(n - 1, -1, -1):
            down[j] = down[j + 1] + np.log(sum(np.exp(down[i] - down[j + 1]) * p[j, i] for i in range(j + 1, min(n, j + pieces.longest) + 1) if (j, i) in p))
        for (j, i), ids in edges.items():
            use = np.exp(up[j] + down[i] - up[n]) * p[j, i] * counts[at]
            ok = ids >= 0
            total += np.bincount(ids[ok], weights=use[ok], minlength=pieces.size)
    return total


def _padded(model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(model)
    return names, np.concatenate([np.stack([model[x] for x in names], axis=1), np.zeros((1, len(names)))])


def _count_words():
    kinds = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(it):
        for b in it:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                seen.setdefault(lang, Counter()).update(text.split())
            yield from batches(((lang, w, n) for lang, c in seen.items() for w, n in c.items()), kinds, 65536)

    return run


def train(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = 2000, rounds: int = 3, smooth: float = 0.1,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Piece probabilities and share of each language, from rows with a language and a text.

    About ``sample_docs`` texts of each language are used, chosen by the hash of their id.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).alias("_h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}, {}
    most = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(1, int((1 << 20) * min(1.0, sample_docs / n)))))])
    some = known.where(F.col("_h") < most[F.col("lang")]).select("lang", "text")
    words = stored(some.mapInArrow(_count_words(), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pieces = vocabulary(path)
    model = {lang: np.full(pieces.size, 1.0 / pieces.size) for lang in sizes}
    for _ in range(rounds):
        before = model

        def step(it):
            own, use = vocabulary(path), {}
            for b in it:
                group: dict[str, tuple[list, list]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                    w, c = group.setdefault(lang, ([], []))
                    w.append(word)
                    c.append(n)
                for lang, (w, c) in group.items():
                    use[lang] = use.get(lang, 0) + expected(w, np.array(c, float), own, np.append(before[lang], 0.0))
            rows = ((lang, int(i), float(v[i])) for lang, v in use.items() for i in np.flatnonzero(v))
            yield from batches(rows, pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("uses", pa.float64())]), 65536)

        found = words.mapInArrow(step, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        model = {}
        for lang in sizes:
            mine = found[found["lang"] == lang]
            v = np.full(pieces.size, smooth)
            v[mine["piece"].to_numpy()] += mine["uses"].to_numpy()
            if not np.isfinite(v).all():
                raise ValueError(f"piece counts of language {lang!r} are not finite")
            model[lang] = v / v.sum()
    discard(docs.sparkSession, words)
    total = sum(sizes.values())
    return model, {k: n / total for k, n in sizes.items()}


def _scorer(model: dict[str, np.ndarray], share: dict[str, float], path: str):
    names, prob = _padded(model) if model else ([], np.zeros((1, 0)))
    prior = np.log([share[x] for x in names]) if names else np.zeros(0)

    def score(texts: list[str]) -> tuple[list[str], list[float]]:
        pieces = vocabulary(path)
        tags, sure = ["und"] * len(texts), [0.0] * len(texts)
        index: dict[str, int] = {}
        rows, flat = [], []
        for i, t in enumerate(texts):
            if names and _LETTER.search(t):
                own = [index.setdefault(w, len(index)) for w in t.split()]
                rows.append((i, len(flat)))
                flat += own
        if not rows:
            return tags, sure
        logs = log_scores(list(index), pieces, prob)
        at = np.array([lo for _, lo in rows])
        flat = np.array(flat)
        # sums by position keep the float order of each text the same in every batch
        sums = np.add.reduceat(logs[flat], at, axis=0) + prior
        post = np.exp(sums - sums.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        for (i, _), k, p in zip(rows, best, post):
            tags[i], sure[i] = names[k], min(1.0, float(p[k]))
        return tags, sure

    return score


def predict(docs: DataFrame, model: dict[str, np.ndarray], share: dict[str, float], path: str = VOCABULARY, text_col: str = "text",
            chunk: int = 2 << 20, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (or the names in ``into``); the text is the only input."""
    score = _scorer(model, share, path)
    where = docs.columns.index(text_col)

    def run(it):
        for b in it:
            tags, sure = [], []
            for _, _, texts in text_slices(b.column(where), b.num_rows, chunk):
                got = score(texts)
                tags += got[0]
                sure += got[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tags, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names, *into])

    schema = StructType(list(docs.schema.fields)).add(into[0], StringType()).add(into[1], DoubleType())
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Languages of all texts, learned from rows whose id's crc32 modulo 3 is not 1: doc_id, held_out, lang_pred, score."""
    held = (id_crc("doc_id", 3) == 1).alias("held_out")
    model, share = train(docs.where(id_crc("doc_id", 3) != 1), **options)
    return predict(docs.select("doc_id", held, "text"), model, share).select("doc_id", "held_out", "lang_pred", "score")
