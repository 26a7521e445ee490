"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Two dictionaries are trained, one on toxic and one on ordinary text. A window is one word in a fixed
frame that both dictionaries know, so that a block is large enough for zstandard to compress and only
the word makes a difference. Windows without four bytes in a row of the toxic dictionary, the shortest
match that zstandard uses, are not tried: it has no match for them. A window is a hit where the toxic dictionary leaves few bytes of it, and
saves so many more than the ordinary one; both bounds are calibrated. A document scores by its hits and
their share through a logistic curve, shifted so that the best F1 of the fitted rows lies at 0.7.

Toxic documents are mostly ordinary text. Trained on all of it, the dictionaries differ by noise (F1
about 0.3 on held-out rows here). So the toxic dictionary is trained on those windows of toxic
documents whose beginnings are far more frequent there than in ordinary documents, counted in distinct
surroundings, so that copies of a document do not count twice. It also holds the ordinary dictionary:
what both know weighs the same on both sides. Windows of ordinary documents that hit by chance are
then added to the ordinary dictionary, a few times over.

Fitting takes at most ``sample_toxic`` and ``sample_ordinary`` labelled rows (those with the smallest
hashes) and ``sample_bytes`` of text, documented bounds; rows of the held-out third are not among them. Scoring covers every
window of every text. The text is the only input of a score.

Null and empty texts have no windows and score as such. Null labels are ignored. Without toxic labels
every text scores 0. Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import batches, row_columns

_MARKS = b".,!*#$%&|?;:\"()[]{}<>~=_"
#: Lengths in bytes of a window's beginning, the blank included.
_BEGINNINGS = (5, 6, 7, 8, 10)
#: The shortest match of the compressors; a window with no such piece of the toxic dictionary is not tried.
_SHARED = 4
#: Windows whose lengths a worker keeps.
_KEPT = 400_000
#: The frame before and after a word; zstandard looks for no matches in a block's last eight bytes.
_FRAME, _TAIL = bytes(range(1, 17)), bytes(range(17, 32))
#: What a match can take in on both sides of a word.
_EDGES = _FRAME[1 - _SHARED :] + b" ", b" " + _TAIL[: _SHARED - 1]


def words_of(text: str | None) -> list[bytes]:
    """A whole text's words, A-Z lower-cased and without marks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _MARKS).split()


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _beginnings(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[:k] for k in _BEGINNINGS if k < len(w)] + [w]


def _telling(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: int, ratio: float, z: float) -> set[bytes]:
    """Beginnings of windows that are far more frequent in toxic documents."""
    n_toxic, n_ordinary = sum(map(len, toxic)) + 1, sum(map(len, ordinary)) + 1

    def strong(a: float, b: float) -> bool:
        a, b = a + 0.5, b + 0.5
        gap = math.log(a / n_toxic) - math.log(b / n_ordinary)
        return gap > math.log(ratio) and gap / math.sqrt(1 / a + 1 / b) > z

    counts = [Counter(), Counter()]
    for counter, docs in zip(counts, (toxic, ordinary)):
        for words in docs:
            for w, n in Counter(words).items():
                for b in _beginnings(w):
                    counter[b] += n
    maybe = {b for b, n in counts[0].items() if n >= least and strong(n, counts[1][b])}
    around: list[dict[bytes, set[int]]] = [defaultdict(set), defaultdict(set)]
    for seen, docs in zip(around, (toxic, ordinary)):
        for words in docs:
            for before, w, after in zip([b"", *words], words, [*words[1:], b""]):
                for b in _beginnings(w):
                    if b in maybe:
                        seen[b].add(hash((before, w, after)))
    return {b for b in maybe if len(around[0][b]) >= least and strong(len(around[0][b]), len(around[1][b]))}


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content; too few samples to train on serve as the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the calibrated bounds of a hit, and the logistic curve's numbers."""

    toxic: bytes
    ordinary: bytes
    gain: int = 3
    left: int = 64
    weights: tuple[float, ...] = (0.0, 0.0)
    bias: float = -20.0

    def features(self, hits: int, words: int) -> tuple[float, ...]:
        return (math.log1p(hits), 10 * math.sqrt(hits / max(words, 1)))

    def score(self, hits: int, words: int) -> float:
        if not self.toxic:
            return 0.0
        x = self.bias + sum(w * f for w, f in zip(self.weights, self.features(hits, words)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _compressor(content: bytes):
    tuned = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=_SHARED, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    ready = zstandard.ZstdCompressionDict(_FRAME + _TAIL + content + _FRAME + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    ready.precompute_compress(compression_params=tuned)
    return zstandard.ZstdCompressor(dict_data=ready, compression_params=tuned).compress


class Lengths:
    """Of each window: bytes left by the toxic dictionary, bytes left by the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(ordinary + toxic), _compressor(ordinary)
        near = (_TAIL + ordinary)[1 - _SHARED :] + toxic + _FRAME[: _SHARED - 1]  # matches may begin before it or end after it
        self.pieces = {near[k : k + _SHARED] for k in range(len(near) - _SHARED + 1)}
        self.young: dict[bytes, tuple[int, int]] = {}
        self.old: dict[bytes, tuple[int, int]] = {}

    def tried(self, word: bytes) -> bool:
        """Whether the toxic dictionary has a long enough piece of the window, with the frame beside it, for a match."""
        w, pieces = _EDGES[0] + word + _EDGES[1], self.pieces
        for k in range(len(w) - _SHARED + 1):
            if w[k : k + _SHARED] in pieces:
                return True
        return False

    def of(self, word: bytes) -> tuple[int, int]:
        """A window that is not tried keeps its length under both."""
        if not self.tried(word):
            n = len(word) + len(_FRAME) + len(_TAIL) + 2
            return n, n
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                window = _FRAME + b" " + word + b" " + _TAIL
                found = len(self.toxic(window)), len(self.ordinary(window))
            if len(self.young) > _KEPT:
                self.young, self.old = {}, self.young
            self.young[word] = found
        return found


class Hits:
    """Whether a window is a hit; most words come again, so verdicts are kept."""

    def __init__(self, model: Model):
        self.model, self.lengths = model, Lengths(model.toxic, model.ordinary)
        self.known: dict[bytes, bool] = {}

    def count(self, words: list[bytes]) -> int:
        known = self.known
        if len(known) > _KEPT:
            known.clear()
        gain, left, tried = self.model.gain, self.model.left, self.lengths.tried
        for w in set(words):
            if w in known:
                continue
            if tried(w):
                toxic, ordinary = self.lengths.of(w)
                known[w] = ordinary - toxic >= gain and toxic <= left
            else:
                known[w] = False
        return sum(map(known.__getitem__, words))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton's steps for a ridge logistic regression; the bias comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(F1, cut): scores from the cut on as positive have the largest F1; the cut lies between scores."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    f1 = 2 * hit[ends] / (ends + 1 + y.sum())
    k = int(np.argmax(f1))
    below = s[ends[k] + 1] if ends[k] + 1 < len(s) else s[ends[k]] - 1
    return float(f1[k]), float((s[ends[k]] + below) / 2)


def fit(toxic: list[str | None], ordinary: list[str | None], least: int = 6, ratio: float = 6.0, z: float = 3.5, size: tuple[int, int] = (4_096, 32_768), cut_at: float = 0.7) -> Model:
    """Trains both dictionaries and calibrates on the same rows."""
    bad, good = [words_of(t) for t in toxic], [words_of(t) for t in ordinary]
    telling = _telling(bad, good, least, ratio, z)
    if not telling:
        return Model(b"", b"")
    mine, theirs = Counter(), Counter()
    for words in bad:
        mine.update(w for w in words if not telling.isdisjoint(_beginnings(w)))
    for words in good:
        theirs.update(w for w in words if telling.isdisjoint(_beginnings(w)))
    framed = lambda counter, most: [b" " + w + b" " for w, n in sorted(counter.items(), key=lambda x: (x[1], x[0])) for _ in range(min(n, most))]
    toxic_text, ordinary_text = _trained(framed(mine, 40), size[0]), _trained(framed(Counter(dict(theirs.most_common(30_000))), 8), size[1])
    missing = [w for w, n in mine.most_common(200) if n >= least and w not in toxic_text]
    toxic_text += b"".join(b" " + w for w in reversed(missing)) + b" "
    for _ in range(3):
        lengths = Lengths(toxic_text, ordinary_text)
        chance = [w for w in theirs if (got := lengths.of(w))[1] - got[0] >= 3]
        if len(chance) < 20:
            break
        ordinary_text += (b" " + b" ".join(sorted(chance, key=lambda w: (theirs[w], w))))[-size[1] // 4 :] + b" "
    lengths = Lengths(toxic_text, ordinary_text)
    each = [[lengths.of(w) for w in words] for words in bad + good]
    y = np.array([1.0] * len(bad) + [0.0] * len(good))
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in each]
    floor = min((int(p[:, 0].min()) for p in pairs if len(p)), default=0)
    best = (-1.0, Model(b"", b""))
    for gain in range(1, 7):
        for left in (floor + 3, floor + 5, floor + 8, floor + 64):
            tried = Model(toxic_text, ordinary_text, gain, left)
            x = np.array([tried.features(int(((p[:, 1] - p[:, 0] >= gain) & (p[:, 0] <= left)).sum()), len(p)) for p in pairs])
            *w, bias = _logistic(x, y)
            f1, cut = _best_cut(x @ np.array(w) + bias, y)
            if f1 > best[0]:
                shift = math.log(cut_at / (1 - cut_at)) - cut
                best = (f1, Model(toxic_text, ordinary_text, gain, left, tuple(map(float, w)), float(bias + shift)))
    return best[1]


def learn(docs: DataFrame, labels: DataFrame, sample_toxic: int = 1500, sample_ordinary: int = 3000, sample_bytes: int = 48 << 20, **options) -> Model:
    """Fits on labelled documents outside the held-out third, at most so many of each kind and so many bytes.

    A document with both labels counts as toxic. Rows with the smallest hashes of doc_id come first.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("id")))
    marked = ids.groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    few = marked.where("toxic = 1").orderBy(*order).limit(sample_toxic).union(marked.where("toxic = 0").orderBy(*order).limit(sample_ordinary))
    rows = row_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(few), "id")  # at most both samples
    size = rows.dropDuplicates(["id", "text"]).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)))
    so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy(*order, "text"))
    kept = size.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes // 2)
    got = sorted(kept.select("id", "toxic", "text").collect(), key=lambda r: (r["id"], r["text"] or ""))
    return fit([r["text"] for r in got if r["toxic"]], [r["text"] for r in got if not r["toxic"]], **options)


def score(docs: DataFrame, model: Model, cut_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; one pass without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(model)
        for batch in rows:
            made = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                made.append(model.score(hits.count(words) if model.toxic else 0, len(words)))
            yield from batches(schema, {"doc_id": batch.column("doc_id"), "score": made})

    slim = row_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = slim.mapInArrow(read, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))
