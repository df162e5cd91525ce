"""Language identification by nearest centroid.

A text becomes a hashed vector of its character 1- to 3-grams, weighted by TF-IDF and
normalised. Each language has several centroids, found by spherical k-means among its
labelled texts; a text gets the language of the centroid with the greatest cosine, and is
rejected where that cosine is below the radius of the centroid for texts of its length.

A radius lies halfway between what the language's own labelled texts reach and what those of the
other languages stay below, which stand for languages not learned; it is fitted for prefixes of
several lengths, as short texts are farther from any centroid. Texts of a few letters can't be told
from those of an unlearned language and mostly pass.

The model is fitted on at most `per_language` labelled rows of each language, those with the
least hash; prediction reads every text from start to end. It has at most four centroids for
each language, and grows with the number of languages alone.

Defined results: a null text, an empty one or one without a letter is `und` with score 0,
and rejected. Without any labelled row everything is `und`. Equal texts get equal results;
other columns pass through unchanged, and columns named like the results are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
DIMS = 4096
#: Numbers of characters for which radii are fitted; a text takes the greatest that it has.
LENGTHS = (1, 8, 16, 32, 64, 128, 256, 1024)
_PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_RESULT = ("lang_pred", "score", "rejected")
_lut: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself for letters and marks of the basic plane, else a space."""
    global _lut
    if _lut is None:
        _lut = np.arange(0x110000, dtype=np.uint32)
        other = [c for c in range(0x3000) if not (chr(c).isalpha() or 0x300 <= c < 0x370)]
        _lut[other] = 32
    return _lut


def _pieces(texts: Iterable[str]) -> Iterator[tuple[int, str, int]]:
    """(index, piece, number of n-grams that start in it); long texts come in several pieces."""
    for i, t in enumerate(texts):
        t = t.lower()
        for s in range(0, len(t), _PIECE):
            n = min(_PIECE, len(t) - s)
            yield i, t[s : s + n + 2].ljust(n + 2), n


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    group: list[tuple[int, str, int]] = []

    def flush() -> None:
        if not group:
            return
        code = _letters()[np.frombuffer("".join(p for _, p, _ in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        width = np.array([n + 2 for _, _, n in group])
        start = np.concatenate([[0], np.cumsum(width)[:-1]])
        own = np.arange(len(group), dtype=np.int64)
        row = np.repeat(own, width)[: len(code) - 2]
        real = np.ones(len(code), dtype=bool)
        real[start + width - 1] = real[start + width - 2] = False
        keep = np.flatnonzero(real[: len(code) - 2])
        row = row[keep] * DIMS
        grams = code[:-2] * np.uint32(0x9E3779B1)
        total = np.zeros(len(group) * DIMS, dtype=np.int64)
        for n in (1, 2, 3):
            if n > 1:
                grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[n - 1 : len(code) - 3 + n] * np.uint32(0xC2B2AE35)
            mixed = (grams ^ (grams >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            total += np.bincount(row + (mixed >> np.uint32(20)).astype(np.int64)[keep], minlength=len(total))
        np.add.at(out, [i for i, _, _ in group], total.reshape(len(group), DIMS))
        group.clear()

    size = 0
    for piece in _pieces(texts):
        group.append(piece)
        size += piece[2]
        if size >= _PIECE or len(group) >= 256:
            flush()
            size = 0
    flush()
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    radius: np.ndarray
    lengths: tuple[int, ...] = (0,)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for s in range(0, len(known), 256):
            part = known[s : s + 256]
            cosine = _weighted(term_counts([texts[i] for i in part]), self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, b in zip(part, best.tolist(), strict=True):
                langs[i] = self.languages[b]
            top = cosine[np.arange(len(part)), best]
            scores[part] = np.round(np.clip(top, 0, 1), 6)
            size = np.searchsorted(self.lengths, [len(texts[i]) for i in part], side="right") - 1
            rejected[part] = top < self.radius[best, size]
        return langs, scores, rejected


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the text nearest to the mean, then the farthest ones."""
    first = int((v @ v.mean(axis=0)).argmax())
    seeds = [first]
    near = v @ v[first]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


def _radii(v: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> list[float]:
    """For each of a language's centroids, halfway between the cosine that all but the farthest hundredth of its
    own texts reach and that which all but the nearest hundredth of other languages' texts stay below, and never
    above the first; NaN where it has no text."""
    cosine = v @ centroids.T
    best, top = cosine.argmax(axis=1), cosine.max(axis=1)
    outside = float(np.quantile(top[~own], 0.99)) if not own.all() else 0.0
    inside = [float(np.quantile(top[own & (best == j)], 0.01)) if (own & (best == j)).any() else np.nan for j in range(len(centroids))]
    return [min(x, (x + outside) / 2) for x in inside]


def fit_vectors(counts: np.ndarray, langs: list[str], per_language_centroids: int = 4, prefixes: Iterable[tuple[int, np.ndarray, list[str]]] = ()) -> Model:
    """Model from the n-gram counts of labelled texts, and radii from those of their prefixes: (length, counts, languages) by length."""
    if not len(langs):
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros((0, 1)))
    idf = (np.log((len(langs) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1).astype(np.float32)
    v, of = _weighted(counts, idf), np.array(langs)
    each = {lang: _kmeans(v[of == lang], per_language_centroids) for lang in sorted(set(langs))}
    lengths, radii = [], []
    #: Prefixes of one length at a time, so that no more than their vectors are held.
    for n, x, x_langs in prefixes:
        x, x_of = _weighted(x, idf), np.array(x_langs)
        lengths.append(n)
        radii.append([r for lang, c in each.items() for r in _radii(x, x_of == lang, c)])
    if not lengths:
        lengths, radii = [0], [[r for lang, c in each.items() for r in _radii(v, of == lang, c)]]
    #: Without own texts of a length, that of the next shorter ones holds.
    radius = np.array(radii).T
    for k in range(1, len(lengths)):
        radius[:, k] = np.where(np.isnan(radius[:, k]), radius[:, k - 1], radius[:, k])
    names = [lang for lang, c in each.items() for _ in c]
    return Model(idf, np.concatenate(list(each.values())).astype(np.float32), names, np.nan_to_num(radius), (0, *lengths[1:]))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, sample_rows: int = 20_000) -> Model:
    """Fit on at most `per_language` rows of each language, and about `sample_rows` in all.

    With more than sample_rows / per_language languages each of them has fewer rows; none is left out. The rows are
    those with the least hash of key and text, equal rows counting once.
    """
    h = F.xxhash64(F.col(key), F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), h.alias("h"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return fit_vectors(np.zeros((0, DIMS), np.float32), [])
    each = max(1, min(per_language, sample_rows // len(counts)))

    def below(limits: dict[str, int]) -> Column:
        return F.col("h") <= F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("lang"))

    #: Hashes are spread evenly, so this leaves somewhat more than `each`; the exact bound is then found among few.
    share = {x: min(1.0, (each + 8 * each**0.5 + 64) / n) for x, n in counts.items()}
    first = {x: int(-(1 << 63) + s * ((1 << 64) - 1)) if s < 1 else (1 << 63) - 1 for x, s in share.items()}
    near: dict[str, list[int]] = {}
    for r in rows.where(below(first)).select("lang", "h").distinct().collect():
        near.setdefault(r["lang"], []).append(r["h"])
    sample = rows.where(below({x: sorted(hs)[:each][-1] for x, hs in near.items()}))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            names = list(zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), strict=True))
            new = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(new, pa.int64()))
            texts = b.column("text").to_pylist()
            for size in (0, *LENGTHS):
                own = [i for i, t in enumerate(texts) if len(t) >= size and (not size or _LETTER.search(t[:size]))]
                for s in range(0, len(own), 256):
                    part = own[s : s + 256]
                    c = term_counts([texts[i][: size or None] for i in part])
                    at = [np.flatnonzero(row).astype(np.int16) for row in c]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("lang").take(pa.array(part)), b.column("h").take(pa.array(part)), pa.array([size] * len(part), pa.int32()), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(c, at, strict=True)], pa.binary())],
                        names=["lang", "h", "size", "at", "n"],
                    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(r["lang"], r["h"], r["size"]): (r["at"], r["n"]) for b in batches for r in b.to_pylist()}
        rows = sorted(found)

        def counts(size: int) -> tuple[np.ndarray, list[str]]:
            own = [k for k in rows if k[2] == size]
            out = np.zeros((len(own), DIMS), dtype=np.float32)
            for i, k in enumerate(own):
                at, n = found[k]
                out[i, np.frombuffer(at, dtype=np.int16)] = np.frombuffer(n, dtype=np.float32)
            return out, [k[0] for k in own]

        prefixes = ((n, *x) for n in LENGTHS if (x := counts(n))[1])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_vectors(*counts(0), prefixes=prefixes))], pa.binary())], names=["model"])

    #: The sample is bounded, so one task trains on it; the driver gets the model alone.
    vectors_ = sample.mapInArrow(vectors, "lang string, h long, size int, at binary, n binary")
    return pickle.loads(vectors_.repartition(1).mapInArrow(train, "model binary").first()["model"])


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with lang_pred, score and rejected."""
    docs = docs.drop(*_RESULT)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = model.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*b.schema.names, *_RESULT],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(predict, schema)
