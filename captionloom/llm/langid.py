"""Language identification by error-correcting output codes.

Every language has a codeword; a linear classifier over hashed byte n-grams predicts each bit. A text
gets the language whose codeword has the smallest weighted hinge loss; bits count by how often they are
right on rows left out of their fit. Where the runner-up's loss is close, the text is flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows the classifiers are fitted on, over all languages: the bound of the sample.
TRAIN_ROWS = 2000
DIM = 2048
GRAMS = 3
RIDGE = 0.05
#: Share of the largest possible loss by which the runner-up must trail.
MARGIN = 0.04
#: Score below which no language stands out; two that are level have a half each.
LEAST_SCORE = 0.45
SEED = 11
UNKNOWN = "und"
BLOCK = 1 << 20
#: ASCII letters lowered, other ASCII to a space, UTF-8 beyond kept.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Square roots of hashed n-gram counts (1 to ``GRAMS`` bytes) over the whole text, at unit length, and a constant."""
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTER_BYTES).split())
    counts = np.zeros(dim, np.float64)
    for at in range(0, len(raw), BLOCK):
        x = np.frombuffer(raw[at : at + BLOCK + GRAMS - 1], np.uint8).astype(np.uint64)
        code = np.zeros(len(x), np.uint64)
        for n in range(1, GRAMS + 1):
            m = min(BLOCK, len(x) - n + 1)
            if m <= 0:
                break
            code = code[:m] * np.uint64(257) + x[n - 1 : n - 1 + m] + np.uint64(1)
            spot = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(40)
            counts += np.bincount((spot % np.uint64(dim)).astype(np.int64), minlength=dim)
    out = np.sqrt(counts)
    length = np.sqrt(counts.sum())
    return np.append(out / length if length else out, 1.0).astype(np.float32)


def codewords(k: int, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 per language: all splits in two for few languages, else spread random ones."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = (np.arange(1, 2 ** (k - 1))[None, :] >> np.arange(k)[:, None]) & 1
        return bits * 2.0 - 1
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        words = rng.integers(0, 2, (k, width)) * 2.0 - 1
        apart = (width - words @ words.T) / 2 + np.eye(k) * width
        if apart.min() > far and not (np.abs(words.sum(axis=0)) == k).any():
            best, far = words, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each row of features."""
        margins = x @ self.weights
        loss = np.maximum(0, 1 - margins[:, None, :] * self.words[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(len(x)), order[:, 0]]
        full = 2 * self.trust.sum()
        score = 1 / np.exp(np.clip((best[:, None] - loss) * 20 / full, -50, 0)).sum(axis=1)
        if len(self.langs) > 1:
            close = (loss[np.arange(len(x)), order[:, 1]] - best) / full < MARGIN
        else:
            close = np.zeros(len(x), bool)
        return [self.langs[i] for i in order[:, 0]], score, close


def fit(langs: list[str], x: np.ndarray) -> Model:
    """Ridge classifiers of all bits; their trust comes from rows left out, in closed form."""
    known = sorted(set(langs))
    words = codewords(len(known))
    y = words[[known.index(v) for v in langs]]
    x = x.astype(np.float64)
    kernel = x @ x.T
    inverse = np.linalg.inv(kernel + RIDGE * np.eye(len(x)))
    dual = inverse @ y
    left_out = y - dual / np.diag(inverse)[:, None]
    trust = np.maximum(1e-3, 2 * (np.sign(left_out) == y).mean(axis=0) - 1)
    return Model(known, words, (x.T @ dual).astype(np.float32), trust)


def held_out(doc_id: Column) -> Column:
    """A third of the documents by their id; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from labelled rows of ``docs`` that are not held out; None if there are none.

    The sample is an equal number of rows per language, one at least: the first in the order of a hash of id and
    text, copies of a row once. It depends on the rows alone, not on their order or number of
    partitions. Its features, not its texts, come to the driver. Languages are few by nature.
    """
    open_rows = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    rows = docs.filter(open_rows)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = max(1, train_rows // len(counts))
    key = F.xxhash64("doc_id", "text")

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())

    # Only hashes below a threshold are looked at. Where copies leave a language too few, its threshold is widened.
    part = {lang: (1.2 * share + 4 * share**0.5 + 4) / n for lang, n in counts.items()}
    chosen: dict[str, list] = {}
    while part:
        low = F.lit(False)
        for lang, p in part.items():
            under = F.lit(True) if p >= 1 else key < F.lit(int(p * 2**64) - 2**63)
            low = low | ((F.col("lang") == lang) & under)
        sample = rows.filter(low).select("doc_id", "lang", "text").distinct()
        got: dict[str, list] = {lang: [] for lang in part}
        for r in sample.select("doc_id", "lang", key.alias("key"), vector("text").alias("x")).collect():
            got[r["lang"]].append(r)
        done = [lang for lang, p in part.items() if p >= 1 or len(got[lang]) >= share]
        for lang in done:
            chosen[lang] = sorted(got[lang], key=lambda r: (r["key"], r["doc_id"], bytes(r["x"])))[:share]
        part = {lang: 2 * p for lang, p in part.items() if lang not in chosen}
    got = [r for lang in sorted(chosen) for r in chosen[lang]]
    got.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    return fit([r["lang"] for r in got], np.stack([np.frombuffer(r["x"], np.float32) for r in got]))


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_found") -> DataFrame:
    """Adds ``out``: struct ``lang, score, ambiguous``. Reads the text alone, all of it.

    ``und`` with score 0 for null, for texts without a letter, and where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def find(texts: pa.Array) -> pa.Array:
        langs, scores, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        spots: list[int] = []
        rows: list[np.ndarray] = []

        def flush() -> None:
            found, score, near = shared.value.decode(np.stack(rows))
            for spot, lang in zip(spots, found):
                langs[spot] = lang
            scores[spots], close[spots] = score, near
            spots.clear()
            rows.clear()

        for i, value in enumerate(texts):
            t = value.as_py()
            if shared.value is not None and has_letter(t):
                spots.append(i)
                rows.append(features(t))
                if len(rows) == 256:
                    flush()
        if rows:
            flush()
        parts = [pa.array(langs, pa.string()), pa.array(scores), pa.array(close)]
        return pa.StructArray.from_arrays(parts, ["lang", "score", "ambiguous"])

    return docs.withColumn(out, find(F.col(text)))


def report(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row; a null doc_id is not held out, nor learned from."""
    docs = docs.select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), learn(docs, train_rows))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("lang_found.lang").alias("lang_pred"),
        F.col("lang_found.score").alias("score"),
        F.col("lang_found.ambiguous").alias("ambiguous"),
    )


def accepted(docs: DataFrame, train_rows: int = TRAIN_ROWS, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` whose language is found; rows without letters, or without a language that stands out, are rejected.

    A text between two languages is flagged as ambiguous, but kept: it may well be clean. Where no row is labelled
    and open to learning there is nothing to judge by: only texts without letters are rejected.
    """
    names = docs.columns
    model = learn(docs, train_rows)
    if model is None:

        @F.arrow_udf("boolean")
        def lettered(texts: pa.Array) -> pa.Array:
            return pa.array([has_letter(t.as_py()) for t in texts], pa.bool_())

        return docs.filter(lettered(F.col("text")))
    found = predict(docs, model, out="__lang")
    sure = (F.col("__lang.lang") != UNKNOWN) & (F.col("__lang.score") >= least_score)
    return found.filter(sure).select(*[F.col(f"`{n}`") for n in names])
