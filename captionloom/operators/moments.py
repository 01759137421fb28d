"""Mean and covariance of feature vectors, and the Frechet distance between two sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS_PER_CORE = 4
STATE = "side string, i int, n bigint, mean array<double>, m2 array<double>"


def _merge(a, b):
    """Combines (n, mean, m2 rows) of two disjoint sets (Chan, Golub, LeVeque 1983)."""
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2], b[2], delta, a[0] * b[0] / n


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centred sums of products of one partition: d rows per side, whatever the row count."""
    state: dict = {}
    for batch in batches:
        sides = np.asarray(batch.column(0).to_pylist(), dtype=object)
        dims = set(batch.column(1).value_lengths().to_pylist())
        if len(dims) > 1:
            raise ValueError(f"feature vectors of different lengths: {sorted(dims)}")
        dim = dims.pop() if dims else 0
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(-1, dim) if dim else flat.reshape(0, 0)
        for side in set(sides.tolist()):
            part = rows[sides == side]
            mean = part.mean(axis=0)
            centred = part - mean
            new = (len(part), mean, centred.T @ centred)
            if side in state:
                if len(state[side][1]) != dim:
                    raise ValueError(f"feature vectors of different lengths: {sorted({len(state[side][1]), dim})}")
                n, mean, m2a, m2b, delta, weight = _merge(state[side], new)
                new = (n, mean, m2a + m2b + np.outer(delta, delta) * weight)
            state[side] = new
    for side, (n, mean, m2) in state.items():
        dim = len(mean)
        yield pa.RecordBatch.from_pydict(
            {
                "side": pa.array([side] * dim, pa.string()),
                "i": pa.array(range(dim), pa.int32()),
                "n": pa.array([n] * dim, pa.int64()),
                "mean": pa.array([mean] * dim, pa.list_(pa.float64())),
                "m2": pa.array(list(m2), pa.list_(pa.float64())),
            }
        )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up partial rows as they come; keeps one row of the matrix per (side, i)."""
    state: dict = {}
    for batch in batches:
        for side, i, n, mean, m2 in batch.itertuples(index=False):
            new = (n, np.asarray(mean), np.asarray(m2))
            if (side, i) in state:
                if len(state[side, i][1]) != len(new[1]):
                    raise ValueError("feature vectors of different lengths")
                n, mean, m2a, m2b, delta, weight = _merge(state[side, i], new)
                new = (n, mean, m2a + m2b + delta[i] * delta * weight)
            state[side, i] = new
    rows = [(s, i, n, mean, m2) for (s, i), (n, mean, m2) in state.items()]
    yield pd.DataFrame(rows, columns=["side", "i", "n", "mean", "m2"])


def moment_state(df: DataFrame, side: str = "side", vec: str = "embedding") -> DataFrame:
    """``side, i, n, mean, m2``: one row per dimension, ``m2`` the i-th row of the centred sums of products.

    Every task reduces its rows to a d x d matrix before anything is shuffled; the partial matrices are
    then summed row by row, spread over (side, i). A task takes several input partitions, so
    that the number of matrices follows the cores of the cluster and not the size of the input.
    Vectors of different lengths are an error.
    """
    narrow = df.select(F.col(side).cast("string").alias("side"), F.col(vec).alias("v"))
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return merge_states(narrow.filter(F.col("v").isNotNull()).coalesce(tasks).mapInArrow(_partials, STATE))


def merge_states(states: DataFrame) -> DataFrame:
    """One state of the rows of several, those of disjoint sets of vectors: it is the state of all of them."""
    return states.repartition("side", "i").mapInPandas(_combine, STATE)


def moments_of(state: DataFrame) -> DataFrame:
    """``side, i, n, mean, cov`` of a state."""
    cov = F.transform("m2", lambda x: x / F.greatest(F.col("n") - 1, F.lit(1)))
    return state.select("side", "i", "n", F.element_at("mean", F.col("i") + 1).alias("mean"), cov.alias("cov"))


def feature_moments(df: DataFrame, side: str = "side", vec: str = "embedding") -> DataFrame:
    """``side, i, n, mean, cov``: one row per dimension, ``cov`` the i-th row of the covariance."""
    return moments_of(moment_state(df, side, vec))


def _version(spark: SparkSession, store: str) -> int | None:
    """The last version that was written to the end; its list of sources is written last, as one file."""
    try:
        return spark.read.parquet(f"{store}/sources").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def kept_state(spark: SparkSession, store: str) -> DataFrame:
    """The state kept in ``store``: moments of all that was added, without reading any of it."""
    version = _version(spark, store)
    if version is None:
        raise ValueError(f"{store} holds no moments")
    return spark.read.schema(STATE).parquet(f"{store}/state/version={version}")


def add_to_kept(store: str, name: str, fingerprint: str, vectors: DataFrame, side: str = "side", vec: str = "embedding") -> bool:
    """Adds the vectors of a source to the state in ``store``; False, and nothing is read, if it is in there already.

    A source is known by its name and what its fingerprint says of its content; a known name with another
    fingerprint is an error, because what was added cannot be taken out again. The new state stands beside the old
    one until its list of sources is written, so a run that was stopped can be repeated. One writer at a time.
    """
    spark = vectors.sparkSession
    version = _version(spark, store)
    names = spark.createDataFrame([(name, fingerprint)], "name string, fingerprint string")
    state = moment_state(vectors, side, vec)
    if version is not None:
        listed = spark.read.parquet(f"{store}/sources/version={version}")
        known = [r["fingerprint"] for r in listed.filter(F.col("name") == name).collect()]
        if known == [fingerprint]:
            return False
        if known:
            raise ValueError(f"{name} has changed since it was added to {store}")
        names, state = listed.unionByName(names), merge_states(kept_state(spark, store).unionByName(state))
    after = 0 if version is None else version + 1
    state.write.mode("overwrite").parquet(f"{store}/state/version={after}")
    names.coalesce(1).write.mode("overwrite").parquet(f"{store}/sources/version={after}")
    return True


def _root_trace(a: np.ndarray, b: np.ndarray) -> float:
    """Trace of (AB)^(1/2) for positive semidefinite A and B."""
    values, basis = np.linalg.eigh((a + a.T) / 2)
    root = basis * np.sqrt(np.clip(values, 0, None))
    inner = root.T @ b @ root
    return float(np.sqrt(np.clip(np.linalg.eigvalsh((inner + inner.T) / 2), 0, None)).sum())


def frechet_distance(moments: DataFrame, real: str = "real", fake: str = "fake") -> DataFrame:
    """``n_real, n_fake, fid`` from moments: |mr-mf|^2 + tr(Cr + Cf - 2 (Cr Cf)^(1/2)).

    What meets in one task, under a constant key, are the 2d moment rows, fixed by the vector length.
    """

    def distance(rows: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for name in (real, fake):
            part = rows[rows["side"] == name].sort_values("i")
            if part.empty or part["n"].iloc[0] < 2:
                raise ValueError(f"side {name!r} needs at least two vectors")
            parts[name] = (int(part["n"].iloc[0]), part["mean"].to_numpy(), np.stack(part["cov"].to_list()))
        (nr, mr, cr), (nf, mf, cf) = parts[real], parts[fake]
        fid = float((mr - mf) @ (mr - mf) + np.trace(cr) + np.trace(cf) - 2 * _root_trace(cr, cf))
        return pd.DataFrame([(nr, nf, fid)], columns=["n_real", "n_fake", "fid"])

    both = moments.filter(F.col("side").isin(real, fake))
    return both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(distance, "n_real bigint, n_fake bigint, fid double")


def fid(df: DataFrame, side: str = "side", vec: str = "embedding", real: str = "real", fake: str = "fake") -> DataFrame:
    return frechet_distance(feature_moments(df, side, vec), real, fake)
