"""Distance, reconstruction and isolation detectors over feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.evaluate import union_flags
from tidewatch.operators.quantiles import flag_above, quantiles
from tidewatch.series import SeriesStats, durable

# Detector profiles (features, clusters) and fit settings.
PROFILES = {
    "spike": (
        ("value_w25_mean", "value_w25_std", "value_w25_zscore", "value_w50_mean", "value_w50_std", "value_w50_zscore"), 8, True,
    ),
    "level_shift": (("value_w25_mean", "value_w25_std", "value_w50_mean", "value_w50_std"), 4, True),
    "dip": (("value_w5_entropy", "value_w25_entropy", "value_w50_entropy"), 4, False),
}
MAX_ITERATIONS = 800
TOLERANCE = 1e-4
SEED = 50
BOUNDARY_PERCENTILE = 99.0
CROSS_DATASET_PERCENTILE = 99.9


@dataclass(frozen=True)
class Profile:
    """Which columns a detector looks at and how many clusters it fits."""

    name: str
    features: tuple[str, ...]
    k: int
    value_is_feature: bool = True

    @property
    def columns(self) -> list[str]:
        return [*(["value"] if self.value_is_feature else []), *self.features]

    @staticmethod
    def named(name: str, value_is_feature: bool | None = None) -> Profile:
        features, k, with_value = PROFILES[name]
        return Profile(name, features, k, with_value if value_is_feature is None else value_is_feature)


def _feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def _distance(a: Column, centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for i, x in enumerate(centre):
        d = F.get(a, F.lit(i)) - F.lit(float(x))
        total = total + d * d
    return F.sqrt(total)


def nearest_centre(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """``cluster`` (lowest number on a tie) and ``distance``: plain expressions over k literals."""
    v = F.col("_features")
    d = F.array(*[F.struct(_distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)])
    rows = df.withColumn("_features", _feature_array(columns)).withColumn("_near", F.array_min(d))
    return rows.select(*df.columns, F.col("_near.cluster").alias("cluster"), F.col("_near.distance").alias("distance"))


@dataclass
class ClusterDetector:
    """Centroids of normal rows with a distance boundary per cluster."""

    columns: list[str]
    centres: list[list[float]]
    boundaries: list[float | None] = field(default_factory=list)

    @staticmethod
    def fit(normal: DataFrame, columns: Sequence[str], k: int, percentile: float = BOUNDARY_PERCENTILE,
            max_iter: int = MAX_ITERATIONS, seed: int = SEED, **kw) -> ClusterDetector:
        spread = normal.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns]).first()
        mean_variance = sum(spread[c] or 0.0 for c in columns) / len(columns)
        # stop when the summed squared shift of the centres is below TOLERANCE * mean variance
        tol = max((TOLERANCE * mean_variance / k) ** 0.5, 1e-12)
        rows = normal.select(array_to_vector(_feature_array(columns)).alias("features"))
        model = KMeans(k=k, maxIter=max_iter, seed=seed, tol=tol).fit(rows)
        centres = [list(map(float, c)) for c in model.clusterCenters()]
        sizes = model.summary.clusterSizes  # known from the fit: no counting job
        kw.setdefault("stats", SeriesStats(sum(sizes), len(sizes), max(sizes)))
        return ClusterDetector(list(columns), centres).with_boundaries(normal, percentile, **kw)

    def with_boundaries(self, normal: DataFrame, percentile: float, **kw) -> ClusterDetector:
        near = nearest_centre(normal.select(*self.columns), self.columns, self.centres)
        found = {r["cluster"]: r["b"] for r in quantiles(near, ["cluster"], "distance", {"b": percentile / 100.0}, **kw).collect()}
        self.boundaries = [found.get(i) for i in range(len(self.centres))]
        return self

    def transform(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Adds cluster, distance and the flag distance > boundary of the row's cluster."""
        rows = nearest_centre(df, self.columns, self.centres)
        limit = F.get(F.array(*[F.lit(b).cast("double") for b in self.boundaries]), F.col("cluster"))
        return rows.withColumn(out, F.when(F.col("distance") > limit, 1).otherwise(0))

    def save(self, spark, path: str) -> None:
        rows = [(i, c, b, self.columns) for i, (c, b) in enumerate(zip(self.centres, self.boundaries))]
        schema = "cluster int, centre array<double>, boundary double, columns array<string>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> ClusterDetector:
        rows = spark.read.parquet(path).orderBy("cluster").collect()
        return ClusterDetector(list(rows[0]["columns"]), [list(r["centre"]) for r in rows], [r["boundary"] for r in rows])


def normal_train_rows(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    return df.where((F.col("split") == "train") & (F.col(label) == 0))


def detect_profiles(
    features: DataFrame, profiles: Sequence[Profile], label: str = "is_anomaly", train: DataFrame | None = None,
    percentile: float = BOUNDARY_PERCENTILE, **kw,
) -> DataFrame:
    """Fit one detector per profile on normal train rows and flag the test rows (or all rows of
    ``features`` when another train table is given); ``predicted`` is 1 if any detector fired."""
    fit_on = normal_train_rows(features, label) if train is None else train.where(F.col(label) == 0)
    rows = features.where(F.col("split") == "test") if train is None else features
    for p in profiles:
        detector = ClusterDetector.fit(fit_on, p.columns, p.k, percentile, **kw)
        rows = detector.transform(rows, f"flag_{p.name}").drop("cluster", "distance")
    return union_flags(rows, [f"flag_{p.name}" for p in profiles])


def reconstruction_scores(
    normal: DataFrame, rows: DataFrame, vector: str, k: int = 4, alpha: float = 0.5, beta: float = 0.5, second_k: int | None = None,
) -> DataFrame:
    """``score`` = alpha * mean((x - r1)^2) + beta * mean((x - r2)^2).

    r1 rebuilds the window from ``k`` principal components of normal windows, r2 rebuilds r1 from
    ``second_k`` components (two linear passes in place of two decoders).
    """
    as_vector = array_to_vector(F.col(vector))
    train = normal.select(as_vector.alias("x"))
    dim = len(normal.select(vector).first()[0])
    k = min(k, dim)
    # the covariance is built with one distributed pass; only dim x k numbers come to the driver
    model = PCA(k=k, inputCol="x", outputCol="z").fit(train)
    mean = np.array([r for r in train.select(vector_to_array("x").alias("v")).agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()])
    basis = model.pc.toArray()
    return _project(rows, vector, mean, basis, alpha, beta, min(second_k or max(1, k // 2), k))


def _project(rows: DataFrame, vector: str, mean: np.ndarray, basis: np.ndarray, alpha: float, beta: float, k2: int) -> DataFrame:
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy())
        r1 = (x - mean) @ basis @ basis.T + mean
        small_basis = basis[:, :k2]
        r2 = (r1 - mean) @ small_basis @ small_basis.T + mean
        return pd.Series(alpha * ((x - r1) ** 2).mean(axis=1) + beta * ((x - r2) ** 2).mean(axis=1))

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return rows.withColumn("score", F.pandas_udf(run, "double")(F.col(vector)))


def flag_top_scores(df: DataFrame, score: str = "score", percentile: float = 99.0, out: str = "predicted", **kw) -> DataFrame:
    return flag_above(df, score, percentile, out, **kw)


def flag_score_magnitude(df: DataFrame, score: str = "score", percentile: float = 99.0, out: str = "predicted", **kw) -> DataFrame:
    """|score| >= percentile of the score."""
    return flag_above(df, score, percentile, out, strict=False, **kw)


def project_2d(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First two principal components as ``x`` and ``y`` (plot data)."""
    rows = df.withColumn("_x", array_to_vector(_feature_array(columns)))
    out = PCA(k=2, inputCol="_x", outputCol="_z").fit(rows).transform(rows)
    z = vector_to_array("_z")
    return out.withColumns({"x": F.get(z, F.lit(0)), "y": F.get(z, F.lit(1))}).drop("_x", "_z")


# --- isolation trees -------------------------------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    harmonic = np.log(big - 1.0 + 1e-300) + np.euler_gamma
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (n - 1.0) / big, np.where(n == 2, 1.0, 0.0))


def isolation_forest(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], trees: int = 100, samples: int = 50, seed: int = 112
) -> IsolationModel:
    """Trees over ``trees`` disjoint samples of ``samples`` rows.

    One distributed top-n by hash draws all samples (trees x samples rows); each group builds one
    small tree; the trees (fixed size) come back to the driver and are sent with the scorer.
    """
    total = trees * samples
    drawn = (
        df.select(F.xxhash64(F.lit(seed), *ids).alias("_h"), *ids, _feature_array(columns).alias("x"))
        .orderBy("_h", *ids)
        .limit(total)
    )
    # bounded by trees x samples rows: numbered in one task and dealt in turn, so that trees are even
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", *ids)) - 1
    dealt = drawn.select((place % trees).cast("int").alias("tree"), "x")
    depth_limit = int(np.ceil(np.log2(max(samples, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf["x"].to_numpy())
        x = x[np.lexsort(x.T)]
        nodes: list[tuple] = []
        todo = [(np.arange(len(x)), 0, -1)]
        while todo:
            rows, depth, slot = todo.pop()
            me = len(nodes)
            if slot >= 0:
                parent, side = divmod(slot, 2)
                nodes[parent][3 + side] = me
            spans = x[rows].max(axis=0) - x[rows].min(axis=0)
            usable = np.flatnonzero(spans > 0)
            if depth >= depth_limit or len(rows) <= 1 or not len(usable):
                nodes.append([tree, -1, depth + float(_average_path(len(rows))), -1, -1])
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(x[rows, feature].min(), x[rows, feature].max()))
            nodes.append([tree, feature, cut, -1, -1])
            below = x[rows, feature] < cut
            todo.append((rows[below], depth + 1, 2 * me))
            todo.append((rows[~below], depth + 1, 2 * me + 1))
        return pd.DataFrame(nodes, columns=["tree", "feature", "cut", "low", "high"]).assign(node=np.arange(len(nodes)))

    built = dealt.groupBy("tree").applyInPandas(build, "tree int, feature int, cut double, low int, high int, node int")
    return IsolationModel(list(columns), built.toPandas().sort_values(["tree", "node"]), samples)


@dataclass
class IsolationModel:
    columns: list[str]
    nodes: pd.DataFrame
    samples: int

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        forest = [
            tuple(g[c].to_numpy() for c in ("feature", "cut", "low", "high")) for _, g in self.nodes.groupby("tree")
        ]
        scale = float(_average_path(self.samples)) or 1.0

        def run(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy())
            depth = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, cut, low, high in forest:
                at = np.zeros(len(x), dtype=int)
                live = feature[at] >= 0
                while live.any():
                    node = at[live]
                    left = x[every[live], feature[node]] < cut[node]
                    at[live] = np.where(left, low[node], high[node])
                    live = feature[at] >= 0
                depth += cut[at]
            return pd.Series(2.0 ** (-depth / len(forest) / scale))

        run.__annotations__ = {"v": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(run, "double")(_feature_array(self.columns)))

    def predict(self, df: DataFrame, contamination: float = 0.03, out: str = "predicted", **kw) -> DataFrame:
        """The top share by score is flagged.  Scores are written once: the cut and the result read them."""
        return flag_above(durable(self.transform(df)), "score", 100.0 * (1 - contamination), out, **kw)


def assembled(columns: Sequence[str], stages: Sequence, out: str = "features") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep"), *stages])


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
