"""Fingerprint similarity, diversity, projections and separability of two libraries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.storage import numbered, written


def sign_lanes(vector: Column) -> Column:
    """64-bit lanes of the signs of all of a vector's components."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))).otherwise(F.lit(0).cast("long")))
    lanes = F.sequence(F.lit(0), F.ceil(F.size(vector) / 64).cast("int") - 1)
    return F.transform(lanes, lambda k: F.aggregate(F.slice(bits, k * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))


def tanimoto(a: Column, b: Column) -> Column:
    """Common over united bits of two lane arrays; 0 for two empty ones."""
    common = popcount(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    union = popcount(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(union > 0, common / union).otherwise(0.0)


def unpack(lanes: pd.Series) -> np.ndarray:
    packed = np.array(lanes.tolist(), dtype=np.int64).reshape(len(lanes), -1)
    return np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def tanimoto_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    common = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def popcount(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0), lambda s, x: s + F.bit_count(x).cast("int"))


def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """rows (id, lanes) in blocks of at most `size` of neighbouring bit counts, a row each: name, ids, lanes, low and high count."""
    counted = rows.select("id", "lanes", popcount(F.col("lanes")).alias("bits"))
    cut = numbered(counted, [F.col("bits"), F.xxhash64("id"), F.col("id")], "__k").withColumn(name, F.floor(F.col("__k") / size))
    made = cut.groupBy(name).agg(F.collect_list(F.struct("id", "lanes")).alias("__r"), F.min("bits").alias(f"{name}_low"), F.max("bits").alias(f"{name}_high"))
    return written(made.select(name, F.col("__r.id").alias("ids"), F.col("__r.lanes").alias("lanes"), f"{name}_low", f"{name}_high"), name)


def best_of(visits: DataFrame, asked: DataFrame, cells: DataFrame, chunk: int = 4096) -> DataFrame:
    """block, id and best similarity of every query of a block to the rows of a cell, for the visits (block, cell)."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"block": [], "id": [], "best": []})
        ids, bits, other = left["ids"].iloc[0], unpack(pd.Series(list(left["lanes"].iloc[0]))), list(right["lanes"].iloc[0])
        top = np.zeros(len(ids))
        for i in range(0, len(other), chunk):
            top = np.maximum(top, tanimoto_matrix(bits, unpack(pd.Series(other[i : i + chunk]))).max(1))
        return pd.DataFrame({"block": left["block"].iloc[0], "id": ids, "best": top})

    one = visits.join(asked.select("block", "ids", "lanes"), "block").groupBy("block", "cell")
    other = visits.select(F.col("block").alias("b"), F.col("cell").alias("c"))
    two = other.join(cells.select(F.col("cell").alias("c"), "lanes"), "c").groupBy("b", "c")
    return one.cogroup(two).applyInPandas(best, "block long, id long, best double")


def nearest_tanimoto(queries: DataFrame, reference: DataFrame, block: int = 2048, cell: int = 8192) -> DataFrame:
    """id and the best similarity of each query (id, lanes) to the reference, 0 where that is empty.

    Both sides are cut into blocks of like bit counts, and a block of queries first visits the cell closest in count.
    Sets of a and b bits are similar by min / max of a and b at most, so each block visits only those other cells that
    could still better the worst of its queries; whole blocks travel, once per visit.
    """
    asked, cells = blocks(queries, "block", block), blocks(reference, "cell", cell)
    listed = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "cell_low", "cell_high"))).alias("cells"))  # three numbers for `cell` rows
    low, high = F.col("block_low"), F.col("block_high")
    bound = lambda c: F.when(c["cell_low"] > high, high / c["cell_low"]).when(c["cell_high"] < low, c["cell_high"] / low).otherwise(F.lit(1.0))
    open_cells = asked.select("block", "block_low", "block_high").crossJoin(F.broadcast(listed))  # one row
    rated = written(open_cells.select("block", F.transform("cells", lambda c: F.struct(bound(c).alias("bound"), c["cell"].alias("cell"))).alias("cells")), "rated")
    home = F.element_at("cells", F.array_position(F.col("cells.bound"), F.array_max("cells.bound")).cast("int"))["cell"]
    first = written(best_of(rated.filter(F.size("cells") > 0).select("block", home.alias("cell")), asked, cells), "best")
    worst = first.groupBy("block").agg(F.min("best").alias("worst"))
    left = rated.filter(F.size("cells") > 0).join(worst, "block").withColumn("home", home)
    rest = left.select("block", F.explode(F.filter("cells", lambda c: (c["bound"] > F.col("worst")) & (c["cell"] != F.col("home"))))).select("block", F.col("col.cell").alias("cell"))
    found = first.unionByName(best_of(rest, asked, cells)).select("id", "best")
    none = asked.select(F.explode("ids").alias("id"), F.lit(0.0).alias("best"))
    return found.unionByName(none).groupBy("id").agg(F.max("best").alias("best"))


def bit_sums(points: DataFrame, dims: int) -> DataFrame:
    """One row: n and per-dimension sums, which give mean squared distances without pairs."""
    return points.agg(F.count("*").alias("n"), *[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(dims)])


def mean_pairwise_distance(sample: DataFrame, most: int = 20_000) -> DataFrame:
    """One row: mean of 1 - similarity over pairs of a stated sample (id, lanes) of at most `most` rows, which every executor gets."""
    sample = written(sample.select("id", "lanes"), "sample")
    if sample.limit(most + 1).count() > most:
        raise ValueError(f"a sample of more than {most} rows")
    a, b = sample.select(F.col("id").alias("i"), F.col("lanes").alias("x")), sample.select(F.col("id").alias("j"), F.col("lanes").alias("y"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).agg(F.avg(1 - tanimoto(F.col("x"), F.col("y"))).alias("mean_distance"), F.count("*").alias("n_pairs"))


def sphere_exclusion(points: DataFrame, threshold: float = 0.7, block: int = 1024) -> DataFrame:
    """id of leaders, as picked one by one in id order: no two as similar as the threshold, every point so similar to one.

    Each round settles the first `block` points in id order that no leader covers yet; the leaders among them, at most
    `block`, go to every executor and drop what they cover there.  So the result depends on neither partitions nor block.
    """
    spark, rounds = points.sparkSession, []
    rest = written(points.select("id", "lanes"), "points")
    while True:
        head = rest.orderBy("id").limit(block).toPandas()
        if head.empty:
            break
        bits = unpack(head["lanes"])
        close, keep = tanimoto_matrix(bits, bits) >= threshold, []
        for i in range(len(head)):
            if not close[i, keep].any():
                keep.append(i)
        rounds.append(spark.createDataFrame([(int(head["id"][i]),) for i in keep], "id long"))
        chosen = spark.sparkContext.broadcast(bits[keep])

        def uncovered(batches, chosen=chosen):
            for frame in batches:
                far = tanimoto_matrix(unpack(frame["lanes"]), chosen.value).max(1) < threshold if len(frame) else []
                yield frame[far] if len(frame) else frame

        rest = written(rest.filter(F.col("id") > int(head["id"].iloc[-1])).mapInPandas(uncovered, "id long, lanes array<long>"), "points")
    return reduce(DataFrame.unionByName, rounds) if rounds else points.select(F.col("id").cast("long").alias("id")).limit(0)


def _fit_pca(points: DataFrame, background: Column, k: int):
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("__v", array_to_vector("vec"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="__v", outputCol="__z").fit(rows.filter(background))
    rows = scaler.transform(rows)
    return rows, PCA(k=k, inputCol="__z", outputCol="__p").fit(rows.filter(background))


def pca(points: DataFrame, background: Column, k: int = 2) -> DataFrame:
    """Adds pca_1 .. pca_k: standardised and fitted on the background rows, projected for all; vec is an array."""
    from pyspark.ml.functions import vector_to_array

    rows, model = _fit_pca(points, background, k)
    out = model.transform(rows).withColumn("__p", vector_to_array("__p"))
    return out.select(*points.columns, *[F.col("__p")[i].alias(f"pca_{i + 1}") for i in range(k)])


def pca_loadings(points: DataFrame, background: Column, names: list[str], k: int = 2) -> DataFrame:
    """component, share of the variance, dimension and its loading; a component points where its largest loading is positive."""
    _, model = _fit_pca(points, background, k)
    axes, shares = model.pc.toArray(), model.explainedVariance.toArray()
    if len(names) != len(axes):
        raise ValueError(f"{len(names)} names for {len(axes)} dimensions")
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(k)])
    rows = [(i + 1, float(shares[i]), n, float(axes[j, i])) for i in range(k) for j, n in enumerate(names)]
    return points.sparkSession.createDataFrame(rows, "component int, share double, dimension string, loading double")


def landmarks(points: DataFrame, n: int, library: str | None = None) -> DataFrame:
    """n points of smallest id hash; with a library column as many of each library."""
    if library is None:
        return hash_sample(points, n, F.struct(F.md5(F.col("id").cast("string").cast("binary")), "id"))
    libraries = points.select(library).distinct().count()
    key = F.struct(F.md5(F.col("id").cast("string").cast("binary")), "id")
    return points.withColumn("__r", F.row_number().over(W.partitionBy(library).orderBy(key))).filter(F.col("__r") <= n // max(libraries, 1)).drop("__r")


def landmark_mds(points: DataFrame, n_landmarks: int = 200, k: int = 2, library: str | None = None) -> DataFrame:
    """Adds mds_1 .. mds_k: classical scaling of landmarks, others by triangulation."""
    marks = landmarks(points, n_landmarks, library).select("id", "lanes").orderBy("id").toPandas()  # n_landmarks rows
    bits = unpack(marks["lanes"])
    d = (1 - tanimoto_matrix(bits, bits)) ** 2
    mean = d.mean(0)
    values, vectors = np.linalg.eigh(-0.5 * (d - mean[:, None] - mean[None] + d.mean()))
    top = np.argsort(values)[::-1][:k]
    projector = vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))
    shared = points.sparkSession.sparkContext.broadcast((bits, mean, projector))

    @F.pandas_udf("array<double>")
    def place(lanes: pd.Series) -> pd.Series:
        bits, mean, projector = shared.value
        far = (1 - tanimoto_matrix(unpack(lanes), bits)) ** 2
        return pd.Series(list(-0.5 * (far - mean) @ projector))

    return points.withColumn("__m", place("lanes")).select(*points.columns, *[F.col("__m")[i].alias(f"mds_{i + 1}") for i in range(k)])


def split(points: DataFrame, label: str, share: float = 0.7) -> DataFrame:
    """Adds fitted: true for that share of each class, those of smallest id hash, so that both parts hold both classes alike."""
    order = [F.col(label), F.md5(F.col("id").cast("string").cast("binary")), F.col("id")]
    sizes = points.groupBy(label).agg(F.count("*").alias("__n")).withColumn("__first", F.sum("__n").over(W.orderBy(label)) - F.col("__n"))  # classes
    return numbered(points, order, "__k").join(F.broadcast(sizes), label).withColumn("fitted", F.col("__k") - F.col("__first") < F.floor(F.col("__n") * share)).drop("__k", "__n", "__first")


def domain_auc(points: DataFrame, label: str, least: int = 100) -> float:
    """How well a logistic model tells two libraries apart on held-out rows of both; NaN for few rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    if points.groupBy(label).count().filter(F.col("count") >= least).count() < 2:
        return float("nan")
    rows = written(split(points.select("id", label, "vec"), label), "split").select(F.col(label).cast("double").alias("label"), array_to_vector("vec").alias("features"), "fitted")
    fitted = rows.filter("fitted")
    model = LogisticRegression(regParam=1.0 / fitted.count(), maxIter=100).fit(fitted)
    return BinaryClassificationEvaluator().evaluate(model.transform(rows.filter("not fitted")))


def hash_sample(rows: DataFrame, n: int, key: Column) -> DataFrame:
    """n rows without replacement, those of smallest hash: the same rows every time."""
    return rows.orderBy(key).limit(n)
