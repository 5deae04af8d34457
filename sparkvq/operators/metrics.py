"""Quality of the codes: distortion, bias of inner products, recall, size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.quantizers import Mse, Prod
from ..functions.columns import matrix, scalars
from ..ship import ship
from .search import query_blocks


def squared_error(column: Column | str, model: Mse | Prod) -> Column:
    """|x - decoded(x)|^2 of each vector."""

    @F.arrow_udf("double")
    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, model.dim)
        back = model.decode(*model.encode(x))
        return scalars(((x.astype(np.float64) - back) ** 2).sum(1), good)

    return run(column)


def product_errors(corpus: DataFrame, queries: DataFrame, models: dict[str, Mse | Prod]) -> DataFrame:
    """Per name of models (name, slope, distortion, pairs) over all pairs of a query and a row of another id.

    slope: sum(estimate * truth) / sum(truth^2), 1 without bias; distortion: mean squared error. Tasks send sums. Without queries no rows.
    """
    spark = corpus.sparkSession
    ship(spark)

    def against(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states = {name: m.prepare(q) for name, m in models.items()}
            sums = {name: np.zeros(4) for name in models}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, good = matrix(batch.column(1), q.shape[1])
                own = batch.column(0).to_numpy()[good]
                other = ids[:, None] != own
                truth = q.astype(np.float64) @ x.T.astype(np.float64)
                for name, m in models.items():
                    est = m.dot(states[name], *m.encode(x)).astype(np.float64)
                    sums[name] += [(est * truth)[other].sum(), (truth**2)[other].sum(), ((est - truth) ** 2)[other].sum(), other.sum()]
            table = np.array(list(sums.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(models)), *(pa.array(c) for c in table)], ["name", "et", "tt", "ee", "n"])

        return corpus.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "name string, et double, tt double, ee double, n double")

    blocks = [against(*b) for b in query_blocks(queries)]
    parts = reduce(DataFrame.unionByName, blocks) if blocks else spark.createDataFrame([], "name string, et double, tt double, ee double, n double")
    s = {c: F.sum(c) for c in ("et", "tt", "ee", "n")}
    return parts.groupBy("name").agg((s["et"] / s["tt"]).alias("slope"), (s["ee"] / s["n"]).alias("distortion"), s["n"].cast("long").alias("pairs"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(hits, wanted): rows of truth (query_id, vec_id) that found has, too."""
    key = ["query_id", "vec_id"]
    return truth.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))


def bytes_per_vector(model: Mse | Prod) -> int:
    """Of codes, sketch and scalars."""
    if isinstance(model, Mse):
        return model.layout.code_bytes + 4
    codes = model.mse.layout.code_bytes if model.bits > 1 else 0
    return codes + -(-model.padded // 8) + 8
