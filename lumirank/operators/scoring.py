"""Scorers of row-aligned features: models in Python, loaded once a worker, with a bound on the rows of a call."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_ROWS = 50_000             # rows that a model sees at once, unless told otherwise
_MODELS: dict[str, Callable] = {}      # of this worker process: Spark reuses workers, so tasks and retries find theirs


def to_numpy(column: pa.Array) -> np.ndarray:
    """A column as numpy: lists of one length become a matrix, numbers and texts a vector (null numbers: NaN)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


class BatchScorer:
    """Adds a score column to a frame, batch by batch in Arrow.

    `load()` gives the model: a function of {column: array} with one value per row. It is called once in a
    worker process, also when tasks are repeated there. Arrow batches are cut so that no call sees more than
    `max_rows` rows. A call must give one number for each row; null results stay null.
    """

    def __init__(self, load: Callable[[], Callable[[dict[str, np.ndarray]], Sequence[float]]], columns: Sequence[str],
                 max_rows: int = MAX_ROWS, name: str = "score"):
        if max_rows < 1:
            raise ValueError("max_rows must be positive")
        self.load, self.columns, self.max_rows, self.name, self.key = load, list(columns), int(max_rows), name, uuid.uuid4().hex

    def model(self) -> Callable:
        if self.key not in _MODELS:
            _MODELS[self.key] = self.load()
        return _MODELS[self.key]

    def score_arrays(self, features: dict[str, np.ndarray], n: int) -> np.ndarray:
        model, out = self.model(), np.empty(n, np.float64)
        for at in range(0, n, self.max_rows):
            part = {c: v[at:at + self.max_rows] for c, v in features.items()}
            got = np.asarray(model(part), np.float64).reshape(-1)
            rows = min(self.max_rows, n - at)
            if len(got) != rows:
                raise ValueError(f"the model gave {len(got)} scores for {rows} rows")
            out[at:at + rows] = got
        return out

    def __call__(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != self.name]
        schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(self.name, T.DoubleType())])
        missing = [c for c in self.columns if c not in kept]
        if missing:
            raise ValueError(f"columns to score are missing: {missing}")

        def run(batches):
            arrow = to_arrow_schema(schema)
            for batch in batches:
                features = {c: to_numpy(batch.column(kept.index(c))) for c in self.columns}
                s = self.score_arrays(features, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, from_pandas=True)], schema=arrow)

        return df.select(*kept).mapInArrow(run, schema)


class PairScorer:
    """A BatchScorer for pairs of a user and an item: the model's columns are the user's and the item's.

    `matrix` scores a block of users against a block of items. Both dimensions are cut, so that one call holds
    at most `max_rows` pairs.
    """

    def __init__(self, load, user_columns: Sequence[str], item_columns: Sequence[str], max_rows: int = MAX_ROWS, decimals: int = 9):
        self.user_columns, self.item_columns, self.decimals = list(user_columns), list(item_columns), decimals
        if set(user_columns) & set(item_columns):
            raise ValueError("a column is named for both sides")
        self.batch = BatchScorer(load, [*user_columns, *item_columns], max_rows)

    def rows(self, u: dict[str, np.ndarray], i: dict[str, np.ndarray], n: int) -> np.ndarray:
        return np.round(self.batch.score_arrays({**u, **i}, n), self.decimals)

    def matrix(self, u: dict[str, np.ndarray], i: dict[str, np.ndarray], n_users: int, n_items: int) -> np.ndarray:
        out, cap = np.empty((n_users, n_items)), self.batch.max_rows
        users = max(1, cap // max(min(n_items, cap), 1))
        step = max(1, min(n_items, cap // users))
        for a in range(0, n_users, users):
            b = min(a + users, n_users)
            for c in range(0, n_items, step):
                d = min(c + step, n_items)
                left = {k: np.repeat(v[a:b], d - c, axis=0) for k, v in u.items()}
                right = {k: np.tile(v[c:d], (b - a,) + (1,) * (v.ndim - 1)) for k, v in i.items()}
                out[a:b, c:d] = self.batch.score_arrays({**left, **right}, (b - a) * (d - c)).reshape(b - a, d - c)
        return np.round(out, self.decimals)


class VectorScorer:
    """Dot product of a user's and an item's vector, over a temperature. Bounds of blocks prune what is scored."""

    def __init__(self, user_vector: str = "embedding", item_vector: str = "embedding", normalize: bool = False,
                 temperature: float = 1.0, decimals: int = 9):
        self.user_vector, self.item_vector = user_vector, item_vector
        self.normalize, self.temperature, self.decimals = normalize, float(temperature), decimals
        self.user_columns, self.item_columns = ["__u"], ["__v"]

    def ready(self, m: np.ndarray) -> np.ndarray:
        m = m.astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if self.normalize else m

    def rows(self, u, i, n):
        return np.round((self.ready(u["__u"]) * self.ready(i["__v"])).sum(axis=1) / self.temperature, self.decimals) if n else np.empty(0)

    def matrix(self, u, i, n_users, n_items):
        return np.round(self.ready(u["__u"]) @ self.ready(i["__v"]).T / self.temperature, self.decimals)
