"""Stage relations (candidates, user features), vocabularies, remaps, metrics and cached tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumirank.config import validate_identifier
from lumirank.sources.files import exists, fs_of, names_in, read_text, remove, write_new, write_text


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


@dataclass
class StageRelation:
    """What one stage hands to the next."""
    stage: str
    candidates: DataFrame
    users: DataFrame
    metrics: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.candidates.select(
            "request_id", "item_id", F.col("score").cast("float").alias("score"), F.col("label").cast("tinyint").alias("label")
        ).write.mode("overwrite").parquet(f"{path}/candidates")
        self.users.write.mode("overwrite").parquet(f"{path}/user_features")
        write_json(self.candidates.sparkSession, f"{path}/stage.json",
                   {"stage": self.stage, "metrics": self.metrics, "metadata": self.metadata})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StageRelation:
        if path.endswith((".pkl", ".pickle")):
            raise ValueError("pickle files are refused: they can run code when read")
        meta = read_json(spark, f"{path}/stage.json")
        return cls(meta["stage"], spark.read.parquet(f"{path}/candidates"),
                   spark.read.parquet(f"{path}/user_features"), meta["metrics"], meta["metadata"])


def stage_path(root: str, stage: str, split: str) -> str:
    return f"{root}/{validate_identifier(stage)}_{validate_identifier(split)}_stage_output"


def load_stages(spark: SparkSession, root: str, stage: str, test: bool = True) -> dict[str, StageRelation]:
    return {s: StageRelation.load(spark, stage_path(root, stage, s)) for s in (("valid", "test") if test else ("valid",))}


def fingerprint(spark: SparkSession, paths: list[str], columns: list[str], specs=None) -> str:
    """SHA-256 over file names, sizes, times, wanted columns and specs."""
    parts = []
    for path in sorted(paths):
        p, fs = fs_of(spark, path)
        it = fs.listFiles(p, True) if fs.getFileStatus(p).isDirectory() else None
        if it is None:
            st = fs.getFileStatus(p)
            parts.append((str(st.getPath()), st.getLen(), st.getModificationTime()))
        else:
            while it.hasNext():
                st = it.next()
                parts.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    payload = json.dumps({"files": sorted(map(list, parts)), "columns": list(columns), "specs": specs}, sort_keys=True, default=str)
    return hashlib.sha256(payload.encode()).hexdigest()


def cached_table(spark: SparkSession, path: str, key: str, build, columns: list[str] | None = None) -> DataFrame:
    """Reuse the table under `path` only if its fingerprint and columns match; else build it anew.

    A build goes to a folder of its own; the marks, which name the valid folders, are numbered, and a new one is put only
    where no other writer has put one. A rebuild that dies half-way leaves the last mark and its whole table; of two
    rebuilds at a time one wins, and the other's caller gets the winner's table if it fits, else an error. The table
    before the last stays for readers that have planned on it, and goes with the next rebuild.
    """
    marks = f"{path}.marks"

    def latest():
        names = [n for n in names_in(spark, marks) if n.endswith(".json")]
        return (int(names[-1].removesuffix(".json")), read_json(spark, f"{marks}/{names[-1]}")) if names else (0, {})

    def valid(mark):
        if mark.get("key") != key or not exists(spark, f"{path}/{mark['version']}"):
            return None
        got = spark.read.parquet(f"{path}/{mark['version']}")
        return got if columns is None or set(columns) <= set(got.columns) else None

    number, old = latest()
    if (got := valid(old)) is not None:
        return got
    version = f"v-{uuid.uuid4().hex}"
    build().write.parquet(f"{path}/{version}")
    try:
        write_new(spark, f"{marks}/{number + 1:012d}.json", json.dumps({"key": key, "version": version, "before": old.get("version")}))
    except FileExistsError:
        remove(spark, f"{path}/{version}")
        if (got := valid(latest()[1])) is not None:
            return got
        raise RuntimeError(f"another writer has rebuilt {path} with other contents") from None
    write_json(spark, f"{path}.fingerprint.json", {"key": key, "version": version})      # for people and other tools: not read here
    if old.get("before"):
        remove(spark, f"{path}/{old['before']}")
    return spark.read.parquet(f"{path}/{version}")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Vocabulary table ordered by index within its files."""
    vocab.select("feature", "token", "idx").repartitionByRange("feature", "idx").sortWithinPartitions(
        "feature", "idx").write.mode("overwrite").parquet(path)


def vocab_json_lines(vocab: DataFrame, shared: list[str] = ()) -> DataFrame:
    """JSON rows of a vocabulary in index order; features that share a table are left out."""
    v = vocab.filter(~F.col("feature").isin(*shared)) if shared else vocab
    return v.orderBy("feature", "idx").select(F.to_json(F.struct("feature", "token", "idx")).alias("value"))


def write_vocab_json(vocab: DataFrame, path: str, shared: list[str] = ()) -> None:
    """The JSON form of a vocabulary, one row per token, ordered across the files."""
    vocab_json_lines(vocab, shared).write.mode("overwrite").text(path)


def write_remap(table: DataFrame, path: str) -> None:
    from lumirank.operators.remap import check_remap
    check_remap(table).write.mode("overwrite").parquet(path)


def read_remap(spark: SparkSession, path: str) -> DataFrame:
    from lumirank.operators.remap import check_remap
    return check_remap(spark.read.parquet(path).select("feature", "old_id", "new_id"))


def metrics_long(wide: DataFrame, stage: str, split: str) -> DataFrame:
    """(stage, split, metric, value) rows of a one-row wide metric frame."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns])
    return wide.select(F.lit(stage).alias("stage"), F.lit(split).alias("split"), F.explode(cells).alias("m")).select(
        "stage", "split", "m.metric", "m.value")


def write_metrics(spark: SparkSession, long: DataFrame, root: str) -> None:
    """eval_metrics as CSV and metrics.json with names stage_split_metric."""
    long.coalesce(1).write.mode("overwrite").csv(f"{root}/eval_metrics", header=True)
    write_json(spark, f"{root}/metrics.json", {f"{r.stage}_{r.split}_{r.metric}": r.value for r in long.collect()})


def write_scores(df: DataFrame, path: str, group: str, label: str, score: str, blended: str | None = None) -> None:
    cols = [F.col(group), F.col(label).alias("label"), F.col(score).alias("label_predict")]
    if blended:
        cols.append(F.col(blended).alias("label_predict_popularity_blend"))
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_predictions(spark: SparkSession, df: DataFrame, root: str, metrics: dict) -> str:
    """Scored rows under a name made of their metrics."""
    name = "predictions_" + "_".join(f"{k}_{v:.4f}" for k, v in sorted(metrics.items()))
    path = f"{root}/{validate_identifier(name.replace('@', '-'))}"
    df.write.mode("overwrite").parquet(path)
    write_json(spark, f"{path}.json", metrics)
    return path


def append_results(slices: DataFrame, overall: DataFrame, experiment: str, path: str) -> None:
    """One row per group and one `all` row: AUC and logloss with four digits, share in percent."""
    cols = ["group", "ratio", "auc", "logloss"]
    fmt = [F.lit(validate_identifier(experiment)).alias("experiment"), "group", F.format_string("%.2f%%", "ratio").alias("ratio"),
           F.format_string("%.4f", "auc").alias("auc"), F.format_string("%.4f", "logloss").alias("logloss")]
    slices.select(*cols).unionByName(overall.select(*cols)).select(*fmt).coalesce(1).write.mode("append").csv(path, header=True)


def write_statistics(tables: dict[str, DataFrame], root: str) -> None:
    """Every table of the dataset statistics as JSON rows, one folder each."""
    for name, t in tables.items():
        t.write.mode("overwrite").json(f"{root}/{validate_identifier(name)}")


def statistics_cache(spark: SparkSession, path: str, key: str, policy: str, build, required: list[str]) -> dict:
    """prefer: reuse a complete cache with the same key; strict: fail without one; refresh: rebuild."""
    if policy not in ("prefer", "strict", "refresh"):
        raise ValueError(f"unknown cache policy {policy!r}")
    ok = None
    if policy != "refresh" and exists(spark, path):
        got = read_json(spark, path)
        if got.get("key") == key and all(r in got.get("stats", {}) for r in required):
            ok = got["stats"]
    if ok is not None:
        return ok
    if policy == "strict":
        raise FileNotFoundError(f"no complete statistics with this key at {path}")
    stats = build()
    write_json(spark, path, {"version": 1, "key": key, "stats": stats})
    return stats
