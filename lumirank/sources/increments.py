"""Statistics of tables that grow: partial results of the files at hand, kept and merged; a new file costs its own scan."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumirank.operators import stats
from lumirank.sources.files import fs_of, names_in, read_text, remove, write_new

Partials = Callable[[DataFrame], dict[str, DataFrame]]


def data_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Fingerprint (of name, size and time) to path, for every data file under a path."""
    p, fs = fs_of(spark, path)
    out, it = {}, fs.listFiles(p, True)
    while it.hasNext():
        st = it.next()
        if not st.getPath().getName().startswith(("_", ".")):
            key = json.dumps([str(st.getPath()), st.getLen(), st.getModificationTime()])
            out[hashlib.sha256(key.encode()).hexdigest()] = str(st.getPath())
    return out


def refresh(spark: SparkSession, path: str, root: str, partials: Partials, key: str = "") -> dict[str, DataFrame]:
    """The union of the partial tables of all files under `path`, by name.

    Files are covered in batches: those a call finds new are read in one scan, and `partials(frame)` gives their
    tables. A manifest names each batch and the fingerprints it covers; a batch with a file that has changed or
    gone is dropped and its other files are read again. Manifests are numbered and put only where no other writer
    has put one, so of two refreshes at a time one fails and may be repeated. `key` names what is computed: with
    another key nothing is reused. Tables of the manifest before the last stay for readers that have planned on them.
    """
    files, marks = data_files(spark, path), f"{root}/manifests"
    names = [n for n in names_in(spark, marks) if n.endswith(".json")]
    number, old = (int(names[-1].removesuffix(".json")), json.loads(read_text(spark, f"{marks}/{names[-1]}"))) if names else (0, {"batches": {}, "key": key, "names": []})
    if old["key"] != key:
        old = {**old, "batches": {}, "dropped": [*old.get("dropped", []), *old["batches"]]}
    batches = {b: fps for b, fps in old["batches"].items() if set(fps) <= set(files)}
    covered = {fp for fps in batches.values() for fp in fps}
    fresh, table_names = sorted(set(files) - covered), old["names"]
    if fresh or not table_names or len(batches) < len(old["batches"]):
        if fresh or not table_names:
            batch = uuid.uuid4().hex
            frame = spark.read.parquet(*[files[fp] for fp in fresh]) if fresh else spark.read.parquet(path)
            made = partials(frame)
            for n, t in made.items():
                t.write.parquet(f"{root}/parts/{batch}/{n}")
            batches[batch], table_names = fresh, sorted(made)
        gone = [b for b in old["batches"] if b not in batches]
        write_new(spark, f"{marks}/{number + 1:012d}.json", json.dumps({"batches": batches, "key": key, "names": table_names, "dropped": gone}))
        for b in set(old.get("dropped", [])) - set(batches) - set(gone):
            remove(spark, f"{root}/parts/{b}")
    return {n: spark.read.parquet(*[f"{root}/parts/{b}/{n}" for b in batches]) for n in table_names}


def dataset_partials(label: str, sides: dict[str, str], split: str = "split") -> Partials:
    """Mergeable tables of the dataset statistics: rows per id, per label value, and per split."""
    def make(df: DataFrame) -> dict[str, DataFrame]:
        missing = [F.count_if(F.col(k).isNull()).alias(f"missing_{k}") for k in sides.values()]
        return {"ids": stats.id_frequencies(df, sides, [split]),
                "labels": df.groupBy(split, F.col(label).cast("string").alias("raw")).agg(F.count("*").alias("n")),
                "rows": df.groupBy(split).agg(F.count("*").alias("rows"), F.count_if(F.col(label) > 0).alias("positive_rows"), *missing)}
    return make


def merged_statistics(parts: dict[str, DataFrame], split: str = "split", top: int = 10) -> dict[str, DataFrame]:
    """What `jobs.statistics` gives, from partial tables: id statistics and top ids per split and overall, and the profile."""
    ids = parts["ids"].groupBy(split, "side", "id").agg(F.sum("n").alias("n"))
    total = ids.groupBy("side", "id").agg(F.sum("n").alias("n"))
    both = ids.unionByName(total.select(F.lit("all").alias(split), "side", "id", "n"))
    counts = [c for c in parts["rows"].columns if c != split]
    sums = parts["rows"].rollup(split).agg(F.grouping(split).alias("__g"), *[F.sum(c).alias(c) for c in counts])
    profile = (sums.withColumn(split, F.when(F.col("__g") == 1, "all").otherwise(F.col(split))).drop("__g")
               .withColumn("positive_rate", F.when(F.col("rows") > 0, F.col("positive_rows") / F.col("rows")).otherwise(0.0)))
    return {"profile": profile.select(split, "rows", "positive_rows", "positive_rate", *[c for c in counts if c.startswith("missing_")]),
            "values": parts["labels"].groupBy(split, "raw").agg(F.sum("n").alias("n")),
            "sides": stats.side_stats(both, [split, "side"]), "top": stats.top_ids(both, top, [split, "side"])}
