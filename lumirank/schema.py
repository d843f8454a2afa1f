"""Feature specs, the fitted feature map, and column groups (driver-side, no rows)."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumirank.sources.files import read_text, write_text

# fixed values
DTYPES: dict[str, T.DataType] = {
    "str": T.StringType(), "string": T.StringType(), "int": T.LongType(), "integer": T.LongType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "bool": T.BooleanType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}
TYPE_ALIASES = {"dense": "numeric", "float": "numeric", "numeric": "numeric", "seq": "sequence",
                "sparse_seq": "sequence", "sequence": "sequence", "sparse": "categorical",
                "categorical": "categorical", "embedding": "embedding", "meta": "meta"}
GROUPS = ("FG1", "FG2", "FG3", "Drop")


def resolve_dtype(name: str, feature: str = "") -> T.DataType:
    key = str(name).strip().lower().removeprefix("np.")
    if key not in DTYPES:
        raise ValueError(f"dtype {name!r} of feature {feature!r} is not allowed")
    return DTYPES[key]


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    type: str = "categorical"
    dtype: str = "str"
    source: str = ""
    group: str | None = None
    active: bool = True
    fill_na: object = None
    preprocess: str | None = None
    normalizer: str | None = None
    splitter: str = "^"
    max_len: int = 0
    padding: str = "post"
    min_count: int = 1
    max_features: int | None = None
    share_embedding: str | None = None
    category_processor: str | None = None
    num_buckets: int = 10
    remap: bool = True
    sequence_length: bool = False

    def fill(self):
        if self.fill_na is not None:
            return self.fill_na
        return "" if isinstance(resolve_dtype(self.dtype, self.name), T.StringType) else 0


def expand_features(entries: list[dict], shares: dict[str, str] | None = None) -> list[FeatureSpec]:
    """One spec per name of each entry; group `drop` turns a column off; sequences are read as text."""
    out = []
    for e in entries:
        names = e["name"] if isinstance(e["name"], list) else [e["name"]]
        group = e.get("feature_group")
        kind = normal_type(e.get("type", "categorical"))
        known = {k: v for k, v in e.items() if k in FeatureSpec.__dataclass_fields__ and k not in ("name", "type", "group")}
        for n in names:
            spec = FeatureSpec(**{**known, "name": n, "type": kind, "group": group,
                                  "active": known.get("active", True) and str(group).lower() != "drop"})
            if kind == "sequence":
                spec = replace(spec, dtype="str")
            if shares and n in shares:
                spec = replace(spec, share_embedding=shares[n])
            out.append(spec)
    return out


def normal_type(kind: str) -> str:
    k = str(kind).strip().lower()
    if k not in TYPE_ALIASES:
        raise ValueError(f"unknown feature type: {kind!r}")
    return TYPE_ALIASES[k]


def drop_unsafe_shares(specs: dict[str, dict]) -> dict[str, dict]:
    """Drop a share whose target is missing or smaller than the feature's own vocabulary."""
    out = {}
    for n, s in specs.items():
        t = s.get("share_embedding")
        bad = t and (t not in specs or s.get("vocab_size", 0) > specs[t].get("vocab_size", 0))
        out[n] = {k: v for k, v in s.items() if not (bad and k == "share_embedding")}
    return out


def is_complete(specs: dict[str, dict]) -> bool:
    """Every coded feature has a vocabulary size, every sequence a length."""
    for s in specs.values():
        kind = normal_type(s.get("type", "categorical"))
        if kind in ("categorical", "sequence") and not s.get("vocab_size"):
            return False
        if kind == "sequence" and not s.get("max_len"):
            return False
    return True


@dataclass
class FeatureMap:
    """Fitted schema: what each encoded column holds."""
    dataset: str
    labels: list[str]
    features: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"dataset_id": self.dataset, "labels": self.labels,
                           "features": [{n: s} for n, s in self.features.items()]}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> FeatureMap:
        d = json.loads(text)
        return cls(d["dataset_id"], d["labels"], {n: s for one in d["features"] for n, s in one.items()})

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, self.to_json())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureMap:
        return cls.from_json(read_text(spark, path))

    def select(self, use: list[str] | None = None, drop: list[str] | None = None,
               override: dict[str, dict] | None = None) -> FeatureMap:
        kept = {n: dict(s) for n, s in self.features.items() if (use is None or n in use) and n not in (drop or [])}
        for n, s in (override or {}).items():
            if n in kept:
                kept[n].update(s)
        return FeatureMap(self.dataset, list(self.labels), kept)

    def resized(self, sizes: dict[str, int]) -> FeatureMap:
        return self.select(override={n: {"vocab_size": v} for n, v in sizes.items()})

    def role(self, kind: str | None = None, source: str | None = None) -> list[str]:
        """Model inputs of a type or source; labels and meta columns are never inputs."""
        return [n for n, s in self.features.items()
                if n not in self.labels and s.get("type") != "meta"
                and (kind is None or s.get("type") == kind) and (source is None or s.get("source") == source)]


class FeatureGroups:
    """Column to group: FG1 item/context, FG2 cloud-side behaviour, FG3 device-private."""

    def __init__(self, assigned: dict[str, str] | None = None):
        self.assigned = dict(assigned or {})

    @classmethod
    def assign(cls, columns: list[str], specs: list[FeatureSpec] = (), explicit: dict[str, str] | None = None,
               fg3_patterns: list[str] = (), fg2_patterns: list[str] = ()) -> FeatureGroups:
        """Explicit, else the spec's group, else name patterns (FG3 before FG2), else FG1."""
        by_spec = {s.name: s.group for s in specs if s.group}
        out = {}
        for c in columns:
            low = c.lower()
            if explicit and c in explicit:
                g = explicit[c]
            elif c in by_spec:
                g = by_spec[c]
            elif any(p.lower() in low for p in fg3_patterns):
                g = "FG3"
            elif any(p.lower() in low for p in fg2_patterns):
                g = "FG2"
            else:
                g = "FG1"
            if g.lower() not in [x.lower() for x in GROUPS]:
                raise ValueError(f"unknown feature group {g!r} for {c!r}")
            out[c] = next(x for x in GROUPS if x.lower() == g.lower())
        return cls(out)

    def of(self, *groups: str) -> list[str]:
        return [c for c, g in self.assigned.items() if g in groups]

    def cloud(self) -> list[str]:
        return self.of("FG1", "FG2")

    def device(self) -> list[str]:
        return self.of("FG1", "FG2", "FG3")

    def user(self) -> list[str]:
        return self.of("FG2", "FG3")

    def item(self) -> list[str]:
        return self.of("FG1")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = "".join(f"{c},{g}\n" for c, g in self.assigned.items())
        write_text(spark, path, "feature,group\n" + rows)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureGroups:
        return cls({r["feature"]: r["group"] for r in csv.DictReader(read_text(spark, path).splitlines())})


def project_groups(df: DataFrame, groups: FeatureGroups, allowed: list[str], keep: list[str]) -> DataFrame:
    """Only the allowed groups' columns, plus the named id and label columns."""
    ok = set(groups.of(*allowed)) | set(keep)
    return df.select([c for c in df.columns if c in ok])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


PREPROCESSORS: dict = {}


def register_preprocessor(name: str):
    """Name a column function so a spec can ask for it."""
    def keep(fn):
        PREPROCESSORS[name] = fn
        return fn
    return keep


@register_preprocessor("copy_from")
def _copy_from(source: str) -> Column:
    return F.col(source)


def _register_calendar() -> None:
    from lumirank.functions import numeric as N
    for name, fn in (("coded_weekday", N.coded_weekday), ("coded_weekend", N.coded_weekend),
                     ("coded_hour", N.coded_hour), ("log_square_bucket", N.log_square_bucket)):
        register_preprocessor(name)(lambda c, fn=fn: fn(F.col(c)))


_register_calendar()


def preprocess(df: DataFrame, specs: list[FeatureSpec], labels: list[str], carry: list[str] = ()) -> DataFrame:
    """Null fill, named function, cast: one projection. Labels first, then carried and feature columns.

    Carried columns (ids that are not model inputs) ride in the same select, so no
    positional re-attachment is needed; a missing one is an error.
    """
    missing = [c for c in carry if c not in df.columns]
    if missing:
        raise ValueError(f"auxiliary columns not in the source: {missing}")
    cols = [F.col(c).cast("double").alias(c) for c in labels]
    cols += [F.col(c) for c in carry if c not in labels]
    for s in specs:
        if not s.active or s.name in carry:
            continue
        t = resolve_dtype(s.dtype, s.name)
        if s.preprocess:
            fn, _, arg = s.preprocess.rstrip(")").partition("(")
            if fn not in PREPROCESSORS:
                raise ValueError(f"unknown preprocessor {fn!r}")
            c = PREPROCESSORS[fn](arg or s.name)
        else:
            c = F.col(s.name)
        if s.name in df.columns and isinstance(df.schema[s.name].dataType, T.ArrayType) and not s.preprocess:
            c = F.array_join(c.cast("array<string>"), s.splitter)
        cols.append(F.coalesce(c.cast(t), F.lit(s.fill()).cast(t)).alias(s.name))
    return df.select(*cols)
