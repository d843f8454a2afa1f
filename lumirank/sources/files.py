"""Small text files beside the tables, on the tables' own file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = fs_of(spark, path)
    return fs.exists(p)


def _put(spark: SparkSession, path: str, text: str, replace: bool) -> None:
    """Written beside, then renamed into place: over an old file, or only where there is none."""
    tmp, fs = fs_of(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    sc = spark.sparkContext
    kinds = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if replace else kinds.NONE
    dst, _ = fs_of(spark, path)
    try:
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), sc._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(tmp), fs.makeQualified(dst), options)
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            raise FileExistsError(path) from None
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A reader sees the old file or the new one, at any time."""
    _put(spark, path, text, True)


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Fails with FileExistsError if any writer has put a file there before."""
    _put(spark, path, text, False)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    p, fs = fs_of(spark, folder)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = fs_of(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    if path.endswith((".pkl", ".pickle")):
        raise ValueError("pickle files are refused: they can run code when read")
    return spark.read.text(path, wholetext=True).first()[0]
