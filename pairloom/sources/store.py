"""Sources and sinks: CSV, Parquet, NumPy and word2vec files, keyed prediction files, and materialised stages."""

from __future__ import annotations

import atexit
import hashlib
import io
import re
import shutil
import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN = "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int"
TEST = "test_id long, question1 string, question2 string"
_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; where none is named, a local one that goes with the process, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            own = tempfile.mkdtemp(prefix="pairloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN.append(f"file://{own}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the cluster's shared folder and reads them back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df itself where its scan has a task for every core; a scan of fewer pieces is dealt out first, or one core would do all the work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def read_csv(spark: SparkSession, path, schema: str, encoding: str = "UTF-8", columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Quoted CSV with a header and line breaks inside quotes. most: rows up to, not including, that many."""
    out = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding=encoding).csv(path)
    out = out.select(*columns) if columns else out
    return out.limit(most - 1) if most else out


def write_csv(df: DataFrame, path: str, run: str | None = None) -> str:
    """With a run's name the folder's name ends in it; gives the folder."""
    path = f"{path}_{run}" if run else path
    df.write.options(header=True, escape='"').csv(path)
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(model, id, p) of all files named like path; the model is the file's name, columns go by name."""
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]  # a file per model
    parts = []
    for f in files:
        rows = spark.read.option("header", True).csv(f)
        parts.append(rows.select(F.lit(re.search(r"([^/]+?)(\.csv)?$", f)[1]).alias("model"), F.col("test_id").cast("long").alias("id"), F.col("is_duplicate").cast("double").alias("p")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "model string, id long, p double")


def write_predictions(predictions: DataFrame, path: str) -> str:
    """(id, p) as test_id, is_duplicate, with the ids that the rows have; gives the folder."""
    return write_csv(predictions.select(F.col("id").alias("test_id"), F.col("p").alias("is_duplicate")), path)


def read_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.text(path).select(F.split("value", separator).alias("fields"))


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of files in word2vec's binary form.

    Records have no fixed length, so a task reads a file, and none may exceed the 2 GB of a value: larger ones are cut
    into files first. Read it once and keep the rows as Parquet.
    """

    def parse(rows):
        for pdf in rows:
            for raw in pdf["content"]:
                head, at = raw.index(b"\n"), 0
                n, dim = map(int, raw[:head].split())
                at = head + 1
                for lo in range(0, n, 1000):
                    words, vecs = [], []
                    for _ in range(lo, min(n, lo + 1000)):
                        blank = raw.index(b" ", at)
                        words.append(raw[at:blank].lstrip(b"\n").decode("utf-8", "replace"))
                        vecs.append(np.frombuffer(raw, "<f4", dim, blank + 1).tolist())
                        at = blank + 1 + 4 * dim
                    yield pd.DataFrame({"word": words, "vec": vecs})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "word string, vec array<float>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, values) of two-dimensional arrays in .npy files."""

    def parse(rows):
        for pdf in rows:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"file": name, "nth": range(len(a)), "values": a.reshape(len(a), -1).astype(float).tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, nth long, values array<double>")


def write_npy(rows: DataFrame, path: str, order: str = "nth", values: str = "values") -> str:
    """A folder of .npy files, one for each range of ``order``: two-dimensional arrays of the rows' values, in order; gives the folder. Names sort as the ranges do."""
    ranged = rows.select(F.col(order).alias("nth"), F.col(values).cast("array<double>").alias("values")).repartitionByRange("nth").sortWithinPartitions("nth")

    def files(batches):
        part, got = TaskContext.get().partitionId(), [v for b in batches for v in b.column("values").to_pylist()]
        if got:
            sink = io.BytesIO()
            np.save(sink, np.array(got, np.float64), allow_pickle=False)
            yield pa.RecordBatch.from_pydict({"name": pa.array([f"part-{part:05d}.npy"]), "content": pa.array([sink.getvalue()], pa.binary())})

    made = materialize(ranged.mapInArrow(files, "name string, content binary"))
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for r in made.select("name").collect():  # a file per partition
        content = made.filter(F.col("name") == r.name).first().content
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/{r.name}")
        out = to.getFileSystem(conf).create(to, True)
        out.write(content)
        out.close()
    return path


def cached(spark: SparkSession, folder: str, inputs: list[str], make) -> DataFrame:
    """make()'s rows, kept below folder under a fingerprint of what they are made from, and read from there the next time.

    inputs: names of what they are made from; a path among them counts with its files' sizes and times.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(name: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(name)
        try:
            files = at.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{name.rstrip('/')}{{,/*}}")) or []
        except Exception:  # not a path
            return name
        return name + "".join(sorted(f"|{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}" for f in files))

    path = f"{folder.rstrip('/')}/{hashlib.sha256(chr(0).join(state(x) if '/' in x else x for x in inputs).encode()).hexdigest()[:24]}"
    there = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def embedding_matrix(words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(idx, word, vec) for words (idx, word): zeros where vectors has none."""
    zero = F.array_repeat(F.lit(0.0).cast(T.FloatType()), dim)
    return words.join(vectors, "word", "left").select("idx", "word", F.coalesce("vec", zero).alias("vec"))
