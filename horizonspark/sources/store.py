"""Tables that outlive a query: versioned runs, and results kept by what they were made from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark.sources import files

#: Hexadecimal digits of a row's digest that are added up as one number.
_DIGITS = 8


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; on a local session without spark.checkpoint.dir, in the machine's temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


class RunStore:
    """Forecast runs as a table partitioned by run_date."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, predictions: DataFrame) -> None:
        """Adds the runs of predictions (run_date and values); runs that are there already are replaced, others stay."""
        files.write_run(predictions.repartition("run_date"), self.root)

    def read(self) -> DataFrame:
        return files.read_runs(self.spark, self.root)

    def newest(self, k: int) -> DataFrame:
        """(run_date, rank) of the k newest runs; no values are read for it, and the runs' dates, a few thousand, are sorted as one array."""
        days = self.read().agg(F.sort_array(F.collect_set("run_date"), False).alias("days"))
        ranked = days.select(F.posexplode("days").alias("at", "run_date")).select("run_date", (F.col("at") + 1).alias("rank"))
        return ranked.where(F.col("rank") <= k)

    def latest(self, k: int = 6) -> DataFrame:
        """Rows of the k newest runs. The runs are found first and prune the folders that the scan reads."""
        return self.read().join(F.broadcast(self.newest(k)), "run_date").drop("rank")


def fingerprint(df: DataFrame, keys: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """(keys, n_rows, fingerprint): a digest of each key's rows that does not depend on their order, but on how often each occurs.

    A row's digest is over the lengths and values of its columns, so that no two rows look alike; the digests are added up in four parts.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    row = F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))
    parts = [F.sum(F.conv(F.substring("digest", 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(32 // _DIGITS)]
    sums = df.select(*keys, row.alias("digest")).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.concat_ws(":", *parts).alias("sums"))
    return sums.select(*keys, "n_rows", F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), "sums")).alias("fingerprint"))


class ResultStore:
    """Results kept with a manifest of what they were made from; a changed input or parameter is another result."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def key(self, inputs: dict[str, DataFrame], **parameters: object) -> str:
        """The digest of the inputs' rows, their columns' names and types, and the parameters."""
        told = [f"{k}={v!r}" for k, v in sorted(parameters.items())]
        for name, df in sorted(inputs.items()):
            print_ = fingerprint(df, columns=sorted(df.columns)).first()
            told += [name, str(sorted(df.dtypes)), print_["fingerprint"]]
        return self.spark.range(1).select(F.md5(F.lit("\n".join(told)))).first()[0]

    def reuse(self, make: Callable[[], DataFrame], inputs: dict[str, DataFrame], **parameters: object) -> tuple[DataFrame, bool]:
        """make()'s result, read from the store if it was made from the same inputs and parameters before, and whether it was.

        A result is listed in the manifest only after it is written whole, so that a broken write is made again.
        """
        key = self.key(inputs, **parameters)
        manifest = self._manifest()
        found = manifest.where(F.col("key") == key).select("path").first() if manifest is not None else None
        path = found["path"] if found else f"{self.root}/results/{uuid.uuid4().hex}"
        if not found:
            make().write.parquet(path)
            self.spark.range(1).select(F.lit(key).alias("key"), F.lit(path).alias("path"), F.current_timestamp().alias("made")).write.mode("append").parquet(f"{self.root}/manifest")
        return self.spark.read.parquet(path), found is not None
