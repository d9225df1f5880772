"""A time-series database as source and sink: its query language as text, and transfers for which its client must be there."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags that an uploaded variable must have.
TAGS = ("site", "varname", "units", "raw_varname", "raw_units", "hpos", "vpos", "repl", "data_raw_freq", "freq", "filegroup", "config_filetype", "data_version", "gain", "offset")
#: Days that listings look back.
DAYS = 9999


def available() -> bool:
    return importlib.util.find_spec("influxdb_client") is not None


def from_bucket(bucket: str) -> str:
    return f'from(bucket: "{bucket}")'


def in_range(start: str, stop: str) -> str:
    return f"|> range(start: {start}, stop: {stop})"


def any_of(tag: str, values: list[str], logic: str = "or") -> str:
    return "|> filter(fn: (r) => " + f" {logic} ".join(f'r["{tag}"] == "{v}"' for v in values) + ")"


def wide() -> str:
    return '|> pivot(rowKey:["_time"], columnKey: ["_field"], valueColumn: "_value")'


def _listing(function: str, days: int = DAYS, **names: str) -> str:
    named = "".join(f'{k}: "{v}", ' for k, v in names.items())
    return f'import "influxdata/influxdb/schema"\nschema.{function}({named}start: -{days}d)'


def fields_of_measurement(bucket: str, measurement: str, days: int = DAYS) -> str:
    return _listing("measurementFieldKeys", days, bucket=bucket, measurement=measurement)


def fields_of_bucket(bucket: str, days: int = DAYS) -> str:
    return _listing("fieldKeys", days, bucket=bucket)


def measurements_of_bucket(bucket: str, days: int = DAYS) -> str:
    return _listing("measurements", days, bucket=bucket)


def download_query(bucket: str, start: str, stop: str, measurements: list[str] | None = None, fields: list[str] | None = None, version: list[str] | None = None) -> str:
    parts = [from_bucket(bucket), in_range(start, stop)]
    parts += [any_of(t, v) for t, v in (("_measurement", measurements), ("data_version", version), ("_field", fields)) if v]
    return "\n".join([*parts, wide()])


@dataclass(frozen=True)
class Backend:
    """Transfers by the database's client. Without the client every call raises, and nothing else of the library is touched."""

    url: str
    token: str
    org: str

    def _client(self):
        if not available():
            raise RuntimeError("the database's client is not installed")
        from influxdb_client import InfluxDBClient

        return InfluxDBClient(url=self.url, token=self.token, org=self.org)

    def download(self, spark: SparkSession, query: str, hours_from_utc: float) -> DataFrame:
        """Rows of a query with local stamps; of repeated stamps the last stays."""
        from aeolith.operators.timeaxis import drop_duplicate_stamps

        with self._client() as c:
            d = spark.createDataFrame(c.query_api().query_data_frame(query))
        d = d.withColumn("ts", (F.col("_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours_from_utc * 3600))).cast("timestamp_ntz"))
        return drop_duplicate_stamps(d, [], ["_time"])

    def upload(self, df: DataFrame, bucket: str, measurement: str, field: str, hours_from_utc: float, batch: int = 5000) -> None:
        """One variable with all its tags, in batches from where the data are."""
        if missing := [t for t in TAGS if t not in df.columns]:
            raise ValueError(f"tags are missing: {missing}")
        if df.select("data_version").distinct().count() != 1:
            raise ValueError("data of one version only")
        d = df.withColumn("_time", F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours_from_utc * 3600)))

        def send(rows) -> None:
            import itertools

            with self._client() as c, c.write_api() as w:
                while part := list(itertools.islice(rows, batch)):
                    w.write(bucket=bucket, record=[{"measurement": measurement, "time": r["_time"], "tags": {t: r[t] for t in TAGS}, "fields": {field: r[field]}} for r in part])

        d.foreachPartition(send)

    def delete(self, bucket: str, start: str, stop: str, measurement: str, fields: list[str] | None = None, version: str | None = None) -> None:
        with self._client() as c:
            for f in fields or [None]:
                rule = " AND ".join(f'{k}="{v}"' for k, v in (("_measurement", measurement), ("_field", f), ("data_version", version)) if v)
                c.delete_api().delete(start, stop, rule, bucket=bucket)

    def buckets(self) -> list[str]:
        with self._client() as c:
            return sorted(b.name for b in c.buckets_api().find_buckets_iter() if not b.name.startswith("_"))
