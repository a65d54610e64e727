"""GPS and trajectory-pair sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GPS_SCHEMA = "date string, suid bigint, utc bigint, lat int, lon int, head int, passenger boolean"


def _number(text: Column, kind: str) -> Column:
    return text.try_cast(kind)


def parse_gps(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Seven space-separated fields; a field that does not parse is NULL."""
    f = F.split("value", " ")
    part = lambda i: F.get(f, F.lit(i))
    return lines.select(
        *(keep or []),
        part(0).alias("date"),
        _number(part(1), "bigint").alias("suid"),
        _number(part(2), "bigint").alias("utc"),
        _number(part(3), "int").alias("lat"),
        _number(part(4), "int").alias("lon"),
        _number(part(5), "int").alias("head"),
        _number(part(6), "boolean").alias("passenger"),
    )


def complete(parsed: DataFrame) -> DataFrame:
    """Lines with every field present."""
    return parsed.dropna(subset=["date", "suid", "utc", "lat", "lon", "head", "passenger"])


def quarantined(parsed: DataFrame) -> DataFrame:
    """Lines that :func:`complete` leaves out."""
    missing = F.lit(False)
    for c in ["date", "suid", "utc", "lat", "lon", "head", "passenger"]:
        missing = missing | F.col(c).isNull()
    return parsed.filter(missing)


def read_gps_text(spark: SparkSession, path: str) -> DataFrame:
    return complete(parse_gps(spark.read.text(path)))


def read_gps_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Day table with status text in ``ostdesc``."""
    table = spark.read.format(fmt).options(**options).load(path) if fmt != "jdbc" else spark.read.format("jdbc").options(**options).load()
    return table.select("suid", "utc", "lat", "lon", "head", F.col("ostdesc").contains("重车").alias("passenger"))


def stream_gps_text(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return complete(parse_gps(stream_lines(spark, path, files_per_batch)))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of the text files in a folder, as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def day_bounds(gps: DataFrame) -> DataFrame:
    return gps.agg(F.min("utc").alias("start_utc"), F.max("utc").alias("end_utc"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """``pre;cur;flag`` with each side ``date suid utc gid offset route``."""
    halves = F.split("value", ";")

    def side(index: int, prefix: str):
        f = F.split(F.get(halves, F.lit(index)), " ")
        route = F.nullif(F.get(f, F.lit(5)), F.lit("null"))
        ids = F.filter(F.split(route, ","), lambda x: x != "")
        return [
            F.nullif(F.get(f, F.lit(0)), F.lit("null")).alias(f"{prefix}date"),
            F.get(f, F.lit(1)).try_cast("bigint").alias(f"{prefix}suid"),
            F.get(f, F.lit(2)).try_cast("bigint").alias(f"{prefix}utc"),
            F.get(f, F.lit(3)).try_cast("bigint").alias(f"{prefix}gid"),
            F.get(f, F.lit(4)).try_cast("double").alias(f"{prefix}offset"),
            F.transform(ids, lambda x: x.try_cast("bigint")).alias(f"{prefix}route"),
        ]

    return lines.select(*side(0, "pre_"), *side(1, ""), F.get(halves, F.lit(2)).try_cast("int").alias("flag"))


def split_by_flag(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pairs.filter(F.col("flag") == 1), pairs.filter(F.col("flag") == 0)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Inverse of :func:`parse_pairs`; a missing field is the text ``null``."""

    def side(prefix: str) -> Column:
        route = F.coalesce(
            F.concat(F.array_join(F.transform(f"{prefix}route", lambda x: x.cast("string")), ","), F.lit(",")), F.lit("null")
        )
        return F.concat_ws(
            " ", *[F.coalesce(F.col(prefix + c).cast("string"), F.lit("null")) for c in ("date", "suid", "utc", "gid", "offset")], route
        )

    return pairs.select(F.concat_ws(";", side("pre_"), side(""), F.coalesce(F.col("flag").cast("string"), F.lit("null"))).alias("value"))
