"""Log lines derived from the ``events`` table.

The given tables hold no log lines, so the registered queries derive them: one line
per event (some twice), in both wire versions, with the usual defects mixed in. The
rules are spelled a second time in SQL in :mod:`logspark.plans.oracles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import spread_table

ESC = "\x1b"
COLOR_ON = f"{ESC}[01;31m{ESC}[K"
COLOR_OFF = f"{ESC}[m{ESC}[K"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _micros() -> Column:
    """`ts` has no zone; it is read as UTC whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))


def event_parts(ev: DataFrame) -> DataFrame:
    """The pieces a line is put together from."""
    user, event = F.col("user_id"), F.col("event_id")
    level = (
        F.when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", 1)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(0)
    )
    return (
        ev.withColumns({"us": _micros(), "clock": F.substring(F.col("ts").cast("string"), 1, 19)})
        .withColumns(
            {
                "sec": F.expr("us div 1000000"),
                "frac": F.lpad((F.col("us") % 1000000).cast("string"), 6, "0"),
                "lvl": level,
                "src": F.concat("event_type", F.lit(":"), (user % 4).cast("string")),
            }
        )
        .withColumns(
            {
                "node": F.concat(F.lit("node-"), (user % 10).cast("string"), F.lit(".log")),
                # Sizes halve from one file to the next; the first holds half of all lines.
                "unit": F.concat(
                    F.lit("unit-"), F.length(F.bin(event % 1024)).cast("string"), F.lit(".log")
                ),
                # Files of a fixed number of events, so there are more of them in a larger table;
                # one in three is longer, with more bad lines than a file may have.
                "block": F.concat(
                    F.lit("block-"),
                    F.expr("event_id div 1200").cast("string"),
                    F.when(event % 1200 < 600, F.lit("-a.log")).when(event % 1200 < 900, F.lit("-b.log")).otherwise(F.lit("-c.log")),
                ),
                "epoch": F.concat(F.col("sec").cast("string"), F.lit("."), "frac", F.lit("000")),
                "rfc": F.concat(
                    F.translate("clock", " ", "T"), F.lit("."), "frac", F.lit("Z")
                ),
                "msg": F.concat("event_type", F.lit(".user-"), user.cast("string")),
                "name": F.element_at(
                    F.array(*map(F.lit, ("debug", "info", "error", "fatal"))), F.col("lvl") + 1
                ),
                "data": F.concat(
                    F.lit('{"session":"'),
                    user.cast("string"),
                    F.lit("."),
                    (event % 7).cast("string"),
                    F.lit('"'),
                    F.when(F.col("event_type") == "error", F.lit(',"error":"boom"')).otherwise(
                        F.lit("")
                    ),
                    F.lit(',"cents":'),
                    F.round(F.col("value") * 100).cast("bigint").cast("string"),
                    F.lit(',"props":'),
                    "props",
                    F.lit("}"),
                ),
            }
        )
    )


def log_lines(ev: DataFrame, file: str = "node") -> DataFrame:
    """``file, event_id, value`` for every event; ``file`` picks the naming rule."""
    event = F.col("event_id")
    p = event_parts(ev)
    source = F.concat(
        F.lit('"'),
        F.when(event % 13 == 0, F.concat(F.lit(COLOR_ON), "src", F.lit(COLOR_OFF))).otherwise(
            F.col("src")
        ),
        F.lit('"'),
    )
    source = F.when(event % 23 == 0, F.lit("7")).otherwise(source)
    time = F.when(event % 2 == 0, F.col("epoch")).otherwise(F.col("rfc"))
    time = F.concat(F.lit('"timestamp":"'), time, F.lit('",'))
    time = (
        F.when((event % 29 == 0) & (event % 3 == 0), F.lit('"timestamp":"5",'))
        .when(
            (event % 29 == 0) & (event % 3 == 1),
            F.concat(F.lit('"timestamp":"'), F.col("sec").cast("string"), F.lit('000",')),
        )
        .when(event % 29 == 0, F.lit(""))
        .otherwise(time)
    )
    level = F.when(
        event % 2 == 0, F.concat(F.lit('"log_level":'), F.col("lvl").cast("string"))
    ).otherwise(F.concat(F.lit('"level":"'), "name", F.lit('"')))
    body = F.concat(
        F.lit("{"),
        time,
        F.lit('"source":'),
        source,
        F.lit(',"message":"'),
        "msg",
        F.lit('",'),
        level,
        F.lit(',"data":'),
        "data",
    )
    day = F.translate("clock", "-", "/")
    foreign = (
        F.when(event % 3 == 0, F.concat(day, F.lit(" started "), "msg"))
        .when(event % 3 == 1, F.concat(day, F.lit(" [error] 12#0: *1 "), "msg"))
        .otherwise(
            F.concat(
                "event_type",
                F.lit(".example - ["),
                F.substring("clock", 9, 2),
                F.lit("/Jan/"),
                F.substring("clock", 1, 4),
                F.lit(":"),
                F.substring("clock", 12, 8),
                F.lit(" +0000] GET /"),
            )
        )
    )
    value = (
        F.when(event % 17 == 0, foreign)
        .when((event % 19 == 0) & (event % 2 == 0), body)
        .when(event % 19 == 0, F.concat(body, F.lit("} trailing")))
        .otherwise(F.concat(body, F.lit("}")))
    )
    copies = F.when(event % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return p.select(
        F.col(file).alias("file"), "event_id", value.alias("value"), F.explode(copies).alias("copy")
    ).drop("copy")


def sample_lines(spark: SparkSession, sf_dir: str, file: str = "node") -> DataFrame:
    """Lines with their file; what the parse operators take."""
    return log_lines(events(spark, sf_dir), file).select("file", "value")
