"""Small log lines for the tests."""

import json


def line(i=0, source="rep", level=1, **more):
    record = {
        "timestamp": f"1520983802.{i:09d}",
        "source": source,
        "message": f"{source}.step-{i}",
        "log_level": level,
        "data": {"session": f"9.{i}"},
    }
    return json.dumps(record | more, separators=(",", ":"))


def block(n, source="rep", start=0):
    return "".join(line(i, source) + "\n" for i in range(start, start + n)).encode()


def lines_df(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")
