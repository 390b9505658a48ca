"""Every query gives what its SQL gives, on the smallest tables."""

import os

import duckdb
import pytest

from weftline.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows(columns, values):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in by) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    have = rows(got.columns, got.collect())
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert have == rows(want.columns, want.fetchall())
    else:
        assert have


def test_limits_by_brute_force(spark, sf_dir):
    """The bounded store against one Python map a store."""
    from weftline import catalog

    cmds = catalog._commands(spark, sf_dir).orderBy("ts", "event_id").collect()
    stores, want = {}, {}
    for r in cmds:
        held, (tag, key, value, msg) = stores.setdefault(r["user_id"] % 25, {}), r["cmd"]
        if tag == "SET" and value > 15_000:
            reply = ("ERR", None, f"value too large: {value}", None)
        elif tag == "SET" and key not in held and len(held) == 4:
            reply = ("ERR", None, "max keys reached", None)
        elif tag == "SET":
            held[key], reply = value, ("OK", None, None, f"SET {key} {value}")
        elif tag == "DEL":
            reply = ("INT", int(key in held), None, f"DEL {key}")
            held.pop(key, None)
        elif tag == "INCR":
            held[key] = held.get(key, 0) + 1
            reply = ("INT", held[key], None, None)
        elif tag == "GET":
            reply = ("INT", held[key], None, None) if key in held else ("NIL", None, None, None)
        else:
            reply = ("BYTES", None, f"ERR unknown: {msg}", None) if tag == "UNKNOWN" else ("ERR", None, msg, None)
        want[r["event_id"]] = reply
    got = {r["event_id"]: (r["tag"], r["i"], r["text"], r["log"]) for r in catalog.q64_kv_limits(spark, sf_dir).collect()}
    assert got == want


def test_pump_keeps_rows_without_a_time(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 10 = 0")
    e.withColumn("ts", F.when(F.col("event_id") % 30 != 0, F.col("ts"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = (sorted(map(tuple, QUERIES[k](spark, str(tmp_path)).collect())) for k in ("q45_bounded_pump", "q41_direct"))
    assert len(want) == e.count() and got == want
