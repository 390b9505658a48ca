"""Every plan of a topology gives the same rows, or is refused before any job."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.apps import kv, netpath, numeric as n, world
from weftline.functions.ports import plain
from weftline.operators.cell import Linear
from weftline.operators.compose import Broadcast, Chain, Choice, DriveTry, Each, Feedback, Id, Merge, Opt, Rep, Switch, TryChain, chain, diamond
from weftline.operators.contract import ContractError, Slot
from weftline.plans.carriers import pump_try
from weftline.plans.drive import drive_seq, fold
from weftline.plans.ranges import by_ranges
from weftline.plans.slots import SlotDrive
from weftline.streaming.pump import bounded_pump, bounded_pump_try, file_stream, log_sink, ordered_files, pump, typed_state

M = 1_000_003
LINES = ["LOGIN alice", " LOGIN bob", "MOVE alice 1 2", "SAY alice hello  world", "LOGOUT zed", "MOVE bob 5 -5", "LOGOUT bob", "LOGIN", "MOVE ghost +1", "JUMP", "", "SAY", "MOVE x 99999999999 1.5"]
CHUNKS = ["SET a 1\nGET", "  a\nSET b 2\n\nINCR c", "\nGET c\nSET d 4\n", "DEL a\nDEL zz\n", "", "SET d 5\nGET d\nSET x y\nNOPE\n", "INCR e\nSET f 9999\nset a\n", "GET"]
RAW = ["aa:bb:06:100:8080.10", "aa:bb:06:200:8080.20", "malformed-garbage", "a:b:6:1:70000.5", "a:b:+6:-1:80.é.1", "a:b", ""]
CMDS = [("SET", "a", 1, None), ("GET", "a", None, None), ("SET", "b", 2, None), ("INCR", "c", None, None), ("SET", "d", 3, None), ("DEL", "a", None, None), ("SET", "d", 4, None), ("SET", "d", 10**6, None), ("UNKNOWN", None, None, "NOPE"), ("PROTOCOL", None, None, "empty command")]
NUMBERS = [5, 0, 3, 2, 10**6, 7, 1]
REALS = [0.5, -0.0, 1e300, 0.50000001]
CASES = {
    "stateless": (chain(n.inc, n.double, n.triple, n.passed), NUMBERS),
    "diamond": (diamond(n.inc, n.inc, n.double, n.sum_pair), NUMBERS),
    "counter": (n.counter, NUMBERS),
    "sensor": (Chain(n.sensor, n.normalize), NUMBERS),
    "scaler": (n.scaler(M), NUMBERS),
    "feedback": (Feedback(n.counter_mod(M), n.inc), NUMBERS),
    "feedback window": (Feedback(n.double, n.counter), NUMBERS),
    "rep": (Rep(2, n.counter), NUMBERS),
    "mixed": (Chain(Broadcast(n.counter, n.scaler(M), n.double), n.sum_pair), NUMBERS),
    "merge": (Merge(n.inc, n.double, n.counter), [(1, 2), (None, 3), (4, None), (5, 6)]),
    "option": (Opt(n.counter), [(1,), (None,), (2,)]),
    "lifted": (Chain(n.lift_some, Opt(n.counter)), NUMBERS),
    "choice": (Choice(n.counter, n.scaler(M)), [("A", 1, None), ("B", None, 5), ("A", 2, None), ("C", 1, 1), (None, None, None), ("B", None, 6)]),
    "try": (TryChain(n.parse, n.fallible_inc), ["7", "-1", "z", "+5", "", " 3", "99999999999999999999"]),
    "checked": (Chain(n.wrapping_scale(10**6 + 3), n.checked_double), [5, -7, 2**31]),
    "reals": (Chain(n.half, Broadcast(n.normalize, n.half, n.normalize)), REALS),
    "threshold": (n.threshold, REALS),
    "identity": (Id(T.LongType()), NUMBERS),
    "total": (Chain(n.total, n.double), [[1, 2, 3], [], [None, 1]]),
    "each": (Each(Chain(n.counter, n.double)), [[1, 2], [], [3, None, 4]]),
    "each stateless": (Each(Chain(n.inc, n.double)), [[1, 2], [], [3, None, 4]]),
    "switch": (Switch(n.counter, n.scaler(M), n.inc), [(0, 5), (0, 3), (1, 5), (1, None), (1, 1), (7, 2), (0, 4), (None, 1)]),
    "player": (world.player_handler, LINES),
    "world": (Chain(world.line_event, world.world_view), LINES),
    "world state": (Chain(world.line_event, world.world_state), LINES),
    "program": (world.program, LINES),
    "store": (kv.bounded_store(3, 100), CMDS),
    "lines": (kv.line_split, CHUNKS),
    "service": (kv.service(3, 100), CHUNKS),
    "packets": (netpath.path, RAW),
    "delivery": (netpath.delivery, RAW),
}
STREAMED = ["counter", "mixed", "option", "choice", "try", "each", "switch", "world", "program", "store", "service", "delivery", "reals"]


def rows_of(values, times=3, seed=1):
    """Each value several times, nulls among them, over three keys of different lengths."""
    rng = random.Random(seed)
    given = [*values, *rng.choices([*values, None, None], k=len(values) * times), None]
    return [(i, rng.choice([0, 0, 0, 1, None]), v) for i, v in enumerate(given)]


def given(spark, cell, values):
    kind = T.StructType([T.StructField("seq", T.LongType()), T.StructField("k", T.LongType()), T.StructField("x", cell.in_type)])
    return spark.createDataFrame(rows_of(values), kind)


def told(df):
    return [(r["seq"], r["k"], r["o"]) for r in df.orderBy("seq").collect()]


def by_hand(cell, rows):
    states, out = {}, []
    for seq, k, x in rows:
        states[k], o = cell.python(states.get(k, cell.initial()), x)
        out.append((seq, k, o))
    return out


def same(got, cell, rows):
    into = plain(cell.out_type)
    return json.dumps([(s, k, into(o)) for s, k, o in got]) == json.dumps(by_hand(cell, rows))


@pytest.mark.parametrize("name", CASES)
def test_plans_agree(spark, name):
    cell, values = CASES[name]
    df, rows = given(spark, cell, values), rows_of(values)
    for how, has in (("window", cell.windowed), ("fold", cell.foldable), ("scan", cell.scannable), ("ranges", cell.ranged), ("lockstep", cell.vectors)):
        if has:
            assert same(told(drive_seq(cell, df, "x", "o", ["k"], ["seq"], how)), cell, rows), how
        else:
            with pytest.raises(ContractError):
                drive_seq(cell, df, "x", "o", ["k"], ["seq"], how)
    assert cell.scannable


@pytest.mark.parametrize("name", STREAMED)
def test_streams_agree(spark, tmp_path, name):
    cell, values = CASES[name]
    df, rows = given(spark, cell, values).withColumnRenamed("x", "the x").withColumn("_odd", F.when(F.col("seq") % 3 > 0, F.col("seq") + (1 << 60))), rows_of(values)
    ordered_files(df, ["seq"], f"{tmp_path}/in", least=3)
    out = bounded_pump(spark, f"{tmp_path}/in", df.schema, cell, "the x", "o", ["k"], ["seq"])
    assert same(told(out), cell, rows)
    assert out.where("(seq % 3 > 0) <> (_odd IS NOT NULL) OR _odd <> seq + (1L << 60)").count() == 0


def test_fold_is_the_same_at_its_border(spark):
    for count in (999, 1000, 1001):
        df = spark.range(count).select(F.col("id").alias("seq"), F.lit(0).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("x"))
        got = fold(n.counter, df, "x", "o", ["k"], ["seq"])
        assert got.exceptAll(drive_seq(n.counter, df, "x", "o", ["k"], ["seq"], "window")).isEmpty() and got.count() == count


def test_no_job_runs_while_a_fold_is_planned(spark):
    df, tracker = given(spark, n.counter, NUMBERS), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    fold(n.counter, df, "x", "o", ["k"], ["seq"])
    assert not list(tracker.getJobIdsForGroup("planning"))
    spark.sparkContext.setJobGroup("", "")


def test_one_key_fills_many_tasks(spark):
    """A recurrence along one key of 20,000 rows, in eight tasks of about as many rows each; without a key too."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("seq"), F.lit("one").alias("k"), (F.col("id") * 31 % 977).alias("x"))
    for cell in (n.scaler(M), Feedback(n.counter_mod(M), n.inc)):
        want = {s: o for s, _, o in told(drive_seq(cell, df, "x", "o", ["k"], ["seq"], "scan"))}
        for keys in (["k"], []):
            made = by_ranges(cell, df, "x", "o", keys, ["seq"], ranges=8)
            assert {s: o for s, _, o in told(made)} == want
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # these rows are few
    size = by_ranges(n.scaler(M), df, "x", "o", ["k"], ["seq"], ranges=32).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset(key)
    assert len(size) == 4 and max(r["count"] for r in size) < 10_000  # 32 ranges, hashed to the session's four partitions


def test_linear_steps_compose():
    rng = random.Random(3)
    for step in (Linear(1, 1), Linear(2, 1, 0, M), Linear(5, 3, 7, 97), Linear(2, 1, 0, M).looped(Linear(0, 1, 1)), Linear(3, 2, 1, 97).looped(Linear(0, 4, 5))):
        s = step.summary()
        xs = [rng.randrange(-50, 1000) for _ in range(30)]
        want = [0]
        for x in xs:
            v = step.a * want[-1] + step.b * x + step.c
            want.append(v % step.m if step.m else v)
        for cut in (0, 1, 13, 30):
            both = s.then(s.of(xs[:cut]), s.of(xs[cut:]))
            assert s.onto(0, both) == want[-1] and s.onto(0, s.of(xs[:cut])) == want[cut]
    with pytest.raises(ValueError):
        Linear(2, 1).summary()


@pytest.mark.parametrize("name", ["world", "lines", "delivery"])
def test_summaries_compose(name):
    cell, values = CASES[name]
    leaf = cell.parts["b"] if name != "lines" else cell
    if name != "lines":
        values = [cell.parts["a"].python(cell.parts["a"].initial(), v)[1] for v in values]
    s = leaf.summary
    state = leaf.initial()
    for v in values:
        state, _ = leaf.python(state, v)
    for cut in range(len(values) + 1):
        got = s.onto(leaf.initial(), s.then(s.of(values[:cut]), s.of(values[cut:])))
        assert got == state, cut
        assert s.onto(s.onto(leaf.initial(), s.of(values[:cut])), s.of(values[cut:])) == state


def test_stores_with_limits(spark):
    """Windows up to a store's first refused key: stores that never refuse, that do at once, and a null store."""
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 2, 3, None]), (rng.choice(["SET", "SET", "DEL", "INCR", "GET"]), f"k{rng.randrange(6)}", 5, None)) for i in range(400)]
    rows += [(400 + i, 7, ("SET", "only", i, None)) for i in range(20)] + [(500, 8, None)]
    df = spark.createDataFrame(rows, "seq bigint, k bigint, cmd struct<tag:string,key:string,value:bigint,msg:string>")
    for most in (1, 3, 100):
        cell = kv.bounded_store(most, 1000)
        want = by_hand(cell, rows)
        got = kv.bounded_replies(df, "cmd", ["k"], ["seq"], most, 1000).orderBy("seq").collect()
        assert [(r["seq"], r["k"], r["reply"] and tuple(r["reply"])) for r in got] == want, most


def test_pump_try_reads_its_input_once(spark, tmp_path):
    spark.range(-1, 100).select(F.col("id").alias("x")).write.parquet(f"{tmp_path}/in")
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    source = spark.read.parquet(f"{tmp_path}/in").mapInArrow(seen, "x bigint")
    good, errors = pump_try(n.fallible_inc, n.double, source, "x", "o")
    assert good.count() == 100 and errors.first()[0] == 1 and reads.value == 101


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    """The sink's folder holds each row once though a batch ran twice: its commit is lost, and it is run again."""
    df = spark.createDataFrame([(i, 0, i) for i in range(60)], "seq bigint, k bigint, x bigint")
    ordered_files(df, ["seq"], f"{tmp_path}/in", least=3)
    target, checkpoint = f"{tmp_path}/log", f"{tmp_path}/checkpoint"

    def go():
        query = log_sink(pump(file_stream(spark, f"{tmp_path}/in", df.schema), n.counter, "x", "o", ["k"], ["seq"]), target, checkpoint)
        query.awaitTermination()

    go()
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    got = spark.read.option("recursiveFileLookup", "true").schema("seq bigint, k bigint, x bigint, o bigint").parquet(target).orderBy("seq").collect()
    assert [r["o"] for r in got] == [sum(range(i + 1)) for i in range(60)]


def test_slot_runs_in_one_pass(spark):
    slot = SlotDrive(Slot(T.LongType(), T.LongType()), n.counter).swap(n.scaler(M)).swap(n.inc)
    df = spark.createDataFrame([(i, 0, e, x) for i, (e, x) in enumerate([(0, 5), (0, 3), (1, 5), (1, 1), (9, 4)])], "seq bigint, k bigint, epoch int, x bigint")
    for how in ("auto", "fold", "scan"):
        made = slot.drive(df, "x", "o", "epoch", ["k"], ["seq"], how)
        assert [r["o"] for r in made.orderBy("seq").collect()] == [5, 8, 5, 11, 5], how
    assert slot.drive(df, "x", "o", "epoch", ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_lockstep_over_batches(spark):
    """Keys of all lengths, nulls and null keys, vectors and single rows, states that go on from batch to batch."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(40)]) if i < 3000 else rng.choice([1000, 1001]), rng.choice([None, *range(100)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "seq bigint, k bigint, x bigint")
    cells = [n.scaler(M), Feedback(n.counter_mod(M), n.inc), Rep(2, n.counter), Broadcast(n.counter, n.scaler(M), n.double), Chain(Broadcast(n.inc, n.counter, n.double), n.sum_pair), chain(n.inc, n.double)]
    for size in ("10000", "37", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for cell in cells[: 6 if size == "10000" else 2]:
            assert same(told(drive_seq(cell, df, "x", "o", ["k"], ["seq"], "lockstep")), cell, rows), size
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = [(i, i % 9, (i, None if i % 5 == 0 else 2)) if i % 7 else (i, i % 9, None) for i in range(200)]
    merge = Merge(n.inc, n.double, n.counter)
    df = spark.createDataFrame(pairs, "seq bigint, k bigint, x struct<_1:bigint,_2:bigint>")
    assert same(told(drive_seq(merge, df, "x", "o", ["k"], ["seq"], "lockstep")), merge, pairs)


def test_a_batch_holds_no_more_rows_than_its_capacity(spark, tmp_path):
    """Rows in flight are bounded, and the state goes on in their order from file to file."""
    from weftline.streaming.pump import typed_state

    df = spark.createDataFrame([(i * 37 % 200, i % 2, i * 37 % 200) for i in range(200)], "seq bigint, k bigint, x bigint")
    ordered_files(df, ["seq"], f"{tmp_path}/in", rows_a_file=23, least=2)
    stream = pump(file_stream(spark, f"{tmp_path}/in", df.schema), n.scaler(M), "x", "o", ["k"], ["seq"])
    with typed_state(spark):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p["numInputRows"] for p in query.recentProgress]
    assert max(rows) <= 23 and sum(rows) == 200
    got = told(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))
    want = told(drive_seq(n.scaler(M), df, "x", "o", ["k"], ["seq"], "scan"))
    assert got == want
    with pytest.raises(ContractError):
        ordered_files(df, ["seq"], f"{tmp_path}/none", rows_a_file=0)


def test_a_stream_without_state_is_a_projection(spark, tmp_path):
    """No key is grouped and no state kept for a cell that has none; rows and columns are the same as in a drive."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i - 30) for i in range(60)], "seq bigint, x bigint")
    ordered_files(df, ["seq"], f"{tmp_path}/in", least=3)
    good, errors = bounded_pump_try(spark, f"{tmp_path}/in", df.schema, n.fallible_inc, n.double, "x", "o", ["seq"], ["seq"])
    want = [(i, i - 30, (i - 29) * 2) for i in range(60) if i % 5 and i >= 30]
    assert [tuple(r) for r in good.where("x IS NOT NULL").orderBy("seq").collect()] == want and errors.first()[0] == 24
    stream = pump(file_stream(spark, f"{tmp_path}/in", df.schema), DriveTry(n.fallible_inc, n.double), "x", "o", ["seq"], ["seq"])
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and stream.columns == ["seq", "x", "o"]


def test_many_keys_take_few_calls(spark, tmp_path):
    """Keys share buckets: a batch calls the step once a bucket, whatever the number of its keys."""
    df = spark.range(6000).select(F.col("id").alias("seq"), (F.col("id") % 1500).alias("k"), F.concat(F.lit("SET a "), F.col("id").cast("string"), F.when(F.col("id") % 3 > 0, "\n").otherwise("")).alias("x"))
    ordered_files(df, ["seq"], f"{tmp_path}/in", least=3)
    for cell in (kv.service(3, 10_000), n.scaler(M)):
        given = df if cell.in_type == df.schema["x"].dataType else df.withColumn("x", F.col("seq"))
        ordered_files(given, ["seq"], f"{tmp_path}/{cell.out_type.simpleString()}", least=3)
        with typed_state(spark):
            stream = pump(file_stream(spark, f"{tmp_path}/{cell.out_type.simpleString()}", given.schema), cell, "x", "o", ["k"], ["seq"], buckets=8)
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out-{cell.out_type.simpleString()}").option("checkpointLocation", f"{tmp_path}/c-{cell.out_type.simpleString()}").trigger(availableNow=True).start()
        query.awaitTermination()
        got = told(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out-{cell.out_type.simpleString()}"))
        assert got == told(drive_seq(cell, given, "x", "o", ["k"], ["seq"], "scan"))
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(kept) <= 8


@pytest.mark.parametrize("name", ["store", "service", "world", "program", "delivery", "each"])
def test_large_states_are_kept_apart(spark, tmp_path, name):
    """States that outgrow their bucket, at once or at some later row, go on as they would there."""
    cell, values = CASES[name]
    df, rows = given(spark, cell, values), rows_of(values)
    ordered_files(df, ["seq"], f"{tmp_path}/in", rows_a_file=7)
    for small in (0, 3, 20):
        with typed_state(spark):
            stream = pump(file_stream(spark, f"{tmp_path}/in", df.schema), cell, "x", "o", ["k"], ["seq"], buckets=2, small=small)
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out{small}").option("checkpointLocation", f"{tmp_path}/c{small}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert same(told(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out{small}")), cell, rows), small


def test_streams_sort_as_spark_does(spark, tmp_path):
    """Orders and keys of several types, nulls and NaN among them."""
    values = [None, float("nan"), 1.5, -0.0, float("inf"), -2.0, float("-inf")]
    rows = [(i, [None, "é", "z", "a", ""][i % 5], values[i % 7], i % 3 == 0 if i % 4 else None, [0.0, -0.0, float("nan"), None][i * 5 % 4], i) for i in range(140)]
    df = spark.createDataFrame(rows, "seq bigint, s string, d double, b boolean, k double, x bigint").withColumn("a", F.struct(F.col("s"), F.col("d"))).withColumn("t", F.timestamp_micros(F.col("seq") % 2))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for order, keys in ((["b", "d", "s", "seq"], ["k"]), (["a", "seq"], ["t"]), (["t", "seq"], ["s", "b"])):
        got = bounded_pump(spark, f"{tmp_path}/in", df.schema, n.scaler(M), "x", "o", keys, order)
        want = drive_seq(n.scaler(M), df, "x", "o", keys, order, "fold")
        assert [(r["seq"], r["o"]) for r in got.orderBy("seq").collect()] == [(r["seq"], r["o"]) for r in want.orderBy("seq").collect()], order


def test_a_log_of_many_stores_takes_few_calls(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 700).alias("k"), F.concat(F.lit("SET a "), F.col("id").cast("string")).alias("line"))
    df = drive_seq(kv.cmd_parse, df, "line", "x", [], ["seq"])
    ordered_files(df, ["seq"], f"{tmp_path}/in", least=3)
    stream = pump(file_stream(spark, f"{tmp_path}/in", df.schema), kv.bounded_store(3, 2000), "x", "o", ["k"], ["seq"], buckets=4)
    query = log_sink(stream.select("seq", "o.log").where("log IS NOT NULL"), f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    got = spark.read.option("recursiveFileLookup", "true").schema("seq bigint, log string").parquet(f"{tmp_path}/log")
    assert sorted(r["log"] for r in got.collect()) == sorted(f"SET a {i}" for i in range(2001))


def kept_by(spark, tmp_path, cell, df):
    """The most entries that the state store holds for a stream of df dealt to four buckets; its rows are a scan's."""
    ordered_files(df, ["seq"], f"{tmp_path}/in", least=3)
    stream = pump(file_stream(spark, f"{tmp_path}/in", df.schema), cell, "x", "o", ["k"], ["seq"], buckets=4)
    with typed_state(spark):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert told(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")) == told(drive_seq(cell, df, "x", "o", ["k"], ["seq"], "scan"))
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_many_worlds_take_few_calls(spark, tmp_path):
    x = F.concat(F.element_at(F.array(*map(F.lit, ("LOGIN p", "MOVE p", "SAY p", "LOGOUT p"))), (F.col("id") % 7 % 4 + 1).cast("int")), (F.col("id") % 3).cast("string"), F.lit(" 1 2"))
    df = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 400).alias("k"), x.alias("x"))
    assert kept_by(spark, tmp_path, world.program, df) <= 4


def test_ranges_are_seldom_cut_in_two(spark, tmp_path):
    """A range of the average length is one file, not a file and a remainder with a micro-batch of its own."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("seq"))
    ordered_files(df, ["seq"], f"{tmp_path}/in", rows_a_file=2000, least=2)
    files = list((tmp_path / "in").glob("part-*"))
    assert len(files) <= 13 and spark.read.parquet(f"{tmp_path}/in").count() == 20_000


def test_many_slots_take_few_calls(spark, tmp_path):
    x = F.struct((F.col("id") > 1500).cast("bigint").alias("epoch"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"))
    df = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 700).alias("k"), x.alias("x"))
    assert kept_by(spark, tmp_path, Switch(n.counter, n.scaler(M)), df) <= 4


def test_a_pump_of_many_keys_takes_few_calls(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 700).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"))
    assert kept_by(spark, tmp_path, Chain(n.inc, n.counter), df) <= 4
