"""Literal inputs and outputs of the algebra, its laws, and the plans that it becomes."""

import pytest
from pyspark.sql import functions as F

from weftline.apps import kv, netpath, numeric as n, world
from weftline.functions.ports import LONG, STRING, strict_int, wrap32
from weftline.operators.cell import Drive, PortMismatch
from weftline.operators.compose import Broadcast, Chain, Choice, Feedback, Id, Merge, Opt, Rep, TryChain, Wire, chain, diamond
from weftline.operators.contract import Blueprint, CarrierCost, ContractError, CostExceeded, Slot, Static, ZeroCapacity, assert_conforms, assert_wiring, conforms, declare_inline_loop_moore, validate_capacity, validate_cost, validate_seam
from weftline.plans.carriers import BoundedCarrier, ChannelCarrier, DirectCarrier, InlineCarrier, QueueCarrier, drive_link, drive_try, drive_wired, pump_try, spawned_flow
from weftline.plans.drive import drive, drive_seq, final_state, fold, run_static
from weftline.plans.ranges import running_sum
from weftline.plans.slots import SlotDrive


OPTION = "struct<some:bigint>"


def frame(spark, values, kind="bigint"):
    return spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], f"seq bigint, k int, x {kind}").coalesce(1)


def outputs(df):
    return [r["o"] for r in df.orderBy("seq").collect()]


def step(spark, cell, *values, kind="bigint"):
    return outputs(drive(cell, frame(spark, values, kind), "x", "o"))


def seq(spark, cell, values, how="auto", kind="bigint"):
    return outputs(drive_seq(cell, frame(spark, values, kind), "x", "o", ["k"], ["seq"], how))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stateless_literals(spark):
    assert outputs(Wire(n.inc, n.double).fire(frame(spark, [5]), "x", "o")) == [12]
    assert step(spark, chain(n.inc, n.double, n.double), 2) == [12]
    assert step(spark, Broadcast(n.inc, n.inc, n.double), 5) == [(7, 12)]
    assert step(spark, Feedback(n.inc, n.inc), 8) == [11]
    assert step(spark, Feedback(Chain(n.inc, n.double), n.inc), 1) == [12]
    assert [step(spark, c, 5)[0] for c in (Rep(3, n.inc), Rep(0, n.inc), Chain(Rep(2, n.inc), n.double))] == [8, 5, 14]
    assert step(spark, diamond(n.inc, n.inc, n.double, n.sum_pair), 4) == [16]
    assert step(spark, Opt(n.inc), None, (5,), kind=OPTION) == [None, (6,)]
    assert step(spark, Chain(Opt(n.inc), Opt(n.double)), (5,), None, kind=OPTION) == [(12,), None]
    assert step(spark, Chain(n.lift_some, Opt(n.double)), 5) == [(10,)]
    assert step(spark, Chain(n.total, n.double), [1, 2, 3], kind="array<bigint>") == [12]
    assert step(spark, Choice(n.inc, n.double), ("A", 5, None), ("B", None, 2), kind="struct<tag:string,a:bigint,b:bigint>") == [("A", 6, None), ("B", None, 4)]


def test_stateful_literals_are_the_same_by_every_plan(spark):
    cells = {
        n.counter: [5, 8, 10],
        Chain(n.counter, n.double): [10, 16, 20],
        Rep(2, n.counter): [5, 13, 23],
        Broadcast(n.counter, n.counter, n.double): [(5, 10), (13, 16), (23, 20)],
        n.scaler(1_000_003): [5, 13, 28],
        Feedback(n.counter_mod(1_000_003), n.inc): [11, 29, 63],
    }
    for cell, want in cells.items():
        for how in ("fold", "scan", *(["window"] if cell.windowed else [])):
            assert seq(spark, cell, [5, 3, 2], how) == want, (cell, how)
    merge = Merge(n.inc, n.double, n.counter)
    for how in ("window", "fold", "scan"):
        assert seq(spark, merge, [(5, 5), (1, 1)], how, "struct<_1:bigint,_2:bigint>") == [16, 20]
        assert seq(spark, Opt(n.counter), [(1,), None, (2,)], how, OPTION) == [(1,), None, (3,)]
        assert seq(spark, Broadcast(n.lift_some, Opt(n.counter), Opt(n.inc)), [1, 2], how) == [((1,), (2,)), ((3,), (3,))]
        both = Choice(n.counter, n.counter)
        assert seq(spark, both, [("A", 1, None), ("B", None, 5), ("A", 2, None)], how, "struct<tag:string,a:bigint,b:bigint>") == [("A", 1, None), ("B", None, 5), ("A", 3, None)]


def test_ranges_give_the_same_sums(spark):
    rows = [(i, i % 3 if i % 7 else None, (i * 37) % 11 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "seq bigint, k int, x bigint")
    got = running_sum(df, "x", "o", ["k"], ["seq"])
    assert got.columns == ["seq", "k", "x", "o"]
    assert outputs(got) == outputs(drive_seq(n.counter, df, "x", "o", ["k"], ["seq"], "window"))


def test_laws(spark):
    a, b, c = n.inc, n.double, n.triple
    for x in (Chain(Chain(a, b), c), Chain(a, Chain(b, c)), Chain(Id(LONG), chain(a, b, c)), Chain(chain(a, b, c), Id(LONG))):
        assert step(spark, x, *range(-64, 65)) == [(v + 1) * 6 for v in range(-64, 65)]
    left = step(spark, Broadcast(Id(LONG), a, b), 1, 2)
    right = step(spark, Broadcast(Id(LONG), b, a), 1, 2)
    assert [(y, x) for x, y in right] == left


def test_types_are_checked_before_any_job():
    with pytest.raises(PortMismatch):
        Chain(n.inc, n.normalize)
    with pytest.raises(PortMismatch):
        Chain(n.lift_some, n.double)  # an option is not its value
    with pytest.raises(PortMismatch):
        Chain(n.inc, Opt(n.double))
    with pytest.raises(PortMismatch):
        assert_wiring(n.inc, n.parse)
    with pytest.raises(PortMismatch):
        SlotDrive(Slot(LONG, LONG), n.parse)
    assert conforms(Slot(LONG, LONG), n.counter) and not conforms(Slot(LONG, STRING), n.inc)
    assert_conforms(Wire(n.inc, n.double))
    with pytest.raises(ValueError):
        Rep(0, n.inc).nonempty()
    with pytest.raises(ValueError):
        drive(n.counter, None)
    with pytest.raises(ValueError):
        drive_seq(n.counter, None, "x", "o", ["k"], [])


def test_contracts():
    validate_cost(CarrierCost.ZERO_ALLOC_INLINE, CarrierCost.EXTERNAL)
    with pytest.raises(CostExceeded):
        validate_cost(CarrierCost.EXTERNAL, CarrierCost.PER_MESSAGE_ALLOC)
    with pytest.raises(ZeroCapacity):
        validate_capacity(0)
    with pytest.raises(CostExceeded):
        validate_seam(CarrierCost.EXTERNAL, CarrierCost.ZERO_ALLOC_INLINE, 0)
    with pytest.raises(ZeroCapacity):
        BoundedCarrier(0)
    declare_inline_loop_moore(n.identity_feed)
    with pytest.raises(ContractError):
        declare_inline_loop_moore(n.inc)
    with pytest.raises(ContractError):
        Static(n.scaler(7)).check()
    Static(n.counter).check()


def test_plans(spark):
    df = frame(spark, range(10))
    composed = plan(Blueprint(chain(n.inc, n.double, n.triple)).activate(df, "x", "o"))
    assert composed.count("Project") <= 1 and "Exchange" not in composed and "Python" not in composed
    by_hand = plan(df.withColumn("o", (F.col("x") + 1) * 2 * 3))
    assert composed.count("Project") == by_hand.count("Project")
    queue = plan(drive_link(n.inc, n.double, QueueCarrier(), df, "x", "o"))
    assert queue.count("MapInArrow") == 1
    assert plan(drive_link(n.inc, n.double, ChannelCarrier(("k",)), df, "x", "o")).count("Exchange hashpartitioning") == 1
    windows = plan(drive_seq(Broadcast(n.counter, n.counter, n.counter), df.repartition(3), "x", "o", ["k"], ["seq"]))
    assert windows.count("Exchange hashpartitioning") == 1


def test_output_may_replace_a_column(spark):
    df = frame(spark, [1, 2, 3]).withColumn("o", F.lit(9).cast("bigint"))
    made = drive(chain(n.inc, n.double), df)
    assert made.columns == df.columns and outputs(made) == [4, 6, 8] and [r["x"] for r in made.orderBy("seq").collect()] == [1, 2, 3]
    made = drive(diamond(n.inc, n.inc, n.double, n.sum_pair), df, "x", "x").orderBy("seq")
    assert made.columns == df.columns and [r["x"] for r in made.collect()] == [7, 10, 13]
    # even the column that orders the rows
    assert sorted(r["seq"] for r in drive_seq(Chain(n.counter, n.double), df, "x", "seq", ["k"], ["seq"], "window").collect()) == [2, 6, 12]
    # a branch that is not taken stays nothing
    both = Opt(diamond(Chain(n.inc, n.double), n.inc, n.double, n.sum_pair))
    some = frame(spark, [None, (1,)], OPTION)
    assert outputs(drive(both, some, "x", "o")) == [None, (13,)]


def test_carriers_agree(spark):
    df = frame(spark, range(100))
    for c in (InlineCarrier(), DirectCarrier(), QueueCarrier(), BoundedCarrier(7), ChannelCarrier(("k",))):
        assert outputs(drive_link(n.inc, n.counter, c, df, "x", "o", Drive(("k",), ("seq",)))) == [sum(range(1, i + 2)) for i in range(100)]


def test_spawned_and_static(spark):
    assert outputs(spawned_flow(n.inc, n.counter, frame(spark, [5, 3]), "x", "o", ["k"])) == [6, 4]
    assert outputs(run_static(Static(Chain(n.inc, n.double)), frame(spark, [5]))) == [12]
    assert outputs(drive_wired(Wire(n.inc, n.double), QueueCarrier(), frame(spark, [5]), "x", "o")) == [12]


def test_failures(spark):
    texts = ["42", "xx", " 42 ", "+6", "1.5", ""]
    assert [tuple(r) for r in outputs(drive_try(n.parse, n.double, frame(spark, texts, "string"), "x", "o"))] == [(84, None), (None, "not a number: xx"), (None, "not a number:  42 "), (12, None), (None, "not a number: 1.5"), (None, "not a number: ")]
    assert [tuple(r) for r in step(spark, TryChain(n.parse, n.fallible_inc), "7", "-1", "z", kind="string")] == [(8, None), (None, "negative"), (None, "not a number: z")]
    good, failed = pump_try(n.fallible_inc, n.double, frame(spark, range(-1, 100)), "x", "o")
    assert outputs(good) == [2 * (i + 1) for i in range(100)] and failed.first()[0] == 1


def test_slot(spark):
    slot = SlotDrive(Slot(LONG, LONG), n.counter).swap(n.scaler(1_000_003))
    df = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 0, 3), (2, 0, 1, 5), (3, 0, 1, 1)], "seq bigint, k int, epoch int, x bigint")
    assert outputs(slot.drive(df, "x", "o", "epoch", ["k"], ["seq"])) == [5, 8, 5, 11]


def test_sensor(spark):
    assert seq(spark, Chain(n.sensor, n.normalize), [200, 300, 600]) == [2.0, 3.0, 6.0]
    assert step(spark, Broadcast(n.to_double, n.normalize, n.threshold), 60) == [(0.6, 1)]


def test_strict_and_wrapping(spark):
    got = spark.sql("SELECT * FROM VALUES ('42'), (' 42'), ('+6'), ('-0'), ('99999999999999999999'), ('1e3'), (NULL) AS t(s)").select(strict_int(F.col("s")), strict_int(F.col("s"), signed=False, high=50)).collect()
    assert [r[0] for r in got] == [42, None, 6, 0, None, None, None]
    assert [r[1] for r in got] == [42, None, 6, None, None, None, None]
    assert spark.range(1).select(wrap32(F.lit(2147483648)), wrap32(F.lit(-2147483649))).first() == (-2147483648, 2147483647)


def test_key_value_session(spark):
    chunk = "SET foo 10\nGET foo\nINCR foo\nSET big 999999999999999999\nSET foo notanumber\nGET\nDEL foo\nNOPE x\n\nGET half"
    lines = kv.split_lines(spark.createDataFrame([(1, 0, chunk[:20]), (1, 1, chunk[20:]), (1, 2, None)], "c int, turn int, chunk string"), "chunk", ["c"], "turn")
    assert lines.count() == 9
    cmds = drive(kv.cmd_parse, lines.where("line <> ''"), "line", "cmd")
    said = drive(kv.resp_encode, kv.replies(cmds, "cmd", ["line_no"]), "reply", "o").orderBy("line_no").collect()
    assert [r["o"] for r in said] == ["+OK\r\n", ":10\r\n", ":11\r\n", "-ERR value too large: 999999999999999999\r\n", "-ERR SET value must be an integer, got 'notanumber'\r\n", "-ERR GET requires a key\r\n", ":1\r\n", "ERR unknown: NOPE\r\n"]
    assert [r["reply"]["log"] for r in said if r["reply"]["log"]] == ["SET foo 10", "DEL foo"]


def test_key_value_limits(spark):
    cmds = frame(spark, [("SET", "a", 1, None), ("SET", "b", 2, None), ("SET", "c", 999_999, None)], "struct<tag:string,key:string,value:bigint,msg:string>")
    got = outputs(drive_seq(kv.bounded_store(1, 1000), cmds, "x", "o", ["k"], ["seq"]))
    assert [(r["tag"], r["text"]) for r in got] == [("OK", None), ("ERR", "max keys reached"), ("ERR", "value too large: 999999")]


def test_world_session(spark):
    lines = ["LOGIN alice", "LOGIN bob", "MOVE alice 1 2", "SAY alice hello  world", "MOVE bob 5 5", "LOGOUT bob", "MOVE ghost 1", "JUMP"]
    events = drive_seq(world.player_handler, frame(spark, lines, "string"), "x", "event", ["k"], ["seq"])
    views = outputs(drive_seq(world.world_view, events, "event", "o", ["k"], ["seq"]))
    assert views[2] == ["event: alice -> (1,2)", "online: [alice@(1,2), bob@(0,0)]"]
    assert views[3][0] == "event: alice: hello  world"
    assert views[5] == ["event: bob left", "online: [alice@(1,2)]"]
    assert views[6:] == [["event: ghost -> (1,0)", "online: [alice@(1,2), ghost@(1,0)]"], ["online: [alice@(1,2), ghost@(1,0)]"]]
    at = world.positions(events, "event", ["k"], ["seq"]).orderBy("seq").collect()
    assert [(r["x"], r["y"]) for r in at] == [(0, 0), (0, 0), (1, 2), (1, 2), (5, 5), (None, None), (1, 0), (None, None)]


def test_packets(spark):
    raw = ["aa:bb:06:100:8080.10", "aa:bb:06:200:8080.20", "aa:bb:06:100:9090.30", "malformed-garbage", "a:b:6:1:70000.5"]
    got = drive(netpath.path, frame(spark, raw, "string"), "x", "o")
    assert [tuple(r) for r in outputs(got)] == [(8080, 10, 7), (8080, 20, 7), (9090, 30, 7), (0, 0, 0), (0, 5, 7)]
    assert sum(r["bytes"] for r in netpath.delivered_table(got, "o").collect()) == 28


def test_static_plans(spark):
    """Windows for state; a plan with a Python node or an exchange of its own is refused."""
    df = frame(spark, [5, 3, 2])
    made = run_static(Static(Chain(n.counter, n.double)), df, "x", "o", ["k"], ["seq"])
    assert outputs(made) == [10, 16, 20] and "InArrow" not in plan(made)
    with pytest.raises(ContractError):
        Static(n.inc).check_plan(drive_link(n.inc, n.double, QueueCarrier(), df, "x", "o"), df)
    with pytest.raises(ContractError):
        Static(n.inc).check_plan(drive_link(n.inc, n.double, ChannelCarrier(("k",)), df, "x", "o"), df)


def test_lines_are_split_once(spark, sf_dir):
    """The words of a line are bound once, and all windows share one sort."""
    from weftline.catalog import QUERIES

    for name, splits in (("q60_kv_replies", 1), ("q63_kv_parse", 1), ("q70_world_state", 2)):
        df = QUERIES[name](spark, sf_dir)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == splits, name
        if name != "q63_kv_parse":
            assert plan(df).count("Sort [") == 1 and plan(df).count("Exchange ") == 1


def test_long_keys_are_scanned(spark):
    rows = [(i, i % 4 if i % 9 else None, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows + [(1000, 77, 1)], "seq bigint, k int, x bigint")
    want = outputs(drive_seq(n.counter, df, "x", "o", ["k"], ["seq"], "window"))
    for most in (10, 50, 1000):
        assert outputs(fold(n.counter, df, "x", "o", ["k"], ["seq"], most)) == want


def test_final_states(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, i) for i in range(40)], "seq bigint, k int, x bigint")
    for cell in (n.counter, n.scaler(1_000_003), Rep(2, n.counter)):
        got = {r["k"]: r["state"] for r in final_state(cell, df, "x", ["k"], ["seq"]).collect()} if hasattr(cell, "final") else None
        if got is not None:
            last = {r["k"]: r["o"] for r in drive_seq(cell, df, "x", "o", ["k"], ["seq"], "scan").orderBy("seq").collect()}
            assert got == last
