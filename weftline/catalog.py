"""All queries of the dataflow algebra, each with the SQL that gives the same rows.

The message stream is ``events`` with values in whole cents (c); a user is a key, and (ts, event_id)
orders a user's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .apps import kv, netpath, numeric as n, world
from .functions.ports import LONG, some
from .operators.cell import Drive
from .operators.compose import Broadcast, Chain, Choice, Feedback, Id, Merge, Opt, Rep, TryChain, Wire, chain, diamond
from .operators.contract import Blueprint, CarrierCost, Slot, Static, assert_conforms, assert_wiring, declare_inline_loop_moore, validate_seam, wire
from .plans.carriers import BoundedCarrier, ChannelCarrier, DirectCarrier, InlineCarrier, QueueCarrier, drive_link, drive_try, drive_wired, pump_try, spawned_flow
from .plans.drive import drive, drive_seq, final_state, run_static
from .plans.ranges import running_sum
from .plans.slots import SlotDrive
from .sources.tables import events, shared_folder, table
from .streaming.pump import bounded_pump, bounded_pump_try, file_stream, log_sink, ordered_files, pump

M = 1_000_003
KEYS, ORDER = ["user_id"], ["ts", "event_id"]

E = "(SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events)"
W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
CHUNKS = "PARTITION BY conv_id ORDER BY turn"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _stateless(name: str, cell, expression: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return drive(cell, events(spark, sf_dir), "c", "o").select("event_id", "o")

    QUERIES[name], ORACLES[name] = run, f"SELECT event_id, {expression} AS o FROM {E}"


def _seq(name: str, cell, sql: str, how: str = "auto", x=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir).withColumn("x", F.col("c") if x is None else x())
        return drive_seq(cell, e, "x", "o", KEYS, ORDER, how).select("event_id", "o")

    QUERIES[name], ORACLES[name] = run, sql


def recurrence(step: str, first: str | None = None) -> str:
    """DuckDB: s after each row of a user, from ``step`` over s and x, starting at 0."""
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, c AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {E}),
r AS (SELECT event_id, user_id, k, CAST({(first or step).replace('s_', '0')} AS BIGINT) AS s FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.k, CAST({step.replace('s_', 'r.s')} AS BIGINT) FROM e JOIN r ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, s AS o FROM r"""


# --- cells and combinators without state -------------------------------------------------------

_stateless("q01_cell", n.inc, "c + 1")
_stateless("q03_chain_nested", chain(n.inc, n.double, n.double), "(c + 1) * 2 * 2")
_stateless("q04_identity", Chain(Id(LONG), Chain(n.double, Id(LONG))), "c * 2")
_stateless("q06_diamond", diamond(n.inc, n.inc, n.double, n.sum_pair), "(c + 2) + (c + 1) * 2")
top = Chain(diamond(Rep(1, n.inc), chain(n.inc, n.inc), n.double, n.sum_pair), Chain(n.lift_some, Opt(n.double)))


@query(f"SELECT event_id, 6 * c + 10 AS o FROM {E}")
def q07_blueprint(spark, sf_dir):
    out = Blueprint(Static(top).check().topology).activate(events(spark, sf_dir), "c", "o")
    return out.select("event_id", F.col("o.some").alias("o"))


_stateless("q08_rep_n", Rep(3, n.inc).nonempty(), "c + 3")
_stateless("q09_rep_zero", Rep(0, n.inc), "c")
_stateless("q13_wrapping", n.wrapping_scale(1_000_003), "((c * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648")
_stateless("q14_triple_passed", Chain(n.passed, n.triple), "c * 3")
_stateless("q24_feedback", Feedback(Chain(n.inc, n.double), n.inc), "(((c + 1) * 2 + 1) + 1) * 2")
declare_inline_loop_moore(n.identity_feed)
_stateless("q24_feedback_moore", Feedback(n.double, n.identity_feed), "c * 4")


@query(f"SELECT event_id, (c + 1) * 2 AS o FROM {E}")
def q02_wire(spark, sf_dir):
    return Wire(n.inc, n.double).fire(events(spark, sf_dir), "c", "o").select("event_id", "o")


@query(f"SELECT event_id, (c + 1) * 2 AS o FROM {E}")
def q02_wire_function(spark, sf_dir):
    return events(spark, sf_dir).transform(wire(n.inc, n.double, "c", "o")).select("event_id", "o")


@query(f"SELECT event_id, c + 2 AS a, (c + 1) * 2 AS b FROM {E}")
def q05_broadcast(spark, sf_dir):
    out = drive(Broadcast(n.inc, n.inc, n.double), events(spark, sf_dir), "c", "o")
    return out.select("event_id", F.col("o._1").alias("a"), F.col("o._2").alias("b"))


@query(f"SELECT event_id, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS tag, CASE WHEN event_type = 'click' THEN c + 1 END AS a, CASE WHEN event_type <> 'click' THEN c * 2 END AS b FROM {E}")
def q10_choice(spark, sf_dir):
    out = drive(Choice(n.inc, n.double), _tagged(events(spark, sf_dir)), "x", "o")
    return out.select("event_id", "o.tag", "o.a", "o.b")


def _tagged(e: DataFrame) -> DataFrame:
    left = F.col("event_type") == "click"
    return e.withColumn("x", F.struct(F.when(left, "A").otherwise("B").alias("tag"), F.when(left, F.col("c")).alias("a"), F.when(~left, F.col("c")).alias("b")))


def _some():
    return F.when(F.col("event_type") != "error", some(F.col("c")))


@query(f"SELECT event_id, CASE WHEN event_type <> 'error' THEN (c + 1) * 2 END AS o FROM {E}")
def q11_opt(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", _some())
    return drive(Chain(Opt(n.inc), Opt(n.double)), e, "x", "o").select("event_id", F.col("o.some").alias("o"))


@query(f"SELECT user_id, CAST(2 * sum(c) AS BIGINT) AS o FROM {E} GROUP BY user_id")
def q12_recursive_sum(spark, sf_dir):
    """A user's values as lists of at most 1000, so that no list grows with the user."""
    lists = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.collect_list("c").alias("xs"))
    return drive(Chain(n.total, n.double), lists, "xs", "o").groupBy("user_id").agg(F.sum("o").alias("o"))


# --- cells with state --------------------------------------------------------------------------

_seq("q20_drive_seq", n.counter, f"SELECT event_id, CAST(sum(c) OVER {W} AS BIGINT) AS o FROM {E}")
_seq("q20_drive_seq_fold", n.counter, ORACLES["q20_drive_seq"], "fold")
_seq("q20_drive_seq_scan", n.counter, ORACLES["q20_drive_seq"], "scan")


@query(ORACLES["q20_drive_seq"])
def q20_drive_seq_ranges(spark, sf_dir):
    """For keys of any size."""
    return running_sum(events(spark, sf_dir), "c", "o", KEYS, ORDER).select("event_id", "o")


_seq("q21_chain_stateful", Chain(n.counter, n.double), f"SELECT event_id, CAST(2 * sum(c) OVER {W} AS BIGINT) AS o FROM {E}")
_merge_sql = f"SELECT event_id, CAST(sum(c + 1 + 2 * c) OVER {W} AS BIGINT) AS o FROM {E}"
_pair = lambda: F.struct(F.col("c").alias("_1"), F.col("c").alias("_2"))
_seq("q23_merge", Merge(n.inc, n.double, n.counter), _merge_sql, x=_pair)
_seq("q23_merge_fold", Merge(n.inc, n.double, n.counter), _merge_sql, "fold", _pair)
_feedback = Feedback(n.counter_mod(M), n.inc)
_seq("q25_feedback_stateful", _feedback, recurrence(f"(2 * ((s_ + x) % {M}) + 1) % {M}"))
_seq("q25_feedback_stateful_fold", _feedback, ORACLES["q25_feedback_stateful"], "fold")
_rep_sql = f"SELECT event_id, CAST(sum(s) OVER {W} AS BIGINT) AS o FROM (SELECT *, sum(c) OVER {W} AS s FROM {E})"
_seq("q26_rep_stateful", Rep(2, n.counter), _rep_sql)
_seq("q26_rep_stateful_fold", Rep(2, n.counter), _rep_sql, "fold")
_seq("q29_affine", n.scaler(M), recurrence(f"(2 * s_ + x) % {M}"))
_seq("q29_affine_fold", n.scaler(M), ORACLES["q29_affine"], "fold")
_seq("q25_feedback_stateful_ranges", _feedback, ORACLES["q25_feedback_stateful"], "ranges")
_seq("q25_feedback_stateful_lockstep", _feedback, ORACLES["q25_feedback_stateful"], "lockstep")
_seq("q29_affine_lockstep", n.scaler(M), ORACLES["q29_affine"], "lockstep")
_seq("q29_affine_ranges", n.scaler(M), ORACLES["q29_affine"], "ranges")
_seq("q30_sensor", Chain(n.sensor, n.normalize), f"SELECT event_id, CAST(c AS DOUBLE) / 100.0 AS o FROM {E}")


@query(f"SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(sum(CASE WHEN event_type <> 'error' THEN c END) OVER {W} AS BIGINT) END AS o FROM {E}")
def q28_opt_stateful(spark, sf_dir):
    out = drive_seq(Opt(n.counter), events(spark, sf_dir).withColumn("x", _some()), "x", "o", KEYS, ORDER)
    return out.select("event_id", F.col("o.some").alias("o"))


@query(f"SELECT event_id, CAST(sum(s) OVER {W} AS BIGINT) AS a, CAST(2 * s AS BIGINT) AS b FROM (SELECT *, sum(c) OVER {W} AS s FROM {E})")
def q22_broadcast_stateful(spark, sf_dir):
    out = drive_seq(Broadcast(n.counter, n.counter, n.double), events(spark, sf_dir), "c", "o", KEYS, ORDER)
    return out.select("event_id", F.col("o._1").alias("a"), F.col("o._2").alias("b"))


@query(
    f"SELECT event_id, t AS tag, CASE WHEN t = 'A' THEN s END AS a, CASE WHEN t = 'B' THEN s END AS b FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id, t ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS t FROM {E}))"
)
def q27_choice_stateful(spark, sf_dir):
    out = drive_seq(Choice(n.counter, n.counter), _tagged(events(spark, sf_dir)), "x", "o", KEYS, ORDER)
    return out.select("event_id", "o.tag", "o.a", "o.b")


@query(f"SELECT event_id, CAST(c AS DOUBLE) / 100.0 AS a, CAST(CASE WHEN c > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS b FROM {E}")
def q31_threshold_tap(spark, sf_dir):
    out = drive(Broadcast(n.to_double, n.normalize, n.threshold), events(spark, sf_dir), "c", "o")
    return out.select("event_id", F.col("o._1").alias("a"), F.col("o._2").alias("b"))


# --- failures ----------------------------------------------------------------------------------

TEXT = "CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN concat('+', event_id) WHEN 2 THEN concat(' ', event_id) WHEN 3 THEN concat('-', event_id) ELSE CAST(event_id AS STRING) END"
NUMBER = "CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN CAST(s AS BIGINT) END"


def _texts(spark, sf_dir):
    return events(spark, sf_dir).withColumn("s", F.expr(TEXT))


_TEXTS = f"(SELECT event_id, c, {TEXT} AS s FROM {E})"


@query(f"SELECT event_id, 2 * {NUMBER} AS ok, CASE WHEN {NUMBER} IS NULL THEN concat('not a number: ', s) END AS err FROM {_TEXTS}")
def q32_drive_try(spark, sf_dir):
    return drive_try(n.parse, n.double, _texts(spark, sf_dir), "s", "o").select("event_id", "o.ok", "o.err")


@query(f"SELECT event_id, CASE WHEN {NUMBER} >= 0 THEN {NUMBER} + 1 END AS ok, CASE WHEN {NUMBER} IS NULL THEN concat('not a number: ', s) WHEN {NUMBER} < 0 THEN 'negative' END AS err FROM {_TEXTS}")
def q33_try_chain(spark, sf_dir):
    return drive(TryChain(n.parse, n.fallible_inc), _texts(spark, sf_dir), "s", "o").select("event_id", "o.ok", "o.err")


def _shifted(spark, sf_dir):
    return events(spark, sf_dir).withColumn("x", F.col("c") - 2000)


@query(f"SELECT event_id, (c - 2000 + 1) * 2 AS o FROM {E} WHERE c >= 2000")
def q34_pump_try(spark, sf_dir):
    return pump_try(n.fallible_inc, n.double, _shifted(spark, sf_dir), "x", "o")[0].select("event_id", "o")


@query(f"SELECT count(*) FILTER (c < 2000) AS errors FROM {E}")
def q35_pump_errors(spark, sf_dir):
    return pump_try(n.fallible_inc, n.double, _shifted(spark, sf_dir), "x", "o")[1]


@query(f"SELECT event_id, (c + 1) * 2 AS o FROM {E}")
def q38_run_static(spark, sf_dir):
    return run_static(Static(Chain(n.inc, n.double)), events(spark, sf_dir), "c", "o").select("event_id", "o")


@query(f"SELECT event_id, CAST(2 * sum(c) OVER {W} AS BIGINT) AS o FROM {E}")
def q38_run_static_stateful(spark, sf_dir):
    return run_static(Static(Chain(n.counter, n.double)), events(spark, sf_dir), "c", "o", KEYS, ORDER).select("event_id", "o")


# --- carriers ----------------------------------------------------------------------------------


def _carried(name: str, carrier) -> None:
    @query(f"SELECT event_id, CAST(sum(c + 1) OVER {W} AS BIGINT) AS o FROM {E}")
    def run(spark, sf_dir):
        return drive_link(n.inc, n.counter, carrier, events(spark, sf_dir), "c", "o", Drive(tuple(KEYS), tuple(ORDER))).select("event_id", "o")

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_carried("q40_inline", InlineCarrier())
_carried("q41_direct", DirectCarrier())
_carried("q42_queue", QueueCarrier())
_carried("q43_channel", ChannelCarrier(("user_id",)))
_carried("q44_bounded", BoundedCarrier(64))


@query(f"SELECT event_id, CAST(c AS DOUBLE) * 0.5 AS o FROM {E}")
def q15_half(spark, sf_dir):
    return drive(Chain(n.to_double, n.half), events(spark, sf_dir), "c", "o").select("event_id", "o")


@query(f"SELECT event_id, c * 2 AS ok, CAST(NULL AS VARCHAR) AS err FROM {E}")
def q37_checked_double(spark, sf_dir):
    return drive(n.checked_double, events(spark, sf_dir), "c", "o").select("event_id", "o.ok", "o.err")


@query(f"SELECT event_id, (c + 1) * 2 AS o FROM {E}")
def q48_seam(spark, sf_dir):
    """An edge is driven once its cost and capacity fit the budget and its ports the slots."""
    carrier, slot = BoundedCarrier(64), Slot(LONG, LONG)
    validate_seam(carrier.cost, CarrierCost.EXTERNAL, carrier.capacity)
    assert_conforms(slot, n.inc), assert_conforms(slot, n.double), assert_wiring(n.inc, n.double)
    return drive_link(n.inc, n.double, carrier, events(spark, sf_dir), "c", "o").select("event_id", "o")


@query(f"SELECT event_id, c + 1 AS o FROM {E}")
def q46_spawned_flow(spark, sf_dir):
    """A counter that begins anew with each message."""
    return spawned_flow(n.inc, n.counter, events(spark, sf_dir), "c", "o", KEYS).select("event_id", "o")


@query(f"SELECT event_id, (c + 1) * 2 AS o FROM {E}")
def q47_drive_wired(spark, sf_dir):
    return drive_wired(Wire(n.inc, n.double), InlineCarrier(), events(spark, sf_dir), "c", "o").select("event_id", "o")


@query(f"SELECT event_id, CAST(sum(c + 1) OVER {W} AS BIGINT) AS o FROM {E}")
def q45_bounded_pump(spark, sf_dir):
    """Files in the order of the rows; one a micro-batch."""
    folder, e = shared_folder(spark), events(spark, sf_dir)
    ordered_files(e, ORDER, folder)
    out = bounded_pump(spark, folder, e.schema, Chain(n.inc, n.counter), "c", "o", KEYS, ORDER)
    return out.select("event_id", "o")


@query(f"SELECT event_id, (c - 2000 + 1) * 2 AS o FROM {E} WHERE c >= 2000")
def q36_bounded_pump_try(spark, sf_dir):
    folder, e = shared_folder(spark), _shifted(spark, sf_dir)
    ordered_files(e, ORDER, folder)
    return bounded_pump_try(spark, folder, e.schema, n.fallible_inc, n.double, "x", "o", KEYS, ORDER)[0].select("event_id", "o")


def _streamed(spark, rows: DataFrame, cell, x: str, out: str, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """rows as a stream of three files or more, one a micro-batch, with the cell's output."""
    folder = shared_folder(spark)
    ordered_files(rows, order, folder, least=3)
    return bounded_pump(spark, folder, rows.schema, cell, x, out, keys, order)


_SWAPPED = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, c AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {E}),
r AS (SELECT event_id, user_id, k, CAST(x AS BIGINT) AS s FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.k, CAST(CASE WHEN e.k <= 20 THEN r.s + x WHEN e.k = 21 THEN x % {M} ELSE (2 * r.s + x) % {M} END AS BIGINT) FROM e JOIN r ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, s AS o FROM r"""


def _epochs(spark, sf_dir) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*ORDER))
    return events(spark, sf_dir).withColumn("epoch", F.when(k <= 20, 0).otherwise(1))


def _slot() -> SlotDrive:
    return SlotDrive(Slot(LONG, LONG), n.counter).swap(n.scaler(M))


@query(_SWAPPED)
def q50_slot_swap(spark, sf_dir):
    """A user's first 20 rows meet a counter, the others a scaler that starts anew."""
    return _slot().drive(_epochs(spark, sf_dir), "c", "o", "epoch", KEYS, ORDER).select("event_id", "o")


@query(_SWAPPED)
def q50_slot_swap_fold(spark, sf_dir):
    return _slot().drive(_epochs(spark, sf_dir), "c", "o", "epoch", KEYS, ORDER, "fold").select("event_id", "o")


@query(_SWAPPED)
def q51_slot_swap_stream(spark, sf_dir):
    """The same in a running stream: the row itself says that the occupant changes."""
    e = _epochs(spark, sf_dir).select("event_id", "ts", "user_id", F.struct(F.col("epoch").cast("bigint").alias("epoch"), F.col("c").alias("x")).alias("x"))
    return _streamed(spark, e, _slot().cell, "x", "o", KEYS).select("event_id", "o")


# --- key/value service -------------------------------------------------------------------------

LINE = """CASE event_type WHEN 'signup' THEN concat('SET k', user_id, ' ', c) WHEN 'view' THEN concat('GET k', user_id, ' extra') WHEN 'error' THEN concat(' DEL  k', user_id)
  WHEN 'click' THEN concat('INCR k', user_id) ELSE CASE event_id % 6 WHEN 0 THEN 'GET' WHEN 1 THEN concat('SET k', user_id, ' x', c) WHEN 2 THEN 'SET k' WHEN 3 THEN '  ' WHEN 4 THEN concat('get k', user_id) ELSE concat('INCR k', user_id) END END"""
_LINES = f"e AS (SELECT event_id, ts, user_id, 0 AS no, {LINE} AS line FROM {E})"
_PARSED = """,
p AS (SELECT *, regexp_split_to_array(trim(line), ' +') AS w FROM e),
cmds AS (
  SELECT *, CASE WHEN w[1] = '' THEN 'PROTOCOL' WHEN w[1] IN ('GET', 'DEL', 'INCR') THEN CASE WHEN len(w) < 2 THEN 'PROTOCOL' ELSE w[1] END
                 WHEN w[1] = 'SET' THEN CASE WHEN len(w) < 3 OR NOT regexp_full_match(w[3], '[+-]?[0-9]+') THEN 'PROTOCOL' ELSE 'SET' END ELSE 'UNKNOWN' END AS tag,
         CASE WHEN w[1] = '' THEN 'empty command' WHEN w[1] IN ('GET', 'DEL', 'INCR') AND len(w) < 2 THEN concat(w[1], ' requires a key')
              WHEN w[1] = 'SET' AND len(w) < 3 THEN 'SET requires key and value' WHEN w[1] = 'SET' AND NOT regexp_full_match(w[3], '[+-]?[0-9]+') THEN concat('SET value must be an integer, got \'\'', w[3], '\'\'')
              WHEN w[1] NOT IN ('GET', 'DEL', 'INCR', 'SET') THEN w[1] END AS msg
  FROM p),
cmd AS (SELECT event_id, ts, user_id, no, tag, CASE WHEN tag IN ('GET', 'SET', 'DEL', 'INCR') THEN w[2] END AS k, CASE WHEN tag = 'SET' THEN CAST(w[3] AS BIGINT) END AS v, msg FROM cmds)"""
_KV = _LINES + _PARSED


def _reply_sql(lines: str, store: str = "") -> str:
    """The replies to the commands of lines (event_id, ts, user_id, no, line), by stores without a limit on keys."""
    by = f"PARTITION BY {store} k"
    return (
        lines
        + _PARSED
        + f""",
a AS (SELECT *, CASE WHEN (tag = 'SET' AND v <= 15000) OR tag = 'DEL' THEN 1 ELSE 0 END AS asg FROM cmd),
g AS (SELECT *, sum(asg) OVER ({by} ORDER BY ts, event_id, no ROWS UNBOUNDED PRECEDING) AS g FROM a),
h AS (SELECT *, max(CASE WHEN asg = 1 AND tag = 'SET' THEN v END) OVER ({by}, g) AS base,
             sum(CASE WHEN tag = 'INCR' THEN 1 ELSE 0 END) OVER ({by}, g ORDER BY ts, event_id, no ROWS UNBOUNDED PRECEDING) AS inc FROM g),
x AS (SELECT *, CAST(CASE WHEN base IS NOT NULL THEN base + inc WHEN inc > 0 THEN inc END AS BIGINT) AS held FROM h),
y AS (SELECT *, lag(held) OVER ({by} ORDER BY ts, event_id, no) AS had FROM x),
reply AS (
  SELECT event_id, no, CASE tag WHEN 'GET' THEN CASE WHEN held IS NULL THEN 'NIL' ELSE 'INT' END WHEN 'SET' THEN CASE WHEN v > 15000 THEN 'ERR' ELSE 'OK' END
                        WHEN 'UNKNOWN' THEN 'BYTES' WHEN 'PROTOCOL' THEN 'ERR' ELSE 'INT' END AS tag,
         CASE WHEN tag IN ('GET', 'INCR') THEN held WHEN tag = 'DEL' THEN CASE WHEN had IS NULL THEN 0 ELSE 1 END END AS i,
         CASE WHEN tag = 'SET' AND v > 15000 THEN concat('value too large: ', v) WHEN tag = 'UNKNOWN' THEN concat('ERR unknown: ', msg) WHEN tag = 'PROTOCOL' THEN msg END AS text,
         CASE WHEN tag = 'SET' AND v <= 15000 THEN concat('SET ', k, ' ', v) WHEN tag = 'DEL' THEN concat('DEL ', k) END AS log
  FROM y)"""
    )


_REPLY = _reply_sql(_LINES)
_SAID = "CASE tag WHEN 'INT' THEN concat(':', i) WHEN 'OK' THEN '+OK' WHEN 'NIL' THEN '$-1' WHEN 'BYTES' THEN text ELSE concat('-ERR ', text) END || chr(13) || chr(10)"


def _commands(spark, sf_dir) -> DataFrame:
    return drive(kv.cmd_parse, events(spark, sf_dir).withColumn("line", F.expr(LINE)), "line", "cmd")


def _replies(spark, sf_dir) -> DataFrame:
    return kv.replies(_commands(spark, sf_dir), "cmd", ORDER, max_value=15_000)


@query(f"WITH {_KV} SELECT event_id, tag, k AS key, v AS value, msg FROM cmd")
def q63_kv_parse(spark, sf_dir):
    return _commands(spark, sf_dir).select("event_id", "cmd.tag", "cmd.key", "cmd.value", "cmd.msg")


@query(f"WITH {_REPLY} SELECT event_id, tag, CAST(i AS BIGINT) AS i, text FROM reply")
def q60_kv_replies(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", "reply.tag", "reply.i", "reply.text")


@query(f"WITH {_REPLY} SELECT event_id, log FROM reply WHERE log IS NOT NULL")
def q61_kv_log(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", "reply.log").where("log IS NOT NULL")


@query(f"WITH {_REPLY} SELECT event_id, {_SAID} AS resp FROM reply")
def q62_kv_resp(spark, sf_dir):
    return drive(kv.resp_encode, _replies(spark, sf_dir), "reply", "resp").select("event_id", "resp")


@query(f"WITH {_REPLY} SELECT event_id, tag, text FROM reply WHERE text IS DISTINCT FROM 'empty command'")
def q66_kv_session(spark, sf_dir):
    """A session skips blank lines."""
    lines = kv.spoken(events(spark, sf_dir).withColumn("line", F.expr(LINE)), "line")
    return kv.replies(drive(kv.cmd_parse, lines, "line", "cmd"), "cmd", ORDER, max_value=15_000).select("event_id", "reply.tag", "reply.text")


#: A store a nation of users, with at most four keys: its map, row by row.
_LIMITS = f"""
WITH RECURSIVE {_KV},
c AS (SELECT event_id, user_id % 25 AS store, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS n, tag, k, v, msg FROM cmd),
r AS (
  SELECT DISTINCT store, CAST(0 AS BIGINT) AS n, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS was, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS m,
         CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS BIGINT) AS v, CAST(NULL AS VARCHAR) AS msg FROM c
  UNION ALL
  SELECT c.store, c.n, r.m,
         CASE WHEN c.tag = 'DEL' THEN map_from_entries(list_filter(map_entries(r.m), lambda e: e.key <> c.k))
              WHEN c.tag = 'INCR' OR c.tag = 'SET' AND c.v <= 15000 AND (r.m[c.k] IS NOT NULL OR cardinality(r.m) < 4)
              THEN map_from_entries(list_filter(map_entries(r.m), lambda e: e.key <> c.k) || [{{'key': c.k, 'value': CASE WHEN c.tag = 'SET' THEN c.v ELSE coalesce(r.m[c.k], 0) + 1 END}}])
              ELSE r.m END,
         c.event_id, c.tag, c.k, c.v, c.msg
  FROM r JOIN c ON c.store = r.store AND c.n = r.n + 1),
t AS (SELECT *, was[k] AS old, tag = 'SET' AND v <= 15000 AND (was[k] IS NOT NULL OR cardinality(was) < 4) AS ok FROM r WHERE n > 0)
SELECT event_id, CASE tag WHEN 'GET' THEN CASE WHEN old IS NULL THEN 'NIL' ELSE 'INT' END WHEN 'SET' THEN CASE WHEN ok THEN 'OK' ELSE 'ERR' END
                      WHEN 'UNKNOWN' THEN 'BYTES' WHEN 'PROTOCOL' THEN 'ERR' ELSE 'INT' END AS tag,
       CAST(CASE tag WHEN 'GET' THEN old WHEN 'INCR' THEN coalesce(old, 0) + 1 WHEN 'DEL' THEN CASE WHEN old IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS i,
       CASE WHEN tag = 'SET' AND v > 15000 THEN concat('value too large: ', v) WHEN tag = 'SET' AND NOT ok THEN 'max keys reached'
            WHEN tag = 'UNKNOWN' THEN concat('ERR unknown: ', msg) WHEN tag = 'PROTOCOL' THEN msg END AS text,
       CASE WHEN ok THEN concat('SET ', k, ' ', v) WHEN tag = 'DEL' THEN concat('DEL ', k) END AS log
FROM t"""


def _stores(spark, sf_dir) -> DataFrame:
    return _commands(spark, sf_dir).withColumn("store", F.col("user_id") % 25)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("event_id", "reply.tag", "reply.i", "reply.text", "reply.log")


@query(_LIMITS)
def q64_kv_limits(spark, sf_dir):
    """With a limit on keys, which ties a store's keys together: one store a nation of users, scanned."""
    return _shown(drive_seq(kv.bounded_store(max_keys=4, max_value=15_000), _stores(spark, sf_dir), "cmd", "reply", ["store"], ORDER))


@query(_LIMITS)
def q64_kv_limits_windows(spark, sf_dir):
    """The same by windows, up to each store's first refused key."""
    return _shown(kv.bounded_replies(_stores(spark, sf_dir), "cmd", ["store"], ORDER, max_keys=4, max_value=15_000))


@query(_LIMITS)
def q64_kv_limits_stream(spark, sf_dir):
    """The same in a stream: of a store's map a batch reads and writes the keys that its commands name."""
    rows = _stores(spark, sf_dir).select("event_id", "ts", "store", "cmd")
    return _shown(_streamed(spark, rows, kv.bounded_store(max_keys=4, max_value=15_000), "cmd", "reply", ["store"]))


# a connection a user: chunks of which every third ends no line
_CHUNK = f"{LINE} || CASE WHEN event_id % 3 = 1 THEN '' ELSE chr(10) END"
_SERVED = (
    "WITH "
    + _reply_sql(
        f"""t AS (SELECT *, {_CHUNK} AS chunk, CASE WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS n FROM {E}),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
f AS (SELECT user_id, string_split(string_agg(chunk, '' ORDER BY ts, event_id), chr(10)) AS lines FROM t GROUP BY user_id),
e AS (SELECT event_id, ts, user_id, before AS no, lines[CAST(before AS BIGINT) + 1] AS line FROM b JOIN f USING (user_id) WHERE n = 1 AND trim(lines[CAST(before AS BIGINT) + 1]) <> '')""",
        "user_id,",
    )
    + f" SELECT event_id, CASE WHEN tag IS NULL THEN '' ELSE {_SAID} END AS resp FROM t LEFT JOIN reply USING (event_id)"
)


def _chunks(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ts", "user_id", F.expr(_CHUNK).alias("chunk"))


def _answers(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.array_join("o", "").alias("resp"))


_service = kv.service(max_keys=1 << 40, max_value=15_000)


@query(_SERVED)
def q67_kv_service(spark, sf_dir):
    """The whole service as one cell: lines, commands, store and answers."""
    return _answers(drive_seq(_service, _chunks(spark, sf_dir), "chunk", "o", KEYS, ORDER))


@query(_SERVED)
def q67_kv_service_stream(spark, sf_dir):
    return _answers(_streamed(spark, _chunks(spark, sf_dir), _service, "chunk", "o", KEYS))


@query(f"WITH {_REPLY} SELECT event_id, log FROM reply WHERE log IS NOT NULL")
def q68_kv_log_sink(spark, sf_dir):
    """The log of a stream of commands, each batch written once however often it runs; a store a user."""
    rows = _commands(spark, sf_dir).select("event_id", "ts", "user_id", "cmd")
    folder, target = shared_folder(spark), shared_folder(spark)
    ordered_files(rows, ORDER, folder, least=3)
    stream = pump(file_stream(spark, folder, rows.schema), kv.bounded_store(max_keys=1 << 40, max_value=15_000), "cmd", "reply", KEYS, ORDER)
    log = stream.select("event_id", "reply.log").where("log IS NOT NULL")
    log_sink(log, f"{target}/log", f"{target}/checkpoint").awaitTermination()
    return spark.read.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{target}/log")


@query(
    f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 3 = 1 THEN '' ELSE chr(10) END AS chunk FROM conversations),
m AS (SELECT *, len(string_split(chunk, chr(10))) - 1 AS n FROM t),
b AS (SELECT *, coalesce(sum(n) OVER ({CHUNKS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
f AS (SELECT conv_id, string_split(string_agg(chunk, '' ORDER BY turn), chr(10)) AS lines FROM t GROUP BY conv_id),
l AS (SELECT conv_id, unnest(range(0, len(lines) - 1)) AS line_no, unnest(lines[1:len(lines) - 1]) AS line FROM f)
SELECT l.conv_id, b.turn, CAST(l.line_no AS BIGINT) AS line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line
FROM l JOIN b ON l.conv_id = b.conv_id AND l.line_no >= b.before AND l.line_no < b.before + b.n"""
)
def q65_line_split(spark, sf_dir):
    chunk = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 1, "").otherwise("\n"))
    return kv.split_lines(table(spark, sf_dir, "conversations").withColumn("chunk", chunk), "chunk", ["conv_id"], "turn")


@query(ORACLES["q65_line_split"].replace("CAST(l.line_no AS BIGINT) AS line_no, ", ""))
def q65_line_split_ranges(spark, sf_dir):
    """By the cell, so that one long connection is split over many tasks."""
    chunk = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 1, "").otherwise("\n"))
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", chunk.alias("chunk"))
    return drive_seq(kv.line_split, chunks, "chunk", "lines", ["conv_id"], ["turn"], "ranges").select("conv_id", "turn", F.explode("lines").alias("line"))


# --- shared world ------------------------------------------------------------------------------

MOVE = """CASE event_type WHEN 'signup' THEN concat('LOGIN p', user_id) WHEN 'view' THEN concat('SAY p', user_id, ' hi  there ', c) WHEN 'error' THEN concat('LOGOUT p', user_id)
  WHEN 'click' THEN concat('MOVE p', user_id, ' ', c % 100, ' ', event_id % 50) ELSE CASE event_id % 3 WHEN 0 THEN concat('MOVE p', user_id, ' x ', event_id % 9) WHEN 1 THEN 'DANCE' ELSE concat('MOVE p', user_id, ' -', c % 10) END END"""
_WORLD = f"""
e AS (SELECT *, user_id // 10 AS world, concat('p', user_id) AS name, {MOVE} AS line FROM {E}),
v AS (SELECT *, CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'view' THEN 'SAY' WHEN 'error' THEN 'LOGOUT' WHEN 'click' THEN 'MOVE' ELSE CASE event_id % 3 WHEN 1 THEN 'IGNORED' ELSE 'MOVE' END END AS tag,
             CASE WHEN event_type = 'click' THEN c % 100 WHEN event_id % 3 = 0 THEN 0 ELSE -(c % 10) END AS mx,
             CASE WHEN event_type = 'click' THEN event_id % 50 WHEN event_id % 3 = 0 THEN event_id % 9 ELSE 0 END AS my FROM e),
s AS (SELECT *, sum(CASE WHEN tag = 'LOGOUT' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, tag = 'IGNORED' ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM v),
f AS (SELECT *, last_value(CASE WHEN tag = 'MOVE' THEN [mx, my] END IGNORE NULLS) OVER q AS moved, max(CASE WHEN tag = 'LOGIN' THEN 1 ELSE 0 END) OVER q AS entered
      FROM s WINDOW q AS (PARTITION BY user_id, tag = 'IGNORED', g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
pos AS (SELECT *, CASE WHEN tag = 'IGNORED' THEN NULL WHEN moved IS NOT NULL THEN moved WHEN entered = 1 THEN [0, 0] END AS place FROM f)"""
_VIEW = (
    _WORLD
    + """,
said AS (SELECT event_id, ts, world, CASE tag WHEN 'LOGIN' THEN name || ' joined' WHEN 'MOVE' THEN name || ' -> (' || mx || ',' || my || ')' WHEN 'SAY' THEN name || ': hi  there ' || c WHEN 'LOGOUT' THEN name || ' left' END AS said FROM pos),
span AS (SELECT world, name, place, ts, event_id, lead(ts) OVER p AS nts, lead(event_id) OVER p AS nid FROM pos WHERE tag <> 'IGNORED' WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
seen AS (SELECT x.event_id, any_value(said) AS said, coalesce(string_agg(s.name || '@(' || s.place[1] || ',' || s.place[2] || ')', ', ' ORDER BY s.name), '') AS online
         FROM said x LEFT JOIN span s ON s.world = x.world AND s.place IS NOT NULL AND (s.ts, s.event_id) <= (x.ts, x.event_id) AND (s.nts IS NULL OR (s.nts, s.nid) > (x.ts, x.event_id)) GROUP BY x.event_id),
views AS (SELECT event_id, CASE WHEN said IS NULL THEN [] ELSE ['event: ' || said] END || ['online: [' || online || ']'] AS lines FROM seen)"""
)


def _world(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"world": F.expr("user_id div 10"), "line": F.expr(MOVE)})
    return drive(world.line_event, e, "line", "event")


def _views(spark, sf_dir, how: str = "auto") -> DataFrame:
    return drive_seq(world.world_view, _world(spark, sf_dir).select("event_id", "ts", "world", "event"), "event", "lines", ["world"], ORDER, how)


@query(f"WITH {_WORLD} SELECT event_id, tag, CASE WHEN tag <> 'IGNORED' THEN name END AS name, CAST(place[1] AS BIGINT) AS x, CAST(place[2] AS BIGINT) AS y FROM pos")
def q70_world_state(spark, sf_dir):
    return world.positions(_world(spark, sf_dir), "event", ["world"], ORDER).select("event_id", "event.tag", "event.name", "x", "y")


@query(f"WITH {_VIEW} SELECT event_id, array_to_string(lines, chr(10)) AS view FROM views")
def q71_world_view(spark, sf_dir):
    return _views(spark, sf_dir).select("event_id", F.array_join("lines", "\n").alias("view"))


@query(f"WITH {_VIEW} SELECT event_id, array_to_string(list_transform(lines, lambda x: 'A: ' || x), chr(10)) AS a, array_to_string(list_transform(lines, lambda x: 'B: ' || x), chr(10)) AS b FROM views")
def q72_view_fanout(spark, sf_dir):
    out = drive(world.view_fan_out, _views(spark, sf_dir), "lines", "o")
    return out.select("event_id", F.col("o._1").alias("a"), F.col("o._2").alias("b"))


@query(ORACLES["q71_world_view"])
def q71_world_view_ranges(spark, sf_dir):
    """One world's view over many tasks."""
    return _views(spark, sf_dir, "ranges").select("event_id", F.array_join("lines", "\n").alias("view"))


def _player_lines(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ts", F.expr("user_id div 10").alias("world"), F.expr(MOVE).alias("line"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("o._1").alias("a"), F.col("o._2").alias("b"))


@query(ORACLES["q72_view_fanout"])
def q73_world_program(spark, sf_dir):
    """Lines, events, world, view and two players as one cell."""
    return _told(drive_seq(world.program, _player_lines(spark, sf_dir), "line", "o", ["world"], ORDER))


@query(ORACLES["q72_view_fanout"])
def q73_world_program_stream(spark, sf_dir):
    return _told(_streamed(spark, _player_lines(spark, sf_dir), world.program, "line", "o", ["world"]))


@query(
    f"""WITH {_WORLD}, l AS (SELECT world, name, arg_max(tag, (ts, event_id)) AS tag FROM pos WHERE tag IN ('LOGIN', 'LOGOUT') GROUP BY world, name)
SELECT w.world, coalesce(string_agg(name, ',' ORDER BY name), '') AS online FROM (SELECT DISTINCT world FROM e) w LEFT JOIN l ON w.world = l.world AND tag = 'LOGIN' GROUP BY w.world"""
)
def q74_online(spark, sf_dir):
    """Who is online in each world at the end: the state of the handler."""
    state = final_state(world.player_handler, _player_lines(spark, sf_dir), "line", ["world"], ORDER)
    return state.select("world", F.array_join(F.array_sort("state"), ",").alias("online"))


# --- packets -----------------------------------------------------------------------------------

RAW = """CASE event_id % 17 WHEN 0 THEN 'malformed-garbage' WHEN 1 THEN 'aa:bb:300:1' WHEN 2 THEN concat('aa:bb:06:', user_id, ':70000.', c % 9, '.1') WHEN 3 THEN concat('aa:bb:+6:-5:', c % 50, '.é')
  ELSE concat('aa:bb:06:', user_id, ':', 8000 + user_id % 7, '.', c % 5) END"""


def _unsigned_sql(x: str, most: int) -> str:
    return f"CASE WHEN regexp_full_match({x}, '\\+?[0-9]+') AND CAST({x} AS HUGEINT) <= {most} THEN CAST({x} AS BIGINT) ELSE 0 END"


_rest = lambda x, sep: f"CASE WHEN instr({x}, '{sep}') > 0 THEN substr({x}, instr({x}, '{sep}') + 1) ELSE '' END"
_PACKETS = f"""
r AS (SELECT event_id, {RAW} AS raw FROM {E}),
e1 AS (SELECT *, {_rest('raw', ':')} AS r1 FROM r), e2 AS (SELECT *, {_rest('r1', ':')} AS r2 FROM e1), e3 AS (SELECT *, {_rest('r2', ':')} AS payload, string_split(r2, ':')[1] AS p FROM e2),
i AS (SELECT event_id, {_unsigned_sql('p', 255)} AS proto, {_unsigned_sql("string_split(payload, ':')[1]", 4294967295)} AS src, {_rest('payload', ':')} AS body FROM e3),
t AS (SELECT *, {_unsigned_sql("string_split(body, '.')[1]", 65535)} AS sport, {_unsigned_sql(_rest('body', '.'), 65535)} AS dport, CAST(strlen(body) AS BIGINT) AS bytes FROM i)"""


def _packets(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.expr(RAW).alias("raw"))


@query(f"WITH {_PACKETS} SELECT event_id, proto, src, sport, dport FROM t")
def q80_packet_parse(spark, sf_dir):
    df = drive(netpath.eth_parse, _packets(spark, sf_dir), "raw", "eth")
    df = drive(netpath.ip_parse, df, "eth", "ip")
    return drive(netpath.tcp_parse, df, "ip", "tcp").select("event_id", "ip.proto", "ip.src", "tcp.sport", "tcp.dport")


@query(f"WITH {_PACKETS} SELECT event_id, sport, dport, bytes FROM t")
def q81_deliver(spark, sf_dir):
    return drive(netpath.path, _packets(spark, sf_dir), "raw", "o").select("event_id", "o.sport", "o.dport", "o.bytes")


@query(f"WITH {_PACKETS} SELECT sport, dport, CAST(sum(bytes) AS BIGINT) AS bytes FROM t GROUP BY sport, dport")
def q82_deliver_table(spark, sf_dir):
    return netpath.delivered_table(drive(netpath.path, _packets(spark, sf_dir), "raw", "o"), "o")


@query(f"WITH {_PACKETS} SELECT event_id % 8 AS host, sport, dport, CAST(sum(bytes) AS BIGINT) AS bytes FROM t GROUP BY 1, sport, dport")
def q83_deliver_state(spark, sf_dir):
    """The table as the state of the cell that delivers, a host of eight."""
    packets = _packets(spark, sf_dir).withColumn("host", F.col("event_id") % 8)
    table = final_state(netpath.delivery, packets, "raw", ["host"], ["event_id"])
    return table.select("host", F.explode("state.b").alias("pair", "bytes")).select("host", "pair.sport", "pair.dport", "bytes")


@query(f"SELECT user_id, CAST(sum(c) AS BIGINT) AS state FROM {E} GROUP BY user_id")
def q90_final_state(spark, sf_dir):
    """What drive_seq leaves in a counter: a sum, combined before the shuffle."""
    return final_state(n.counter, events(spark, sf_dir), "c", KEYS, ORDER)


@query(f"SELECT user_id, arg_max(o, (ts, event_id)) AS state FROM ({ORACLES['q29_affine']}) JOIN {E} USING (event_id) GROUP BY user_id")
def q91_final_state_scan(spark, sf_dir):
    """What drive_seq leaves in a scaler, which no aggregate computes."""
    return final_state(n.scaler(M), events(spark, sf_dir), "c", KEYS, ORDER)
