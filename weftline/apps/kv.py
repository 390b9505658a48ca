"""A key/value service as a log of commands.

A store keyed by its keys is a set of windows: a SET that is accepted and a DEL open a new group of a
key's rows, and within a group a value is that SET's value plus the INCRs so far.  A limit on the
number of keys ties all keys of a store together, but only from its first refused key on: up to there
the windows hold, and from there it is scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ports import BOOL, LONG, STRING, let, plain_int, strict_int, struct_type
from ..operators.cell import Cell, Stateful, Stateless, Summary
from ..operators.compose import Each, chain
from ..plans.ranges import running_sum
from ..plans.steps import scan_from
from ..sources.tables import shared_folder

CMD = struct_type(tag=STRING, key=STRING, value=LONG, msg=STRING)
REPLY = struct_type(tag=STRING, i=LONG, text=STRING, log=STRING)
STORE, LINES = T.MapType(STRING, LONG), T.ArrayType(STRING)
BLANKS = r"[\s]+"


def _parse(line: Column) -> Column:
    """The words are bound once, so that taking the command apart does not split the line again."""
    return let(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), BLANKS), _command)


def _command(words: Column) -> Column:
    word = lambda i: F.nullif(F.get(words, F.lit(i)), F.lit(""))
    verb, key, value = word(0), word(1), word(2)
    number = strict_int(value)
    cmd = lambda tag, k=None, v=None, msg=None: F.struct(
        F.lit(tag).alias("tag"), (F.lit(k).cast("string") if k is None else k).alias("key"), (F.lit(v).cast("bigint") if v is None else v).alias("value"), (F.lit(msg).cast("string") if msg is None or isinstance(msg, str) else msg).alias("msg")
    )
    wrong = lambda m: cmd("PROTOCOL", msg=m)
    one = lambda v: F.when(key.isNull(), wrong(f"{v} requires a key")).otherwise(cmd(v, key))
    put = (
        F.when(key.isNull() | value.isNull(), wrong("SET requires key and value"))
        .when(number.isNull(), wrong(F.concat(F.lit("SET value must be an integer, got '"), value, F.lit("'"))))
        .otherwise(cmd("SET", key, number))
    )
    return (
        F.when(verb.isNull(), wrong("empty command"))
        .when(verb == "GET", one("GET"))
        .when(verb == "SET", put)
        .when(verb == "DEL", one("DEL"))
        .when(verb == "INCR", one("INCR"))
        .otherwise(cmd("UNKNOWN", msg=verb))
    )


WHITE = re.compile(r"[ \t\n\v\f\r]+")
EDGE = " \t\n\v\f\r"


def _plain_parse(line: str) -> tuple:
    verb, key, value = [*(w or None for w in WHITE.split(line.strip(EDGE))), None, None][:3]
    wrong = lambda msg: ("PROTOCOL", None, None, msg)
    if verb is None:
        return wrong("empty command")
    if verb == "SET":
        if key is None or value is None:
            return wrong("SET requires key and value")
        number = plain_int(value)
        return wrong(f"SET value must be an integer, got '{value}'") if number is None else (verb, key, number, None)
    if verb in ("GET", "DEL", "INCR"):
        return wrong(f"{verb} requires a key") if key is None else (verb, key, None, None)
    return "UNKNOWN", None, None, verb


cmd_parse = Stateless(STRING, CMD, _parse, _plain_parse)


def _cut(buffer: str, chunk: str) -> tuple:
    *lines, rest = (buffer + chunk).split("\n")
    return rest, [line.strip(EDGE) for line in lines]


def _tail(chunks: Iterable[str]) -> tuple:
    all_, cut, rest = "".join(chunks).rpartition("\n")
    return bool(cut), rest


#: Chunks of a stream to the lines that each of them ends, trimmed; what follows the last line feed waits.
line_split = Stateful(
    STRING,
    LINES,
    STRING,
    "",
    None,
    _cut,
    given=Summary(struct_type(cut=BOOL, rest=STRING), _tail, lambda a, b: b if b[0] else (a[0], a[1] + b[1]), lambda s, a: a[1] if a[0] else s + a[1]),
)
#: Without blank lines, which a session skips.
spoken_lines = Stateless(LINES, LINES, lambda xs: F.filter(xs, lambda x: x != ""), lambda xs: [x for x in xs if x])


def spoken(df: DataFrame, line: str) -> DataFrame:
    """Without blank lines, which a session skips."""
    return df.where(F.col(line).rlike(r"\S"))


def _encode(r: Column) -> Column:
    return (
        F.when(r["tag"] == "INT", F.concat(F.lit(":"), r["i"].cast("string"), F.lit("\r\n")))
        .when(r["tag"] == "OK", F.lit("+OK\r\n"))
        .when(r["tag"] == "NIL", F.lit("$-1\r\n"))
        .when(r["tag"] == "BYTES", F.concat(r["text"], F.lit("\r\n")))
        .otherwise(F.concat(F.lit("-ERR "), r["text"], F.lit("\r\n")))
    )


def _plain_encode(r: tuple) -> str:
    tag, i, text, _ = r
    said = {"INT": f":{i}", "OK": "+OK", "NIL": "$-1", "BYTES": text}
    return f"{said[tag] if tag in said else f'-ERR {text}'}\r\n"


resp_encode = Stateless(REPLY, STRING, _encode, _plain_encode)


def replies(df: DataFrame, cmd: str, order: list[str], max_value: int = 1_000_000, stores: list[str] = []) -> DataFrame:
    """df with ``reply`` (tag, i, text, log), for stores whose number of keys has no limit.  All windows share
    one sort.  Rows without a key need no state; each is a partition of its own."""
    return _windows(df, cmd, order, max_value, stores).select(*df.columns, "reply")


def _windows(df: DataFrame, cmd: str, order: list[str], max_value: int, stores: list[str]) -> DataFrame:
    """df with the reply, the key (__k), and its value before and after the row (__was, __held)."""
    c = F.col(cmd)
    rows = df.withColumns({"__tag": c["tag"], "__k": c["key"], "__v": c["value"]})
    accepted = (F.col("__tag") == "SET") & (F.col("__v") <= max_value)
    alone = F.when(F.col("__k").isNull(), F.xxhash64(*order))
    key = Window.partitionBy(*stores, "__k", "__alone").orderBy(*order)
    sofar = key.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__alone", alone).withColumn("__all", F.sum(F.when(F.col("__tag") == "INCR", 1).otherwise(0)).over(sofar))
    # what the last accepted SET or DEL left, and the INCRs up to it
    opens = F.when(accepted | (F.col("__tag") == "DEL"), F.struct(F.when(accepted, F.col("__v")).alias("v"), F.col("__all").alias("n")))
    rows = rows.withColumn("__open", F.last(opens, ignorenulls=True).over(sofar))
    rows = rows.withColumns({"__base": F.col("__open")["v"], "__inc": F.col("__all") - F.coalesce(F.col("__open")["n"], F.lit(0))})
    held = F.when(F.col("__base").isNotNull(), F.col("__base") + F.col("__inc")).when(F.col("__inc") > 0, F.col("__inc"))
    rows = rows.withColumn("__held", held)
    rows = rows.withColumn("__was", F.lag("__held").over(key))
    tag, key, value = F.col("__tag"), F.col("__k"), F.col("__v")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    reply = lambda t, i=none, text=null, log=null: F.struct(F.lit(t).alias("tag"), i.cast("bigint").alias("i"), text.alias("text"), log.alias("log"))
    out = (
        F.when(tag == "GET", F.when(F.col("__held").isNull(), reply("NIL")).otherwise(reply("INT", F.col("__held"))))
        .when(tag == "SET", F.when(value > max_value, reply("ERR", text=F.concat(F.lit("value too large: "), value.cast("string")))).otherwise(reply("OK", log=F.concat_ws(" ", F.lit("SET"), key, value.cast("string")))))
        .when(tag == "DEL", reply("INT", F.col("__was").isNotNull().cast("bigint"), log=F.concat_ws(" ", F.lit("DEL"), key)))
        .when(tag == "INCR", reply("INT", F.col("__held")))
        .when(tag == "UNKNOWN", reply("BYTES", text=F.concat(F.lit("ERR unknown: "), c["msg"])))
        .when(tag == "PROTOCOL", reply("ERR", text=c["msg"]))
    )
    return rows.withColumn("reply", out)


def bounded_replies(df: DataFrame, cmd: str, stores: list[str], order: list[str], max_keys: int = 10_000, max_value: int = 1_000_000) -> DataFrame:
    """df with ``reply``, for stores with a limit on their keys: the same as driving bounded_store along each.

    Stores are taken to stay within the limit, and run as windows by key; a running number of keys, over ranges
    of a store, then shows its first SET that must be refused.  Up to there the windows are right.  A store that
    has such a row is scanned from it on, beginning with the keys it held before; others are never scanned."""
    if not stores:
        raise ValueError("name the columns that tell stores apart; one store needs a constant one")
    columns = df.columns
    rows = _windows(df, cmd, order, max_value, stores)
    alive = rows.withColumn("__change", F.col("__held").isNotNull().cast("bigint") - F.col("__was").isNotNull().cast("bigint")).drop("__tag", "__v", "__alone", "__all", "__open", "__base", "__inc")
    counted = running_sum(alive, "__change", "__keys", stores, order)
    path = shared_folder(df.sparkSession)
    counted.write.parquet(path)
    counted = df.sparkSession.read.schema(counted.schema).parquet(path)
    c = F.col(cmd)
    over = (c["tag"] == "SET") & (c["value"] <= max_value) & F.col("__was").isNull() & (F.col("__keys") > max_keys)
    at = F.struct(*order)
    first = counted.where(over).groupBy(*(F.col(k).alias(f"__s{i}") for i, k in enumerate(stores))).agg(F.min(at).alias("__first"))
    same = reduce(Column.__and__, (counted[k].eqNullSafe(first[f"__s{i}"]) for i, k in enumerate(stores)))
    marked = counted.join(first, same, "left")
    fine = marked.where(F.col("__first").isNull() | (at < F.col("__first")))
    late = marked.where(at >= F.col("__first")).select(*columns)
    # what each key held at last before the first refusal
    last = fine.where(F.col("__first").isNotNull() & F.col("__k").isNotNull()).groupBy(*stores, "__k").agg(F.max_by("__held", at).alias("__held"))
    held = F.map_from_entries(F.collect_list(F.when(F.col("__held").isNotNull(), F.struct("__k", "__held"))))
    # a store without any key yet has its row too
    starts = first.select(*(F.col(f"__s{i}").alias(k) for i, k in enumerate(stores)), F.lit(None).cast("string").alias("__k"), F.lit(None).cast("bigint").alias("__held")).union(last.select(*stores, "__k", "__held")).groupBy(*stores).agg(held.alias("state"))
    return fine.select(*columns, "reply").union(scan_from(bounded_store(max_keys, max_value), starts, late, cmd, "reply", stores, order))


def bounded_store(max_keys: int = 10_000, max_value: int = 1_000_000) -> Stateful:
    """The store as one cell, with both limits; its state is all of the map."""

    def step(s: tuple, cmd: tuple) -> tuple:
        held, (tag, k, v, msg) = s, cmd
        if tag == "GET":
            reply = ("INT", held[k], None, None) if k in held else ("NIL", None, None, None)
        elif tag == "SET" and v > max_value:
            reply = ("ERR", None, f"value too large: {v}", None)
        elif tag == "SET" and k not in held and len(held) >= max_keys:
            reply = ("ERR", None, "max keys reached", None)
        elif tag == "SET":
            held[k], reply = v, ("OK", None, None, f"SET {k} {v}")
        elif tag == "DEL":
            reply = ("INT", int(held.pop(k, None) is not None), None, f"DEL {k}")
        elif tag == "INCR":
            held[k] = held.get(k, 0) + 1
            reply = ("INT", held[k], None, None)
        else:
            reply = {"UNKNOWN": ("BYTES", None, f"ERR unknown: {msg}", None), "PROTOCOL": ("ERR", None, msg, None)}.get(tag)
        return held, reply

    return Stateful(CMD, REPLY, STORE, dict, None, step, lazy=True)


def service(max_keys: int = 10_000, max_value: int = 1_000_000) -> Cell:
    """The whole service as one cell: chunks of a connection to the answers to the lines that each ends."""
    return chain(line_split, spoken_lines, Each(chain(cmd_parse, bounded_store(max_keys, max_value), resp_encode)))


def split_lines(df: DataFrame, chunk: str, keys: list[str], order: str) -> DataFrame:
    """(keys, order, line_no, line): every line that a chunk ends, trimmed, by stream; what follows
    the last line feed waits for more."""
    sofar = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.select(*keys, order, F.split(F.coalesce(F.col(chunk), F.lit("")), "\n").alias("__p"))
    parts = parts.withColumn("__before", F.coalesce(F.sum(F.size("__p") - 1).over(sofar), F.lit(0)))
    pieces = parts.select(*keys, order, "__before", F.size("__p").alias("__n"), F.posexplode("__p").alias("__i", "__piece"))
    lines = pieces.groupBy(*keys, (F.col("__before") + F.col("__i")).cast("bigint").alias("line_no")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "__piece"))), lambda x: x["__piece"]), "").alias("line"),
        F.max(F.when(F.col("__i") < F.col("__n") - 1, F.col(order))).alias(order),
    )
    return lines.where(F.col(order).isNotNull()).select(*keys, order, "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
