"""A packet path: raw frame -> ethernet -> ip -> tcp -> delivery."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ports import LONG, STRING, plain_int, strict_int, struct_type
from ..operators.cell import Cell, Stateful, Stateless, Summary
from ..operators.compose import Chain, chain

ETH = struct_type(proto=LONG, payload=STRING)
IP = struct_type(src=LONG, dst=LONG, proto=LONG, payload=STRING)
TCP = struct_type(sport=LONG, dport=LONG, payload=STRING)
DELIVERED = struct_type(sport=LONG, dport=LONG, bytes=LONG)


def _unsigned(s: Column, bits: int) -> Column:
    return F.coalesce(strict_int(s, signed=False, high=(1 << bits) - 1), F.lit(0).cast("bigint"))


def _eth(raw: Column) -> Column:
    piece = lambda i: F.get(F.split(raw, ":", 4), F.lit(i))
    return F.struct(_unsigned(piece(2), 8).alias("proto"), F.coalesce(piece(3), F.lit("")).alias("payload"))


def _ip(e: Column) -> Column:
    piece = lambda i: F.get(F.split(e["payload"], ":", 2), F.lit(i))
    return F.struct(_unsigned(piece(0), 32).alias("src"), F.lit(0).cast("bigint").alias("dst"), e["proto"].alias("proto"), F.coalesce(piece(1), F.lit("")).alias("payload"))


def _tcp(i: Column) -> Column:
    piece = lambda k: F.get(F.split(i["payload"], r"\.", 2), F.lit(k))
    return F.struct(_unsigned(piece(0), 16).alias("sport"), _unsigned(piece(1), 16).alias("dport"), i["payload"].alias("payload"))


def _deliver(t: Column) -> Column:
    return F.struct(t["sport"].alias("sport"), t["dport"].alias("dport"), F.octet_length(t["payload"]).cast("bigint").alias("bytes"))


def _number(s: str | None, bits: int) -> int:
    return plain_int(s, signed=False, high=(1 << bits) - 1) or 0 if s is not None else 0


def _piece(pieces: list[str], i: int) -> str | None:
    return pieces[i] if i < len(pieces) else None


def _plain_eth(raw: str) -> tuple:
    pieces = raw.split(":", 3)
    return _number(_piece(pieces, 2), 8), _piece(pieces, 3) or ""


def _plain_ip(e: tuple) -> tuple:
    src, _, rest = e[1].partition(":")
    return _number(src, 32), 0, e[0], rest


def _plain_tcp(i: tuple) -> tuple:
    sport, dot, dport = i[3].partition(".")
    return _number(sport, 16), _number(dport, 16), i[3]


def _plain_deliver(t: tuple) -> tuple:
    return t[0], t[1], len(t[2].encode())


def _delivered(held: dict, t: tuple) -> tuple:
    made = _plain_deliver(t)
    held[made[:2]] = held.get(made[:2], 0) + made[2]
    return held, made


def _add(held: dict, more: dict) -> dict:
    out = dict(held)
    for pair, n in more.items():
        out[pair] = out.get(pair, 0) + n
    return out


def _sums(segments: Iterable[tuple]) -> dict:
    held: dict = {}
    for t in segments:
        _delivered(held, t)
    return held


PAIR = struct_type(sport=LONG, dport=LONG)
TABLE = T.MapType(PAIR, LONG)
eth_parse, ip_parse, tcp_parse = Stateless(STRING, ETH, _eth, _plain_eth), Stateless(ETH, IP, _ip, _plain_ip), Stateless(IP, TCP, _tcp, _plain_tcp)
#: What of a segment is delivered, without the table of what was.
measure = Stateless(TCP, DELIVERED, _deliver, _plain_deliver)
#: The same, with the bytes of each pair of ports so far as its state.
deliver = Stateful(TCP, DELIVERED, TABLE, dict, None, _delivered, over=lambda t, w: _deliver(t), given=Summary(TABLE, _sums, _add, _add), lazy=True)
parsed: Cell = chain(eth_parse, ip_parse, tcp_parse)
path: Cell = Chain(parsed, measure)
delivery: Cell = Chain(parsed, deliver)


def delivered_table(df: DataFrame, delivered: str) -> DataFrame:
    """The state after all packets: bytes by port pair."""
    d = F.col(delivered)
    return df.groupBy(d["sport"].alias("sport"), d["dport"].alias("dport")).agg(F.sum(d["bytes"]).alias("bytes"))
