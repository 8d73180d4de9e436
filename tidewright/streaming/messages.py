"""Messages of exchanges as rows: one declaration per kind, parsed as variants, so a new kind is a new entry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

D, L, S, B = "double", "long", "string", "boolean"
_BEST = {"best_bid": ("b[0][0]", D), "best_bid_size": ("b[0][1]", D), "best_ask": ("a[0][0]", D), "best_ask_size": ("a[0][1]", D), "bids": ("b", "array<array<double>>"), "asks": ("a", "array<array<double>>")}
_NAMED = "array<struct<price: double, qty: double>>"

#: Kind -> (array that holds the rows, or None, field -> path in a row (after ^: in the message) and type); fixed values of the formats.
MESSAGES: dict[str, tuple[str | None, dict[str, tuple[str, str]]]] = {
    "trades": (None, {"symbol": ("s", S), "trade_id": ("a", L), "price": ("p", D), "quantity": ("q", D), "time_ms": ("T", L), "is_buyer_maker": ("m", B)}),
    "mark_price": (None, {"symbol": ("s", S), "mark_price": ("p", D), "index_price": ("i", D), "funding_rate": ("r", D), "time_ms": ("E", L)}),
    "kline": (None, {"symbol": ("s", S), "time_ms": ("k.t", L), "o": ("k.o", D), "h": ("k.h", D), "l": ("k.l", D), "c": ("k.c", D), "v": ("k.v", D), "closed": ("k.x", B), "trades": ("k.n", L)}),
    "book_ticker": (None, {"symbol": ("s", S), "bid": ("b", D), "bid_size": ("B", D), "ask": ("a", D), "ask_size": ("A", D), "time_ms": ("T", L)}),
    "ticker": (None, {"symbol": ("s", S), "time_ms": ("E", L), "change": ("p", D), "change_pct": ("P", D), "mean_price": ("w", D), "last": ("c", D), "volume": ("v", D), "high": ("h", D), "low": ("l", D)}),
    "liquidations": (
        None,
        {"symbol": ("o.s", S), "side": ("o.S", S), "order_type": ("o.o", S), "time_in_force": ("o.f", S), "quantity": ("o.q", D), "price": ("o.p", D), "avg_price": ("o.ap", D), "status": ("o.X", S), "last_filled": ("o.l", D), "filled": ("o.z", D), "event_ms": ("E", L), "time_ms": ("o.T", L)},
    ),
    "order_book": (None, {"symbol": ("s", S), "time_ms": ("E", L), **_BEST}),
    "order_book_spot": (None, {"time_ms": ("lastUpdateId", L), **{k: (p.replace("b", "bids").replace("a", "asks") if len(p) == 1 else p.replace("b[", "bids[").replace("a[", "asks["), t) for k, (p, t) in _BEST.items()}}),
    "trade_list": ("data", {"symbol": ("s", S), "trade_id": ("i", S), "price": ("p", D), "quantity": ("v", D), "time_ms": ("T", L), "side": ("S", S), "tick_direction": ("L", S), "block_trade": ("BT", B), "sent_ms": ("^ts", L)}),
    "topic_book": (None, {"symbol": ("data.s", S), "time_ms": ("ts", L), "update": ("type", S), **{k: (f"data.{p}", t) for k, (p, t) in _BEST.items()}}),
    "topic_book_protected": (None, {"symbol": ("data.s", S), "time_ms": ("ts", L), "update": ("type", S), "sequence": ("data.seq", L), **{k: (f"data.{p}", t) for k, (p, t) in _BEST.items()}}),
    "topic_ticker": (
        None,
        {"symbol": ("data.symbol", S), "time_ms": ("ts", L), "update": ("type", S), "last_price": ("data.lastPrice", D), "prev_price_24h": ("data.prevPrice24h", D), "price_24h_pcnt": ("data.price24hPcnt", D), "high_price_24h": ("data.highPrice24h", D), "low_price_24h": ("data.lowPrice24h", D),
         "volume_24h": ("data.volume24h", D), "turnover_24h": ("data.turnover24h", D), "bid1_price": ("data.bid1Price", D), "bid1_size": ("data.bid1Size", D), "ask1_price": ("data.ask1Price", D), "ask1_size": ("data.ask1Size", D)},
    ),
    "topic_kline": ("data", {"sent_ms": ("^ts", L), "start_ms": ("start", L), "end_ms": ("end", L), "o": ("open", D), "h": ("high", D), "l": ("low", D), "c": ("close", D), "v": ("volume", D), "turnover": ("turnover", D), "closed": ("confirm", B)}),
    "topic_liquidations": ("data", {"sent_ms": ("^ts", L), "symbol": ("s", S), "side": ("S", S), "price": ("p", D), "size": ("v", D), "time_ms": ("T", L)}),
    "all_mids": (None, {"mids": ("data.mids", "map<string, double>")}),
    "l2_book": (
        None,
        {"symbol": ("data.coin", S), "time_ms": ("data.time", L), "best_bid": ("data.levels[0][0].px", D), "best_bid_size": ("data.levels[0][0].sz", D), "best_bid_orders": ("data.levels[0][0].n", L), "best_ask": ("data.levels[1][0].px", D), "best_ask_size": ("data.levels[1][0].sz", D),
         "best_ask_orders": ("data.levels[1][0].n", L), "bids": ("data.levels[0]", "array<struct<px: double, sz: double, n: bigint>>"), "asks": ("data.levels[1]", "array<struct<px: double, sz: double, n: bigint>>")},
    ),
    "coin_trades": ("data", {"symbol": ("coin", S), "time_ms": ("time", L), "side": ("side", S), "price": ("px", D), "quantity": ("sz", D)}),
    "candle": (None, {"symbol": ("data.s", S), "time_ms": ("data.t", L), "o": ("data.o", D), "h": ("data.h", D), "l": ("data.l", D), "c": ("data.c", D), "v": ("data.v", D), "trades": ("data.n", L)}),
    "spot_ticker": ("data", {"symbol": ("symbol", S), "iso_time": ("timestamp", S), "ask": ("ask", D), "ask_size": ("ask_qty", D), "bid": ("bid", D), "bid_size": ("bid_qty", D), "change": ("change", D), "change_pct": ("change_pct", D), "high": ("high", D), "last": ("last", D), "low": ("low", D), "volume": ("volume", D), "vwap": ("vwap", D)}),
    "spot_book": ("data", {"symbol": ("symbol", S), "iso_time": ("timestamp", S), "update": ("^type", S), "best_bid": ("bids[0].price", D), "best_bid_size": ("bids[0].qty", D), "best_ask": ("asks[0].price", D), "best_ask_size": ("asks[0].qty", D), "bids": ("bids", _NAMED), "asks": ("asks", _NAMED)}),
    "spot_orders": (
        "data",
        {"symbol": ("symbol", S), "iso_time": ("timestamp", S), "update": ("^type", S), "checksum": ("checksum", L), "best_bid": ("bids[0].limit_price", D), "best_bid_size": ("bids[0].order_qty", D), "best_ask": ("asks[0].limit_price", D), "best_ask_size": ("asks[0].order_qty", D)},
    ),
    "spot_trades": ("data", {"symbol": ("symbol", S), "iso_time": ("timestamp", S), "side": ("side", S), "price": ("price", D), "quantity": ("qty", D), "order_type": ("ord_type", S)}),
    "spot_ohlc": ("data", {"symbol": ("symbol", S), "iso_time": ("timestamp", S), "o": ("open", D), "h": ("high", D), "l": ("low", D), "c": ("close", D), "trades": ("trades", L), "v": ("volume", D), "vwap": ("vwap", D)}),
    "futures_ticker_lite": (None, {"symbol": ("product_id", S), "bid": ("bid", D), "ask": ("ask", D), "change": ("change", D), "premium": ("premium", D), "volume": ("volume", D)}),
    "futures_ticker": (
        None,
        {"symbol": ("product_id", S), "time_ms": ("time", L), "bid": ("bid", D), "ask": ("ask", D), "bid_size": ("bid_size", D), "ask_size": ("ask_size", D), "volume": ("volume", D), "mark_price": ("markPrice", D), "index_price": ("index", D), "last": ("last", D), "change": ("change", D),
         "funding_rate": ("funding_rate", D), "funding_rate_prediction": ("funding_rate_prediction", D), "open_interest": ("openInterest", D), "tag": ("tag", S)},
    ),
    "futures_book": (None, {"symbol": ("product_id", S), "time_ms": ("timestamp", L), "sequence": ("seq", L), "side": ("side", S), "price": ("price", D), "quantity": ("qty", D)}),
    "futures_trade": (None, {"symbol": ("product_id", S), "time_ms": ("time", L), "side": ("side", S), "type": ("type", S), "price": ("price", D), "quantity": ("qty", D), "sequence": ("seq", L)}),
    "futures_trade_snapshot": ("trades", {"symbol": ("product_id", S), "time_ms": ("time", L), "side": ("side", S), "type": ("type", S), "price": ("price", D), "quantity": ("qty", D), "sequence": ("seq", L)}),
}


def parse_messages(raw: DataFrame, kind: str, column: str = "value", keep: tuple = ()) -> DataFrame:
    """Rows of JSON messages of one kind; a message with a list gives a row for each entry, unreadable ones none.

    ``keep`` columns of ``raw`` (a topic, a time of arrival) come along; times in ISO form are also given as ``time_ms``.
    """
    holder, fields = MESSAGES[kind]
    doc = F.try_parse_json(F.col(column).cast("string"))
    rows = raw.select(*keep, doc.alias("_message"))
    rows = rows.withColumn("_doc", F.explode(F.try_variant_get("_message", f"$.{holder}", T.ArrayType(T.VariantType()).simpleString())) if holder else F.col("_message"))

    def get(path: str, kind_: str) -> Column:
        source, path = ("_message", path[1:]) if path.startswith("^") else ("_doc", path)
        return F.try_variant_get(source, f"$.{path}", kind_)

    out = rows.select(*keep, *[get(path, t).alias(name) for name, (path, t) in fields.items()])
    out = out.filter(F.coalesce(*[F.col(n).cast("string") for n, (_, t) in fields.items() if t in (D, L, S, B)], *[F.to_json(n) for n, (_, t) in fields.items() if t not in (D, L, S, B)]).isNotNull())
    if "iso_time" in fields:
        out = out.withColumn("time_ms", F.unix_millis(F.try_to_timestamp(F.col("iso_time"))))
    return out


def forward_filled(rows: DataFrame, by: str = "symbol", order: str = "time_ms", needs: str = "last_price") -> DataFrame:
    """Messages that hold changes only, as whole rows: each field's last known value; rows before ``needs`` is known are left out.

    A batch is filled by windows, a stream by the state of each series, which holds its last row.
    """
    fields = [c for c in rows.columns if c not in (by, order)]
    if not rows.isStreaming:
        along = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(by, order, *[F.last(c, ignorenulls=True).over(along).alias(c) for c in fields]).filter(F.col(needs).isNotNull())
    schema = T.StructType([rows.schema[c] for c in (by, order, *fields)])
    state_schema = T.StructType([rows.schema[c] for c in fields])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(frames)).sort_values(order)
        filled = part[fields].astype(object).where(part[fields].notna(), None)
        if state.exists:
            filled = pd.concat([pd.DataFrame([state.get], columns=fields, dtype=object), filled])
        filled = filled.ffill()
        state.update(tuple(None if pd.isna(v) else v for v in filled.iloc[-1]))
        out = filled.iloc[len(filled) - len(part) :]
        out.insert(0, by, key[0])
        out.insert(1, order, part[order].to_numpy())
        yield out[out[needs].notna()]

    return rows.groupBy(by).applyInPandasWithState(run, schema, state_schema, "append", "NoTimeout")
