"""Problem 8: filling containers by bounded-space online packing.

Each partition keeps a fixed number of open windows, places every item where it fits best, and emits the fullest window
when none fits. The items open at the end of the partitions are packed again, largest first, by groups of ``fan_in`` partitions, round by
round, so that no task ever holds more than fan_in times ``windows`` windows; the emptiest ``windows`` of each round go on to the next.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.session import cut

WINDOWS = 4096
FAN_IN = 16
OUT = "container bigint, doc_id bigint, piece int, first_token bigint, tokens int, open boolean, part int"


class Packer:
    """Open windows by room left; an item goes to the window with the least room that holds it."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows, self.next = capacity, windows, 0
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def put(self, size: int, item: tuple) -> list | None:
        """Place one item; gives the window that had to be closed for it, if any."""
        closed = None
        k = bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, w = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.windows:
                closed = self.held.pop(self.rooms.pop(0)[1])
            room, w = self.capacity, self.next
            self.next += 1
            self.held[w] = []
        self.held[w].append(item)
        if room == size:
            full = self.held.pop(w)
            return full if closed is None else [closed, full]
        insort(self.rooms, (room - size, w))
        return closed


def _pack(batches: Iterator[pd.DataFrame], capacity: int, windows: int, most: int, base: int, part: int, last: bool) -> Iterator[pd.DataFrame]:
    packer, number = Packer(capacity, most), 0

    def rows(windows_: list[list], open_: bool) -> pd.DataFrame:
        nonlocal number
        out = []
        for w in windows_:
            out += [(base + number, *x, open_, part) for x in w]
            number += 1
        return pd.DataFrame(out, columns=["container", "doc_id", "piece", "first_token", "tokens", "open", "part"]).astype({"doc_id": "Int64"})

    for pdf in batches:
        done: list[list] = []
        items = zip(pdf["tokens"].tolist(), pdf["doc_id"].astype("Int64").tolist(), pdf["piece"].tolist(), pdf["first_token"].tolist(), strict=True)
        for size, doc, piece, first in items:
            doc = None if doc is pd.NA else doc
            while size > capacity:
                done.append([(doc, piece, first, capacity)])
                size, first, piece = size - capacity, first + capacity, piece + 1
            got = packer.put(size, (doc, piece, first, size))
            if got:
                done += got if isinstance(got[0], list) else [got]
        if done:
            yield rows(done, False)
    if packer.held:
        rest = [packer.held[w] for _, w in packer.rooms]
        if last or len(rest) <= windows:
            yield rows(rest, not last)
        else:  # after a merge without limit, the emptiest windows stay open
            yield rows(rest[:-windows], False)
            yield rows(rest[-windows:], True)


def _repack(capacity: int, windows: int, level: int, last: bool):
    """Packs what one group of partitions left open; the last level closes everything."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        return pd.concat(list(_pack(iter([pdf]), capacity, windows, len(pdf) + 1, (level << 56) + (g << 32), g, last)))

    return run


def pack(docs: DataFrame, capacity: int, text: str = "text", key: str = "doc_id", windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(container, doc_id, piece, first_token, tokens): every row of docs is in one container, whole, unless it has more than capacity tokens.

    Tokens are those of the byte-level tokenizer of the ByT5 models: the UTF-8 bytes of the text and one end token, so a null or blank
    text has one token or more. A text over capacity gives full pieces (piece 0, 1, ...) that fill a container each, and a
    remainder that is packed like any other item. n_tokens as delivered is not used. Equal rows are items of their own; a null doc_id
    stays null. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 1).alias("tokens"))

    def first(batches):
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        yield from _pack(batches, capacity, windows, windows, p << 32, p, False)

    stage = cut(sized.mapInPandas(first, OUT))
    done = stage.filter("NOT open")
    parts = (stage.agg(F.max("part")).first()[0] or 0) + 1
    left = stage.filter("open")
    level = 0
    while True:
        level += 1
        parts = -(-parts // fan_in)
        last = parts == 1

        merged = left.withColumn("g", F.floor(F.col("part") / fan_in)).groupBy("g").applyInPandas(_repack(capacity, windows, level, last), OUT)
        if last:
            return done.unionByName(merged).select("container", "doc_id", "piece", "first_token", "tokens")
        merged = cut(merged)
        done = done.unionByName(merged.filter("NOT open"))
        left = merged.filter("open")
