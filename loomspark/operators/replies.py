"""Replies that come in pieces: a table function that keeps what it has of a reply until it is whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf


@udtf(returnType="reply string, item int, value string, error string")
class Pieces:
    """The JSON objects of one reply, as soon as each is whole; pieces of a reply come in order, in one partition.

    What stands between objects is passed over. Strings may hold braces, and a piece may end anywhere, in a
    string or an escape too. At the end, what is left open is an item with an error.
    """

    def __init__(self):
        self.reply, self.item, self.open, self.quoted, self.escaped, self.held = None, 0, 0, False, False, []

    def eval(self, row):
        self.reply = row["reply"]
        for c in row["piece"] or "":
            if not self.open and c != "{":
                continue
            self.held.append(c)
            if self.escaped:
                self.escaped = False
            elif self.quoted:
                self.escaped, self.quoted = c == "\\", c != '"'
            elif c == '"':
                self.quoted = True
            elif c in "{}":
                self.open += 1 if c == "{" else -1
                if not self.open:
                    yield self.whole("".join(self.held))
                    self.held = []

    def whole(self, text: str):
        self.item += 1
        try:
            return self.reply, self.item, json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")), None
        except (ValueError, RecursionError):
            return self.reply, self.item, text, "no JSON"

    def terminate(self):
        if self.held:
            yield self.reply, self.item + 1, "".join(self.held), "cut off"


def assembled(df: DataFrame, reply: str, order: str, piece: str) -> DataFrame:
    """(reply, item, value, error): the objects of each reply, whose pieces are rows in the order given. Null pieces are empty."""
    from pyspark.sql import functions as F

    rows = df.select(F.col(reply).cast("string").alias("reply"), F.col(order).alias("place"), F.col(piece).alias("piece"))
    return Pieces(rows.asTable().partitionBy("reply").orderBy("place"))
