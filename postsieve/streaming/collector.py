"""Collection of posts from an unbounded source of nested JSON events."""

from __future__ import annotations

import os
import socket
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType, StructField, StructType

EVENT = "struct<commit:struct<record:struct<`$type`:string,text:string>>>"
POST_TYPE = "app.bsky.feed.post"  # fixed value: the type of an event that is a post


class ReplaySource(DataSource):
    """Replays recorded events (JSON lines of one file) as a stream, ``rows`` per batch."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType())])

    def simpleStreamReader(self, schema: StructType) -> "ReplayReader":  # noqa: N802
        return ReplayReader(self.options["path"], int(self.options.get("rows", "100")))


class ReplayReader(SimpleDataSourceStreamReader):
    """The offset is a position in the file, so a batch reads its own lines only."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def initialOffset(self) -> dict:  # noqa: N802
        return {"byte": 0}

    def _lines(self, start: int, end: int | None) -> tuple[list[tuple[str]], int]:
        """Whole lines from ``start``, up to ``end`` or ``rows`` of them, and the position behind them."""
        out, at = [], start
        with open(self.path, "rb") as f:
            f.seek(start)
            while (end is None and len(out) < self.rows) or (end is not None and at < end):
                line = f.readline()
                if not line:
                    break
                at += len(line)
                out.append((line.decode("utf-8", "replace").rstrip("\r\n"),))
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        got, at = self._lines(start["byte"], None)
        return iter(got), {"byte": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:  # noqa: N802
        return iter(self._lines(start["byte"], end["byte"])[0])


class SocketSource(DataSource):
    """Events of an endless socket, one per line (host, port, spool, rows).

    A socket has no cursor: what comes in is appended to the spool file first, in a
    folder the driver keeps, and batches are positions in it. So a batch can be
    read again after a failure, and a restarted stream goes on where it was.
    """

    @classmethod
    def name(cls) -> str:
        return "event_socket"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType())])

    def simpleStreamReader(self, schema: StructType) -> "SocketReader":  # noqa: N802
        o = self.options
        return SocketReader(o["host"], int(o["port"]), o["spool"], int(o.get("rows", "100")), float(o.get("wait", "1")))


class SocketReader(ReplayReader):
    def __init__(self, host: str, port: int, spool: str, rows: int, wait: float):
        super().__init__(spool, rows)
        self.address, self.wait, self.socket, self.rest = (host, port), wait, None, b""

    def _receive(self) -> None:
        """Appends what has come in, in whole lines, to the spool; waits for the first of it."""
        lines, until = [], time.monotonic() + self.wait
        try:
            if self.socket is None:
                self.socket = socket.create_connection(self.address, timeout=self.wait)
            while len(lines) < self.rows and time.monotonic() < until:
                self.socket.settimeout(0.05 if lines else max(0.01, until - time.monotonic()))
                got = self.socket.recv(1 << 16)
                if not got:
                    self.socket.close()
                    self.socket = None
                    break
                *whole, self.rest = (self.rest + got).split(b"\n")
                lines += whole
        except TimeoutError:
            pass
        except OSError:  # the other side is gone: the next batch tries again
            self.socket = None
        with open(self.path, "ab") as f:
            f.writelines(x + b"\n" for x in lines)

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if not os.path.exists(self.path) or os.path.getsize(self.path) <= start["byte"]:
            self._receive()
        return super().read(start)


def replay(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    spark.dataSource.register(ReplaySource)
    return spark.readStream.format("replay").option("path", path).option("rows", str(rows)).load()


def listen(spark: SparkSession, host: str, port: int, spool: str, rows: int = 100) -> DataFrame:
    spark.dataSource.register(SocketSource)
    return spark.readStream.format("event_socket").options(host=host, port=str(port), spool=spool, rows=str(rows)).load()


def posts_of(events: DataFrame, language: Callable[[pd.Series], pd.Series] | None = None, wanted: str = "en") -> DataFrame:
    """(text) of events that are posts with a text, in the wanted language; line feeds become spaces.

    ``language`` maps a series of texts to codes, null where it fails; those rows are
    dropped. ``functions.language.languages_of`` is one.
    """
    record = F.from_json("value", EVENT)["commit"]["record"]
    d = events.select(record["$type"].alias("kind"), record["text"].alias("text")).where((F.col("kind") == POST_TYPE) & (F.col("text") != ""))
    if language is not None:
        d = d.where(F.pandas_udf(language, "string")("text") == wanted)
    return d.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))


def collect(posts: DataFrame, folder: str, most: int | None = None, checkpoint: str | None = None):
    """Starts the streaming text sink; ``most`` stops it after so many posts."""
    d = posts if most is None else posts.limit(most)
    return d.writeStream.format("text").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint or f"{folder}/_checkpoint").trigger(processingTime="1 second").start()
