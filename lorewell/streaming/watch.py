"""Watching a folder and applying changes in order.

A stream of files (``ingest``) sees new ones alone; a folder in which files change
and vanish is listed, compared with the last listing, and what it feeds is built
anew once it has been quiet for a while.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from queue import Queue

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUIET = 0.25


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, stamp, size) of all files below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.unix_millis("modificationTime").alias("stamp"), F.col("length").alias("size"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of files that were added, changed or removed between two listings."""
    both = before.alias("b").join(now.alias("n"), "path", "full")
    kind = F.when(F.col("b.stamp").isNull(), "added").when(F.col("n.stamp").isNull(), "removed").when((F.col("b.stamp") != F.col("n.stamp")) | (F.col("b.size") != F.col("n.size")), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


class Debounced:
    """Calls ``action`` once, ``quiet`` seconds after the last of a burst of ``touch`` calls."""

    def __init__(self, action: Callable[[], None], quiet: float = QUIET):
        self.action, self.quiet = action, quiet
        self.lock, self.timer = threading.Lock(), None

    def touch(self) -> None:
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = threading.Timer(self.quiet, self.action)
            self.timer.daemon = True
            self.timer.start()

    def stop(self) -> None:
        with self.lock:
            if self.timer:
                self.timer.cancel()


def watch(list_files: Callable[[], frozenset], build: Callable[[], None], rounds: int, pause: float = 0.1, quiet: float = QUIET) -> int:
    """Lists ``rounds`` times and builds when a change has settled; returns how often it built.

    A failing build is tried again after the next change; listing goes on.
    """
    built = 0

    def run() -> None:
        nonlocal built
        build()
        built += 1

    waiting, last = Debounced(run, quiet), list_files()
    for _ in range(rounds):
        time.sleep(pause)
        if (now := list_files()) != last:
            last = now
            waiting.touch()
    time.sleep(quiet * 1.5)
    return built


class Mutations:
    """Applies changes one after another, in the order in which they were given; one that fails leaves the state as it was."""

    def __init__(self, state):
        self.state = state
        self.queue: Queue = Queue()
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while (item := self.queue.get()) is not None:
            change, done = item
            try:
                self.state = change(self.state)
                done.set_result(self.state)
            except Exception as e:  # goes to whoever asked for the change
                done.set_exception(e)

    def submit(self, change: Callable) -> Future:
        """``change`` maps the state to the next one."""
        done: Future = Future()
        self.queue.put((change, done))
        return done

    def close(self) -> None:
        self.queue.put(None)
