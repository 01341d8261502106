"""Choosing among arriving tries, with keyed state and timers, and sessions of events (an extension).

Tries of a paragraph arrive late, repeatedly and out of order. Those that are no farther apart than `wait` are one session; when the watermark has passed a
session's last try by more than `wait`, no further row can belong to it, and its choice is given: the first accepted try, else the least copied
one, else none. The result is that of `chosen_by_session` over all rows at once, but for rows later than the watermark, which don't count. State is
what open sessions hold; it is kept in the checkpoint, so that a stopped stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.session import ship

#: Columns of a try besides its key; at is a moment in milliseconds.
TRY = ("at", "round", "try", "problem", "share", "text")
STATE = "at array<bigint>, round array<int>, try array<int>, problem array<string>, share array<double>, text array<string>"
CHOICE = "began bigint, ended bigint, n_tries int, status string, text string"


def choice(tries: list[tuple]) -> tuple:
    """(began, ended, n_tries, status, text) of a session's tries, in the order of TRY."""
    good = min((t for t in tries if t[3] is None), key=lambda t: (t[1], t[2]), default=None)
    copied = min((t for t in tries if t[3] == "(copied)"), key=lambda t: (t[4], t[1], t[2]), default=None)
    best = good or copied
    status = "accepted" if good else "copied" if copied else "untouched"
    return min(t[0] for t in tries), max(t[0] for t in tries), len(tries), status, best[5] if best else None


def sessions_of(tries: list[tuple], wait: int) -> list[list[tuple]]:
    """Tries in order of time, cut where two are farther apart than `wait`."""
    out: list[list[tuple]] = []
    for t in sorted(tries, key=lambda t: (t[0], t[1], t[2])):
        if out and t[0] - out[-1][-1][0] <= wait:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def chosen_stream(tries: DataFrame, key: list[str], at: str = "at", wait: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(key, CHOICE) of each session of a stream of tries (key, at, round, try, problem, share, text), as rows are final. A try that arrives again within
    the watermark counts once."""
    ship(tries.sparkSession)
    gap = int(pd.Timedelta(wait).total_seconds() * 1000)
    kinds = dict(tries.dtypes)

    def update(own: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(None if x != x else x for x in t) for t in zip(*state.get)] if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                moments = f["at"].astype("int64").tolist()
                held += [(m, int(r), int(k), None if p is None or p != p else p, s, t) for m, r, k, p, s, t in zip(moments, f["round"], f["try"], f["problem"], f["share"], f["text"])]
        passed = state.getCurrentWatermarkMs()
        all_of = sessions_of(held, gap)
        done = [s for s in all_of if s[-1][0] + gap < passed]
        rest = [s for s in all_of if s[-1][0] + gap >= passed]
        if rest:
            state.update(tuple([t[i] for s in rest for t in s] for i in range(len(TRY))))
            state.setTimeoutTimestamp(max(min(s[-1][0] for s in rest) + gap + 1, passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*own, *choice(s)) for s in done], columns=[*key, *CHOICE_NAMES])

    once = tries.withWatermark(at, late).dropDuplicatesWithinWatermark([*key, "round", "try"])
    rows = once.select(*key, F.unix_millis(at).alias("at"), *[F.col(c) for c in TRY[1:]], F.col(at).alias("moment"))
    out = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", " + CHOICE
    return rows.groupBy(*key).applyInPandasWithState(update, out, STATE, "append", "EventTimeTimeout")


CHOICE_NAMES = [c.split()[0] for c in CHOICE.split(", ")]


def chosen_by_session(tries: DataFrame, key: list[str], at: str = "at", wait: str = "10 minutes") -> DataFrame:
    """The same of a table, natively."""
    gap = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = tries.dropDuplicates([*key, "round", "try"]).withColumn("__at", F.unix_millis(at))
    order = Window.partitionBy(*key).orderBy("__at", "round", "try")
    cut = F.coalesce(F.col("__at") - F.lag("__at").over(order) > gap, F.lit(True))
    rows = rows.withColumn("__cut", cut).withColumn("__session", F.sum(F.col("__cut").cast("int")).over(order))
    good = F.min(F.when(F.col("problem").isNull(), F.struct("round", "try", "text")))
    copied = F.min(F.when(F.col("problem") == "(copied)", F.struct("share", "round", "try", "text")))
    out = rows.groupBy(*key, "__session").agg(F.min("__at").alias("began"), F.max("__at").alias("ended"), F.count("*").cast("int").alias("n_tries"), good.alias("good"), copied.alias("copied"))
    status = F.when(F.col("good").isNotNull(), "accepted").when(F.col("copied").isNotNull(), "copied").otherwise("untouched")
    return out.select(*key, "began", "ended", "n_tries", status.alias("status"), F.when(F.col("good").isNotNull(), F.col("good.text")).otherwise(F.col("copied.text")).alias("text"))


def user_sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user, began, ended, n_events) of a table's or a stream's sessions: events of a user no farther apart than `gap`; late: the watermark of a stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark(at, late)
    out = rows.groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n_events"))
    return out.select(user, F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "n_events")
