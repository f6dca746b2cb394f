"""Motion-gated capture: which frames of each station become inspections.

The rule is a fold over the frames of a station. ``auto_captures`` evaluates it for stored frames in
parallel, inside a station too: after a capture at frame i the next one is the first moving frame at
least two frames and one cooldown later, whatever happened before i. So each run of frames can be
solved for every moving frame it may be entered at. The entries of neighbouring runs are put together, some at a
time, up a tree, the captures before each run follow from them down the same tree, and a last pass lists the
captures of each run. No step sees more than a run, or the few entries of some of them.

``stored_outcomes`` evaluates the whole rule (stabilisation, failed reads, problems) over stored frames: every run is
folded from a guessed state, and folded again while the state that the run before it ends in is another one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.operators.capture_rule import CAPTURED, COOLDOWN_US, CaptureRule, StationState
from seamline.operators.ordered import RUN, join_on, ordered_runs, with_history
from seamline.session import cut_lineage, shuffle_partitions, spread

#: Runs, or groups of runs, that are put together in one step.
FAN = 8


def motion_candidates(
    frames: DataFrame,
    station: str,
    ts_us: str,
    unique: str,
    signal: str,
    moved: Callable[[Column, Column], Column],
    runs: int | None = None,
) -> DataFrame:
    """Frames that differ from the frame before them at their station, with ``position`` from 1.

    A null station is a station of its own. ``frames`` holds readable frames only, so an unreadable one leaves the comparison as it was.
    """
    keys, order = [station], [ts_us, unique]
    ordered = ordered_runs(frames.withColumn("_one", F.lit(1)), keys, order, runs)
    lagged = with_history(ordered, keys, order, [signal], "_before", {"_one": "position"})
    before = F.col("_before")
    changed = before.isNotNull() & moved(before[signal], F.col(signal))
    return lagged.filter(changed).withColumn("previous", before[signal]).drop("_before", "_one")


def _following(ts: np.ndarray, position: np.ndarray, at_ts, at_position, cooldown: int):
    """First row a capture may follow at, after one at the given time and position: a later row."""
    return np.maximum(
        np.searchsorted(ts, np.asarray(at_ts) + cooldown), np.searchsorted(position, np.asarray(at_position) + 2)
    )


ENTRY = ["entry_ts", "entry_position", "leave_ts", "leave_position"]


def _borders(run: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]


def _reachable(ts: np.ndarray, position: np.ndarray, leave: np.ndarray, cooldown: int) -> np.ndarray:
    """Entries to keep. Earlier runs end before row 0, so they lead no further than to what follows it; of entries
    that leave by the same row only the latest is kept."""
    reach = min(len(ts), int(_following(ts, position, ts[0], position[0], cooldown)) + 1)
    leave = leave[:reach]
    return np.flatnonzero(np.append(leave[1:] != leave[:-1], True))


def auto_captures(
    frames: DataFrame,
    station: str,
    ts_us: str,
    unique: str,
    signal: str,
    moved: Callable[[Column, Column], Column],
    cooldown_us: int = COOLDOWN_US,
    runs: int | None = None,
) -> DataFrame:
    """Captured frames (station, ts_us, unique) of the motion rule without stabilisation."""
    moving = motion_candidates(frames, station, ts_us, unique, signal, moved, runs)
    moving = cut_lineage(moving.select(station, RUN, ts_us, unique, "position"))
    dtype = dict(moving.dtypes)

    def entries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", ignore_index=True)
        ts, position = rows[ts_us].to_numpy(), rows["position"].to_numpy()
        count = len(rows)
        jump = np.append(_following(ts, position, ts, position, cooldown_us), count)
        last = np.arange(count + 1)
        while (jump[:-1] < count).any():
            inner = jump < count
            last[inner] = last[jump[inner]]
            jump[inner] = jump[jump[inner]]
        leave = last[:-1]
        kept = _reachable(ts, position, leave, cooldown_us)
        return pd.DataFrame(
            {
                station: rows[station].iloc[0],
                RUN: rows[RUN].iloc[0],
                "entry_ts": ts[kept],
                "entry_position": position[kept],
                "leave_ts": ts[leave[kept]],
                "leave_position": position[leave[kept]],
            }
        )

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        """The entries of several neighbouring parts, as entries of the whole they make."""
        rows = rows.sort_values([RUN, "entry_position"], ignore_index=True)
        ts, position, leave_ts, leave_position = (rows[c].to_numpy().copy() for c in ENTRY)
        borders = _borders(rows[RUN].to_numpy())
        for start, end in reversed(list(zip(borders, borders[1:]))):
            # who leaves this part may enter a later one
            after = end + _following(ts[end:], position[end:], leave_ts[start:end], leave_position[start:end], cooldown_us)
            on = after < len(rows)
            leave_ts[start:end][on], leave_position[start:end][on] = leave_ts[after[on]], leave_position[after[on]]
        kept = _reachable(ts, position, leave_position, cooldown_us)
        return pd.DataFrame({station: rows[station].iloc[0], RUN: rows[RUN].iloc[0] // FAN, **{
            name: values[kept] for name, values in zip(ENTRY, (ts, position, leave_ts, leave_position))
        }})

    def link(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        """The last capture before each of several neighbouring parts, from the one before the first of them."""
        rows = rows.sort_values([RUN, "entry_position"], ignore_index=True)
        run, ts, position = (rows[c].to_numpy() for c in (RUN, "entry_ts", "entry_position"))
        borders = _borders(run)
        out, at = [], None
        if len(before) and not pd.isna(before["at_ts"].iloc[0]):
            at = (int(before["at_ts"].iloc[0]), int(before["at_position"].iloc[0]))
        for start, end in zip(borders, borders[1:]):
            out.append((rows[station].iloc[0], run[start], *(at or (None, None))))
            row = start
            if at is not None:
                row += int(_following(ts[start:end], position[start:end], *at, cooldown_us))
            if row < end:
                at = (int(rows["leave_ts"].iloc[row]), int(rows["leave_position"].iloc[row]))
        linked = pd.DataFrame(out, columns=[station, RUN, "at_ts", "at_position"])
        return linked.astype({"at_ts": "Int64", "at_position": "Int64"})

    def walk(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", ignore_index=True)
        ts, position = rows[ts_us].to_numpy(), rows["position"].to_numpy()
        row = 0
        if len(before) and not pd.isna(before["at_ts"].iloc[0]):
            at = (int(before["at_ts"].iloc[0]), int(before["at_position"].iloc[0]))
            row = int(_following(ts, position, *at, cooldown_us))
        taken = []
        while row < len(rows):
            taken.append(row)
            row = max(row + 1, int(_following(ts, position, ts[row], position[row], cooldown_us)))
        return rows.iloc[taken][[station, ts_us, unique]]

    key = f"{station} {dtype[station]}"
    entry_schema = f"{key}, {RUN} int, entry_ts long, entry_position long, leave_ts long, leave_position long"
    pieces = spread(moving, station, RUN)
    # a station within one run needs no linking
    several = moving.groupBy(station).agg(F.count_distinct(RUN).alias("_runs")).filter("_runs > 1")
    split = spread(join_on(moving, several.select(station), [station]), station, RUN)
    levels = [cut_lineage(split.groupBy(station, RUN).applyInPandas(entries, entry_schema))]
    count = runs or shuffle_partitions(frames.sparkSession)
    while count > FAN:
        count = -(-count // FAN)
        part = F.floor(F.col(RUN) / FAN).alias("_part")
        levels.append(cut_lineage(levels[-1].groupBy(station, part).applyInPandas(compose, entry_schema)))
    # back down: the parts of one whole start from what comes before it
    linked = levels[0].select(station, RUN, F.lit(None).cast("long").alias("at_ts"), F.lit(None).cast("long").alias("at_position")).limit(0)
    for level in reversed(levels):
        parts = level.withColumn("_part", F.floor(F.col(RUN) / FAN).cast("int")).groupBy(station, "_part")
        whole = linked.withColumn("_part", F.col(RUN)).groupBy(station, "_part")
        linked = parts.cogroup(whole).applyInPandas(link, f"{key}, {RUN} int, at_ts long, at_position long")
    started = spread(linked, station, RUN).groupBy(station, RUN)
    result = f"{key}, {ts_us} long, {unique} {dtype[unique]}"
    return pieces.groupBy(station, RUN).cogroup(started).applyInPandas(walk, result)


def station_status(events: DataFrame, station: str, order: list[str], columns: list[str]) -> DataFrame:
    """Newest row of each station."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("newest")
    return events.groupBy(station).agg(newest).select(station, "newest.*")


#: What a run hands on to the next; the error a station shows is left to whoever reads the outcomes in order.
CARRIED = "baseline binary, last_us long, pending_us long, pending binary"


def stored_outcomes(
    frames: DataFrame, station: str, ts_us: str, unique: str, rule: CaptureRule, runs: int | None = None
) -> DataFrame:
    """(station, ts_us, unique, outcome, trigger_us) of the frames that the rule captures or that fail under it.

    ``frames``: station, ts_us, unique, readable, signal (binary), error. Outcomes are those of ``capture_rule``: a
    frame is captured, unreadable, a failed_read (when the scene should be stable) or a problem. ``trigger_us`` is
    the time of the frame that moved, for captures and failed reads. Frames of one time follow by ``unique``.
    A null station is a station of its own.

    A run far longer than the cooldown forgets how it was entered, so two or three rounds are usual; a round folds
    only runs that are entered in another state than before. Runs shorter than the cooldown pass their state on one
    run a round, at most as many rounds as a station has runs: give fewer ``runs`` then.
    """
    kinds, keys = dict(frames.dtypes), [station, RUN]
    columns = [station, ts_us, unique, "readable", "signal", "error"]
    ordered = ordered_runs(frames.select(*columns), [station], [ts_us, unique], runs)
    state = [part.split()[0] for part in CARRIED.split(", ")]

    def folded(rows: pd.DataFrame, before: pd.DataFrame) -> tuple[StationState, list]:
        now = StationState()
        if len(before):
            known = before.iloc[0]
            for name in state:
                value = known[name]
                if isinstance(value, (bytes, bytearray)):
                    setattr(now, name, bytes(value))
                elif not pd.isna(value):
                    setattr(now, name, int(value))
        found = []
        for row in rows.sort_values([ts_us, unique]).itertuples(index=False):
            at, name, signal = int(getattr(row, ts_us)), getattr(row, unique), row.signal
            trigger, now.seen_us = now.pending_us, None
            outcome = rule.advance(now, at, bool(row.readable), None if signal is None else bytes(signal), row.error)
            if outcome:
                found.append((at, name, outcome, trigger if trigger is not None else at if outcome == CAPTURED else None))
        if len(rows) and now.last_us is not None and int(rows[ts_us].max()) - now.last_us >= rule.cooldown_us:
            now.last_us = None  # rested, whatever comes
        return now, found

    def leave(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=[*keys, *state])
        now = folded(rows, before)[0]
        out = pd.DataFrame([(rows[station].iloc[0], rows[RUN].iloc[0], *[getattr(now, name) for name in state])], columns=[*keys, *state])
        return out.astype({"last_us": "Int64", "pending_us": "Int64"})

    def report(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        found = [(rows[station].iloc[0], *row) for row in folded(rows, before)[1]] if len(rows) else []
        return pd.DataFrame(found, columns=[station, ts_us, unique, "outcome", "trigger_us"]).astype({"trigger_us": "Int64"})

    def with_entries(rows: DataFrame, entered: DataFrame):
        return spread(rows, *keys).groupBy(*keys).cogroup(spread(entered, *keys).groupBy(*keys))

    carried = f"{station} {kinds[station]}, {RUN} int, {CARRIED}"
    earlier = Window.partitionBy(station).orderBy(RUN)  # a row for each run of a station
    exits = cut_lineage(with_entries(ordered, ordered.select(*keys).limit(0)).applyInPandas(leave, carried))
    entered = None
    while True:
        now = exits.select(*keys, *[F.lag(name).over(earlier).alias(name) for name in state])
        other = reduce(or_, [~F.col(name).eqNullSafe(F.col("_was_" + name)) for name in state])
        if entered is None:
            changed = now.where(reduce(or_, [F.col(name).isNotNull() for name in state]))
        else:
            was = entered.withColumnsRenamed({name: "_was_" + name for name in state})
            changed = join_on(now, was, keys).where(other).select(*now.columns)
        entered, changed = cut_lineage(now), cut_lineage(changed)
        if changed.isEmpty():
            break
        again = with_entries(join_on(ordered, changed.select(*keys), keys), changed).applyInPandas(leave, carried)
        kept = exits.join(changed.select(*[F.col(k).alias("_c" + k) for k in keys]), reduce(and_, [F.col(k).eqNullSafe(F.col("_c" + k)) for k in keys]), "left_anti")
        exits = cut_lineage(kept.unionByName(again))
    result = f"{station} {kinds[station]}, {ts_us} long, {unique} {kinds[unique]}, outcome string, trigger_us long"
    return with_entries(ordered, entered).applyInPandas(report, result)
