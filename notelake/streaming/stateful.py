"""Keyed state machines over streams, for ``transformWithStateInPandas``.

State lives in the store of the cluster and grows by what a machine keeps, not
by what has passed. A micro-batch brings each key its new rows only; what was
decided before stays decided, so the result does not depend on where the stream
is cut into micro-batches, as long as a key's rows arrive in their order.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from notelake.operators.lifecycle import FOLLOWS, REPLACES, SAME, Known, note_rows, settle

#: Fixed value: failed attempts after which an entry is set aside.
MAX_ATTEMPTS = 5


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(list(order), kind="stable")


class _Capture(StatefulProcessor):
    """One asset: its active notes by their place in the order of arrival."""

    def __init__(self, same: float, follows: float):
        self.same, self.follows = same, follows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "place long", "memory_id long, protected boolean, private boolean, embedding array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], v[1], v[2], np.array(v[3])) for k, v in sorted(self.active.iterator())} if key[0] is not None else {}
        n, out = max(known, default=-1) + 1, []
        for r in _rows(rows, "at", "memory_id").itertuples():
            outcome, other = "stored", None
            if key[0] is not None and r.embedding is not None:
                v = np.asarray(r.embedding, dtype=np.float64)
                hits = sorted((-round(float(w @ v), 6), at) for at, (*_, w) in known.items() if len(w) == len(v))
                near = (Known(-c, *known[at][:3]) for c, at in hits if -c >= self.follows)
                outcome, other = settle(near, bool(r.private), bool(r.resolves), self.same)
                if outcome in REPLACES:
                    at = next(at for at, x in known.items() if x[0] == other)
                    del known[at]
                    self.active.removeKey((at,))
                if outcome != "duplicate":
                    known[n] = (int(r.memory_id), bool(r.protected), bool(r.private), v)
                    self.active.updateValue((n,), (*known[n][:3], v.tolist()))
                    n += 1
            out.append((int(r.memory_id), outcome, other))
        yield pd.DataFrame(out, columns=["memory_id", "outcome", "other"]).astype({"other": "Int64"})

    def close(self) -> None:
        pass


def capture(notes: DataFrame, same: float = SAME, follows: float = FOLLOWS) -> DataFrame:
    """memory_id, outcome and other of each note as it arrives: what ``operators.lifecycle.outcomes`` says of all notes up to it."""
    return note_rows(notes).groupBy("asset").transformWithStateInPandas(_Capture(same, follows), "memory_id long, outcome string, other long", "append", "None")


class _Outbox(StatefulProcessor):
    """One note of a device: its open entry, if it has one, and how many were closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "seq long, op string, priority int, base_rev int, state string, attempts int, closed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, op, priority, base_rev, state, attempts, closed = self.entry.get() if self.entry.exists() else (None, None, None, None, None, 0, 0)
        for r in _rows(rows, "seq").itertuples():
            open_ = state in ("pending", "conflict", "failed")
            if r.action == "enqueue":
                # Edits of a note collapse: the entry keeps its place and base, and one that was set aside is tried again.
                if not open_:
                    seq, base_rev, priority = int(r.seq), int(r.base_rev), int(r.priority)
                op, priority, state, attempts = r.op, max(priority, int(r.priority)), "pending", 0
            elif r.action == "fail" and state == "pending":
                attempts += 1
                if attempts >= MAX_ATTEMPTS:
                    state, attempts = "failed", attempts + 1  # setting aside counts as closing does
            elif r.action in ("done", "conflict") and state == "pending":
                state, attempts = r.action, attempts + 1
            elif r.action == "rebase" and state in ("pending", "conflict"):
                base_rev, state = int(r.base_rev), "pending"
            elif r.action == "retry" and state == "failed":
                state, attempts = "pending", 0
            elif r.action == "cancel" and open_:
                state = "cancelled"
            closed += open_ and state in ("done", "cancelled")
        if state is not None:
            self.entry.update((seq, op, priority, base_rev, state, attempts, int(closed)))
            yield pd.DataFrame({"device_id": [key[0]], "memory_id": [int(key[1])], "seq": [seq], "op": [op], "priority": [priority], "base_rev": [base_rev], "state": [state], "attempts": [attempts], "closed": [int(closed)]})

    def close(self) -> None:
        pass


def outbox(actions: DataFrame) -> DataFrame:
    """The entry of each device and note after each micro-batch: seq, op, priority, base_rev, state, attempts and closed.

    ``actions`` has device_id, memory_id, seq (their order), action, op,
    priority and base_rev. ``enqueue`` opens an entry or collapses into the open
    one; ``fail`` counts an attempt, and the fifth sets the entry aside;
    ``defer`` counts none; ``done`` and ``conflict`` end an attempt; ``rebase``
    puts it back on another base; ``retry`` revives one that was set aside;
    ``cancel`` closes it. An action without an entry that it fits does nothing.
    """
    schema = "device_id string, memory_id long, seq long, op string, priority int, base_rev int, state string, attempts int, closed long"
    return actions.groupBy("device_id", "memory_id").transformWithStateInPandas(_Outbox(), schema, "update", "None")


#: Buckets that announcements are dealt into; the state of a stream goes with it.
BUCKETS = 1024


class _Expiry(StatefulProcessor):
    """The announcements of one bucket: when each ends, and which end at a time.

    A call of the state is a message, so a bucket that holds nothing is asked
    once, and only rows that move or wait cost calls of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "memory_id long", "at long")
        self.due = handle.getMapState("due", "at long", "ids array<long>")

    def _due(self, at: int) -> list[int]:
        return list(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []

    def _forget(self, ids: list[int]) -> None:
        """Take ``ids`` out of the state, and the timers that are left without any."""
        gone: dict[int, set[int]] = {}
        for i in ids:
            if self.ends.containsKey((i,)):
                gone.setdefault(self.ends.getValue((i,))[0], set()).add(i)
                self.ends.removeKey((i,))
        for at, some in gone.items():
            left = [i for i in self._due(at) if i not in some]
            if left:
                self.due.updateValue((at,), (left,))
            else:
                self.due.removeKey((at,))
                self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = _rows(rows, "updated_at").drop_duplicates("memory_id", keep="last")
        if self.ends.exists():
            self._forget(last["memory_id"].tolist())
        over = last["ends"] <= timerValues.getCurrentProcessingTimeInMs()
        for at, some in last[~over].groupby("ends")["memory_id"]:
            ids = some.tolist()
            for i in ids:
                self.ends.updateValue((i,), (int(at),))
            self.due.updateValue((int(at),), (self._due(int(at)) + ids,))
            self.handle.registerTimer(int(at))
        if over.any():
            yield _told(last["memory_id"][over], last["ends"][over])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        ids = self._due(at)
        if ids:
            for i in ids:
                self.ends.removeKey((i,))
            self.due.removeKey((at,))
            yield _told(ids, [at] * len(ids))

    def close(self) -> None:
        pass


def _told(ids, ends) -> pd.DataFrame:
    return pd.DataFrame({"memory_id": np.asarray(ids, dtype=np.int64), "expired_at": np.asarray(ends, dtype=np.int64).astype("datetime64[ms]")})


def expiry(notes: DataFrame) -> DataFrame:
    """memory_id and expired_at of announcements as their time is up by the clock, whether or not anything else arrives.

    A later row of an announcement (by updated_at) moves its end. What has
    ended leaves no state; a row that comes after its own end is told at once.
    State is kept by bucket of announcements, whose rows come together.
    """
    rows = notes.where("memory_id is not null and expires_at is not null").select(F.col("memory_id").cast("long"), F.unix_millis(F.col("expires_at").cast("timestamp")).alias("ends"), "updated_at")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("memory_id"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Expiry(), "memory_id long, expired_at timestamp", "append", "ProcessingTime")


class _Link(StatefulProcessor):
    """One device: its link, since when, and the beats since then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "span long, online boolean, since timestamp, until timestamp, beats long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.span.get() if self.span.exists() else None
        out = []
        for r in _rows(rows, "ts", "id").itertuples():
            if now is None or now[1] != r.online:
                now = (now[0] + 1 if now else 1, bool(r.online), r.ts, r.ts, 0)
                out.append(now)
            now = (*now[:3], r.ts, now[4] + 1)
            if out:
                out[-1] = now
            else:
                out.append(now)
        self.span.update(now)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["device_id", "span", "online", "since", "until", "beats"])

    def close(self) -> None:
        pass


def link_spans(beats: DataFrame) -> DataFrame:
    """Spans of each device's link as they grow: device_id, span (its number), online, since, until and beats; the newest row of a span holds.

    ``beats`` has device_id, id, ts and online. A beat that says otherwise than
    the one before ends the span and begins the next.
    """
    schema = "device_id string, span long, online boolean, since timestamp, until timestamp, beats long"
    return beats.groupBy("device_id").transformWithStateInPandas(_Link(), schema, "update", "None")


class _Guarded(StatefulProcessor):
    """One shared row: its revision and payload."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "rev int, payload string, has_vector boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.row.get() if self.row.exists() else None
        out = []
        for r in _rows(rows, "seq", "rev").itertuples():
            expect = None if pd.isna(r.expect_rev) else int(r.expect_rev)
            if r.kind == "patch":
                landed = at is not None and at[0] == expect  # a payload alone makes no row
            else:
                landed = at is None or expect is None or at[0] == expect
            if landed:
                at = (int(r.rev), r.payload, at[2] if r.kind == "patch" else r.kind == "write")
            out.append((int(key[0]), int(r.seq), landed))
        if at is not None:
            self.row.update(at)
        yield pd.DataFrame(out, columns=["memory_id", "seq", "landed"])

    def close(self) -> None:
        pass


def guarded_writes(writes: DataFrame) -> DataFrame:
    """Whether each write lands: memory_id, seq and landed, as the writes arrive.

    ``writes`` has memory_id, seq, kind (write, patch or tombstone), expect_rev,
    rev and payload. A write or tombstone lands if the row is absent, nothing is
    expected, or the revision is the expected one; a patch only if the row is
    there with the expected revision, and it leaves the row's vector as it is.
    """
    return writes.groupBy("memory_id").transformWithStateInPandas(_Guarded(), "memory_id long, seq long, landed boolean", "append", "None")
