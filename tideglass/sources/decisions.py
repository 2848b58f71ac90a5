"""A log of decisions without gaps: entries are final, in order, and safe against two writers; and the same rules over whole logs.

An entry is a file named by its number. It is written aside and then put in its place by an operation that fails where
something stands already, so of two writers of one number one is refused; a reader never sees half an entry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "session string, seq long, kind string, month long, action string, note string, at string"


class DecisionError(ValueError):
    """An entry that the log's rules don't allow; the log is as it was."""


class DecisionLog:
    """Sessions under ``root``: each has its decision windows (months from 0), its length, and entries of kinds ``start``, ``reveal`` and ``decide``."""

    def __init__(self, spark: SparkSession, root: str, actions: Sequence[str]):
        self.spark, self.root, self.actions = spark, root.rstrip("/"), tuple(actions)
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _place(self, session: str, seq: int, entry: dict) -> None:
        folder = f"{self.root}/session={session}"
        aside, target = self._path(f"{self.root}/_aside/{uuid.uuid4().hex}"), self._path(f"{folder}/{seq:012d}.json")
        self._fs.mkdirs(self._path(folder))
        self._fs.mkdirs(self._path(f"{self.root}/_aside"))
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename would replace; a link fails where a file is
                files = self._jvm.java.nio.file
                at = lambda p: files.Paths.get(self._fs.makeQualified(p).toUri())
                try:
                    files.Files.createLink(at(target), at(aside))
                except Exception as e:
                    if "FileAlreadyExistsException" not in str(e):
                        raise
                    raise DecisionError(f"{session}: entry {seq} was written by another") from None
            elif self._fs.exists(target) or not self._fs.rename(aside, target):
                raise DecisionError(f"{session}: entry {seq} was written by another")
        finally:
            self._fs.delete(aside, False)

    def entries(self, session: str) -> list[dict]:
        """One session's entries in order; a missing number is an error, as entries are only ever added at the end."""
        folder = self._path(f"{self.root}/session={session}")
        if not self._fs.exists(folder):
            raise KeyError(session)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if [int(n[:-5]) for n in names] != list(range(len(names))):
            raise DecisionError(f"{session}: entries are missing")
        rows = self.spark.read.schema("seq long, kind string, month long, action string, note string, at string, windows array<long>, months long").json([f"{folder.toString()}/{n}" for n in names])
        return [r.asDict() for r in rows.orderBy("seq").collect()]  # one session

    def start(self, session: str, windows: Sequence[int], months: int, at: str) -> None:
        if list(windows) != sorted(set(windows)) or any(not 0 <= w < months for w in windows):
            raise DecisionError(f"{session}: windows must be ascending months under {months}")
        self._place(session, 0, {"seq": 0, "kind": "start", "windows": list(windows), "months": months, "at": at})

    def state(self, session: str) -> dict:
        """``(next, revealed, decided, undecided, ceiling, active)``: up to where the next reveal may go follows from the first undecided window."""
        rows = self.entries(session)
        windows, months = rows[0]["windows"], rows[0]["months"]
        decided = {r["month"]: r["action"] for r in rows if r["kind"] == "decide"}
        undecided = [w for w in windows if w not in decided]
        revealed = max([0, *(r["month"] for r in rows if r["kind"] == "reveal")])
        return {"next": len(rows), "revealed": revealed, "decided": decided, "windows": windows, "undecided": undecided, "ceiling": undecided[0] + 1 if undecided else months, "active": bool(undecided) or revealed < months}

    def reveal(self, session: str, month: int, at: str) -> None:
        """Moves the pointer on: never back, and never beyond an undecided window."""
        s = self.state(session)
        if month < s["revealed"]:
            raise DecisionError(f"{session}: revealed up to {s['revealed']} already")
        if month > s["ceiling"]:
            raise DecisionError(f"{session}: month {month} lies beyond {s['ceiling']}, up to which may be revealed")
        self._place(session, s["next"], {"seq": s["next"], "kind": "reveal", "month": month, "at": at})

    def decide(self, session: str, month: int, action: str, at: str, note: str | None = None) -> None:
        """One decision, in order of the windows, of a month that is revealed; final."""
        s = self.state(session)
        if fault := _fault(month, action, self.actions, s["windows"], list(s["decided"]), s["revealed"]):
            raise DecisionError(f"{session}: {fault}")
        self._place(session, s["next"], {"seq": s["next"], "kind": "decide", "month": month, "action": action, "note": note, "at": at})

    def read(self) -> DataFrame:
        """All sessions' entries as a table."""
        return self.spark.read.schema(ENTRY).option("recursiveFileLookup", "false").json(f"{self.root}/session=*", pathGlobFilter="*.json").select(
            F.regexp_extract(F.col("_metadata.file_path"), r"/session=([^/]+)/", 1).alias("session"), "seq", "kind", "month", "action", "note", "at"
        )


def _fault(month: int | None, action: str | None, actions: Sequence[str], windows: Sequence[int], decided: Sequence[int], revealed: int | None) -> str | None:
    if action not in actions:
        return "unknown action"
    if month not in windows:
        return "not a window"
    if month in decided:
        return "already decided"
    if month != next(w for w in windows if w not in decided):
        return "out of order"
    return "not revealed" if revealed is not None and revealed < month + 1 else None


def judged(requests: DataFrame, windows: DataFrame, actions: Sequence[str], session: str = "session", order: str = "seq") -> DataFrame:
    """``(session, order, month, action, fault)`` of each requested decision, taken in order: null if it holds, else why it is refused.

    ``windows`` has one row ``(session, windows)`` with the ascending months. A request counts as decided only if it held; requests of a session without
    windows aren't windows of it. Requests of one place go by month and action. Rows stream by session, and only the session's windows and what it has decided are held.
    """
    kinds = dict(requests.dtypes)
    rows = requests.select(session, order, F.col("month").cast("long").alias("month"), F.col("action").cast("string").alias("action"))
    both = rows.join(windows.select(F.col(session).alias("_s"), F.col("windows").cast("array<long>").alias("_w")), F.col(session).eqNullSafe(F.col("_s")), "left").drop("_s")
    both = both.repartition(session).sortWithinPartitions(session, order, "month", "action")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, decided, begun = None, [], False
        for batch in batches:
            faults = []
            for key, month, action, months in zip(*(batch.column(c).to_pylist() for c in (session, "month", "action", "_w")), strict=True):
                if not begun or key != own:
                    own, decided, begun = key, [], True
                fault = _fault(month, action, actions, months or (), decided, None)
                if fault is None:
                    decided.append(month)
                faults.append(fault)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (session, order, "month", "action")], pa.array(faults, pa.string())], [session, order, "month", "action", "fault"])

    return both.mapInArrow(judge, f"`{session}` {kinds[session]}, `{order}` {kinds[order]}, month long, action string, fault string")


def ceilings(judgements: DataFrame, windows: DataFrame, session: str = "session") -> DataFrame:
    """``(session, decided, next_window, ceiling)``: how many decisions held, the first undecided window (null if none is left) and up to where may be revealed."""
    held = judgements.where("fault IS NULL").groupBy(F.col(session).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    both = windows.join(held, F.col(session).eqNullSafe(F.col("_s")), "left").withColumn("decided", F.coalesce("_n", F.lit(0)))
    nxt = F.get("windows", F.col("decided").cast("int"))
    return both.select(session, "decided", nxt.alias("next_window"), F.coalesce(nxt + 1, F.col("months")).alias("ceiling"))
