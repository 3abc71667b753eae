"""Sessions: commands in, results out, with history, named sets, undo and SQL.

Result sets are Parquet tables in the session's folder, and so is the log, a small JSON file: the
folder may be on any file system that Spark knows. Names, history and saved sets survive a
restart; a THAT that was not saved is replayed from its commands.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import TABLES, GraphHeap
from .operators import reports
from .plans import lower
from .plans.ast import Command, Complete, Incomplete, Invalid, Pipeline
from .plans.parser import parse
from .storage import read_text, write_text

SHOWN_ROWS = 10
_SQL = re.compile(r"(select|with)\b", re.IGNORECASE)
_HISTORY = re.compile(r"[hst](\d+)", re.IGNORECASE)


@dataclass
class SetResult:
    ids: DataFrame
    rows: DataFrame


@dataclass
class TableResult:
    name: str
    rows: DataFrame


@dataclass
class ScalarResult:
    rows: DataFrame


@dataclass
class VoidResult:
    info: dict


@dataclass
class ErrorResult:
    error: str


Result = SetResult | TableResult | ScalarResult | VoidResult | ErrorResult


@dataclass
class Entry:
    id: int
    command: str
    timestamp: int
    set_path: str | None = None
    table_path: str | None = None
    input1: int | None = None
    input2: int | None = None
    kind: str = "query"
    undone: bool = False


class Session:
    def __init__(self, heap: GraphHeap, folder: str):
        self.heap, self.spark = heap, heap.spark
        self.folder = str(folder).rstrip("/")
        self.log = f"{self.folder}/session.json"
        self.history: list[Entry] = []
        self.bindings: dict[str, int] = {}
        self.that: int | None = None
        self._live: dict[int, DataFrame] = {}
        if (found := read_text(self.spark, self.log)) is not None:
            state = json.loads(found)
            self.history = [Entry(**e) for e in state["history"]]
            self.bindings = state["names"]
            self.that = state["that"]
            if (entry := self._entry(self.that)) and not entry.set_path and not entry.table_path:
                self._live[entry.id] = self._replayed(entry)
        self._views()

    # state

    def _save(self) -> None:
        state = {"history": [asdict(e) for e in self.history], "names": self.bindings, "that": self.that}
        write_text(self.spark, self.log, json.dumps(state))

    def _views(self) -> None:
        """Base tables, named sets, history and names as views for SQL."""
        for name in TABLES:
            getattr(self.heap, name).createOrReplaceTempView(name)
        rows = [(e.id, e.command, e.timestamp, e.set_path, e.table_path, e.input1, e.input2) for e in self.history]
        schema = "id bigint, command string, timestamp bigint, bitset_file string, sql_table string, input1 bigint, input2 bigint"
        self.spark.createDataFrame(rows, schema).createOrReplaceTempView("history")
        self.spark.createDataFrame(sorted(self.bindings.items()), "name string, history_id bigint").createOrReplaceTempView("names")
        for name, n in self.bindings.items():
            entry = self._entry(n)
            if entry and (entry.set_path or entry.table_path):
                self._rows(entry).createOrReplaceTempView(name)
        for entry in self.history:
            if entry.table_path:
                self._rows(entry).createOrReplaceTempView(f"t{entry.id}")

    def _rows(self, entry: Entry) -> DataFrame:
        return self.spark.read.parquet(entry.table_path or entry.set_path)

    def _entry(self, n: int | None) -> Entry | None:
        return next((e for e in self.history if e.id == n), None)

    def _record(self, text: str, **more) -> Entry:
        entry = Entry(len(self.history) + 1, text, int(time.time() * 1000), **more)
        self.history.append(entry)
        return entry

    def _replayed(self, entry: Entry) -> DataFrame:
        """The set of an entry that was not kept, from its command; its THAT is the entry's first input."""
        parsed = parse(entry.command)
        assert isinstance(parsed, Complete) and isinstance(parsed.query, Pipeline)
        ids = lower.id_set(self.heap, parsed.query, lambda name: self._kept(self._entry(entry.input1)) if name == "THAT" else self.resolve(name))
        t = parsed.query.terminal
        return reports.top(self.heap, ids, t.n, t.by, smallest=t.kind == "bottom").select("id") if t.kind in ("top", "bottom") else ids

    def _kept(self, entry: Entry | None) -> DataFrame:
        if entry is None:
            raise lower.Unresolved("THAT is empty")
        return self.spark.read.parquet(entry.set_path) if entry.set_path else self._replayed(entry)

    def _persist(self, n: int) -> None:
        """Write a set once, when it gets a name."""
        entry = self._entry(n)
        if entry.set_path is None and entry.table_path is None and n in self._live:
            path = f"{self.folder}/sets/{n}"
            self._live[n].write.parquet(path)
            entry.set_path = path

    @property
    def prompt(self) -> str:
        return f"s{self.that}>" if self.that else ">"

    # names

    def resolve(self, name: str) -> DataFrame:
        """The set of THAT, of a name of the user's, or of a history entry (h3, s3)."""
        if name == "THAT":
            n = self.that
            if n is None:
                raise lower.Unresolved("THAT is empty")
        elif name in self.bindings:
            n = self.bindings[name]
        elif m := _HISTORY.fullmatch(name):
            n = int(m[1])
        else:
            raise lower.Unresolved(f"Unknown name: {name}")
        if n in self._live:
            return self._live[n]
        entry = self._entry(n)
        if entry is None:
            raise lower.Unresolved(f"No history entry {n}")
        if entry.table_path:
            raise lower.Unresolved(f"t{n} is a table: query it with SQL SELECT")
        if entry.set_path:
            return self.spark.read.parquet(entry.set_path)
        raise lower.Unresolved(f"The set of history entry {n} was not kept: run it again, or name it with CALL")

    # commands

    def execute(self, text: str) -> Result:
        text = text.strip()
        try:
            if not text:
                return self._that()
            if _SQL.match(text):
                return self._sql(text)
            parsed = parse(text)
            if isinstance(parsed, Invalid):
                return ErrorResult(parsed.message)
            if isinstance(parsed, Incomplete):
                return ErrorResult(f"incomplete, expected {', '.join(parsed.completions)}")
            assert isinstance(parsed, Complete)
            return self._pipeline(text, parsed.query) if isinstance(parsed.query, Pipeline) else self._command(text, parsed.query)
        except (lower.Unresolved, ValueError) as wrong:
            return ErrorResult(str(wrong))
        finally:
            self._save()

    def _pipeline(self, text: str, plan: Pipeline) -> Result:
        ids = lower.id_set(self.heap, plan, self.resolve)
        t = plan.terminal
        entry = self._record(text, input1=self.that)
        if t.kind == "count":
            return ScalarResult(reports.count(ids))
        if t.kind in ("sum", "max"):
            return ScalarResult(reports.aggregate(self.heap, ids, t.kind, t.by))
        if t.kind == "group":
            return ScalarResult(reports.by_class(self.heap, ids, t.n or None))
        if t.kind == "sample":
            rows = reports.sample(self.heap, ids, t.n)
        else:
            rows = reports.top(self.heap, ids, t.n, t.by, smallest=t.kind == "bottom")
        kept = rows.select("id") if t.kind in ("top", "bottom") else ids
        self._live[entry.id], self.that = kept, entry.id
        return SetResult(kept, rows)

    def _that(self) -> Result:
        if self.that is None:
            return ErrorResult("THAT is empty")
        entry = self._entry(self.that)
        if entry.table_path:
            return TableResult(f"t{entry.id}", self._rows(entry))
        ids = self.resolve("THAT")
        return SetResult(ids, reports.top(self.heap, ids, SHOWN_ROWS))

    def _sql(self, text: str) -> Result:
        self._views()
        rows = self.spark.sql(text)
        entry = self._record(text)
        path = f"{self.folder}/tables/{entry.id}"
        rows.write.parquet(path)
        entry.table_path, self.that = path, entry.id
        rows = self.spark.read.parquet(path)
        rows.createOrReplaceTempView(f"t{entry.id}")
        return TableResult(f"t{entry.id}", rows)

    def _command(self, text: str, c: Command) -> Result:
        if c.kind == "that":
            return self._that()
        if c.kind == "recall":
            return self._recall(c.n)
        if c.kind == "names":
            regex = re.compile(".*".join(re.escape(p) for p in c.name.split("*")))
            return VoidResult({"names": [{"name": k, "histId": v} for k, v in sorted(self.bindings.items()) if regex.fullmatch(k)]})
        if c.kind == "history":
            return VoidResult({"history": [{"id": e.id, "command": e.command, "timestamp": e.timestamp} for e in reversed(self.history[-c.n :])]})
        if c.kind == "explain_name":
            return self._provenance(c.name)
        if c.kind == "undo":
            return self._undo()
        if c.kind in ("call_that", "call"):
            n = self.that if c.kind == "call_that" else c.n
            if n is None:
                return ErrorResult("THAT is empty")
            if self._entry(n) is None:
                return ErrorResult(f"No history entry {n}")
            self._persist(n)
            self._record(text, kind="call", input1=n, input2=self.bindings.get(c.name))
            self.bindings[c.name] = n
            return VoidResult({"name": c.name, "histId": n})
        if c.kind == "forget":
            self._record(text, kind="forget", input2=self.bindings.pop(c.name, None))
            return VoidResult({"forgot": c.name})
        make = {
            "summary": lambda: reports.summary(self.heap), "classes": lambda: reports.class_counts(self.heap, c.name), "explain": lambda: reports.explain(self.heap, c.n),
            "inspect": lambda: reports.inspect(self.heap, c.n), "read": lambda: reports.read(self.heap, c.n),
        }[c.kind]
        self._record(text)
        return ScalarResult(make())

    def _recall(self, n: int) -> Result:
        entry = self._entry(n)
        if entry is None:
            return ErrorResult(f"No history entry {n}")
        if entry.table_path:
            return TableResult(f"t{n}", self._rows(entry))
        if n in self._live or entry.set_path:
            ids = self.resolve(f"h{n}")
            return SetResult(ids, reports.top(self.heap, ids, SHOWN_ROWS))
        return self.execute(entry.command)

    def _provenance(self, name: str) -> Result:
        n = self.bindings.get(name)
        if n is None and (m := _HISTORY.fullmatch(name)):
            n = int(m[1])
        entry = self._entry(n)
        if entry is None:
            return ErrorResult(f"Unknown name: {name}")
        kind = "table" if entry.table_path else "bitset" if entry.set_path or n in self._live else "other"
        out = {"name": name, "histId": n, "type": kind, "command": entry.command}
        used = [w for w in re.findall(r"[A-Za-z_]\w*", entry.command) if w in self.bindings or _HISTORY.fullmatch(w)]
        return VoidResult(out | ({"derivedFrom": used} if used else {}))

    def _undo(self) -> Result:
        """Take back the newest CALL or FORGET that is not undone yet."""
        entry = next((e for e in reversed(self.history) if e.kind in ("call", "forget") and not e.undone), None)
        if entry is None:
            return ErrorResult("Nothing to undo")
        name = entry.command.split()[-1]
        if entry.input2 is not None:
            self.bindings[name] = entry.input2
        else:
            self.bindings.pop(name, None)
        entry.undone = True
        self._record("UNDO")
        return VoidResult({"undone": entry.command})


def collected(rows: DataFrame) -> list[dict]:
    """Rows as dicts, object ids as i<n>."""
    as_id = [F.concat(F.lit("i"), F.col(c)).alias(c) if c in ("id", "ref") else F.col(f"`{c}`") for c in rows.columns]
    return [r.asDict(recursive=True) for r in rows.select(*as_id).collect()]
