"""Requests by line: JSON-RPC over the serving queries, for one repository or several, and one run at a time with its log.

A reply holds a page of rows and, where there are more, a mark to ask for the next page with. Rows are ordered by the query's
own order and then by all other plain columns, and a page begins after the last row of the one before, so a result of any size
comes whole, page by page, and a page's filter on sorted tables prunes what comes before it.
"""

from __future__ import annotations

import inspect
import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from . import serve
from .generate import Run

PROTOCOL = "2024-11-05"
PARSE_ERROR, NO_METHOD, BAD_PARAMETERS, FAILED = -32700, -32601, -32602, -32603
#: Rows of a page at most.
MOST_ROWS = 1_000
KINDS = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Job:
    """One run at a time; status(since) gives the lines of its log from a position on."""

    log: list[str] = field(default_factory=list)
    running: bool = False
    error: str | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def start(self, work: Work, wait: bool = False) -> None:
        with self._lock:
            if self.running:
                raise Refused(409, "a run is going on")
            self.running, self.error = True, None
            self.log.clear()

        def run():
            try:
                work(self.log.append)
            except Exception as error:  # the job reports what stopped it
                self.error = f"{type(error).__name__}: {error}"
            finally:
                self.running = False

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        if wait:
            thread.join()

    def status(self, since: int = 0) -> dict:
        return {"running": self.running, "error": self.error, "lines": self.log[since:], "next": len(self.log)}


#: What a job does, given where it writes its log.
Work = Callable[[Callable[[str], None]], None]
RUN_TOOLS = {"start_run": "Makes a repository's tables and notes anew, one run at a time.", "run_status": "Whether a run goes on, what stopped it, and its log from a position on."}


def run_tools() -> list[dict]:
    properties = {"start_run": {"repo": {"type": "string"}}, "run_status": {"repo": {"type": "string"}, "since": {"type": "integer"}}}
    return [{"name": n, "description": said, "inputSchema": {"type": "object", "properties": properties[n], "required": []}} for n, said in RUN_TOOLS.items()]


def tools() -> list[dict]:
    """Name, description and parameters of every serving query."""
    out = [{"name": "list_repos", "description": "The repositories that are served.", "inputSchema": {"type": "object", "properties": {}}}]
    for name, f in sorted(serve.TOOLS.items()):
        parameters = {k: p for k, p in inspect.signature(f).parameters.items() if k != "made"}
        properties = {k: {"type": KINDS.get(str(p.annotation).split(" | ")[0], "string")} for k, p in parameters.items()} | {"repo": {"type": "string"}, "page": {"type": "integer"}, "after": {"type": "string"}}
        required = [k for k, p in parameters.items() if p.default is inspect.Parameter.empty]
        out.append({"name": name, "description": (f.__doc__ or name).strip(), "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


def chosen(repositories: dict[str, tuple[str, Run]], alias: str | None) -> dict[str, Run]:
    """The runs of an alias, of several with commas, or with "*" of all; without an alias that of the only repository."""
    if alias is None and len(repositories) == 1:
        return {k: run for k, (_, run) in repositories.items()}
    wanted = list(repositories) if alias == "*" else (alias or "").split(",")
    if any(a not in repositories for a in wanted):
        raise Refused(BAD_PARAMETERS, f"no repository {alias!r}; there are {', '.join(repositories)}")
    return {a: repositories[a][1] for a in wanted}


def asked(runs: dict[str, Run], name: str, parameters: dict) -> DataFrame:
    """The rows of a query; of several repositories those of each, with a column repo, and no table of any other is read."""
    found = [serve.call(run, name, **parameters).withColumn("repo", F.lit(alias)) for alias, run in runs.items()]
    if len(found) == 1:
        return found[0].drop("repo")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def page_of(found: DataFrame, order: list[tuple[str, bool]], after: list | None, size: int) -> tuple[list[dict], list | None]:
    """A page of rows and the mark of the next one. order: columns and whether they ascend; a mark: the last row's keys, and how many rows equal to it came."""
    plain = [f.name for f in found.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    order = [(c, up) for c, up in order if c in plain]
    keys = order + [(c, True) for c in plain if c not in dict(order)]
    last, seen = after or (None, 0)
    if last is not None:
        later, same = F.lit(False), F.lit(True)
        for (c, up), value in zip(keys, last, strict=True):
            own = F.lit(value).cast(found.schema[c].dataType)
            beyond = (F.col(c).isNotNull() if value is None else F.col(c) > own) if up else (F.lit(False) if value is None else F.col(c).isNull() | (F.col(c) < own))
            later, same = later | (same & F.coalesce(beyond, F.lit(False))), same & F.col(c).eqNullSafe(own)
        found = found.where(later | same)
    sort = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]
    marked = found.orderBy(*sort).limit(seen + size + 1).select(F.to_json(F.struct("*")).alias("row"), F.array(*(F.col(c).cast("string") for c, _ in keys)).alias("key"))
    rows = [(json.loads(r["row"]), list(r["key"])) for r in marked.collect()][seen:]
    if len(rows) <= size:
        return [r for r, _ in rows], None
    end, here = rows[size - 1][1], [k for _, k in rows[:size]]
    return [r for r, _ in rows[:size]], [end, sum(k == end for k in here) + (seen if end == last else 0)]


def called(repositories: dict[str, tuple[str, Run]], name: str, arguments: dict) -> dict:
    if name == "list_repos":
        return {"count": len(repositories), "repos": [{"alias": k, "root": root} for k, (root, _) in repositories.items()]}
    if name not in serve.TOOLS:
        raise Refused(NO_METHOD, f"no query {name!r}")
    own = {k: v for k, v in arguments.items() if k not in ("repo", "page", "after")}
    try:
        inspect.signature(serve.TOOLS[name]).bind(None, **own)
        size = min(MOST_ROWS, max(1, int(arguments.get("page", MOST_ROWS))))
        after = json.loads(arguments["after"]) if arguments.get("after") else None
        found = asked(chosen(repositories, arguments.get("repo")), name, own)
    except (TypeError, ValueError) as error:
        raise Refused(BAD_PARAMETERS, str(error)) from error
    rows, mark = page_of(found, serve.ORDER.get(name, []), after, size)
    return {"count": len(rows), "more": mark is not None, "next": mark and json.dumps(mark), "rows": rows}


def run_asked(runs: dict[str, tuple[Job, Work]], name: str, arguments: dict) -> dict:
    """Starts the run of a repository, or tells how it goes; since: the position in its log to tell from."""
    alias = arguments.get("repo") or (next(iter(runs)) if len(runs) == 1 else None)
    if alias not in runs:
        raise Refused(BAD_PARAMETERS, f"no repository {alias!r}; there are {', '.join(runs)}")
    job, work = runs[alias]
    if name == "start_run":
        job.start(work)
    try:
        return job.status(max(0, int(arguments.get("since", 0))))
    except (TypeError, ValueError) as error:
        raise Refused(BAD_PARAMETERS, str(error)) from error


def answered(repositories: dict[str, tuple[str, Run]], line: str, runs: dict[str, tuple[Job, Work]] | None = None) -> str | None:
    """The reply to one line; None to a notification or an empty line. runs: the repositories whose tables a request may have made anew."""
    if not line.strip():
        return None
    identity = None
    try:
        try:
            request = json.loads(line)
            identity, method, parameters = request.get("id"), request["method"], request.get("params") or {}
        except (ValueError, AttributeError, KeyError) as error:
            raise Refused(PARSE_ERROR, "not a request") from error
        if method.startswith("notifications/") or method == "initialized":
            return None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "strataloom", "version": "1.0.0"}}
        elif method == "tools/list":
            result = {"tools": tools() + (run_tools() if runs else [])}
        elif method == "tools/call":
            name, arguments = parameters.get("name", ""), parameters.get("arguments") or {}
            found = run_asked(runs, name, arguments) if runs and name in RUN_TOOLS else called(repositories, name, arguments)
            result = {"content": [{"type": "text", "text": json.dumps(found, indent=2)}]}
        else:
            raise Refused(NO_METHOD, f"no method {method!r}")
        return json.dumps({"jsonrpc": "2.0", "id": identity, "result": result})
    except Refused as error:
        return json.dumps({"jsonrpc": "2.0", "id": identity, "error": {"code": error.code, "message": str(error)}})
    except Exception as error:  # a failed query must not end the server
        return json.dumps({"jsonrpc": "2.0", "id": identity, "error": {"code": FAILED, "message": f"{type(error).__name__}: {error}"[:500]}})
