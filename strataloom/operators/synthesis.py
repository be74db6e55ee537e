"""The language-model edge: tolerant JSON, checked replies, retries, merging. The model is an injected callable; none is called here."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import rules
from ..functions.storage import spread

EVIDENCE_KINDS = ("code", "git", "test", "graph", "comment", "doc")
DELAYS = (1.0, 2.0, 4.0)
_transient = re.compile(r"429|rate limit|timeout|network|ECONNRESET|ETIMEDOUT", re.IGNORECASE)
#: Of a call: what the reply says it cost, the time it took, and what kept its reply from being used.
CALL = "struct<cost:double,duration_ms:bigint,error:string>"
_CALL = pa.field("call", pa.struct([("cost", pa.float64()), ("duration_ms", pa.int64()), ("error", pa.string())]))
FIELD = "struct<observed:array<string>,inferred:array<string>,confidence:double,evidence:array<struct<type:string,detail:string>>>"


#: What counts between braces: a whole string with its escapes (one that is not closed goes to the end), or a brace.
_mark = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}]', re.DOTALL)


def _objects(text: str):
    """The balanced {...} of a text, strings and their escapes honoured."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth = 0
        for m in _mark.finditer(text, start):
            if m[0] in "{}":
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    yield text[start : m.end()]
                    break


def parsed_json(text: str):
    """The JSON of a reply: as it is, else without a code fence, else its first object that parses; ValueError without one."""
    fenced = re.search(r"```(?:json)?\s*\n?(.*?)```", text, re.DOTALL)
    for candidate in (text.strip(), *([fenced[1].strip()] if fenced else []), *_objects(text)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    raise ValueError("no JSON in the reply")


def checked_note(value) -> dict:
    """A reply as six fields: lists default to empty, unknown evidence kinds become code, confidence from 0 to 1 is required."""
    out = {}
    for name in rules.NOTE_FIELDS:
        own = value.get(name) if isinstance(value, dict) else None
        if not isinstance(own, dict) or not isinstance(own.get("confidence"), (int, float)) or isinstance(own["confidence"], bool) or not 0 <= own["confidence"] <= 1:
            raise ValueError(f"{name} has no confidence from 0 to 1")
        lists = {k: [str(x) for x in own.get(k) or []] for k in ("observed", "inferred")}
        evidence = [{"type": e.get("type") if e.get("type") in EVIDENCE_KINDS else "code", "detail": str(e.get("detail", ""))} for e in own.get("evidence") or [] if isinstance(e, dict)]
        out[name] = {**lists, "confidence": float(own["confidence"]), "evidence": evidence}
    return out


def merged_field(static: dict, reply: dict) -> dict:
    """Observed from the static note, inferred and evidence of the reply that are not in it, the reply's confidence."""
    fold = lambda x: x.strip().lower()
    seen, had = {fold(x) for x in static["observed"]}, {fold(e["detail"]) for e in static["evidence"]}
    return {
        "observed": static["observed"], "inferred": [x for x in reply["inferred"] if fold(x) not in seen], "confidence": reply["confidence"],
        "evidence": [*static["evidence"], *(e for e in reply["evidence"] if fold(e["detail"]) not in had)],
    }


def is_transient(error: Exception) -> bool:
    return bool(_transient.search(str(error)))


def with_retry(call: Callable[[], str], delays: tuple[float, ...] = DELAYS, sleep=time.sleep) -> str:
    """The call's result; after a transient error once more after each delay, other errors at once."""
    for delay in (*delays, None):
        try:
            return call()
        except Exception as error:
            if delay is None or not is_transient(error):
                raise
            sleep(delay)
    raise AssertionError


def told(reply, model: str, took: int) -> tuple[str, str, dict]:
    """Text, model and call of a reply: a text, or a mapping with content and maybe model and usage (cost, duration_ms)."""
    if isinstance(reply, str):
        return reply, model, {"cost": None, "duration_ms": took, "error": None}
    used = reply.get("usage") or {}
    cost, lasted = used.get("cost"), used.get("duration_ms")
    return reply["content"], reply.get("model") or model, {"cost": None if cost is None else float(cost), "duration_ms": took if lasted is None else int(lasted), "error": None}


def synthesised(notes: DataFrame, complete: Callable[[str], str | dict], model: str, timeout: float = 30.0, parallel: int = 5, delays: tuple[float, ...] = DELAYS) -> DataFrame:
    """notes (path, prompt, six fields, model) with each field merged with the model's reply, and the call (CALL); on any failure the static note stays.

    Calls of a batch run side by side, at most `parallel` at a time in a task; a row is idempotent, so a task can be run again.
    """
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema), f"call {CALL}"])

    def one(row: dict) -> dict:
        began, call = time.monotonic(), {"cost": None, "duration_ms": None, "error": None}
        try:
            answer = with_retry(lambda: complete(row["prompt"]), delays)
            text, name, call = told(answer, model, int((time.monotonic() - began) * 1000))
            reply = checked_note(parsed_json(text))
        except Exception as error:
            return {**row, "call": {**call, "error": f"{type(error).__name__}: {error}"[:500]}}
        return {**row, **{n: merged_field(row[n], reply[n]) for n in rules.NOTE_FIELDS}, "model": name, "call": call}

    def run(batches):
        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                rows = batch.to_pylist()
                waiting, out = [pool.submit(one, r) for r in rows], []
                for r, w in zip(rows, waiting, strict=True):
                    try:
                        out.append(w.result(timeout))
                    except Late:
                        out.append({**r, "call": {"cost": None, "duration_ms": int(timeout * 1000), "error": "no reply in time"}})
                yield pa.RecordBatch.from_pylist(out, pa.schema([*batch.schema, _CALL]))

    return spread(notes, notes.columns[0]).mapInArrow(run, ddl)
