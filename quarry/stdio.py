"""The engine's four tools over standard input and output, a JSON-RPC 2.0 message a line.

python -m quarry.stdio CORPUS   (a folder of Parquet, or a JSON array)
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from dataclasses import fields
from typing import Any, TextIO

from quarry.operators.support import Ask
from quarry.plans.engine import NAME, VERSION, Engine, encoded

PROTOCOL = "2024-11-05"
BAD_REQUEST, NO_METHOD, BAD_PARAMS = -32600, -32601, -32602


def _text(*names: str) -> dict[str, Any]:
    return {n: {"type": "string"} for n in names}


def _supporting(engine: Engine, a: dict[str, Any]) -> dict[str, Any]:
    known = {f.name for f in fields(Ask)}
    return engine.find_supporting(Ask(**{k: v for k, v in a.items() if k in known}), a.get("limit"))


#: Name, what it does, parameters, those that must be given, and the call.
TOOLS: dict[str, tuple[str, dict[str, Any], list[str], Callable[[Engine, dict[str, Any]], dict[str, Any]]]] = {
    "search": ("Finds inquiries by words and filters.", {**_text("query"), "limit": {"type": "integer"}, "offset": {"type": "integer"}, "filters": {"type": "object"}}, [], lambda e, a: e.search(a.get("query"), a.get("limit"), a.get("offset", 0), a.get("filters"))),
    "get": ("Reads one inquiry by its id.", _text("id"), ["id"], lambda e, a: e.get(a["id"])),
    "list_recent": ("Lists the newest inquiries, from a date on.", {**_text("since"), "limit": {"type": "integer"}}, [], lambda e, a: e.list_recent(a.get("since"), a.get("limit"))),
    "find_supporting": ("Ranks inquiries that support a line item, with the parts of their scores.", {**_text("query", "now", "vehicle_make", "vehicle_model"), "vehicle_year": {"type": "integer"}, "limit": {"type": "integer"}}, ["query", "now"], _supporting),
}


def answer(engine: Engine, message: Any) -> dict[str, Any] | None:
    """The reply to a message; none to a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": BAD_REQUEST, "message": "no request"}}
    if "id" not in message:
        return None
    method, params = message["method"], message.get("params") or {}
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "serverInfo": {"name": NAME, "version": VERSION}, "capabilities": {"tools": {}}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        listed = [{"name": n, "description": engine.describe(t[0]), "inputSchema": {"type": "object", "properties": t[1], "required": t[2]}} for n, t in TOOLS.items()]
        return reply | {"result": {"tools": listed}}
    if method != "tools/call":
        return reply | {"error": {"code": NO_METHOD, "message": f"no method {method}"}}
    tool, given = TOOLS.get(params.get("name")), params.get("arguments") or {}
    if tool is None or any(n not in given for n in tool[2]):
        return reply | {"error": {"code": BAD_PARAMS, "message": "no such tool" if tool is None else f"needed: {', '.join(tool[2])}"}}
    try:
        both = encoded(tool[3](engine, given))
    except Exception as error:  # noqa: BLE001  a failing call is an answer, not the end of the server
        return reply | {"result": {"isError": True, "content": [{"type": "text", "text": str(error)}]}}
    return reply | {"result": {"content": [{"type": "text", "text": both["text"]}], "structuredContent": json.loads(json.dumps(both["structured"], default=str))}}


def serve(engine: Engine, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            message = None
        reply = answer(engine, message)
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def main(argv: list[str]) -> int:
    from quarry.session import session
    from quarry.sources import tables

    if len(argv) != 1:
        print(__doc__, file=sys.stderr)
        return 1
    spark = session("stdio")
    corpus = tables.corpus_file(spark, argv[0]) if argv[0].endswith(".json") else tables.opened(spark, argv[0], tables.SERVED)
    serve(Engine(corpus.cache()), sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
