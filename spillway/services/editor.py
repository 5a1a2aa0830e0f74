"""Editors and tool callers as message handlers over the engine (SRC-25, SRC-26, STR-01).

handle() takes a decoded JSON-RPC message and gives the messages to send; how they travel is
the caller's.  Documents are kept as they last were; a burst of changes is one scan, of the
last text, when flush() is called after the quiet time.
"""

from __future__ import annotations

from collections.abc import Callable

from spillway.detect import model as M
from spillway.detect.kernel import Scanner

LEVEL = {"critical": 1, "high": 1, "medium": 2}


class Documents:
    """An editor's open documents and their diagnostics."""

    def __init__(self, scanner: Scanner | None = None):
        self.scanner, self.texts, self.stale = scanner or Scanner(), {}, {}

    def diagnostics(self, uri: str) -> list[dict]:
        text = self.texts.get(uri, "")
        lines = text.split("\n")
        out = []
        for f in self.scanner.scan(text, uri, "file"):
            if f.line < 1:
                continue
            line = lines[f.line - 1].encode()
            at = len(line[: f.col - 1].decode("utf-8", "ignore").encode("utf-16-le")) // 2
            end = at + len(f.value.split("\n")[0].encode("utf-16-le")) // 2
            out.append({"range": {"start": {"line": f.line - 1, "character": at}, "end": {"line": f.line - 1, "character": end}}, "severity": LEVEL.get(f.severity, 3), "source": "spillway", "message": f"{f.type}: {M.redact(f.value)}"})
        return out

    def _shown(self, uri: str, found: list[dict]) -> dict:
        return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": found}}

    def handle(self, message: dict) -> list[dict]:
        method, given = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return [{"jsonrpc": "2.0", "id": message.get("id"), "result": {"capabilities": {"textDocumentSync": {"openClose": True, "change": 1, "save": {"includeText": True}}}}}]
        if method == "shutdown":
            return [{"jsonrpc": "2.0", "id": message.get("id"), "result": None}]
        doc = given.get("textDocument") or {}
        uri = doc.get("uri")
        if method == "textDocument/didOpen":
            self.texts[uri] = doc.get("text", "")
            return [self._shown(uri, self.diagnostics(uri))]
        if method == "textDocument/didChange" and uri in self.texts:
            for change in given.get("contentChanges", []):
                self.texts[uri] = change.get("text", "")
            self.stale[uri] = True
            return []
        if method == "textDocument/didSave" and uri in self.texts:
            self.texts[uri] = given.get("text", self.texts[uri])
            self.stale.pop(uri, None)
            return [self._shown(uri, self.diagnostics(uri))]
        if method == "textDocument/didClose":
            self.texts.pop(uri, None)
            self.stale.pop(uri, None)
            return [self._shown(uri, [])]
        return [{"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}}] if "id" in message else []

    def flush(self) -> list[dict]:
        """Diagnostics of the documents that were edited since they were last scanned."""
        uris, self.stale = list(self.stale), {}
        return [self._shown(uri, self.diagnostics(uri)) for uri in uris]


def _text(name: str, what: str, **fields: str) -> dict:
    return {"name": name, "description": what, "inputSchema": {"type": "object", "properties": {k: {"type": "string", "description": v} for k, v in fields.items()}, "required": list(fields)}}


TOOLS = [
    _text("scan_text", "Findings of a text", text="what to scan", path="its path"),
    _text("scan_folder", "Findings of the files of a folder", path="the folder"),
    _text("scan_package", "Findings of a mobile package", path="the file"),
    _text("scan_history", "Findings of every blob of a repository", path="its folder"),
]


def handle(message: dict, call: Callable[[str, dict], object]) -> dict | None:
    """The answer to a tool caller's message; call(name, arguments) does the work, and its failure is the tool's answer."""
    method, id = message.get("method"), message.get("id")
    if id is None:
        return None
    if method == "initialize":
        return {"jsonrpc": "2.0", "id": id, "result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "spillway", "version": "1"}}}
    if method == "tools/list":
        return {"jsonrpc": "2.0", "id": id, "result": {"tools": TOOLS}}
    if method == "tools/call":
        given = message.get("params") or {}
        tool = next((t for t in TOOLS if t["name"] == given.get("name")), None)
        missing = [k for k in tool["inputSchema"]["required"] if not isinstance((given.get("arguments") or {}).get(k), str)] if tool else []
        if tool is None or missing:
            return {"jsonrpc": "2.0", "id": id, "error": {"code": -32602, "message": f"missing: {', '.join(missing)}" if tool else "no such tool"}}
        try:
            content, bad = str(call(tool["name"], given["arguments"])), False
        except Exception as e:  # told to the caller, who goes on
            content, bad = f"{type(e).__name__}: {e}", True
        return {"jsonrpc": "2.0", "id": id, "result": {"content": [{"type": "text", "text": content}], "isError": bad}}
    return {"jsonrpc": "2.0", "id": id, "error": {"code": -32601, "message": f"no method {method}"}}
