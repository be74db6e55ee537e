"""Facts of source files by language: imports, exports with signatures, hooks, environment variables, calls, comments.

A parser is a function (text, options) -> dict, registered by suffix and run in Arrow batches; what one raises leaves an empty
row with the error. Options carry the settings' own call patterns and packages, and the Go module that a file lies in. TypeScript goes through a small scanner that blanks comments and strings of the same length, so declarations are
found by pattern at brace depth 0 and read back from the original text. Types that are not written are not inferred.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..functions.storage import spread
from .governance import ancestors

DETAIL = "array<struct<name:string,signature:string,kind:string,doc_comment:string>>"
FACTS = (
    "imports array<string>, local_imports array<string>, external_imports array<string>, exports array<string>, "
    f"export_details {DETAIL}, symbols array<string>, hooks array<string>, env_vars array<string>, api_calls array<string>, "
    "comments struct<todo:array<string>,fixme:array<string>,hack:array<string>,invariant:array<string>,decision:array<string>>, "
    "has_side_effects boolean, signatures array<string>, error string"
)


@dataclass(frozen=True)
class Options:
    """call_patterns and packages count beside the fixed ones; a pattern that does not compile is left out."""

    call_patterns: tuple[str, ...] = ()
    packages: tuple[str, ...] = ()
    module: str | None = None


PARSERS: dict[str, Callable[[str, Options], dict]] = {}


def parser(*suffixes: str):
    def register(f):
        PARSERS.update(dict.fromkeys(suffixes, f))
        return f

    return register


def empty() -> dict:
    lists = {k: [] for k in ("imports", "local_imports", "external_imports", "exports", "export_details", "symbols", "hooks", "env_vars", "api_calls", "signatures")}
    return lists | {"comments": {tag: [] for tag, _ in rules.COMMENT_TAGS}, "has_side_effects": False, "error": None}


def once(found) -> list:
    return list(dict.fromkeys(found))


def groups(pattern: str, text: str, flags: int = re.MULTILINE) -> list[str]:
    """The first group that is not empty of each match."""
    return [g for m in re.finditer(pattern, text, flags | re.ASCII) if (g := next((x for x in m.groups() if x), None))]


def called(text: str, more: tuple[str, ...] = ()) -> list[str]:
    return once(groups("|".join(f"(?:{p})" for p in (*rules.API_CALLS, *usable(more))), text))


def usable(patterns: tuple[str, ...]) -> tuple[str, ...]:
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return tuple(out)


def side_effects(imports: list[str], more: tuple[str, ...] = ()) -> bool:
    own = [i.lower() for i in imports]
    return any(p.lower() in i for p in (*rules.SIDE_EFFECT_PACKAGES, *more) for i in own)


def tagged(text: str, marker: str) -> dict:
    """Comment lines by their tag; a // comment wants a colon or white space after invariant and decision words."""
    out = {tag: [] for tag, _ in rules.COMMENT_TAGS}
    for line in text.split("\n"):
        at = re.search(r"//|^\s*\*|/\*" if marker == "//" else "#", line)
        if not at:
            continue
        said = line[at.start() :].strip()
        for tag, words in rules.COMMENT_TAGS:
            after = r"[:\s]" if marker == "//" and tag in ("invariant", "decision") else r"\b"
            if re.search(rf"\b(?:{words}){after}", said, re.IGNORECASE):
                out[tag].append(re.sub(r"^(?://+|/\*+|\*+|#+)\s*|\s*\*/$", "", said).strip())
                break
    return out


@parser(".py")
def python(text: str, options: Options = Options()) -> dict:
    imports = once(groups(r"^import\s+([\w.]+)|^from\s+(\.*[\w.]*)\s+import\b", text))
    local = [i for i in imports if i.startswith(".")]
    external = [i for i in imports if not i.startswith(".")]
    names = once(groups(r"^(?:async\s+def|def|class)\s+([A-Za-z]\w*)", text))
    listed = re.search(r"__all__\s*=\s*\[([^\]]*)\]", text)
    exports = [n for n in names if n in re.findall(r"['\"](\w+)['\"]", listed[1])] if listed else names
    details = []
    rows = text.split("\n")
    for k, row in enumerate(rows):
        f = re.match(r"(async\s+)?def\s+([A-Za-z]\w*)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?", row)
        c = re.match(r"class\s+([A-Za-z]\w*)(?:\(([^)]*)\))?", row)
        if f and f[2] in exports:
            said = f"{'async ' if f[1] else ''}def {f[2]}({f[3].strip()})" + (f" -> {f[4].strip()}" if f[4] else "")
            details.append({"name": f[2], "signature": said, "kind": "function", "doc_comment": _docstring(rows[k + 1 : k + 4])})
        elif c and c[1] in exports:
            said = f"class {c[1]}" + (f"({c[2].strip()})" if (c[2] or "").strip() else "")
            details.append({"name": c[1], "signature": said, "kind": "class", "doc_comment": _docstring(rows[k + 1 : k + 4])})
    environment = once(groups(r"os\.environ(?:\.get)?\s*\[\s*['\"]([A-Z_][A-Z0-9_]*)['\"]|os\.getenv\s*\(\s*['\"]([A-Z_][A-Z0-9_]*)['\"]", text))
    requests = groups(r"(?:requests|httpx|aiohttp)\s*\.\s*(?:get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]", text)
    return empty() | {
        "imports": imports, "local_imports": local, "external_imports": external, "exports": exports, "export_details": details,
        "symbols": once(groups(r"^(?:async\s+def|def|class)\s+(\w+)", text)), "env_vars": environment, "api_calls": once([*requests, *called(text, options.call_patterns)]), "comments": tagged(text, "#"),
        "has_side_effects": side_effects(external, options.packages) or bool(re.search(r"\b(sentry|datadog|mixpanel|firebase|analytics)\b", text, re.IGNORECASE)), "signatures": [d["signature"] for d in details],
    }


def _docstring(rows: list[str]) -> str | None:
    first = next((r.strip() for r in rows if r.strip()), "")
    m = re.match(r"(\"\"\"|''')(.*)", first)
    return (m[2].split(m[1])[0].strip() or None) if m else None


@parser(".go")
def go(text: str, options: Options = Options()) -> dict:
    module = options.module
    block = re.search(r"^import\s*\(([^)]*)\)", text, re.MULTILINE)
    imports = once([*groups(r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', text), *(re.findall(r'"([^"]+)"', block[1]) if block else [])])
    local = [i for i in imports if i.startswith(".") or module and (i == module or i.startswith(module + "/"))]
    external = [i for i in imports if i not in local]
    details = []
    for m in re.finditer(r"^func\s+(?:\(([^)]*)\)\s*)?([A-Z]\w*)\s*(\([^)]*\))\s*([^{\n]*)", text, re.MULTILINE):
        receiver, result = f"({m[1]}) " if m[1] else "", m[4].strip()
        details.append((m.start(), m[2], f"func {receiver}{m[2]}{m[3]}" + (f" {result}" if result else ""), "function"))
    for m in re.finditer(r"^type\s+([A-Z]\w*)\s+(struct|interface)\s*\{([^}]*)\}", text, re.MULTILINE):
        own = [x.strip() for x in m[3].split("\n") if x.strip() and not x.strip().startswith("//")]
        shown = "; ".join(own[:6]) + ("; ..." if len(own) > 6 else "")
        details.append((m.start(), m[1], f"type {m[1]} {m[2]} {{ {shown} }}", "type" if m[2] == "struct" else "interface"))
    for m in re.finditer(r"^type\s+([A-Z]\w*)\s+(?!struct\b|interface\b)=?\s*([^\n{]+)", text, re.MULTILINE):
        details.append((m.start(), m[1], f"type {m[1]} {m[2].strip()}", "type"))
    listed, seen = [], set()
    for at, name, said, kind in sorted(details):
        if name not in seen:
            seen.add(name)
            above = re.search(r"((?:^[ \t]*//[^\n]*\n)+)\Z", text[:at], re.MULTILINE)
            doc = re.sub(r"^//\s*", "", above[1].strip().split("\n")[0].strip()) if above else None
            listed.append({"name": name, "signature": said, "kind": kind, "doc_comment": doc})
    exports = [d["name"] for d in listed]
    return empty() | {
        "imports": imports, "local_imports": local, "external_imports": external, "exports": exports, "export_details": listed, "symbols": once(groups(r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)", text)),
        "env_vars": once(groups(r'os\.(?:Getenv|LookupEnv)\(\s*"([A-Z_][A-Z0-9_]*)"', text)), "api_calls": once(groups(r'http\.(?:Get|Post|Head|PostForm|NewRequest)\(\s*(?:"[A-Z]+"\s*,\s*)?"([^"]+)"', text)),
        "comments": tagged(text, "//"), "has_side_effects": side_effects(external, options.packages), "signatures": [d["signature"] for d in listed],
    }


def blanked(text: str) -> str:
    """text with comments, and what stands inside strings and templates, as spaces: positions and line breaks stay."""
    out, at = list(text), 0
    pattern = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
    for m in pattern.finditer(text):
        a, b = (m.start(), m.end()) if m[0][0] == "/" else (m.start() + 1, m.end() - 1)
        for at in range(a, b):
            if out[at] != "\n":
                out[at] = " "
    return "".join(out)


def _depths(code: str) -> list[int]:
    out, depth = [], 0
    for c in code:
        depth -= c in "})]"
        out.append(depth)
        depth += c in "{(["
    return out


def _closing(code: str, at: int) -> int:
    """Where the bracket at a position is closed."""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] in "{([") - (code[k] in "})]")
        if not depth:
            return k
    return len(code) - 1


def _result(code: str, text: str, at: int) -> str:
    m = _COLON.match(code, at)
    if not m:
        return ""
    begin = k = m.end()
    depth = 0
    while k < len(code) and (depth or code[k] not in "{;\n=" or k == begin):
        depth += (code[k] in "{([<") - (code[k] in "})]>")
        k += 1
    return " ".join(text[begin:k].split())


_COLON = re.compile(r"\s*:\s*")
_CALL = re.compile(r"\s*(?:<[^>]*>)?\s*\(")
_ARROW = re.compile(r"\s*(?::[^=]+)?=\s*(async\s+)?(?:function\b\s*\w*\s*)?(?:<[^>]*>)?\(")
_BODY = re.compile(r"\s*(?::[^=;]+)?(?:=>|\{)")
_OBJECT = re.compile(r"\s*(?::[^=]+)?=\s*\{")
_ALIAS = re.compile(r"\s*(?:<[^>]*>)?\s*=\s*")
_HEAD = re.compile(r"[^{]*")
_EXPORT_DEFAULT = re.compile(r"\s*export\s+default")
_METHOD = re.compile(r"[ \t]*((?:(?:public|protected|private|static|async|override|abstract)\s+)*)(?!constructor\b|get\s|set\s|if\b|for\b|while\b|switch\b|return\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\(")
_PROPERTY = re.compile(r"\s*(?:readonly\s+)?([A-Za-z_$][\w$]*)(\?)?\s*:\s*")
_MEMBER = re.compile(r"\s*([A-Za-z_$][\w$]*|['\"][^'\"]*['\"])")


def _alias_end(code: str, at: int) -> int:
    """Where a type's expression ends: at a semicolon, an empty line or a line that begins anew, outside all brackets."""
    depth, k = 0, at
    while k < len(code):
        c = code[k]
        depth += (c in "{([") - (c in "})]")
        if depth <= 0 and (c == ";" or c == "\n" and re.compile(r"[^\S\n]*\n|[^\s|&]").match(code, k + 1)):
            return k
        k += 1
    return k


def _members(code: str, begin: int, close: int, marks: str) -> list[int]:
    """Where the members of a body begin: after its bracket and after each of marks (or a closing brace) outside inner brackets."""
    out, depth, fresh = [], 0, True
    for k in range(begin + 1, close):
        c = code[k]
        if fresh and not c.isspace():
            out.append(k)
            fresh = False
        depth += (c in "{([") - (c in "})]")
        if not depth and (c in marks or c == "}"):
            fresh = True
    return out


def _shapes(code: str, text: str, kind: str, name: str, end: int) -> str | None:
    """A class with its first five methods that are not private, an interface with its first six properties, an enum with its members."""
    begin = code.find("{", end)
    if begin < 0:
        return None
    close = _closing(code, begin)
    own = []
    if kind == "class":
        for at in _members(code, begin, close, ";\n"):
            m = _METHOD.match(code, at)
            if m and "private" not in m[1]:
                to = _closing(code, m.end() - 1)
                result = _result(code, text, to + 1)
                own.append(f"{m[2]}({' '.join(text[m.end() : to].split())})" + (f": {result}" if result else ""))
        return f"class {name} {{ {'; '.join(own[:5])} }}"
    if kind == "interface":
        starts = _members(code, begin, close, ";,\n")
        for at, to in zip(starts, [*starts[1:], close], strict=True):
            if m := _PROPERTY.match(code, at):
                own.append(f"{m[1]}{m[2] or ''}: {' '.join(text[m.end() : to].split()).rstrip(';,').strip() or 'unknown'}")
        return f"interface {name} {{ {'; '.join(own[:6])}{'; ...' if len(own) > 6 else ''} }}"
    own = [m[1] for at in _members(code, begin, close, ",") if (m := _MEMBER.match(text, at))]
    return f"enum {name} {{ {', '.join(own)} }}"


def _short(s: str, n: int) -> str:
    return s if len(s) <= n else s[:n] + "..."


def _jsdoc(text: str, at: int) -> str | None:
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*\Z", text[:at], re.DOTALL)
    said = [x.strip().lstrip("*").strip() for x in m[1].split("\n")] if m else []
    return next((x for x in said if x and not x.startswith("@")), None)


#: The order in which the signatures of a file are listed.
_LISTED = {"function": 0, "const": 1, "class": 2, "interface": 3, "type": 4, "enum": 5}


@parser(".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs")
def typescript(text: str, options: Options = Options()) -> dict:
    code = blanked(text)
    depth = _depths(code)
    top = lambda pattern: [m for m in re.finditer(pattern, code, re.MULTILINE) if depth[m.start() + len(m[0]) - len(m[0].lstrip())] == 0]
    closing_quote = re.compile(r"[\"'`]")
    quoted = lambda at: text[at + 1 : m.start()] if (m := closing_quote.search(code, at + 1)) else ""
    imports = [quoted(m.end() - 1) for m in top(r"^[ \t]*import\b(?!\s*\()[^\"'`;()]*[\"']")]
    imports += [quoted(m.end() - 1) for m in re.finditer(r"\bimport\s*\(\s*[\"'`]", code)]
    local = [i for i in imports if i.startswith((".", "@/", "~/"))]
    external = [i for i in imports if i not in local]
    declared, symbols, signatures, named_hooks = [], [], [], []
    for m in top(r"^[ \t]*(export\s+)?(default\s+)?(?:declare\s+)?(abstract\s+)?(async\s+)?(function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"):
        exported, kind, name, end = bool(m[1]), m[5].rstrip("*"), m[6], m.end()
        said, what, listed = None, kind, None
        if kind == "function" and (p := _CALL.match(code, end)):
            close = _closing(code, p.end() - 1)
            parameters = " ".join(text[p.end() : close].split())
            result = _result(code, text, close + 1)
            said = f"{'async ' if m[4] else ''}{name}({parameters})" + (f": {_short(result, 50)}" if result else "")
            listed = f"{name}({parameters})" + (f": {result}" if result else "")
        elif kind in ("const", "let", "var"):
            arrow = _ARROW.match(code, end)
            if arrow:
                close = _closing(code, arrow.end() - 1)
                result = _result(code, text, close + 1)
                if body := _BODY.match(code, close + 1):
                    parameters = " ".join(text[arrow.end() : close].split())
                    said, what = f"{'async ' if arrow[1] else ''}{name}({parameters})" + (f": {_short(result, 50)}" if result else ""), "const"
                    listed = f"{name}({parameters})" + (f": {result}" if result else "") if body[0].endswith("=>") else None
            if arrow and said or _OBJECT.match(code, end):
                symbols.append(name)
        elif kind == "type" and (eq := _ALIAS.match(code, end)):
            whole = " ".join(text[eq.end() : _alias_end(code, eq.end())].split())
            said, listed = f"type {name} = {_short(whole, 60)}", f"type {name} = {_short(whole, 120)}"
        elif kind in ("class", "interface", "enum"):
            head = _HEAD.match(code, end)[0].strip()
            said = f"{kind} {name}" + (f" {' '.join(head.split())}" if head else "")
            listed = _shapes(code, text, kind, name, end)
        if kind in ("function", "class", "enum"):
            symbols.append(name)
        if re.match(r"use[A-Z]", name) and kind in ("function", "const", "let", "var"):
            named_hooks.append(name)
        if listed:
            signatures.append((_LISTED["const" if kind in ("let", "var") else kind], m.start(), listed))
        declared.append((name, exported, said, what if kind not in ("let", "var") else "const", m.start()))
    exports = [("default" if _EXPORT_DEFAULT.match(code, at) else n) for n, e, _, _, at in declared if e]
    for m in top(r"^[ \t]*export\s*(?:type\s*)?\{([^}]*)\}"):
        exports += [x.split(" as ")[-1].strip() for x in m[1].split(",") if x.strip()]
    if top(r"^[ \t]*export\s+default\b(?!\s+(?:async\s+)?(?:function|class)\b)"):
        exports.append("default")
    details, seen = [], set()
    for name, exported, said, what, at in declared:
        if exported and said and name not in seen:
            seen.add(name)
            while code[at].isspace():
                at += 1
            details.append({"name": name, "signature": said, "kind": what, "doc_comment": _jsdoc(text, at)})
    comments = tagged(text, "//")
    return empty() | {
        "imports": imports, "local_imports": local, "external_imports": external, "exports": once(exports), "export_details": details, "symbols": once(symbols), "hooks": once(named_hooks),
        "env_vars": once(groups(r"process\.env\.([A-Z_][A-Z0-9_]*)", text)), "api_calls": called(text, options.call_patterns), "comments": comments,
        "has_side_effects": side_effects(external, options.packages) or bool(comments["hack"]), "signatures": once(x for *_, x in sorted(signatures)),
    }


def parse(path: str, text: str, options: Options = Options()) -> dict:
    """The facts of a file by its suffix; empty for other suffixes and where the parser fails."""
    own = PARSERS.get("." + path.rpartition(".")[2])
    if own is None:
        return empty()
    try:
        return own(text or "", options)
    except Exception as error:
        return empty() | {"error": f"{type(error).__name__}: {error}"}


def analyses(files: DataFrame, options: Options = Options(), modules: DataFrame | None = None) -> DataFrame:
    """path and FACTS of every file (path, content). modules (dir, module): Go files are parsed with the module of the nearest directory above."""
    own = files.select("path", F.col("content").cast("string").alias("content"))
    own = own.withColumn("module", F.lit(None).cast("string")) if modules is None else own.join(with_go_modules(own, modules), "path", "left")

    def run(batches):
        for batch in batches:
            rows = zip(batch["path"], batch["content"], batch["module"], strict=True)
            yield pd.DataFrame([{"path": p} | parse(p, t, replace(options, module=m or options.module)) for p, t, m in rows])

    return spread(own.select("path", "content", "module"), "path").mapInPandas(run, f"path string, {FACTS}")


def skeleton(path: str, text: str, whole_lines: int = 200, import_lines: int = 20) -> str:
    """A short form of a long file: its first import lines, its exported declarations with what is said above them, its tagged comments."""
    rows = (text or "").split("\n")
    if len(rows) <= whole_lines:
        return text or ""
    facts = parse(path, text)
    head = [r for r in rows if re.match(r"\s*(import|from)\b", r)][:import_lines]
    said = [f"// {d['doc_comment']}\n{d['signature']}" if d["doc_comment"] else d["signature"] for d in facts["export_details"]]
    return "\n".join([*head, *said, *(f"// {tag.upper()}: {x}" for tag, own in facts["comments"].items() for x in own)])


def with_go_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module: the Go module of the nearest directory above that has one (modules: dir, module)."""
    own = files.select("path", F.explode(F.concat(ancestors(paths.dirname(F.col("path"))), F.array(F.lit(".")))).alias("dir"))
    return own.join(modules, "dir").groupBy("path").agg(F.max_by("module", F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))).alias("module"))


def go_modules(files: DataFrame) -> DataFrame:
    """dir, module of every go.mod among files (path, content)."""
    own = files.where(paths.basename(F.col("path")) == "go.mod")
    return own.select(paths.dirname(F.col("path")).alias("dir"), F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1).alias("module")).where("module != ''")
