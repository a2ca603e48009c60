"""Code files to symbols, imports and calls.

Python is read by its own grammar (``ast``). SQL is read by its statements. Other languages
are read by one tolerant lexer that finds declarations and imports where their syntax is
unmistakable; languages in braces that ``braces`` knows have their members and references read
too. A call is proven or not written.
"""

from __future__ import annotations

import ast
import re

from ..functions.ids import find_ids
from ..functions.paths import folder, normalise
from . import braces
from .documents import Extraction, lines_of

# Languages by file suffix, by file name and by interpreter.
SUFFIXES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "typescript",
    "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "vue": "vue", "cs": "csharp", "razor": "razor", "kt": "kotlin",
    "kts": "kotlin", "java": "java", "rs": "rust", "dart": "dart", "sql": "sql", "bicep": "bicep", "hcl": "hcl", "tf": "terraform",
    "swift": "swift", "graphql": "graphql", "gql": "graphql", "sh": "shell", "bash": "shell", "lua": "lua", "go": "go", "c": "c",
    "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "php": "php", "rb": "ruby", "ex": "elixir", "exs": "elixir", "scala": "scala",
    "ml": "ocaml", "mli": "ocaml",
}
NAMES = {"Rakefile": "ruby", "Gemfile": "ruby", "BUILD": "python"}
INTERPRETERS = {"python": "python", "python3": "python", "sh": "shell", "bash": "shell", "node": "typescript", "ruby": "ruby", "lua": "lua", "php": "php"}
#: Languages compiled together.
FAMILIES = {"java": "jvm", "kotlin": "jvm", "scala": "jvm", "csharp": "dotnet", "razor": "dotnet", "c": "c", "cpp": "c", "vue": "typescript", "terraform": "hcl"}
DOC_CAP = 600


def language(rel: str, text: str = "") -> str | None:
    leaf = rel.rpartition("/")[2]
    if leaf in NAMES:
        return NAMES[leaf]
    found = SUFFIXES.get(leaf.rpartition(".")[2].lower()) if "." in leaf else None
    if found is None and (m := re.match(r"#!\s*(?:/\S*/)?(?:env\s+)?([\w.]+)", text[:256])):
        found = INTERPRETERS.get(m[1])
    return found


def family(lang: str) -> str:
    return FAMILIES.get(lang, lang)


class _Python(ast.NodeVisitor):
    """Declarations, imports, bases, decorators and proven calls of one module."""

    def __init__(self, ex: Extraction, lines: list[str]) -> None:
        self.ex, self.lines, self.rel = ex, lines, ex.rel
        self.own: dict[str, str] = {}  # top-level name: id
        self.bound: dict[str, str] = {}  # imported name: symbol id
        self.modules: dict[str, str] = {}  # imported name: module file
        self.members: set[str] = set()

    def symbol(self, name: str) -> str:
        return f"sym:{self.rel}::{name}"

    def declare(self, body: list[ast.stmt], prefix: str = "", depth: int = 0) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                names = [node.name]
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                names = [t.id for t in targets if isinstance(t, ast.Name)]
            else:
                continue
            for name in names:
                full = prefix + name
                id_ = self.symbol(full)
                if id_ in self.members:
                    continue
                self.members.add(id_)
                head = self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""
                doc = ast.get_docstring(node) if hasattr(node, "body") and isinstance(node.body, list) else None
                said = " ".join((doc or "")[:DOC_CAP].split())
                self.ex.node(id_, "Symbol", full, f"{said}\n{head}" if said else head, node.lineno, node.end_lineno or node.lineno)
                owner = self.symbol(prefix[:-1]) if prefix else f"file:{self.rel}"
                self.ex.edge(owner, id_, "Declares", "export" if not prefix and not name.startswith("_") else "")
                if not prefix:
                    self.own[name] = id_
            if isinstance(node, ast.ClassDef):
                self.declare(node.body, prefix + node.name + ".", depth + 1)

    def imports(self, tree: ast.Module) -> None:
        base = folder(self.rel)
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    target = a.name.replace(".", "/") + ".py"
                    self.ex.edge(f"file:{self.rel}", f"file:{target}", "Imports", "*")
                    self.modules[a.asname or a.name.partition(".")[0]] = target
            elif isinstance(node, ast.ImportFrom):
                at = base
                for _ in range(node.level - 1):
                    at = folder(at)
                stem = (f"{at}/" if node.level and at else "") + (node.module or "").replace(".", "/")
                target = normalise("", stem.rstrip("/") + (".py" if node.module else "/__init__.py"))
                names = ", ".join(f"{a.name} as {a.asname}" if a.asname else a.name for a in node.names)
                kind = "ReExports" if self.rel.endswith("__init__.py") and node.level else "Imports"
                self.ex.edge(f"file:{self.rel}", f"file:{target}", kind, names)
                if kind == "ReExports":
                    self.ex.edge(f"file:{self.rel}", f"file:{target}", "Imports", names)
                for a in node.names:
                    self.bound[a.asname or a.name] = f"sym:{target}::{a.name}"

    def reference(self, node: ast.expr, holder: str | None) -> str | None:
        """The symbol an expression names, if that is proven."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return None
        parts.append(node.id)
        parts.reverse()
        head, rest = parts[0], parts[1:]
        if head == "self" and holder and len(rest) == 1:
            id_ = f"{holder}.{rest[0]}"
            return id_ if id_ in self.members else None
        if head in self.bound:
            return ".".join([self.bound[head], *rest])
        if head in self.modules and rest:
            return f"sym:{self.modules[head]}::{'.'.join(rest)}"
        if head in self.own:
            id_ = ".".join([self.own[head], *rest])
            return id_ if id_ in self.members else self.own[head] if not rest else None
        return None

    def uses(self, body: list[ast.stmt], prefix: str = "") -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                id_ = self.symbol(prefix + node.name)
                for b in node.bases:
                    if (t := self.reference(b, None)) and t != id_:
                        self.ex.edge(id_, t, "Extends", "")
                self.decorated(node, id_)
                self.uses(node.body, prefix + node.name + ".")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                id_ = self.symbol(prefix + node.name)
                self.decorated(node, id_)
                self.calls(node, id_, self.symbol(prefix[:-1]) if prefix else None)

    def decorated(self, node, id_: str) -> None:
        for d in node.decorator_list:
            d = d.func if isinstance(d, ast.Call) else d
            if (t := self.reference(d, None)) and t != id_:
                self.ex.edge(id_, t, "DecoratedBy", ast.unparse(d))

    def calls(self, fn, id_: str, holder: str | None) -> None:
        local = {a.arg for a in [*fn.args.args, *fn.args.kwonlyargs, *fn.args.posonlyargs]} - {"self"}
        local |= {n.id for n in ast.walk(fn) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        local |= {n.name for n in ast.walk(fn) if n is not fn and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        best: dict[str, str] = {}

        def head(e: ast.expr) -> str | None:
            while isinstance(e, ast.Attribute):
                e = e.value
            return e.id if isinstance(e, ast.Name) else None

        for n in ast.walk(fn):
            if isinstance(n, ast.Call):
                for e, context in [(n.func, ""), *[(a, "arg") for a in n.args], *[(k.value, "arg") for k in n.keywords]]:
                    t = None if head(e) in local else self.reference(e, holder)
                    if t and t != id_ and t != holder and (t not in best or context == ""):
                        best[t] = context
        for t, context in best.items():
            self.ex.edge(id_, t, "Calls", context)


def python(ex: Extraction, text: str) -> None:
    lines = lines_of(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    p = _Python(ex, lines)
    p.declare(tree.body)
    p.imports(tree)
    p.uses(tree.body)


_SQL = re.compile(
    r"\b(create|alter)\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(table|view|function|procedure|index|type|trigger|sequence)\s+"
    r"(?:if\s+(?:not\s+)?exists\s+)?(?:only\s+)?((?:\"[^\"]+\"|[\w$]+)(?:\.(?:\"[^\"]+\"|[\w$]+))*)",
    re.I,
)
_SQL_REF = re.compile(r"\breferences\s+((?:\"[^\"]+\"|[\w$]+)(?:\.(?:\"[^\"]+\"|[\w$]+))*)", re.I)


def _folded(name: str) -> str:
    """Unquoted parts in lower case, quotes taken off."""
    return ".".join(p[1:-1] if p.startswith('"') else p.lower() for p in re.findall(r'"[^"]+"|[\w$]+', name))


def sql(ex: Extraction, text: str) -> None:
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    found = list(_SQL.finditer(bare))
    for n, m in enumerate(found):
        name = _folded(m[3])
        id_ = f"sym:{ex.rel}::{name}"
        stop = bare.find(";", m.end())
        stop = len(bare) if stop < 0 else stop
        line = bare.count("\n", 0, m.start()) + 1
        ex.node(id_, "Symbol", name, " ".join(m[0].split()), line, bare.count("\n", 0, stop) + 1)
        ex.edge(f"file:{ex.rel}", id_, "Declares", "export")
        for r in _SQL_REF.finditer(bare, m.end(), stop):
            ex.edge(id_, f"sym:{ex.rel}::{_folded(r[1])}", "References", "")


# How other languages declare and import, as line patterns with a name.
DECLARES = {
    "typescript": r"^\s*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function\*?|interface|type|enum|const|let)\s+([A-Za-z_$][\w$]*)",
    "csharp": r"^\s*(public\s+)?(?:[a-z]+\s+)*(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)",
    "kotlin": r"^\s*()(?:[a-z]+\s+)*(?:class|interface|object|fun|typealias)\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?([A-Za-z_]\w*)",
    "java": r"^\s*(public\s+)?(?:[a-z]+\s+)*(?:class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)",
    "rust": r"^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod|type|static|macro_rules!)\s+([A-Za-z_]\w*)",
    "dart": r"^\s*()(?:abstract\s+)?(?:class|mixin|enum|extension|typedef)\s+([A-Za-z_]\w*)",
    "swift": r"^\s*(public\s+|open\s+)?(?:[a-z]+\s+)*(?:class|struct|enum|protocol|func|actor)\s+([A-Za-z_]\w*)",
    "graphql": r"^\s*()(?:type|interface|enum|input|scalar|union|directive)\s+@?([A-Za-z_]\w*)",
    "shell": r"^\s*()(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)",
    "lua": r"^\s*(?:local\s+)?()function\s+([A-Za-z_][\w.:]*)",
    "go": r"^()(?:func(?:\s*\([^)]*\))?|type|var|const)\s+([A-Za-z_]\w*)",
    "c": r"^()(?:typedef\s+)?(?:struct|enum|union|class)\s+([A-Za-z_]\w*)\s*\{",
    "php": r"^\s*()(?:[a-z]+\s+)*(?:class|interface|trait|enum|function)\s+([A-Za-z_]\w*)",
    "ruby": r"^\s*()(?:class|module|def)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)",
    "elixir": r"^\s*()(?:defmodule|defp?|defmacro)\s+([A-Za-z_][\w.]*[?!]?)",
    "scala": r"^\s*()(?:[a-z]+\s+)*(?:class|trait|object|def|type)\s+([A-Za-z_]\w*)",
    "ocaml": r"^\s*()(?:let(?:\s+rec)?|type|module|exception)\s+([A-Za-z_]\w*)",
    "hcl": r"^()(?:resource|data|module|variable|output|provider)\s+\"([\w-]+)\"",
    "bicep": r"^\s*()(?:resource|module|param|var|output|func|type)\s+([A-Za-z_]\w*)",
}
RELATIVE_IMPORT = {
    "typescript": r"""(?:from|import|require\()\s*['"](\.{1,2}/[^'"]+)['"]""",
    "dart": r"""^\s*(?:import|part|export)\s+['"]([^'":]+)['"]""",
    "shell": r"""^\s*(?:source|\.)\s+["']?(\.{0,2}/?[\w./-]+)""",
    "c": r"""^\s*#\s*include\s+"([^"]+)\"""",
    "ruby": r"""^\s*require_relative\s+['"]([^'"]+)['"]""",
    "bicep": r"""^\s*module\s+\w+\s+'([^']+)'""",
}
_TS_NAMES = re.compile(r"""(import|export)\s+(?:type\s+)?(\{[^}]*\}|\*(?:\s+as\s+\w+)?|\w+)?\s*(?:,\s*\{[^}]*\})?\s*from\s+['"](\.{1,2}/[^'"]+)['"]""", re.S)


def lexed(ex: Extraction, text: str, lang: str) -> None:
    fam = lang if lang in DECLARES else family(lang)
    pattern = re.compile(DECLARES[fam]) if fam in DECLARES else None
    lines, seen = lines_of(text), set()
    if fam in braces.TYPES:
        reader = braces.Reader(ex.rel, text, fam)
        ex.package, ex.refs = reader.package, reader.refs()
        for name, (start, end, shown, head) in reader.declared.items():
            ex.node(f"sym:{ex.rel}::{name}", "Symbol", name, head[:DOC_CAP], start, end)
            owner = f"sym:{ex.rel}::{name.rpartition('.')[0]}" if name.rpartition(".")[0] in reader.declared else f"file:{ex.rel}"
            ex.edge(owner, f"sym:{ex.rel}::{name}", "Declares", "export" if shown else "")
            seen.add(name)
    for n, line in enumerate(lines, 1):
        m = pattern.match(line) if pattern else None
        if m is None or m[2] in seen or (fam in braces.TYPES and line[:1].isspace()):
            continue
        seen.add(m[2])
        id_ = f"sym:{ex.rel}::{m[2]}"
        ex.node(id_, "Symbol", m[2], line.strip()[:DOC_CAP], n, _block_end(lines, n))
        shown = bool(m[1]) or fam in ("graphql", "shell", "ruby", "python") or (fam == "go" and m[2][0].isupper())
        ex.edge(f"file:{ex.rel}", id_, "Declares", "export" if shown else "")
    base = folder(ex.rel)
    if fam == "typescript":
        for m in _TS_NAMES.finditer(text):
            names = ", ".join(x.strip() for x in (m[2] or "*").strip("{} \n").split(",") if x.strip()) or "*"
            names = "*" if names.startswith("*") else names
            target = normalise(base, m[3])
            target = target if re.search(r"\.\w+$", target) else target + ".ts"
            ex.edge(f"file:{ex.rel}", f"file:{re.sub(r'[.]js$', '.ts', target)}", "ReExports" if m[1] == "export" else "Imports", names)
    elif fam in RELATIVE_IMPORT:
        for m in re.finditer(RELATIVE_IMPORT[fam], text, re.M):
            ex.edge(f"file:{ex.rel}", f"file:{normalise(base, m[1])}", "Imports", "*")


def _block_end(lines: list[str], start: int) -> int:
    """The line of the brace that closes what opens at line ``start``, or that line itself."""
    depth, opened = 0, False
    for n in range(start - 1, len(lines)):
        for c in lines[n]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return n + 1
        if not opened and n > start:
            break
    return start


def scripts(text: str) -> str:
    """A component's scripts where they stand, all else blank."""
    kept = [m.span(1) for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", text, re.S | re.I)]
    return "".join(c if c == "\n" or any(a <= i < b for a, b in kept) else " " for i, c in enumerate(text))


def code(rel: str, text: str) -> Extraction:
    ex = Extraction(rel)
    ex.node(f"file:{rel}", "File", rel)
    lang = language(rel, text)
    if lang == "python":
        python(ex, text)
    elif lang == "sql":
        sql(ex, text)
    elif lang == "vue":
        lexed(ex, scripts(text), "typescript")
    elif lang is not None:
        lexed(ex, text, lang)
    spans = sorted((n[5], n[6], n[0]) for n in ex.nodes if n[1] == "Symbol")
    for n, line in enumerate(lines_of(text), 1):
        quoted = re.search(r"#|//|--|/\*|\*|['\"]", line)
        if quoted is None:
            continue
        for cited, _ in find_ids(line[quoted.start() :]):
            owner = next((i for a, b, i in spans if a <= n <= b), f"file:{rel}")  # the outermost
            ex.edge(owner, cited, "References", "comment" if quoted[0] not in "'\"" else "string")
    if ex.package is not None:
        ex.nodes[0] = (*ex.nodes[0][:3], ex.package, *ex.nodes[0][4:])  # what other files may name it by
    return ex
