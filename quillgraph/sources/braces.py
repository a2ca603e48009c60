"""Declarations and references of languages written in braces.

One pass over a file's tokens keeps a stack of what is open, so members get their owners'
names. What a name may stand for is not decided here: a reference is written as candidates,
each a package and a name in it, and ``operators.bind`` joins them with what all files
declare. A package is what the language says it is: the declared one of a Java, Kotlin or C#
file, the module path of a Rust file, the path without its suffix elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.paths import folder, normalise

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|(?<![\w>&<])'(?:\\.|[^'\\\n])*'", re.S)
_TOKEN = re.compile(r"[\w$]+|::|=>|->|\?\.|[{}()\[\];:,.=<>@&]|\n")

# Words that open a declaration, by language.
TYPES = {
    "typescript": {"class", "interface", "enum", "namespace"}, "java": {"class", "interface", "enum", "record"},
    "kotlin": {"class", "interface", "object"}, "csharp": {"class", "interface", "enum", "record", "struct"},
    "rust": {"struct", "enum", "trait", "impl"}, "dart": {"class", "mixin", "enum", "extension"},
}
FUNCTIONS = {"typescript": {"function"}, "kotlin": {"fun"}, "rust": {"fn"}}
BINDS = {"const", "let", "var", "val", "final", "mut"}
#: Words that stand before a parenthesis and call nothing.
NO_CALL = {
    "if", "for", "while", "switch", "catch", "return", "function", "fn", "fun", "super", "this", "new", "throw", "typeof", "await", "when",
    "match", "using", "lock", "sizeof", "nameof", "assert", "in", "is", "as", "else", "do", "try", "constructor", "foreach", "synchronized", "yield",
}


@dataclass
class Scope:
    name: str  # qualified; "" for the file
    kind: str  # type, function or block
    bases: list[str] = field(default_factory=list)
    types: dict[str, str | None] = field(default_factory=dict)  # variables and fields: their types, if said
    parens: int = 0  # open around it
    own: bool = True  # declared here, not a further block of what is


def package_of(rel: str, lang: str, text: str) -> str:
    if lang in ("java", "kotlin"):
        m = re.search(r"^\s*package\s+([\w.]+)", text, re.M)
        return m[1] if m else ""
    if lang == "csharp":
        m = re.search(r"^\s*namespace\s+([\w.]+)", text, re.M)
        return m[1] if m else ""
    stem = rel.rpartition(".")[0]
    if lang != "rust":
        return stem
    head, _, tail = stem.rpartition("src/") if "src/" in stem else ("", "", stem)
    crate = head.rstrip("/").rpartition("/")[2].replace("-", "_") or "crate"
    parts = [p for p in tail.split("/") if p]
    if parts and parts[-1] in ("lib", "main", "mod"):
        parts.pop()
    return "::".join([crate, *parts])


def _blanked(text: str) -> str:
    """Comments blank, and of strings a digit that stands for a value."""
    return _BLANK.sub(lambda m: ("" if m[0][0] == "/" else "0") + re.sub(r"[^\n]", " ", m[0])[m[0][0] != "/" :], text)


def _undecorated(part: list) -> list:
    """A header's tokens without the annotations before it."""
    k = 0
    while k + 1 < len(part) and part[k][0] == "@":
        k += 2
        while k + 1 < len(part) and part[k][0] in (".", "::"):
            k += 2
        if k < len(part) and part[k][0] == "(":
            depth = 0
            while k < len(part):
                depth += (part[k][0] == "(") - (part[k][0] == ")")
                k += 1
                if depth == 0:
                    break
    return part[k:]


class Reader:
    """One file: ``declared`` (name, line, end, shown, head) and ``refs`` (source name, kind,
    context, candidates)."""

    def __init__(self, rel: str, text: str, lang: str) -> None:
        self.rel, self.text, self.lang, self.package = rel, text, lang, package_of(rel, lang, text)
        self.declared: dict[str, list] = {}
        self.imported: dict[str, tuple[str, str]] = {}  # name here: package, name there
        self.spaces: dict[str, str] = {}  # name here: package it stands for
        self.opened: list[str] = []  # packages whose names are all visible
        self.uses: list[tuple[str, str, list[str], Scope | None, dict]] = []
        self.supers: dict[str, list[str]] = {}
        self.fields: dict[str, dict[str, str | None]] = {}
        self._imports()
        self._scan()

    # -- imports

    def _imports(self) -> None:
        base, t = folder(self.rel), self.text
        if self.lang == "typescript":
            for m in re.finditer(r"""import\s+(?:type\s+)?([^'";]*?)\s*from\s*['"](\.{1,2}/[^'"]+)['"]""", t):
                at = re.sub(r"\.[mc]?[jt]sx?$", "", normalise(base, m[2]))
                inner = re.search(r"\{([^}]*)\}", m[1])
                for e in (inner[1].split(",") if inner else []):
                    a, _, b = e.strip().removeprefix("type ").partition(" as ")
                    if a.strip():
                        self.imported[(b or a).strip()] = (at, a.strip())
                if s := re.search(r"\*\s+as\s+(\w+)", m[1]):
                    self.spaces[s[1]] = at
        elif self.lang == "dart":
            for m in re.finditer(r"""^\s*(?:import|part)\s+['"]([^':"]+)\.dart['"](?:\s+as\s+(\w+))?""", t, re.M):
                at = normalise(base, m[1])
                if m[2]:
                    self.spaces[m[2]] = at
                else:
                    self.opened.append(at)
        elif self.lang == "csharp":
            self.opened += re.findall(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", t, re.M)
            parts = self.package.split(".")
            self.opened += [".".join(parts[:n]) for n in range(len(parts) - 1, 0, -1)]  # enclosing ones
        elif self.lang in ("java", "kotlin"):
            for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)\.(\*|\w+)(?:\s+as\s+(\w+))?\s*;?\s*$", t, re.M):
                if m[2] == "*":
                    self.opened.append(m[1])
                else:
                    self.imported[m[3] or m[2]] = (m[1], m[2])
        elif self.lang == "rust":
            for m in re.finditer(r"\buse\s+([^;]+);", t):
                self._use_tree(re.sub(r"\s+", " ", m[1]).strip(), [])
            for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", t, re.M):
                self.spaces[m[1]] = f"{self.package}::{m[1]}"

    def _use_tree(self, tree: str, at: list[str]) -> None:
        if "{" in tree:
            head, _, rest = tree.partition("{")
            depth, item = 0, ""
            for c in rest[: rest.rfind("}")] + ",":
                depth += (c == "{") - (c == "}")
                if c == "," and depth == 0:
                    if item.strip():
                        self._use_tree(item.strip(), [*at, *[p.strip() for p in head.split("::") if p.strip()]])
                    item = ""
                else:
                    item += c
            return
        path, _, name = tree.partition(" as ")
        parts = self._absolute([*at, *path.strip().split("::")])
        if parts[-1] == "*":
            self.opened.append("::".join(parts[:-1]))
        elif parts[-1] != "self":
            self.imported[name or parts[-1]] = ("::".join(parts[:-1]), parts[-1])
            self.spaces[name or parts[-1]] = "::".join(parts)

    def _absolute(self, parts: list[str]) -> list[str]:
        mine = self.package.split("::")
        if parts[0] == "crate":
            return [mine[0], *parts[1:]]
        if parts[0] == "self":
            return [*mine, *parts[1:]]
        while parts and parts[0] == "super":
            mine, parts = mine[:-1], parts[1:]
            if not parts or parts[0] != "super":
                return [*mine, *parts]
        return parts

    # -- declarations and uses

    def _scan(self) -> None:
        toks, line = [], 1
        for m in _TOKEN.finditer(_blanked(self.text)):
            if m[0] == "\n":
                line += 1
            else:
                toks.append((m[0], line))
        self.lines = self.text.split("\n")
        stack, begin, n = [Scope("", "file")], 0, 0
        ends: list[str | None] = []
        parens = 0
        while n < len(toks):
            t, at = toks[n]
            if n > begin and parens <= 0 and at > toks[n - 1][1] and self._breaks(toks[n - 1][0], t):
                if not self._signature(toks[begin:n], stack[-1]):
                    self._statement(toks[begin:n], stack[-1])
                begin = n
            parens += (t in "([") - (t in ")]")
            if t == "{" and parens <= 0:
                stack.append(self._opened(toks, begin, n, stack))
                new = stack[-1]
                ends.append(new.name if new.kind in ("type", "function") and new.own else None)
                begin, parens = n + 1, 0
            elif t == "{":
                self._statement(toks[begin:n], stack[-1])
                stack.append(Scope(stack[-1].name, "block" if stack[-1].kind != "file" else "file", types=stack[-1].types))
                ends.append(None)
                stack[-1].parens = parens
                begin, parens = n + 1, 0
            elif t == "}":
                self._statement(toks[begin:n], stack[-1])
                if len(stack) > 1:
                    gone = stack.pop()
                    parens = gone.parens
                    name = ends.pop()
                    if name in self.declared:
                        self.declared[name][1] = at
                begin = n + 1
            elif t == ";" and parens <= 0:
                if not self._signature(toks[begin:n], stack[-1]):
                    self._statement(toks[begin:n], stack[-1])
                begin = n + 1
            n += 1
        self._statement(toks[begin:], stack[-1])

    def _breaks(self, last: str, first: str) -> bool:
        """Whether a line's end ends a statement, where none needs a semicolon."""
        if self.lang not in ("typescript", "kotlin"):
            return False
        goes_on = {".", "?.", "{", ":", "=", ")", "]", ",", "=>", "->", "extends", "implements", "<", ">", "&", "@", "("}
        return last not in goes_on - {")", "]", ">"} and first not in goes_on - {"@", "("} and last != "export"

    def _declare(self, name: str, line: int, shown: bool) -> None:
        self.declared.setdefault(name, [line, line, shown, self.lines[line - 1].strip()])

    def _head(self, words: list[str]) -> int | None:
        """Where a type's opening word stands in a header."""
        kinds = TYPES[self.lang]
        return next((i for i, w in enumerate(words[:-1]) if w in kinds and re.match(r"[A-Za-z_<]", words[i + 1])), None)

    def _shown(self, words: list[str]) -> bool:
        mark = {"typescript": "export", "rust": "pub", "java": "public", "csharp": "public"}.get(self.lang)
        return mark in words if mark else not {"private", "internal"} & set(words)

    def _type(self, part: list, outer: Scope) -> Scope | None:
        part = _undecorated(part)
        words = [w for w, _ in part]
        i = self._head(words)
        if i is None or outer.kind in ("function", "block") or "(" in words[:i]:
            return None
        flat, depth = [], 0  # without type parameters
        for w in words[i + 1 :]:
            depth += (w == "<") - (w == ">")
            if depth == 0 and w != ">":
                flat.append(w)
        if not flat:
            return None
        name, rest = flat[0], flat[1:]
        bases = []
        if words[i] == "impl":
            if "for" in flat:
                bases, name = [flat[flat.index("for") - 1]], flat[flat.index("for") + 1]
        else:
            nest, marked = 0, False
            for w in rest:
                nest += (w == "(") - (w == ")")
                if nest == 0 and w in ("extends", "implements", ":", "with"):
                    marked = True
                elif nest == 0 and marked and re.match(r"[A-Za-z_]", w) and w not in ("where", "on"):
                    bases.append(w)
        full = f"{outer.name}.{name}" if outer.name else name
        if words[i] != "impl":
            self._declare(full, self._line(part, full), self._shown(words))
        self.supers.setdefault(full, []).extend(bases)
        scope = Scope(full, "type", bases, self.fields.setdefault(full, {}), own=words[i] != "impl")
        for a, t in re.findall(r"(\w+) : (?:& )?(?:mut )?(\w+)", " ".join(words[i:])):  # parameters of a header, bounds
            scope.types[a] = t
        for b in bases:
            self.uses.append((full, "Implements" if self._contract(words, b) else "Extends", [b], outer, {}))
        return scope

    def _contract(self, words: list[str], base: str) -> bool:
        if self.lang == "rust":
            return True
        if "implements" in words:
            return words.index("implements") < len(words) - words[::-1].index(base) - 1
        return self.lang == "csharp" and bool(re.match(r"I[A-Z]", base))

    def _function(self, part: list, outer: Scope) -> Scope | None:
        part = _undecorated(part)
        words = [w for w, _ in part]
        if "(" not in words:
            return None
        open_ = words.index("(")
        kinds = FUNCTIONS.get(self.lang, set())
        name = None
        for i, w in enumerate(words):
            if w in kinds and i + 1 < len(words) and re.match(r"[A-Za-z_$]", words[i + 1]):
                flat = [x for x in words[i + 1 :]]
                cut = flat.index("(") if "(" in flat else len(flat)
                names = [x for x in flat[:cut] if re.match(r"[A-Za-z_$]", x)]
                name = flat[0] if self.lang != "kotlin" or "." not in flat[:cut] else names[-1]
                open_ = i + 1 + cut
                break
        else:
            if "=>" in words and "=" in words and words[0] in ("const", "let", "export"):
                name = words[words.index("=") - 1] if ":" not in words[: words.index("=")] else words[words.index(":") - 1]
            elif outer.kind in ("type", "file") and open_ > 0 and "=" not in words[:open_]:
                k = open_ - 1
                if words[k] == ">":
                    while k > 0 and words[k] != "<":
                        k -= 1
                    k -= 1
                typed = self.lang == "typescript" and outer.kind == "type" or k > 0 and re.match(r"[\w>\]]", words[k - 1])
                if words[k] not in NO_CALL and re.match(r"[A-Za-z_$]", words[k]) and (typed or words[k] == outer.name.rpartition(".")[2]):
                    name = words[k]
                elif words[k] == "constructor":
                    name = "constructor"
        if name is None or outer.kind in ("function", "block"):
            return None
        full = f"{outer.name}.{name}" if outer.name else name
        self._declare(full, self._line(part, full), self._shown(words))
        if self.lang == "rust" and outer.kind == "type" and outer.name not in self.declared:
            self.uses.append((full, "References", [outer.name], outer, {}))  # a foreign type's own member
        scope = Scope(full, "function", outer.bases)
        said = " ".join(words[open_:])
        if self.lang in ("typescript", "kotlin", "rust"):
            scope.types.update({a: b for a, b in re.findall(r"([\w$]+) : (?:& )?(?:mut |dyn |impl )*(\w+)", said)})
        else:
            scope.types.update({b: a for a, b in re.findall(r"([A-Za-z_]\w*)(?: <[^()]*?>)?(?: \[ \])? (\w+)(?= [,)=])", said)})
        if name == "constructor":  # its parameters with a modifier are fields
            for b, a, t in re.findall(r"(private|public|protected|readonly) (?:readonly )?(\w+) : (\w+)", said):
                outer.types[a] = t
        return scope

    def _opened(self, toks: list, begin: int, n: int, stack: list[Scope]) -> Scope:
        part = toks[begin:n]
        words, outer = [w for w, _ in part], stack[-1]
        if words and self.lang == "csharp" and words[0] == "namespace" or self.lang == "rust" and "mod" in words[:3]:
            return Scope(outer.name, outer.kind)
        made = self._type(part, outer) or self._function(part, outer)
        if made is not None:
            return made
        self._statement(part, outer)
        return Scope(outer.name, "block" if outer.kind != "file" else "file", outer.bases, outer.types)

    @staticmethod
    def _line(part: list, name: str) -> int:
        """The line a declaration's name stands on."""
        leaf = name.rpartition(".")[2]
        return next((line for w, line in part if w == leaf), part[0][1])

    def _signature(self, part: list, outer: Scope) -> bool:
        """A member without a body, or a type without one."""
        words = [w for w, _ in part]
        if not words or "use" in words[:2] or "import" in words[:1]:
            return True
        if outer.kind == "file" and self._type(part, outer):
            return True
        body = next((i for i, w in enumerate(words) if w == "=>" or w == "=" and self.lang == "kotlin"), None)
        if body is not None and ("fun" in words[:body] or self.lang in ("typescript", "dart", "csharp")):
            made = self._function(part, outer)
            if made is not None:  # all of its body is one expression
                self._statement(part[body + 1 :], made)
                return True
        if outer.kind == "type" and "=" not in words and self._function(part, outer):
            return True
        return False

    def _statement(self, part: list, scope: Scope) -> None:
        """Variables with their types, and the calls, of one statement."""
        words = [w for w, _ in part]
        if not words or words[0] in ("import", "package", "using", "use"):
            return
        said = " ".join(words)
        colon = self.lang in ("typescript", "kotlin", "rust")
        if scope.kind == "type":
            pairs = re.findall(r"(\w+) : (?:& )?(?:mut |dyn )*(\w+)", said) if colon else [(b, a) for a, b in re.findall(r"([A-Za-z_]\w*)(?: <[^()]*?>)? (\w+)(?= =|$)", said)]
            scope.types.update(dict(pairs))
        else:
            for a, t, made in re.findall(r"\b(?:const|let|var|val|final|mut) (?:mut )?(\w+)(?: : (?:& )?(\w+))?(?: = (?:new )?([A-Z]\w*) \()?", said):
                scope.types[a] = t or made or None
            if not colon:
                for a, b, made in re.findall(r"\b([A-Z]\w*)(?: <[^()]*?>)? (\w+) =(?: new ([A-Z]\w*))?", said):
                    scope.types[b] = made or a
        n = 0
        while n < len(words):
            if not re.match(r"[A-Za-z_$]", words[n]) or (n and words[n - 1] in (".", "?.", "::", "@")):
                n += 1
                continue
            chain, k = [words[n]], n + 1
            while k + 1 < len(words) and words[k] in (".", "?.", "::") and re.match(r"[A-Za-z_$]", words[k + 1]):
                chain.append(words[k + 1])
                k += 2
            after = words[k] if k < len(words) else ""
            before = words[n - 1] if n else ""
            name = scope.name if scope.kind != "file" else ""
            if after == "(" and chain[-1] not in NO_CALL:
                self.uses.append((name, "Calls", chain, scope, dict(scope.types)))
            elif before == "<" and self.lang == "typescript" and self.rel.endswith(("x", "vue")) and chain[0][0].isupper():
                self.uses.append((name, "Calls", chain, scope, dict(scope.types)))
            elif (before == "(" or before == "," and "(" in words[:n]) and after in (")", ",") and len(chain) <= 2:
                self.uses.append((name, "Pass", chain, scope, dict(scope.types)))
            n = k

    # -- candidates

    def places(self, name: str) -> list[tuple[int, str, str, bool]]:
        """Where a plain name may be declared: rank, package, its name there, proven by an import."""
        own = [(0, self.package, name, False)] if name in self.declared else []
        if name in self.imported:
            at, there = self.imported[name]
            return [*own, (1, at, there, self.lang == "typescript")]
        if self.lang in ("java", "kotlin", "csharp"):
            own.append((2, self.package, name, False))
        return own + [(3, p, name, False) for p in self.opened]

    def candidates(self, name: str, chain: list[str], types: dict) -> list[tuple[int, str, str, bool]]:
        """``rank, package, name, proven`` of what a chain may name."""
        holder = name.rpartition(".")[0]
        while holder and holder not in self.supers:
            holder = holder.rpartition(".")[0]
        if name in self.supers:
            holder = name
        fields = self.fields.get(holder, {})
        head, rest = chain[0], chain[1:]
        if head == "this" or head == "self" or head == "Self":
            if len(rest) == 1:
                return self._member(holder, rest[0])
            if len(rest) == 2 and fields.get(rest[0]):
                return self._of_type(fields.get(fields[rest[0]]) or fields[rest[0]], rest[1])
            return []
        if head in types and types is not fields:
            t = types[head]
            return self._of_type(fields.get(t) or t, rest[0]) if t and len(rest) == 1 else []
        if not rest:
            inside = self._member(holder, head) if holder and self.lang not in ("typescript", "rust") else []
            return inside + [(r + 4, p, n, ok) for r, p, n, ok in self.places(head)]
        if head in fields and fields[head] and len(rest) == 1 and self.lang not in ("typescript", "rust"):
            return self._of_type(fields[head], rest[0])
        out = [(r, p, ".".join([n, *rest]), ok) for r, p, n, ok in self.places(head)]
        if head in self.spaces:
            out += [(1, self.spaces[head], ".".join(rest), self.lang == "typescript")]
        if self.lang == "rust" and len(chain) > 1:
            full = self._absolute(chain)
            out += [(2, "::".join(full[:k]), ".".join(full[k:]), False) for k in range(len(full) - 1, 0, -1)]
        if holder == head or head in self.supers:
            out += [(1, self.package, ".".join(chain), False)]
        return out

    def _member(self, holder: str, name: str) -> list:
        """Of the type itself, else of the types it is made from."""
        out, seen, todo, rank = [], set(), [holder], 0
        while todo:
            at = todo.pop(0)
            if not at or at in seen:
                continue
            seen.add(at)
            if at in self.supers:
                out.append((rank, self.package, f"{at}.{name}", False))
                todo += self.supers[at]
            else:
                out += [(min(rank, 2) + 1, p, f"{n}.{name}", False) for _, p, n, _ in self.places(at)]
            rank += 1
        return out

    def _of_type(self, type_: str, name: str) -> list:
        return [(r, p, f"{n}.{name}", ok) for r, p, n, ok in self.places(type_)]

    def refs(self) -> list[tuple[int, str, str, str, int, str, str, bool]]:
        """Rows: number, source id, kind, context, rank, package, name, proven."""
        out = []
        for k, (name, kind, chain, _, types) in enumerate(self.uses):
            source = f"sym:{self.rel}::{name}" if name else f"file:{self.rel}"
            context = "arg" if kind == "Pass" else ""
            found = self.candidates(name, chain, types) if kind in ("Calls", "Pass") else self.places(chain[0])
            for r, p, n, ok in dict.fromkeys(found):
                out.append((k, source, "Calls" if kind == "Pass" else kind, context, r, p, n, ok))
        return out
