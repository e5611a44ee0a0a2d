"""TypeScript and JavaScript source text to rows: items, imports and implemented interfaces. A lexer and a walk over matched brackets.

The file is cut into top-level statements; each is a list of tokens that tables of openers decide on. Members of classes, enums and interfaces are cut
the same way. What is exported by name further down is collected first and applied at the end. Broken files still give rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from quillon.sources.rust import PRIVATE, PUBLIC, RESTRICTED, Parsed, collapse

# Extensions of modules and of other files that imports name, folders that hold no code of the package, tags of documentation,
# modules of the runtime.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
ASSETS = ("css", "scss", "sass", "less", "json", "svg", "png", "jpg", "jpeg", "gif", "webp", "html")
SKIPPED = ("node_modules", "dist", "coverage", "__tests__", "__mocks__", "test", "tests")
HIDING, NAMING, TALKING = ("internal", "hidden", "ignore"), ("module", "fileoverview", "file", "packageDocumentation"), ("description",)
BUILTINS = tuple(
    "assert buffer child_process cluster console crypto dns events fs http http2 https module net os path perf_hooks process querystring readline stream "
    "string_decoder timers tls tty url util v8 vm worker_threads zlib test".split()
)
#: Signatures with a value that are longer are cut before it.
LONG = 100

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)"""
    r"""|(?P<word>[#@]?[^\W\d$][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<punct>=>|\?\.|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\*\*|\+\+|--|[-+*/%&|^]=|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_VALUES_AFTER = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "else", "do", "await", "yield"}
_GOES_ON = set(". ?. ( [ + - * / % , = => ? : && || ?? == === != !== < > <= >= | & ^ instanceof in as satisfies extends implements ` ) ] } ++ --".split()) - {"++", "--"}
_WANTS_MORE = set(". ?. ( [ + - * / % , = => ? : && || ?? == === != !== < <= >= | & ^ instanceof in as satisfies extends implements new typeof keyof infer return await".split())
_BEFORE_TYPES = {"<", ",", "=", "|", "&", ":", "is", "extends", "=>", "?"}
_MARKS = {"export", "default", "declare", "abstract", "async"}
_MEMBER_MARKS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set", "accessor"}
_VIS = {"private": PRIVATE, "protected": RESTRICTED}


@dataclass
class Comment:
    lines: list[str]
    hidden: bool
    module: bool
    first: int
    last: int


def normal(path: list[str]) -> list[str]:
    """A module's path without a source extension on its last part and without a trailing index."""
    if not path:
        return path
    stem, _, ext = path[-1].rpartition(".")
    path = [*path[:-1], stem] if stem and ext in EXTENSIONS else path
    return path[:-1] if path and path[-1] == "index" else path


def specifier(text: str, folder: list[str]) -> tuple[list[str], bool] | None:
    """Segments of what an import names and whether they start at the source root; null for other files and for what leaves the root."""
    if not text.startswith("."):
        parts = [p for p in text.removeprefix("node:").split("/") if p]
        if len(parts) > 1 and len(parts[0]) > 1 and parts[0][0] == "@":
            parts = ["/".join(parts[:2]), *parts[2:]]
        return (parts, False) if parts else None
    path = list(folder)
    for part in text.split("/"):
        if part == ".." and not path:
            return None
        if part == "..":
            path.pop()
        elif part not in ("", "."):
            path.append(part)
    if path and "." in path[-1] and path[-1].rpartition(".")[2] in ASSETS:
        return None
    return normal(path), True


def module_of(parts: list[str]) -> list[str] | None:
    """Module of a file by its path below the source directory; null for tests, declaration files and what is no source."""
    if not parts or set(parts[:-1]) & set(SKIPPED):
        return None
    stem, _, ext = parts[-1].rpartition(".")
    if not stem or ext not in EXTENSIONS or stem.endswith((".test", ".spec", ".d")):
        return None
    return parts[:-1] if stem == "index" else [*parts[:-1], stem]


def split_query(text: str) -> list[str]:
    return [p for p in re.split(r"::|/|\.", text) if p]


class _File:
    def __init__(self, source: str, folder: list[str]):
        self.src, self.folder, self.out = source, folder, Parsed()
        self.out.lines = source.count("\n") + bool(source and not source.endswith("\n"))
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.text: list[str] = []
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.notes: dict[int, list[Comment]] = {}
        self.listed: set[str] = set()
        self._lex()
        self.close = self._pair()
        n = len(self.text)
        self._leading()
        for i, j in self._statements(0, n):
            self._statement(i, j)
        self._imports()
        self._apply_lists()

    # tokens

    def row(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def line(self, i: int) -> int:
        return self.row(self.start[i])

    def _lex(self) -> None:
        src, at, n = self.src, 0, len(self.src)
        while at < n:
            m = _TOKEN.match(src, at)
            kind, end = m.lastgroup, m.end()
            if kind == "tick":
                kind, end = "str", self._template(at)
            elif kind == "punct" and m[0][0] == "/" and self._starts_value() and (r := _REGEX.match(src, at)):
                kind, end = "str", r.end()
            if kind == "block":
                if (note := self._comment(src[at:end], at, end)) is not None:
                    self.notes.setdefault(len(self.text), []).append(note)
                self.out.parse_errors |= not src[at:end].endswith("*/")
            elif kind not in ("space", "line"):
                self.text.append(src[at:end])
                self.kind.append(kind)
                self.start.append(at)
                self.end.append(end)
            at = end

    def _starts_value(self) -> bool:
        if not self.text:
            return True
        t = self.text[-1]
        return t in _VALUES_AFTER if self.kind[-1] == "word" else self.kind[-1] == "punct" and t not in (")", "]", "}", "<", "++", "--")

    def _template(self, at: int) -> int:
        """End of the template that starts at `at`; expressions inside may hold templates and strings."""
        src, n, depth, i = self.src, len(self.src), [], at + 1
        while i < n:
            c = src[i]
            if c == "\\":
                i += 2
                continue
            if not depth:
                if c == "`":
                    return i + 1
                if src.startswith("${", i):
                    depth.append(1)
                    i += 1
            elif c == "`":
                i = self._template(i)
                continue
            elif c in "\"'":
                stop = re.compile(r"(?:\\.|[^\\\n%s])*" % c, re.S).match(src, i + 1).end()
                i = stop
            elif c == "{":
                depth.append(1)
            elif c == "}":
                depth.pop()
            i += 1
        self.out.parse_errors = True
        return n

    def _comment(self, raw: str, at: int, end: int) -> Comment | None:
        if not raw.startswith("/**") or raw.startswith(("/**/", "/***")):
            return None
        lines, hidden, module, prose = [], False, False, True
        for line in raw[3:].removesuffix("*/").splitlines():
            line = line.strip()
            if line.startswith("*") and not line.startswith("**"):
                line = line[1:].removeprefix(" ")
            line = line.rstrip()
            tag = re.match(r"\s*@(\S*)\s*(.*)", line)
            if not tag:
                lines += [line] * prose
                continue
            hidden, module = hidden or tag[1] in HIDING, module or tag[1] in NAMING
            if tag[1] in NAMING + TALKING:
                lines += [tag[2].strip()] * bool(tag[2].strip())
            else:
                prose = False
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return Comment(lines, hidden, module, self.row(at), self.row(end - 1))

    def _pair(self) -> dict[int, int]:
        close, stack = {}, []
        for i, t in enumerate(self.text):
            if self.kind[i] == "punct" and t in _PAIRS:
                stack.append(i)
            elif self.kind[i] == "punct" and t in _PAIRS.values():
                if stack and _PAIRS[self.text[stack[-1]]] == t:
                    close[stack.pop()] = i
                else:
                    self.out.parse_errors = True
        for i in stack:
            self.out.parse_errors = True
            close[i] = len(self.text)
        return close

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def after(self, i: int) -> int:
        return min(self.close.get(i, i), len(self.text) - 1) + 1

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "word"

    def find(self, i: int, j: int, *stops: str) -> int:
        """First token of [i, j) outside of brackets that is one of stops; j without one."""
        while i < j:
            if self.text[i] in stops and self.kind[i] != "str":
                return i
            i = self.after(i)
        return j

    def said(self, i: int, j: int) -> str:
        """Tokens [i, j) as one line, without what only ends or opens."""
        return collapse(self.src[self.start[i] : self.end[j - 1]]).rstrip(";,{ ") if i < j else ""

    def _angle(self, i: int) -> int:
        """The token behind type arguments that start at i."""
        depth = 0
        while i < len(self.text):
            t = self.text[i]
            depth += (t == "<") - (t == ">")
            if not depth:
                return i + 1
            if t == ";":
                break
            i = self.after(i)
        return i

    def _statements(self, i: int, j: int) -> list[tuple[int, int]]:
        """Statements of [i, j): they end at ;, behind the body of a declaration, or where a line ends and nothing asks for more."""
        out = []
        while i < j:
            if self.at(i) == ";":
                i += 1
                continue
            k = self._past_marks(i)
            head = self.at(k)
            if head in ("function", "class", "interface", "enum", "namespace", "module") and self.at(k + 1) not in (".", "=") and self.kind[k] == "word" or head == "const" and self.at(k + 1) == "enum":
                limit = self._line_end(k, j)
                open_ = self._body(k, limit + 1 if limit < j and self.at(limit) == "{" else limit)
                end = self.after(open_) if self.at(open_) == "{" and open_ < j else self._line_end(i, j)
            else:
                end = self._line_end(i, j)
            end = max(end, i + 1)
            out.append((i, end))
            i = end
        return out

    def _body(self, i: int, j: int) -> int:
        """The { that opens the body of a declaration, or the ; that stands in for one. Braces of types in its head are passed over."""
        i = self.find(i, j, "{", ";")
        while i < j and self.at(i) == "{" and self.at(i - 1) in _BEFORE_TYPES:
            i = self.find(self.after(i), j, "{", ";")
        return i

    def _past_marks(self, i: int) -> int:
        while i < len(self.text):
            if self.text[i].startswith("@") and self.kind[i] == "word":  # a decorator
                i += 1
                while self.at(i) == ".":
                    i += 2
                if self.at(i) == "(":
                    i = self.after(i)
            elif self.text[i] in _MARKS and not (self.text[i] in ("async", "declare", "abstract") and not self.name_at(i + 1)):
                i += 1
            else:
                return i
        return i

    def _line_end(self, i: int, j: int) -> int:
        k = i
        while k < j:
            if self.text[k] == ";" and self.kind[k] == "punct":
                return k + 1
            k = self.after(k)
            if k < j and self.line(k) > self.row(self.end[k - 1] - 1) and self.at(k) not in _GOES_ON and self.at(k - 1) not in _WANTS_MORE:
                return k
        return j

    # items

    def _leading(self) -> None:
        """The first comment documents the file if it is tagged so, or if no statement follows in the next line."""
        first = self.notes.get(0, [])
        if first and (first[0].module or len(first) > 1 or not self.text or self.line(0) > first[0].last + 1):
            self.out.module_doc, self.out.module_doc_line = first[0].lines, first[0].first
            self.notes[0] = first[1:]

    def _note(self, i: int) -> Comment | None:
        """The comment that ends in the line above the token, or in its own."""
        found = self.notes.get(i, [])[-1:]
        return found[0] if found and self.line(i) - found[0].last <= 1 else None

    def _add(self, kind: str, name: str, vis: int, i: int, decl: int, j: int, signature: str, *, owner: str | None = None, fields: list[str] = (), note: Comment | None = None) -> None:
        signature = signature.partition(" = ")[0] if len(signature) > LONG else signature
        self.out.items.append(
            {
                "kind": kind, "name": name, "vis": vis, "signature": signature, "doc": note.lines if note else [], "start_line": note.first if note else self.line(i),
                "decl_line": self.line(decl), "end_line": self.row(self.end[j - 1] - 1), "fields": list(fields), "derives": [], "owner": owner,
                "hidden": bool(note and note.hidden), "test_only": False,
            }
        )

    def _statement(self, i: int, j: int) -> None:
        note, k = self._note(i), self._past_marks(i)
        marks = {self.text[x] for x in range(i, k)}
        vis = PUBLIC if "export" in marks else PRIVATE
        decl = next((x for x in range(i, k) if self.text[x] in ("abstract", "async", "declare") and not any(t.startswith("@") for t in self.text[x:k])), k)
        head = self.at(k)
        if head in ("{", "*") or head == "type" and self.at(k + 1) in ("{", "*"):
            if vis == PUBLIC:
                self._export_list(i, k, j, note)
        elif head == "function":
            name = self.at(k + 1 + (self.at(k + 1) == "*"))
            body = self._body(k, j)
            self._add("fn", name if name not in ("(", "") else "default", vis, i, decl, j, self.said(decl, min(body, j)), note=note)
        elif head == "class":
            self._class(i, decl, k, j, vis, note)
        elif head == "interface":
            body = self._body(k, j)
            self._add("interface", self.at(k + 1), vis, i, decl, j, self.said(decl, body), fields=self._parts(body), note=note)
        elif head == "enum" or head == "const" and self.at(k + 1) == "enum":
            at = k + (head == "const")
            body = self.find(at, j, "{")
            names = [t.partition("=")[0].strip() for t in self._parts(body)]
            self._add("enum", self.at(at + 1), vis, i, decl, j, self.said(decl, body), fields=names, note=note)
        elif head == "type" and self.name_at(k + 1):
            self._add("type", self.at(k + 1), vis, i, decl, j, self.said(decl, j), note=note)
        elif head in ("const", "let", "var"):
            self._variables(i, decl, k, j, vis, note)
        elif head in ("namespace", "module", "global") and self.at(k + 1) not in (".", "=") or head in ("import", "if", "for", "while", "return", "try", "switch"):
            return
        elif {"export", "default"} <= marks and self.name_at(k) and j - k <= 2 and head not in ("function", "class"):
            self.listed.add(head)
        elif {"export", "default"} <= marks:
            self._add("const", "default", PUBLIC, i, i, j, self.said(i, self._value_head(k, j)), note=note)
        elif vis == PRIVATE:
            self._assignment(i, j, note)

    def _value_head(self, i: int, j: int) -> int:
        """Where the body of a function or arrow that starts at i begins; j for other values."""
        if self.at(i) == "async":
            i += 1
        if self.at(i) == "function":
            return self.find(i, j, "{")
        arrow = self.find(i, j, "=>", ",", ";")
        return arrow + 1 if arrow < j and self.at(arrow) == "=>" else j

    def _is_function(self, i: int, j: int) -> bool:
        i += self.at(i) == "async"
        if self.at(i) == "function":
            return True
        arrow = self.find(i, j, "=>", ";")
        return arrow < j and self.at(arrow) == "=>" and (self.at(i) in ("(", "<") or arrow == i + 1)

    def _variables(self, i: int, decl: int, k: int, j: int, vis: int, note: Comment | None) -> None:
        at = k + 1
        while at < j and self.at(at) != ";":
            end = self.find(at, j, ",", ";")
            if not self.name_at(at):  # destructuring names nothing of its own
                at = end + 1
                continue
            value = self.find(at, end, "=") + 1
            kind = "fn" if value < end and self._is_function(value, end) else "const"
            if value < end and self.at(value) == "class":
                self._class(i, decl, value, end, vis, note, self.at(at))
            else:
                stop = self._value_head(value, end) if kind == "fn" else end
                single = at == k + 1
                self._add(kind, self.at(at), vis, i, decl if single else at, j if single else end, self.said(decl, stop) if single else f"{self.at(k)} {self.said(at, stop)}", note=note if single else None)
                self._chain(self.at(at), value, end)
            at = end + 1

    def _chain(self, name: str, value: int, end: int) -> None:
        """var a = exports = module.exports = ... exports a."""
        while value < end:
            stop = self.find(value, end, "=")
            if stop < end and "".join(self.text[value:stop]) in ("exports", "module.exports"):
                self.listed.add(name)
            value = stop + 1

    def _class(self, i: int, decl: int, k: int, j: int, vis: int, note: Comment | None, name: str | None = None) -> None:
        body = self._body(k, j)
        own = self.at(k + 1) if self.name_at(k + 1) and self.at(k + 1) not in ("extends", "implements") else None
        name = name or own or "default"
        said = self.find(k, body, "implements")
        at = said + 1
        while at < body:
            end = self.find_type_end(at, body)
            if self.name_at(at):
                bare = next((x for x in range(at, end) if self.at(x) == "<"), end)
                self.out.trait_impls.append({"ty": name, "trait_name": "".join(self.text[at:bare])})
            at = end + 1
        place = len(self.out.items)
        self._add("class", name, vis, i, decl, j, self.said(decl, body), note=note)
        fields = []
        stop = min(self.close.get(body, j), j)
        for a, b in self._members(body + 1, stop):
            self._member(a, b, name, vis, fields)
        self.out.items[place]["fields"] = fields

    def find_type_end(self, i: int, j: int) -> int:
        """The comma behind a type that may have arguments."""
        while i < j and self.at(i) != ",":
            i = self._angle(i) if self.at(i) == "<" else self.after(i)
        return min(i, j)

    def _members(self, i: int, j: int) -> list[tuple[int, int]]:
        """Members of a class body: a method ends behind its body, others at ; or the end of their line."""
        out = []
        while i < j:
            if self.at(i) == ";":
                i += 1
                continue
            k = i
            while k < j:
                t = self.at(k)
                if t == ";":
                    k += 1
                    break
                if t == "{" and self.at(k - 1) not in ("=", ":", "|", "&", "=>", "(", ",", "<", "is", "?") and k > i:
                    k = self.after(k)
                    break
                k = self.after(k)
                if k < j and self.line(k) > self.row(self.end[k - 1] - 1) and self.at(k) not in _GOES_ON - {"["} and self.at(k - 1) not in _WANTS_MORE and not self._only_marks(i, k):
                    break
            out.append((i, k))
            i = max(k, i + 1)
        return out

    def _only_marks(self, i: int, k: int) -> bool:
        return self._past_marks(i) >= k or all(t in _MEMBER_MARKS for t in self.text[i:k])

    def _member(self, i: int, j: int, owner: str, owner_vis: int, fields: list[str]) -> None:
        note, k = self._note(i), self._past_marks(i)
        if self.at(k) == "static" and self.at(k + 1) == "{":
            return
        first = k
        while self.at(k) in _MEMBER_MARKS and k + 1 < j and self.at(k + 1) not in ("(", "=", ":", "?", "!", ";", "<"):
            k += 1
        marks = set(self.text[first:k])
        k += self.at(k) == "*"
        name_end = self.after(k)
        name = self.src[self.start[k] : self.end[name_end - 1]]
        vis = next((v for m, v in _VIS.items() if m in marks), PRIVATE if name.startswith("#") else PUBLIC)
        p = name_end + (self.at(name_end) in ("?", "!"))
        p = self._angle(p) if self.at(p) == "<" else p
        if p < j and self.at(p) == "(":
            body = self._body(self.after(p), j)
            said = next((x for x in range(first, k + 1) if self.text[x] not in ("public", "private", "protected")), k)
            self._add("fn", name, min(vis, PUBLIC), i, said, j, self.said(said, body), owner=owner, note=note)
            return
        value = self.find(p, j, "=")
        if value < j and self._is_function(value + 1, j):
            said = next((x for x in range(first, k + 1) if self.text[x] not in ("public", "private", "protected")), k)
            self._add("fn", name, vis, i, said, j, self.said(said, self._value_head(value + 1, j)), owner=owner, note=note)
        else:
            fields.append(self.said(first, value))

    def _parts(self, body: int) -> list[str]:
        """Members of an interface or enum as text."""
        if self.at(body) != "{":
            return []
        out, i, j = [], body + 1, min(self.close[body], len(self.text))
        while i < j:
            k = i
            while k < j and self.at(k) not in (";", ","):
                k = self._angle(k) if self.at(k) == "<" else self.after(k)
                if k < j and self.line(k) > self.row(self.end[k - 1] - 1) and self.at(k) not in _GOES_ON - {"["} and self.at(k - 1) not in _WANTS_MORE:
                    break
            k = min(k, j)
            if k > i:
                out.append(self.said(i, k))
            i = k + (self.at(k) in (";", ",")) if k < j else j
        return out

    def _export_list(self, i: int, k: int, j: int, note: Comment | None) -> None:
        """export { a, b as c } of what stands here, and what is passed on from another module, as items of kind use."""
        k += self.at(k) == "type"
        passed = self.find(k, j, "from") < j
        signature = self.said(i, j)
        if self.at(k) == "*":
            name = self.at(k + 2) if self.at(k + 1) == "as" else "*"
            self._add("use", name, PUBLIC, i, i, j, signature, note=note)
            return
        for a, b in self._names(k):
            if passed:
                self._add("use", b, PUBLIC, i, i, j, signature, note=note)
            else:
                self.listed.add(a)

    def _names(self, k: int) -> list[tuple[str, str]]:
        """(name, name given to it) of a list in braces."""
        out, i, j = [], k + 1, min(self.close.get(k, k), len(self.text))
        while i < j:
            end = self.find(i, j, ",")
            words = [self.text[x] for x in range(i, end)]
            words = words[1:] if len(words) > 1 and words[0] == "type" and words[1] != "as" else words
            if words:
                out.append((words[0].strip("'\""), words[-1].strip("'\"")))
            i = end + 1
        return out

    def _assignment(self, i: int, j: int, note: Comment | None) -> None:
        """module.exports = ..., exports.a = ..., a.b = function and A.prototype.b = function."""
        equals = self.find(i, j, "=")
        target = "".join(self.text[i:equals]) if equals < j else ""
        value, stop = equals + 1, j - (self.at(j - 1) == ";")
        parts = target.split(".")
        whole = target in ("module.exports", "exports")
        if whole or target.startswith(("exports.", "module.exports.")):
            inner = self.find(value, stop, "=")
            while inner < stop and "".join(self.text[value:inner]) in ("exports", "module.exports"):
                value, inner = inner + 1, self.find(inner + 1, stop, "=")
            if whole and self.at(value) == "{":
                self.listed |= {a for a, _ in self._shorthand(value)}
            elif self.name_at(value) and value + 1 >= stop:
                self.listed.add(self.at(value))
                if not whole and parts[-1] != self.at(value):
                    self._add("const", parts[-1], PUBLIC, i, i, j, self.said(i, stop), note=note)
            elif self.at(value) == "class":
                self._class(i, i, value, stop, PUBLIC, note, parts[-1] if not whole else None)
                if whole and not self.name_at(value + 1):
                    self.out.items[-1]["name"] = "default"
            else:
                function = self._is_function(value, stop)
                own = self.at(value + 1 + (self.at(value) == "async")) if function and whole else ""
                name = parts[-1] if not whole else own if re.match(r"[\w$]+$", own or "(") else "default"
                self._add("fn" if function else "const", name, PUBLIC, i, i, j, self.said(i, self._value_head(value, stop) if function else stop), note=note)
        elif equals < j and len(parts) in (2, 3) and all(re.fullmatch(r"[\w$]+", p) for p in parts) and (len(parts) == 2 or parts[1] == "prototype") and parts[0] not in ("this", "window", "process"):
            if self._is_function(value, stop):
                head = value + (self.at(value) == "async")
                if self.at(head) == "function":
                    head = self.find(head, stop, "(")
                self._add("fn", parts[-1], PUBLIC, i, i, j, f"{parts[-1]}{self.said(head, self._value_head(value, stop))}", owner=parts[0], note=note)

    def _shorthand(self, k: int) -> list[tuple[str, str]]:
        """(value's name, key) of an object that lists names: { a, b: c }."""
        out, i, j = [], k + 1, min(self.close.get(k, k), len(self.text))
        while i < j:
            end = self.find(i, j, ",")
            if self.name_at(i) and (end == i + 1 or end == i + 3 and self.at(i + 1) == ":" and self.name_at(i + 2)):
                out.append((self.at(end - 1), self.at(i)))
            i = end + 1
        return out

    # imports

    def _imports(self) -> None:
        found = []
        i, n = 0, len(self.text)
        while i < n:
            t = self.text[i]
            if self.kind[i] == "word" and t in ("import", "require") and self.at(i + 1) == "(" and self._quoted(i + 2) and self.at(i - 1) != ".":
                self._named(found, i, i + 2, [], True)
            elif self.kind[i] == "word" and t in ("import", "export") and self.at(i - 1) != ".":
                if self._quoted(i + 1):
                    self._named(found, i, i + 1, [], True)
                else:
                    stop = self._from(i, n)
                    if stop:
                        braces = next((x for x in range(i + 1, stop) if self.at(x) == "{"), None)
                        names = [a for a, _ in self._names(braces)] if braces and t == "import" else []
                        first = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) != "from")
                        self._named(found, i, stop + 1, names, self.at(first) != "{")
            i += 1
        self.out.refs = [r for _, r in sorted(found, key=lambda x: x[0])]

    def _quoted(self, i: int) -> bool:
        return self.at(i)[:1] in ("'", '"') and self.kind[i] == "str"

    def _from(self, i: int, n: int) -> int | None:
        """Where `from` stands in front of a text, in the statement at i."""
        k = i + 1
        while k < n and (self.kind[k] == "word" or self.at(k) in ("{", "*", ",")) and self.at(k) not in ("function", "class", "const", "let", "var", "interface", "enum"):
            if self.at(k) == "from" and self._quoted(k + 1):
                return k
            k = self.after(k)
        return None

    def _named(self, found: list, i: int, text: int, names: list[str], whole: bool) -> None:
        """A reference for the module (if it is taken as a whole, or nothing is named) and one for each name that is taken from it."""
        at = specifier(self.text[text][1:-1], self.folder)
        if at is None:
            return
        line = self.line(i)
        ref = {"glob": False, "anchored": at[1], "line": line, "in_test": False, "owner": None}
        if whole or not names:
            found.append((line, ref | {"segments": at[0]}))
        found += [(line, ref | {"segments": [*at[0], n]}) for n in names]

    def _apply_lists(self) -> None:
        """What is exported by name is public; a method is at most as visible as its owner."""
        for x in self.out.items:
            if x["owner"] is None and x["name"] in self.listed:
                x["vis"] = PUBLIC
        owners = {x["name"]: x["vis"] for x in self.out.items if x["owner"] is None}
        for x in self.out.items:
            if x["owner"] is not None:
                x["vis"] = min(x["vis"], owners.get(x["owner"], PUBLIC if x["owner"] in self.listed else PRIVATE))


def parse(source: str, folder: list[str] = ()) -> Parsed:
    """folder: the file's directory below the source root, where relative imports start."""
    return _File(source, list(folder)).out
