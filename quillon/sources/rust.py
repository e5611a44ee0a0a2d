"""Rust source text to rows: items, references, calls, trait impls and tests. A lexer and a walk over matched brackets; no grammar is needed.

Broken files still give rows; unbalanced brackets and unfinished strings are reported as a syntax error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>[bc]?r(?P<hashes>\#*)")|(?P<str>[bc]?"(?:\\.|[^"\\])*"?)"""
    r"""|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<num>\d\w*(?:\.\d\w*)?)"""
    r"""|(?P<punct>::|->|=>|==|!=|<=|>=|\.\.=|\.\.\.|\.\.|&&|\|\||[-+*/%^&|]=|.)""",
    re.S,
)
#: The same without names, for text without block comments and raw strings: there a token is what matches, and its text says of which kind it is.
_PIECES = re.compile(re.sub(r"\?P<\w+>", "?:", _TOKEN.pattern), re.S)
_LONE = re.compile(r'/\*|r\#*"')
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MARKERS = {"pub", "default", "unsafe", "async", "const", "extern"}
_KINDS = {"fn": "fn", "struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "type": "type", "const": "const", "static": "static", "use": "use", "mod": "mod", "impl": "impl", "macro_rules": "macro"}
#: Markers but for pub, and kinds of items whose word may stand for something else.
_MARKS = _MARKERS - {"pub"}
_SOFT = {"const", "union", "macro_rules"}
_PATH_WORDS = {"self", "Self", "super", "crate"}
_RESERVED = set("as break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while async await".split())
PRIVATE, RESTRICTED, PUBLIC = 0, 1, 2


class _Kinds(dict):
    """Token -> its kind, remembered for short tokens within a bound."""

    def __missing__(self, text: str) -> str:
        kind = _TOKEN.match(text).lastgroup
        if len(text) <= 40 and len(self) < 100_000:
            self[text] = kind
        return kind


_kinds = _Kinds()


#: Tokens at which a walk over expressions only goes on.
_IDLE = {";", ",", ".", "=", "&", "->", "=>", ")", "]", "}", "!", ":", "+", "*", "-", "?", "==", "pub"}
#: Tokens besides words at which a walk over types does more than go on.
_TURNS = {"#", "<", "::"}


def collapse(text: str) -> str:
    return " ".join(text.split())


def squeeze(text: str) -> str:
    return "".join(text.split())


def without_generics(text: str) -> str:
    depth, out = 0, []
    for c in text:
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return "".join(out)


def segments(path: str) -> list[str]:
    """a::b::<T> as [a, b]."""
    return [s for s in without_generics(squeeze(path)).split("::") if s]


def comment(raw: str) -> tuple[str, list[str]]:
    """inner, outer or plain, and the lines of a documenting comment without its marks."""

    def bare(s: str) -> str:
        return s.removeprefix(" ").rstrip()

    def block(body: str) -> list[str]:
        lines = [bare(x.lstrip().removeprefix("*")) for x in body.removesuffix("*/").splitlines()]
        first = next((i for i, x in enumerate(lines) if x), len(lines))
        return lines[first:]

    raw = raw.rstrip("\r\n")
    if raw.startswith("//!"):
        return "inner", [bare(raw[3:])]
    if raw.startswith("///") and not raw.startswith("////"):
        return "outer", [bare(raw[3:])]
    if raw.startswith("/*!"):
        return "inner", block(raw[3:])
    if raw.startswith("/**") and not raw.startswith("/***") and raw != "/**/":
        return "outer", block(raw[3:])
    return "plain", []


def cfg_test(squeezed: str) -> bool:
    return squeezed == "cfg(test)" or squeezed.startswith("cfg(all(test")


@dataclass
class Parsed:
    lines: int = 0
    module_doc: list = field(default_factory=list)
    module_doc_line: int = 0
    parse_errors: bool = False
    items: list = field(default_factory=list)
    refs: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    trait_impls: list = field(default_factory=list)
    tests: list = field(default_factory=list)


@dataclass(frozen=True)
class _Place:
    """Where a walk over items is: type of the impl, inside a trait's impl, inside tests, at the top of the file."""

    owner: str | None = None
    of_trait: bool = False
    in_test: bool = False
    top: bool = False


@dataclass(frozen=True)
class _Scope:
    """Where a walk over references is."""

    owner: tuple | None = None
    impl_type: str | None = None
    in_test: bool = False


class _File:
    def __init__(self, source: str):
        self.src, self.out = source, Parsed()
        self.out.lines = source.count("\n") + bool(source and not source.endswith("\n"))
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.text: list[str] = []
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.notes: dict[int, list[tuple[str, int, int]]] = {}
        if _LONE.search(source):
            self._lex()
        else:
            self._split()
        self.close = self._pair()
        n = len(self.text)
        #: The token behind each, or behind the group that it opens.
        self.next = list(range(1, n + 1))
        for a, b in self.close.items():
            self.next[a] = min(b, n - 1) + 1
        self._container(0, n, _Place(top=True))
        self._walk(0, n, _Scope())

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def _split(self) -> None:
        pieces = _PIECES.findall(self.src)
        at, text, kinds, start, ends = 0, self.text, self.kind, self.start, self.end
        for piece, kind in zip(pieces, map(_kinds.__getitem__, pieces)):
            end = at + len(piece)
            if kind == "line":
                self.notes.setdefault(len(text), []).append((piece, at, end))
            elif kind != "space":
                if kind == "str" and (len(piece) < 2 or piece[-1] != '"'):
                    self.out.parse_errors = True
                text.append(piece)
                kinds.append(kind)
                start.append(at)
                ends.append(end)
            at = end

    def _lex(self) -> None:
        src, at, n = self.src, 0, len(self.src)
        while at < n:
            m = _TOKEN.match(src, at)
            kind, end = m.lastgroup, m.end()
            if kind == "hashes":
                kind = "raw"
            if kind == "block":
                depth = 1
                while depth and end < n:
                    o, c = src.find("/*", end), src.find("*/", end)
                    if c < 0:
                        end, self.out.parse_errors = n, True
                        break
                    depth, end = (depth + 1, o + 2) if 0 <= o < c else (depth - 1, c + 2)
            elif kind == "raw":
                stop = src.find('"' + m["hashes"], end)
                self.out.parse_errors |= stop < 0
                end = n if stop < 0 else stop + 1 + len(m["hashes"])
            elif kind == "str" and (end - at < 2 or src[end - 1] != '"'):
                self.out.parse_errors = True
            if kind in ("line", "block"):
                self.notes.setdefault(len(self.text), []).append((src[at:end], at, end))
            elif kind != "space":
                self.text.append(src[at:end])
                self.kind.append("str" if kind == "raw" else kind)
                self.start.append(at)
                self.end.append(end)
            at = end

    def _pair(self) -> dict[int, int]:
        close, stack = {}, []
        for i, t in enumerate(self.text):  # other tokens are longer than a bracket, or none
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                if stack and _OPEN[self.text[stack[-1]]] == t:
                    close[stack.pop()] = i
                else:
                    self.out.parse_errors = True
        for i in stack:
            self.out.parse_errors = True
            close[i] = len(self.text)
        return close

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "word"

    def span(self, i: int, j: int) -> str:
        """Source from token i up to, not including, token j."""
        return self.src[self.start[i] : self.end[j - 1]] if i < j <= len(self.text) else ""

    def after(self, i: int) -> int:
        """The token behind i, or behind the group that i opens."""
        return self.next[i] if i < len(self.next) else len(self.next)

    def find(self, i: int, j: int, stops: set[str]) -> int:
        """First token in [i, j) outside of brackets that is one of stops; j without one."""
        text, after = self.text, self.next
        while i < j:
            if text[i] in stops and self.kind[i] in ("punct", "word"):
                return i
            i = after[i]
        return j

    def angle(self, i: int, j: int) -> int:
        """The token behind the > that matches the < at i; i if there is none."""
        depth, k = 0, i
        while k < j:
            t = self.text[k]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in (";", "{", "}") or t == ">=":
                return i
            k = self.after(k)
        return i

    # items

    def _head(self, i: int, j: int) -> tuple[int, int, str]:
        """Visibility, the keyword's position and the kind of the item at i; kind is empty for anything else."""
        vis, k = PRIVATE, i
        if k < j and self.kind[k] == "word" and (plain := _KINDS.get(self.text[k], "")) and self.text[k] not in _SOFT:
            return vis, k, plain
        if self.at(k) == "pub":
            vis, k = PUBLIC, k + 1
            if self.at(k) == "(" and self.at(k + 1) in ("crate", "self", "super", "in"):
                vis, k = RESTRICTED, self.after(k)
        while k < j and self.text[k] in _MARKS:
            t, n = self.at(k), self.at(k + 1)
            if t == "const" and n not in ("fn", "unsafe", "async", "extern"):
                break
            k += 1
            if t == "extern" and k < j and self.kind[k] == "str":
                k += 1
        t = self.at(k)
        if t == "macro_rules" and self.at(k + 1) != "!" or t == "union" and not self.is_word(k + 1) or t in ("default", "auto") or k >= j or self.kind[k] != "word":
            return vis, k, ""
        if t == "auto" or t == "unsafe":
            k += 1
            t = self.at(k)
        return vis, k, _KINDS.get(t, "")

    def _item_end(self, i: int, j: int) -> tuple[int, int]:
        """(body, end): the { of an item's body (or -1) and the token behind the item at i."""
        return self._end_behind(i, j, *self._head(i, j)[1:])

    def _end_behind(self, i: int, j: int, k: int, kind: str) -> tuple[int, int]:
        """The same, where the head was read."""
        if kind in ("use", "type", "const", "static"):
            return -1, min(self.find(k, j, {";"}) + 1, j)
        if kind == "macro":
            g = k + 3
            end = self.after(g)
            return g, end + (self.at(end) == ";" and self.at(g) != "{")
        if kind == "struct" or kind == "union":
            stop = self.find(k, j, {"{", ";"})
            return (stop, self.after(stop)) if self.at(stop) == "{" and stop < j else (-1, min(stop + 1, j))
        if kind:
            stop = self.find(k, j, {"{", ";"})
            return (stop, self.after(stop)) if stop < j and self.at(stop) == "{" else (-1, min(stop + 1, j))
        stop = self.find(i, j, {";", "{"})
        if stop < j and self.at(stop) == "{":
            return -1, self.after(stop)
        return -1, min(stop + 1, j)

    def _container(self, i: int, j: int, place: _Place) -> None:
        docs, attrs, first = [], [], None
        while i <= j:
            for raw, at, _ in self.notes.get(i, ()):
                what, lines = comment(raw)
                if what == "inner" and place.top:
                    self.out.module_doc_line = self.out.module_doc_line or self.line(at)
                    self.out.module_doc += lines
                elif what == "outer":
                    first = at if first is None else first
                    docs += lines
            if i >= j:
                return
            if self.at(i) == "#" and self.at(i + 1) == "[":
                end = self.after(i + 1)
                first = self.start[i] if first is None else first
                attrs.append(self.src[self.end[i + 1] : self.start[end - 1]])
                i = end
                continue
            if self.at(i) == "#" and self.at(i + 1) == "!":
                i = self.after(i + 2)
                continue
            if self.at(i) == ";":
                i += 1
                continue
            head = self._head(i, j)
            body, stop = self._end_behind(i, j, *head[1:])
            end = max(stop, i + 1)
            if head[2]:
                self._item(i, head, body, stop, place, docs, attrs, first)
            docs, attrs, first, i = [], [], None, end

    def _item(self, i: int, head: tuple[int, int, str], body: int, end: int, place: _Place, docs: list, attrs: list, first: int | None) -> None:
        vis, k, kind = head
        squeezed = [squeeze(a) for a in attrs]
        test_only = any(map(cfg_test, squeezed))
        in_test = place.in_test or test_only
        name = self.at(k + 2) if kind == "macro" else self.at(k + 2) if kind == "static" and self.at(k + 1) == "mut" else self.at(k + 1)
        if kind == "fn":
            if any(a == "test" or a.endswith("::test") or a.startswith("test(") for a in squeezed):
                self.out.tests.append({"name": name, "doc": docs})
                return
            if place.of_trait:
                return
        if kind == "mod":
            if body >= 0:
                self._container(body + 1, self.close[body], _Place(in_test=in_test))
            return
        if kind == "impl":
            self._impl(k, body, place, in_test)
            return
        if place.in_test or kind == "use" and vis == PRIVATE:
            return
        derives = [d.rsplit("::", 1)[-1] for a in squeezed if a.startswith("derive(") and a.endswith(")") for d in a[7:-1].split(",") if d]
        begin = self.start[i]
        item = {
            "kind": kind,
            "name": name,
            "vis": vis,
            "signature": self._signature(i, body, end, kind, name),
            "doc": docs,
            "start_line": self.line(begin if first is None else first),
            "decl_line": self.line(begin),
            "end_line": self.line(self.end[end - 1] - 1),
            "fields": self._members(kind, body),
            "derives": derives,
            "owner": place.owner,
            "hidden": any("doc(hidden)" in a for a in squeezed),
            "test_only": test_only,
        }
        if kind != "use":
            self.out.items.append(item)
            return
        for segs, star, alias in self.use_paths(k + 1, end - (self.at(end - 1) == ";"), []):
            shown = "*" if star else alias or (segs[-1] if segs else "")
            self.out.items.append(item | {"name": shown, "signature": f"use {'::'.join(segs)}{'::*' if star else ''}"})

    def _impl_head(self, k: int, body: int) -> tuple[str, str | None]:
        """Type and trait of the impl whose keyword is at k."""
        i = self.angle(k + 1, body) if self.at(k + 1) == "<" else k + 1
        stop, depth, split = body, 0, -1
        p = i
        while p < body:
            t = self.text[p]
            depth += (t == "<") - (t == ">")
            if not depth and t == "where":
                stop = p
                break
            if not depth and t == "for" and self.at(p + 1) != "<":
                split = p
            p = self.after(p)
        last = lambda a, b: (segments(self.span(a, b)) or [""])[-1]
        return (last(split + 1, stop), last(i, split)) if split >= 0 else (last(i, stop), None)

    def _impl(self, k: int, body: int, place: _Place, in_test: bool) -> None:
        if body < 0:
            return
        ty, of = self._impl_head(k, body)
        if of is not None and not in_test:
            self.out.trait_impls.append({"ty": ty, "trait_name": of})
        self._container(body + 1, self.close[body], _Place(owner=ty, of_trait=of is not None, in_test=in_test))

    def _signature(self, i: int, body: int, end: int, kind: str, name: str) -> str:
        if kind == "macro":
            return f"macro_rules! {name}"
        sig = collapse(self.src[self.start[i] : self.start[body]] if body >= 0 else self.span(i, end)).rstrip(";{ ")
        if kind in ("const", "static") and len(sig.encode()) > 100:
            sig = sig.split(" = ", 1)[0]
        return sig.removeprefix("pub ")

    def _members(self, kind: str, body: int) -> list[str]:
        if body < 0 or kind not in ("struct", "union", "enum", "trait"):
            return []
        i, j, out = body + 1, self.close[body], []
        if kind == "trait":
            while i < j:
                i = self._skip_attrs(i, j)
                if i >= j:
                    break
                inner, end = self._item_end(i, j)
                what = self._head(i, j)[2]
                if what == "fn":
                    out.append(self._signature(i, inner, end, "fn", ""))
                elif what == "type":
                    out.append(collapse(self.span(i, end)).rstrip(";"))
                i = max(end, i + 1)
            return out
        while i < j:
            i = self._skip_attrs(i, j)
            first, depth = i, 0
            while i < j and not (self.text[i] == "," and not depth):
                depth += (self.text[i] == "<") - (self.text[i] == ">")
                i = self.after(i)
            if first < i:
                out.append(collapse(self.span(first, i)))
            i += 1
        return out

    def _skip_attrs(self, i: int, j: int) -> int:
        while i < j and self.at(i) == "#":
            i = self.after(i + 1 + (self.at(i + 1) == "!"))
        return i

    def use_paths(self, i: int, j: int, prefix: list[str]) -> list[tuple[list[str], bool, str | None]]:
        """Leaves of a use tree: path, whether it ends in *, alias."""
        segs = []
        while i < j:
            t = self.text[i]
            if t == "::":
                i += 1
            elif t == "{":
                out, k, stop = [], i + 1, self.close[i]
                while k < stop:
                    comma = self.find(k, stop, {","})
                    if comma > k:
                        out += self.use_paths(k, comma, prefix + segs)
                    k = comma + 1
                return out
            elif t == "*":
                return [(prefix + segs, True, None)]
            elif t == "as":
                whole = prefix if segs == ["self"] and prefix else prefix + segs
                return [(whole, False, self.at(i + 1))]
            else:
                segs.append(t)
                i += 1
        return [(prefix if segs == ["self"] and prefix else prefix + segs, False, None)]

    # references and calls

    def _ref(self, segs: list[str], at: int, scope: _Scope, star: bool = False) -> None:
        if star or len(segs) > 1:
            self._add(segs, at, scope, star)

    def _add(self, segs: list[str], at: int, scope: _Scope, star: bool) -> None:
        self.out.refs.append({"segments": segs, "glob": star, "anchored": False, "line": self.line(self.start[at]), "in_test": scope.in_test, "owner": scope.owner})

    def _path(self, i: int, j: int, in_type: bool) -> tuple[list[str], int, int]:
        """Segments of the path at i, the token behind it, and where its last generics begin (else the same token)."""
        segs, k = [], i
        if self.at(k) == "::":
            k += 1
        segs.append(self.text[k])
        k += 1
        while k < j:
            if self.at(k) == "::" and self.is_word(k + 1):
                segs.append(self.text[k + 1])
                k += 2
            elif self.at(k) == "::" and self.at(k + 1) == "<" or in_type and self.at(k) == "<":
                g = self.angle(k + (self.at(k) == "::"), j)
                if self.at(g) == "::" and self.is_word(g + 1) and g > k + 1:
                    segs.append(self.text[g + 1])
                    k = g + 2
                    continue
                return segs, k, g if self.at(k) == "::" and g > k + 1 else k
            else:
                break
        return segs, k, k

    def _starts_path(self, i: int) -> bool:
        return self.is_word(i) and (self.text[i] not in _RESERVED or self.text[i] in _PATH_WORDS) or self.at(i) == "::" and self.is_word(i + 1)

    def _types(self, i: int, j: int, scope: _Scope) -> None:
        """Paths in types and patterns; no calls there."""
        kind, text = self.kind, self.text
        while i < j:
            t = text[i]
            if kind[i] != "word" and t not in _TURNS:
                i += 1
            elif t == "#" and self.at(i + 1) == "[":
                i = self.after(i + 1)
            elif t == "<" and not (self.is_word(i - 1) or self.at(i - 1) in ("::", ">")):
                g = self.angle(i, j)
                i = g + 2 if g > i and self.at(g) == "::" else i + 1
            elif self._starts_path(i):
                segs, k, _ = self._path(i, j, True)
                self._ref(segs, i, scope)
                i = self.after(k + 1) if self.at(k) == "!" and self.at(k + 1) in _OPEN else max(k, i + 1)
            else:
                i += 1

    def _walk(self, i: int, j: int, scope: _Scope) -> None:
        tested = False
        text, idle = self.text, _IDLE
        while i < j:
            t = text[i]
            if t in idle and not tested:
                i += 1
                continue
            if t == "#" and self.at(i + 1) in ("[", "!"):
                group = i + 1 + (self.at(i + 1) == "!")
                if group == i + 1:
                    tested |= cfg_test(squeeze(self.src[self.end[group] : self.start[self.after(group) - 1]]))
                i = self.after(group)
                continue
            if tested:
                end = max(self._item_end(i, j)[1], i + 1)
                self._walk(i, end, _Scope(scope.owner, scope.impl_type, True))
                tested, i = False, end
                continue
            i = max(self._step(i, j, scope), i + 1)

    def _step(self, i: int, j: int, scope: _Scope) -> int:
        """Reads the piece of syntax at i; the token behind it."""
        t = self.text[i]
        if self.kind[i] == "word":
            if t == "use":
                end = self.find(i, j, {";"})
                for segs, star, _ in self.use_paths(i + 1, end, []):
                    self._add(segs, i, scope, star)
                return end + 1
            if t == "fn":
                if not self.is_word(i + 1):
                    return self.after(i + 1)
                stop = self.find(i, j, {"{", ";"})
                own = _Scope((scope.impl_type, self.text[i + 1]), scope.impl_type, scope.in_test) if self.at(stop) == "{" and stop < j else scope
                self._types(i + 2, stop, own)
                if stop < j and self.at(stop) == "{":
                    self._walk(stop + 1, self.close[stop], own)
                return self.after(stop) if stop < j else j
            if t == "impl":
                body = self.find(i, j, {"{", ";"})
                if body >= j or self.at(body) == ";":
                    return i + 1
                own = _Scope(scope.owner, self._impl_head(i, body)[0], scope.in_test)
                self._types(i + 1, body, own)
                self._walk(body + 1, self.close[body], own)
                return self.after(body)
            if t == "mod" and self.is_word(i + 1):
                if self.at(i + 2) == "{":
                    self._walk(i + 3, self.close[i + 2], _Scope(in_test=scope.in_test))
                    return self.after(i + 2)
                return i + 3
            if t in ("struct", "enum", "type") or t == "union" and self.is_word(i + 1):
                end = self._item_end(i, j)[1]
                self._types(i + 2, end, scope)
                return end
            if t == "trait":
                body = self.find(i, j, {"{"})
                self._types(i + 2, body, scope)
                if body < j:
                    self._walk(body + 1, self.close[body], scope)
                return self.after(body) if body < j else j
            if t == "macro_rules" and self.at(i + 1) == "!":
                return self._item_end(i, j)[1]
            if t in ("const", "static") and (self.is_word(i + 1) and self.at(i + 2) == ":" or self.at(i + 1) == "mut"):
                equal = self.find(i, j, {"=", ";"})
                self._types(i + 2, equal, scope)
                return equal + 1
            if t == "let":
                stop = self.find(i + 1, j, {"=", ";", "in"})
                self._types(i + 1, stop, scope)
                return stop + 1
            if t == "for" and self.at(i + 1) != "<":
                stop = self.find(i + 1, j, {"in", "{"})
                self._types(i + 1, stop, scope)
                return stop + 1
            if t == "match":
                body = self.find(i + 1, j, {"{"})
                self._walk(i + 1, body, scope)
                if body < j:
                    self._arms(body + 1, self.close[body], scope)
                return self.after(body) if body < j else j
            if t == "as":
                return self._cast(i + 1, j, scope)
        if t in ("|", "||") and self._expression_starts(i):
            if t == "||":
                return i + 1
            stop = self.find(i + 1, j, {"|"})
            self._types(i + 1, stop, scope)
            return stop + 1
        if t == "<" and self._expression_starts(i):
            g = self.angle(i, j)
            if g > i and self.at(g) == "::":
                return self._chain(i, g + 2, j, scope, [], i)
        if self._starts_path(i):
            if self.at(i - 1) == "pub":
                return i + 1
            segs, k, generics = self._path(i, j, False)
            return self._chain(i, k, j, scope, segs, generics)
        if t in _OPEN:
            end = self.after(i)
            self._walk(i + 1, min(self.close[i], j), scope)
            return end
        return i + 1

    def _cast(self, i: int, j: int, scope: _Scope) -> int:
        if self._starts_path(i):
            segs, k, _ = self._path(i, j, True)
            self._ref(segs, i, scope)
            return k
        return i

    def _expression_starts(self, i: int) -> bool:
        before = self.at(i - 1)
        return i == 0 or before in ("(", ",", "=", "=>", "{", "}", ";", "move", "return", "[", "else", "&", "&&", "!", "in", "==", "|", "->", "async")

    def _arms(self, i: int, j: int, scope: _Scope) -> None:
        while i < j:
            i = self._skip_attrs(i, j)
            stop = self.find(i, j, {"=>", "if"})
            self._types(i, stop, scope)
            arrow = self.find(stop, j, {"=>"})
            if self.at(stop) == "if":
                self._walk(stop + 1, arrow, scope)
            i = arrow + 1
            if i >= j:
                return
            end = self.after(i) if self.at(i) == "{" else self._until_comma(i, j)
            self._walk(i, end, scope)
            i = end + (self.at(end) == ",")

    def _until_comma(self, i: int, j: int) -> int:
        """End of the expression at i in a list; commas between the bars of a closure and in generics do not end it."""
        while i < j and self.text[i] != ",":
            if self.text[i] == "|" and self._expression_starts(i):
                i = self.find(i + 1, j, {"|"}) + 1
            elif self.text[i] == "::" and self.at(i + 1) == "<":
                i = max(self.angle(i + 1, j), i + 2)
            else:
                i = self.after(i)
        return min(i, j)

    def _chain(self, i: int, k: int, j: int, scope: _Scope, segs: list[str], generics: int) -> int:
        """A path at i with what is called on it. The last call of a chain is recorded first, as the outermost expression.

        k: the token behind the path; generics: the token behind its last generics, if it ends with some.
        """
        if self.at(k) == "!" and self.at(k + 1) in _OPEN and self.at(k) != "!=":
            self._ref(segs, i, scope)
            return self._postfix(i, self.after(k + 1), j, scope, [])
        ops: list[tuple] = []
        p = generics if generics > k else k
        if self.at(p) == "(" and p < j and self.at(i - 1) not in ("fn",):
            ops.append(("call", k, p))
            p = self.after(p)
        elif generics > k:
            p = generics
        base = lambda: (self._ref(segs, i, scope), self._types(k, generics, scope) if generics > k else None)
        return self._postfix(i, p, j, scope, ops, base)

    def _postfix(self, i: int, p: int, j: int, scope: _Scope, ops: list[tuple], base=lambda: None) -> int:
        while p < j:
            t = self.text[p]
            if t == "." and self.is_word(p + 1):
                g = self.angle(p + 3, j) if self.at(p + 2) == "::" and self.at(p + 3) == "<" else p + 2
                if self.at(g) == "(" and g < j:
                    ops.append(("method", p + 1, g, g if g > p + 2 else 0))
                    p = self.after(g)
                else:
                    p += 2
            elif t == "." and self.at(p + 1).isdigit():
                p += 2
            elif t == "?":
                p += 1
            elif t == "[" and ops:
                ops.append(("index", p))
                p = self.after(p)
            elif t == "(" and ops and ops[-1][0] != "index":
                ops.append(("again", p))
                p = self.after(p)
            else:
                break
        for op in reversed(ops):
            if op[0] == "call":
                callee = squeeze(self.span(i, op[2]))
                whole = self.span(op[1], op[2])
                generic = squeeze(whole).removeprefix("::").lstrip("<").rstrip(">") if whole else None
                self._call(callee, None, generic, op[2], self.line(self.start[i]), scope)
            elif op[0] == "method":
                generic = squeeze(self.span(op[1] + 2, op[3])).lstrip("<").rstrip(">") if op[3] else None
                self._call(self.text[op[1]], self.text[op[1]], generic, op[2], self.line(self.start[op[1]]), scope)
            elif op[0] == "again":
                self._call(squeeze(self.span(i, op[1])), None, None, op[1], self.line(self.start[i]), scope)
        base()
        for op in ops:
            group = op[2] if op[0] in ("call", "method") else op[1]
            if op[0] == "method" and op[3]:
                self._types(op[1] + 2, op[3], scope)
            self._walk(group + 1, min(self.close[group], j), scope)
        return p

    def _call(self, callee: str, method: str | None, generics: str | None, group: int, line: int, scope: _Scope) -> None:
        args, k, stop = [], group + 1, min(self.close[group], len(self.text))
        while k < stop:
            end = self._until_comma(k, stop)
            if end > k:
                args.append(collapse(self.span(k, end)).replace(" .", ".").replace(". ", ".").replace(" ::", "::"))
            k = end + 1
        self.out.calls.append({"callee": callee, "method": method, "generics": generics, "args": args, "line": line, "in_test": scope.in_test, "owner": scope.owner})


def parse(source: str) -> Parsed:
    return _File(source).out


def module_of(parts: list[str]) -> list[str] | None:
    """Module of a file by its path below the source directory; null if the file belongs to none."""
    if not parts or not parts[-1].endswith(".rs") or parts[0] == "bin" and len(parts) > 1:
        return None
    dirs, stem = parts[:-1], parts[-1][:-3]
    return dirs if stem == "mod" or not dirs and stem in ("main", "lib") else [*dirs, stem]
