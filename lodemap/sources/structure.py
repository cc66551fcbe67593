"""Structure of source files: declarations with their extent, imports, parents and calls.

One pass per file. Comments and literals are blanked in place (lengths and line breaks stay), so that what is left can
be matched over line ends, and brackets can be paired; a declaration ends with the bracket that its body opens. Python
sources go through the language's own parser. A broken file gives what can be made out, a file of another language
nothing. A file is one row; files are dealt out evenly over the tasks, however few parts their table is read in.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .source_code import NOT_CALLS
from .tables import spread

SYMBOLS = "path string, line int, end_line int, kind string, name string, exported boolean, signature string, owner string"
IMPORTS = "path string, line int, target string, import_type string, names string"
PARENTS = "path string, child string, relation string, parent string"
CALLS = "path string, caller string, callee string, line int"

_TOKENS = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[\w$]+)"
_STRINGS = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_LEXERS = {
    "script": re.compile(rf"{_TOKENS}|(?P<string>{_STRINGS})|(?P<tick>`)|(?P<slash>/)|(?P<mark>=>|.)", re.S),
    "java": re.compile(rf'{_TOKENS}|(?P<string>"""(?:\\.|.)*?(?:"""|\Z)|{_STRINGS})|(?P<mark>.)', re.S),
    "go": re.compile(rf"{_TOKENS}|(?P<string>`[^`]*`?|{_STRINGS})|(?P<mark>.)", re.S),
}
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?P<stop>`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![*/>])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words that an expression follows, and words whose brackets a statement follows.
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await", "extends", "default"}
_HEADS = {"if", "while", "for", "with"}
_NAME = r"[A-Za-z_$][\w$]*"
_SCRIPT = re.compile(rf"(?P<mark>(?:\b(?:export|default|declare|abstract|async)\s+)*)\b(?P<word>function|class|interface|enum|type|namespace)\b\s*\*?\s*(?P<name>{_NAME})")
_ARROW = re.compile(rf"(?P<mark>\bexport\s+)?\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::(?:[^=;\n]|=>|\n(?!\s*(?:const|let|var|function|class|export|import|return|if|for)\b))*?)?=(?![=>])\s*(?P<fn>(?:async\b\s*)?(?:function\b|(?:<[^>]*>\s*)?\(|{_NAME}\s*=>))?")
_METHOD = re.compile(rf"(?P<mark>(?:\b(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*)\*?\s*(?P<name>[#A-Za-z_$][\w$]*)\s*(?:<[^>(){{}}]*>\s*)?\(")
_JAVA_TYPE = re.compile(r"(?P<mark>(?:\b(?:public|protected|private|static|abstract|final|sealed)\s+)*)\b(?P<word>class|interface|enum|record)\s+(?P<name>\w+)")
_JAVA_METHOD = re.compile(r"(?P<mark>(?:\b(?:public|protected|private|static|abstract|final|synchronized|native|default)\s+)*)(?:<[^>]*>\s*)?(?:[\w.]+(?:<[^(){};]*>)?(?:\[\])*\s+)?(?P<name>\w+)\s*\(")
_GO = re.compile(r"^(?:func\s*(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<func>\w+)\s*(?:\[[^\]]*\])?\(|type\s+(?P<type>\w+)(?:\[[^\]]*\])?\s+(?P<word>struct|interface|\S+))", re.M)
_CALL = re.compile(r"(?<![.\w$])([A-Za-z_$][\w$]*)\s*\(")
_WORDS = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": "namespace", "record": "class", "struct": "class"}
#: Words that stand where a method's name could.
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "synchronized", "super", "this", "function", "await", "typeof"}


class Source:
    """A file with its comments, and its literals too, blanked, and its brackets paired.

    What a slash opens depends on what stands before it: behind a value it divides, elsewhere it opens a regular
    expression. Text of templates is blanked, the code between ``${`` and ``}`` stays, at any depth. A closing bracket
    closes the last open one of its kind together with those left open inside; one without a partner closes nothing.
    """

    def __init__(self, text: str, language: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.language = language
        self.close: dict[int, int] = {}
        comments: list[tuple[int, int]] = []
        literals: list[tuple[int, int]] = []
        next_token = _LEXERS.get(language, _LEXERS["script"]).match
        open_: list[tuple[str, int, bool]] = []  # bracket, place, whether a value ends where it closes
        at, value, word = 0, False, ""  # a value has just ended; the last word, if it was the last token
        while at < len(text):
            m = next_token(text, at)
            kind, token, begin, at = m.lastgroup, m[0], m.start(), m.end()
            if kind == "comment":
                comments.append((begin, at))
            elif kind == "string":
                literals.append((begin, at))
                value, word = True, ""
            elif kind == "word":
                value, word = token not in _BEFORE_EXPRESSION, token
            elif kind == "tick" or (token == "}" and open_ and open_[-1][0] == "$"):
                if kind != "tick":
                    open_.pop()
                m = _TEMPLATE.match(text, at)
                at = m.end()
                literals.append((begin, at))
                if m["stop"] == "${":
                    open_.append(("$", begin, False))
                value, word = m["stop"] != "${", ""
            elif kind == "slash":
                m = None if value or text[begin - 1 : begin] == "<" else _REGEX.match(text, begin)
                if m:
                    at = m.end()
                    literals.append((begin, at))
                value, word = m is not None, ""
            elif token in "([{":
                ends = word not in _HEADS if token == "(" else token == "[" or (not value and word not in ("do", "else") and text[:begin].rstrip()[-1:] not in ("", ";", "}", "{", ">"))
                open_.append((token, begin, ends))
                value, word = False, ""
            elif token in ")]}":
                partner = {")": "(", "]": "[", "}": "{"}[token]
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] in (partner, "$")), -1)
                if k >= 0 and open_[k][0] == partner:
                    value = open_[k][2]
                    self.close |= {place: begin for _, place, _ in open_[k:]}
                    del open_[k:]
                word = ""
            elif kind != "space":
                value, word = False, ""
        self.quoted, self.code = self._blanked(text, comments), self._blanked(text, sorted(comments + literals))

    @staticmethod
    def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
        out, done = [], 0
        for a, b in spans:
            out += [text[done:a], re.sub(r"[^\n]", " ", text[a:b])]
            done = b
        return "".join([*out, text[done:]])

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def body(self, at: int) -> tuple[int, int] | None:
        """The braces that open behind ``at``, before the statement ends."""
        while m := re.compile(r"[{(\[;]|=>").search(self.code, at):
            if m[0] == "{":
                return m.start(), self.close.get(m.start(), len(self.code) - 1)
            if m[0] == ";":
                return None
            at = m.end() if m[0] == "=>" else self.close.get(m.start(), len(self.code)) + 1
            if m[0] == "=>" and not self.code[at:].lstrip().startswith("{"):
                return None
        return None

    def end(self, at: int) -> int:
        """Where a declaration without braces ends."""
        m = re.compile(r"[;\n]").search(self.code, at)
        return m.start() if m else len(self.code)

    def signature(self, at: int, stop: int) -> str:
        """Parameters and result type of the function whose parameters open behind ``at``."""
        begin = self.code.find("(", at, stop)
        if begin < 0:
            return ""
        said = re.sub(r"\s+", " ", self.quoted[begin:stop]).strip().removesuffix("=>").strip()
        return said if len(said) <= 200 else said[:200] + "..."


def _script_symbols(s: Source) -> Iterator[tuple]:
    types = []
    for m in _SCRIPT.finditer(s.code):
        word = m["word"]
        found = s.body(m.end())
        begin, stop = found or (s.end(m.end()), s.end(m.end()))
        if word == "class" or word == "interface":
            types.append((m["name"], word, begin, stop))
        if word == "type" and not re.match(r"\s*(?:<[^=;]*>\s*)?=", s.code[m.end() :]):
            continue
        yield m.start("word"), stop, _WORDS[word], m["name"], "export" in m["mark"], s.signature(m.end(), begin) if word == "function" else "", "", m["mark"]
    for m in _ARROW.finditer(s.code):
        found = s.body(m.start("fn")) if m["fn"] else None
        stop = found[1] if found else s.end(m.end())
        head = s.code.find("=>", m.end()) if m["fn"] else -1
        kind = "const" if not m["fn"] else "component" if m["name"][0] == m["name"][0].upper() != "_" else "function"
        yield m.start("name"), stop, kind, m["name"], bool(m["mark"]), s.signature(m.start("fn"), found[0] if found else head if head > 0 else stop) if m["fn"] else "", "", ""
    for owner, word, begin, stop in types:
        if word == "class":
            yield from _methods(s, _METHOD, owner, begin, stop, lambda mark, name: not re.search("private|protected", mark) and not name.startswith("#"))


def _methods(s: Source, pattern: re.Pattern, owner: str, begin: int, stop: int, exported: Callable[[str, str], bool]) -> Iterator[tuple]:
    at = begin + 1
    while at < stop:
        m, skip = pattern.search(s.code, at, stop), s.code.find("{", at, stop)
        if m is None or 0 <= skip < m.start():  # an inner body comes first
            if skip < 0:
                return
            at = s.close.get(skip, stop) + 1
            continue
        after = s.close.get(m.end() - 1, stop) + 1
        found = s.body(after)
        if m["name"] in _NOT_METHODS or found is None or found[0] >= stop or re.search(r"[=}]", s.code[after : found[0]]):
            at = after
            continue
        yield m.start("name"), found[1], "method", m["name"], exported(m["mark"] or "", m["name"]), s.signature(m.end("name"), found[0]), owner, ""
        at = found[1] + 1


def _java_symbols(s: Source) -> Iterator[tuple]:
    for m in _JAVA_TYPE.finditer(s.code):
        found = s.body(m.end())
        begin, stop = found or (s.end(m.end()), s.end(m.end()))
        yield m.start("word"), stop, _WORDS[m["word"]], m["name"], "public" in m["mark"], "", "", ""
        yield from _methods(s, _JAVA_METHOD, m["name"], begin, stop, lambda mark, _: "public" in mark)


def _go_symbols(s: Source) -> Iterator[tuple]:
    for m in _GO.finditer(s.code):
        found = s.body(s.close.get(m.end() - 1, m.end()) + 1) if m["func"] else s.body(m.start("word")) if m["word"] in ("struct", "interface") else None
        stop = found[1] if found else s.end(m.end())
        if m["func"]:
            yield m.start("func"), stop, "method" if m["owner"] else "function", m["func"], m["func"][0].isupper(), s.signature(m.end("func"), found[0] if found else stop), m["owner"] or "", ""
        else:
            yield m.start("type"), stop, _WORDS.get(m["word"], "type") if m["word"] in ("struct", "interface") else "type", m["type"], m["type"][0].isupper(), "", "", ""


def _python_symbols(tree: ast.AST, owner: str = "") -> Iterator[tuple]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, ast.ClassDef):
            yield node.lineno, node.end_lineno, "class", node.name, not node.name.startswith("_"), "", owner
            yield from _python_symbols(node, node.name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            said = f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
            yield node.lineno, node.end_lineno, "method" if owner else "function", node.name, not node.name.startswith("_"), said if len(said) <= 200 else said[:200] + "...", owner
            yield from _python_symbols(node)
        else:
            yield from _python_symbols(node, owner)


_source = lru_cache(maxsize=4)(Source)  # symbols and calls of a file share it
_FINDERS = {"javascript": _script_symbols, "typescript": _script_symbols, "java": _java_symbols, "go": _go_symbols}


def _tree(text: str) -> ast.AST | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def symbols_of(text: str, language: str) -> list[tuple]:
    """(line, end_line, kind, name, exported, signature, owner) of each declaration, in order of place."""
    if language == "python":
        return sorted(_python_symbols(tree)) if (tree := _tree(text)) else []
    if language not in _FINDERS:
        return []
    s = _source(text, language)
    out = {(at, name): (s.line(at), s.line(stop), kind, name, shown, said, owner) for at, stop, kind, name, shown, said, owner, _ in _FINDERS[language](s)}
    return [out[k] for k in sorted(out)]


_JS_IMPORT = re.compile(r"""(?:^|[;\n])\s*(?P<word>import|export)\b\s*(?:type\s+)?(?P<names>[\w$*{}\s,]*?)\s*(?:\bfrom\b\s*)?(?P<q>['"])(?P<target>[^'"\n]+)(?P=q)""")
_JS_CALLED = re.compile(r"""\b(?P<word>import|require)\s*\(\s*(?P<q>['"`])(?P<target>[^'"`\n]+)(?P=q)\s*\)""")
_JAVA_IMPORT = re.compile(r"(?:^|(?<=[;\n]))\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")
_GO_IMPORT = re.compile(r"^import\s*(?:\((?P<block>[^)]*)\)|(?P<one>[^\n]*))", re.M)
_GO_PATH = re.compile(r'(?P<alias>[\w.]+\s+)?"(?P<target>[^"\n]+)"')


def imports_of(text: str, language: str) -> list[tuple]:
    """(line, target, import_type, names) of each import, in order of place; names are those taken over, comma-joined."""
    out: list[tuple[int, str, str, str]] = []
    if language == "python":
        for node in ast.walk(_tree(text) or ast.Module([], [])):
            if isinstance(node, ast.Import):
                out += [(node.lineno, a.name, "namespace", a.asname or "") for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out.append((node.lineno, "." * node.level + (node.module or ""), "named", ",".join(a.name for a in node.names)))
        return sorted(out)
    s = _source(text, language)
    if language in ("javascript", "typescript"):
        for m in _JS_IMPORT.finditer(s.quoted):
            names = re.sub(r"\s+", " ", m["names"]).strip()
            if m["word"] == "export" and not names:
                continue
            kind = "named" if names.startswith("{") else "namespace" if names.startswith("*") else "default"
            taken = ",".join(x.strip() for x in re.sub(r"[{}]", "", names).split(",") if x.strip())
            out.append((s.line(m.start("word")), m["target"], kind, taken))
        out += [(s.line(m.start("word")), m["target"], "dynamic" if m["word"] == "import" else "require", "") for m in _JS_CALLED.finditer(s.quoted)]
    elif language == "java":
        out = [(s.line(m.start(1)), m[1], "named", m[1].rpartition(".")[2]) for m in _JAVA_IMPORT.finditer(s.code)]
    elif language == "go":
        for m in _GO_IMPORT.finditer(s.quoted):
            group = "block" if m["block"] is not None else "one"
            out += [(s.line(m.start(group) + p.start("target")), p["target"], "named", (p["alias"] or "").strip()) for p in _GO_PATH.finditer(m[group])]
    return sorted(out)


_HEAD = re.compile(r"\b(?P<word>class|interface|record|enum)\s+(?P<name>[\w$]+)\s*(?:<[^{]*?>\s*)?(?:\([^)]*\)\s*)?(?=extends|implements)(?P<rest>[^{;]*)")


def parents_of(text: str, language: str) -> list[tuple]:
    """(child, relation, parent) of each class and interface: all parents, without type arguments."""
    if language == "python":
        return sorted({(n.name, "extends", ast.unparse(b)) for n in ast.walk(_tree(text) or ast.Module([], [])) if isinstance(n, ast.ClassDef) for b in n.bases})
    if language not in ("javascript", "typescript", "java"):
        return []
    out = set()
    for m in _HEAD.finditer(_source(text, language).code):
        rest = m["rest"]
        while (less := re.sub(r"<[^<>]*>", "", rest)) != rest:
            rest = less
        for part in re.finditer(r"\b(extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", rest, re.S):
            out |= {(m["name"], part[1], p.strip()) for p in part[2].split(",") if re.fullmatch(r"[\w$.]+", p.strip())}
    return sorted(out)


def calls_of(text: str, language: str) -> list[tuple]:
    """(caller, callee, line): plain calls, by the innermost declared function around them; calls of oneself are left out."""
    found = [(a, b, n) for a, b, k, n, *_ in symbols_of(text, language) if k in ("function", "method", "component")]
    out = set()
    if language == "python":
        for node in ast.walk(_tree(text) or ast.Module([], [])):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
                out.add((node.func.id, node.lineno))
    else:
        s = _source(text, language)
        heads = {(a, n.lstrip("#")) for a, _, n in found}
        met = {(m[1], s.line(m.start(1))) for m in _CALL.finditer(s.code)}
        out = {(n, a) for n, a in met if n not in NOT_CALLS and n not in ("async", "func") and (a, n) not in heads}
    rows, around, spans = [], [], deque(sorted(found))
    for line, callee in sorted((line, callee) for callee, line in out):
        while spans and spans[0][0] <= line:
            around.append(spans.popleft())
        around = [f for f in around if f[1] >= line]  # as deep as functions nest
        if around and (caller := min((b - a, n) for a, b, n in around)[1]) != callee:
            rows.append((caller, callee, line))
    return sorted(rows)


def _table(files: DataFrame, find: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, lang, t in zip(f["path"], f["language"], f["text"], strict=True) for r in find(t or "", lang or "")]
            yield pd.DataFrame(rows, columns=names)

    return spread(files.select("path", "language", "text")).mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """``SYMBOLS`` of files (path, language, text); null texts are empty."""
    return _table(files, symbols_of, SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    return _table(files, imports_of, IMPORTS)


def hierarchy(files: DataFrame) -> DataFrame:
    return _table(files, parents_of, PARENTS)


def calls(files: DataFrame) -> DataFrame:
    return _table(files, calls_of, CALLS)
