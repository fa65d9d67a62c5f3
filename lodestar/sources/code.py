"""Source parsing: definitions and call sites of Python by its own grammar, of other languages by braces.

Only Python's grammar is at hand; the others are read by definition patterns and brace or `end`
matching behind the same interface, with reduced fidelity (no macros, no overload resolution).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

MOST_DEPTH = 12
DEFINITIONS = "path string, name string, qualified_name string, kind string, start_line int, end_line int, depth int"
CALLS = "path string, line int, callee string"
_C_LIKE = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|override|open|suspend|virtual|inline|pub(?:\([^)]*\))?|unsafe|sealed|partial)\s+)*"
#: Definition patterns by language: kind and an expression whose last group is the name.
PATTERNS = {
    "javascript": [("function", _C_LIKE + r"function\s*\*?\s*(\w+)"), ("class", _C_LIKE + r"class\s+(\w+)"), ("interface", _C_LIKE + r"interface\s+(\w+)"), ("enum", _C_LIKE + r"enum\s+(\w+)"), ("type", _C_LIKE + r"type\s+(\w+)\s*(?:<[^>]*>)?\s*="), ("function", _C_LIKE + r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|\w+\s*=>)"), ("method", r"^\s+(?:(?:static|async|get|set|public|private|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^)]*\)[^;{]*\{")],
    "go": [("method", r"^func\s*\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("type", r"^type\s+(\w+)")],
    "java": [("class", _C_LIKE + r"(?:class|record)\s+(\w+)"), ("interface", _C_LIKE + r"interface\s+(\w+)"), ("enum", _C_LIKE + r"enum\s+(\w+)"), ("method", _C_LIKE + r"(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.? ]+?\s+(\w+)\s*\([^)]*\)[^;{]*\{")],
    "rust": [("function", _C_LIKE + r"(?:const\s+)?fn\s+(\w+)"), ("type", _C_LIKE + r"struct\s+(\w+)"), ("enum", _C_LIKE + r"enum\s+(\w+)"), ("trait", _C_LIKE + r"trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("module", _C_LIKE + r"mod\s+(\w+)\s*\{")],
    "cpp": [("module", r"^\s*namespace\s+(\w+)\s*\{"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)[^;]*\{"), ("type", r"^\s*(?:typedef\s+)?(?:struct|union|enum(?:\s+class)?)\s+(\w+)[^;]*\{"), ("function", r"^\s*(?!return\b|else\b|if\b|for\b|while\b|switch\b)[\w:<>,*&~ ]+?[\s*&]([\w~]+(?:::[\w~]+)*)\s*\([^;]*\)\s*(?:const)?\s*(?:noexcept)?\s*\{")],
    "ruby": [("class", r"^\s*class\s+([\w:]+)"), ("module", r"^\s*module\s+([\w:]+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)")],
    "php": [("class", _C_LIKE + r"class\s+(\w+)"), ("interface", _C_LIKE + r"interface\s+(\w+)"), ("trait", _C_LIKE + r"trait\s+(\w+)"), ("function", _C_LIKE + r"function\s+&?(\w+)")],
    "swift": [("class", _C_LIKE + r"(?:class|struct|enum)\s+(\w+)"), ("interface", _C_LIKE + r"protocol\s+(\w+)"), ("function", _C_LIKE + r"func\s+(\w+)")],
    "scala": [("class", _C_LIKE + r"(?:case\s+)?(?:class|object)\s+(\w+)"), ("trait", _C_LIKE + r"trait\s+(\w+)"), ("function", _C_LIKE + r"def\s+(\w+)")],
    "kotlin": [("class", _C_LIKE + r"(?:data\s+)?(?:class|object|interface)\s+(\w+)"), ("function", _C_LIKE + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")],
}
PATTERNS |= {"typescript": PATTERNS["javascript"], "tsx": PATTERNS["javascript"], "csharp": [*PATTERNS["java"], ("type", _C_LIKE + r"struct\s+(\w+)"), ("module", _C_LIKE + r"namespace\s+([\w.]+)")], "c": PATTERNS["cpp"]}
_RULES = {language: [(kind, re.compile(p)) for kind, p in rules] for language, rules in PATTERNS.items()}
#: Kinds whose functions are methods.
CONTAINERS = {"class", "interface", "module", "impl", "trait", "enum"}
_CALL = re.compile(r"(?<![\w$])(?!(?:if|for|while|switch|catch|return|function|def|class|fn|func|new|sizeof|match|elif|and|or|not|in)\b)([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")


@dataclass(frozen=True)
class Definition:
    """A definition: its place, and its name within its containers."""

    name: str
    qualified_name: str
    kind: str
    start: int
    end: int
    depth: int


def callee_name(text: str) -> str:
    """The name called: without one level of generics, the last identifier."""
    found = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"<[^<>]*>", "", text))
    return found[-1] if found else ""


def _python(text: str) -> tuple[list[Definition], list[tuple[int, str]]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    found: list[Definition] = []

    def walk(node: ast.AST, prefix: str, in_class: bool, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}.{child.name}" if prefix else child.name
                is_class = isinstance(child, ast.ClassDef)
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                found.append(Definition(child.name, name, "class" if is_class else "method" if in_class else "function", start, child.end_lineno or start, depth))
                if depth < MOST_DEPTH:
                    walk(child, name, is_class, depth + 1)
            else:
                walk(child, prefix, in_class, depth)

    walk(tree, "", False, 0)
    calls = [(n.lineno, callee_name(ast.unparse(n.func))) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute)]
    return found, sorted(calls)


def _end_of(lines: list[str], start: int, ruby: bool) -> int:
    """Last line of a definition: where its braces close, or for Ruby its `end` at the same indent."""
    if ruby:
        indent = len(lines[start]) - len(lines[start].lstrip())
        return next((i for i in range(start + 1, len(lines)) if lines[i].strip() == "end" and len(lines[i]) - len(lines[i].lstrip()) <= indent), start)
    level, opened = 0, False
    for i in range(start, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i])
        for c in bare:
            level += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and level <= 0:
            return i
        if not opened and (";" in bare or i > start + 8):
            return i if ";" in bare else start
    return len(lines) - 1 if opened else start


def _by_pattern(text: str, language: str) -> tuple[list[Definition], list[tuple[int, str]]]:
    lines = text.splitlines()
    found: list[Definition] = []
    calls: list[tuple[int, str]] = []
    heads = set()
    for i, line in enumerate(lines):
        for kind, pattern in _RULES[language]:
            m = pattern.match(line)
            if m:
                end = _end_of(lines, i, language == "ruby")
                around = [d for d in found if d.start <= i + 1 and end + 1 <= d.end]
                name = m.groups()[-1].replace("::", ".").split(".")[-1]
                scope = around[-1] if around else None
                prefix = f"{scope.qualified_name}." if scope else f"{m.group(1)}." if len(m.groups()) > 1 else ""
                kind = "method" if kind == "function" and scope and scope.kind in CONTAINERS else kind
                if len(around) <= MOST_DEPTH:
                    found.append(Definition(name, prefix + name, kind, i + 1, end + 1, len(around)))
                heads.add(i)
                break
    for i, line in enumerate(lines):
        names = [m.group(1) for m in _CALL.finditer(line)]
        calls += [(i + 1, n) for n in (names[1:] if i in heads else names)]
    return found, calls


def parse(text: str, language: str) -> tuple[list[Definition], list[tuple[int, str]]]:
    """Definitions and (line, callee) call sites of a source text; none for unknown languages."""
    if language == "python":
        return _python(text)
    return _by_pattern(text, language) if language in _RULES else ([], [])


def definitions(files: DataFrame) -> DataFrame:
    """Definitions of files (path, language, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f.path, d.name, d.qualified_name, d.kind, d.start, d.end, d.depth) for f in frame.itertuples() for d in parse(f.text or "", f.language)[0]]
            yield pd.DataFrame(rows, columns=["path", "name", "qualified_name", "kind", "start_line", "end_line", "depth"])

    return files.select("path", "language", "text").mapInPandas(run, DEFINITIONS)


def calls(files: DataFrame) -> DataFrame:
    """Raw call sites of files (path, language, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f.path, line, name) for f in frame.itertuples() for line, name in parse(f.text or "", f.language)[1]]
            yield pd.DataFrame(rows, columns=["path", "line", "callee"])

    return files.select("path", "language", "text").mapInPandas(run, CALLS)
