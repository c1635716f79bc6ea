"""Parsers that need more than patterns, as table functions over (repo_id, path, content)."""

from __future__ import annotations

import ast
import re
import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


def parse(files: DataFrame, parser: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """repo_id, path and the parser's rows of each file's content, in Arrow batches; a file that doesn't parse has none."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f.repo_id, f.path, *r) for f in batch.itertuples(index=False) for r in parser(f.content or "")]
            yield pd.DataFrame(rows, columns=["repo_id", "path", *names])

    return files.select("repo_id", "path", "content").mapInPandas(run, f"repo_id string, path string, {columns}")


BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.comprehension, ast.match_case, ast.Assert)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)


def python_functions(text: str) -> Iterator[tuple]:
    """name, start_line, end_line, complexity (branches + 1), depth of each function."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def own(node: ast.AST, depth: int) -> Iterator[tuple[ast.AST, int]]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            below = depth + isinstance(child, NESTING)
            yield child, below
            yield from own(child, below)

    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inside = list(own(f, 0))
            yield f.name, f.lineno, f.end_lineno, 1 + sum(isinstance(n, BRANCHES) for n, _ in inside), max([0, *(d for _, d in inside)])


def python_imports(text: str) -> Iterator[tuple]:
    """module, line of each import."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            yield from ((a.name, n.lineno) for a in n.names)
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            yield n.module, n.lineno


def python_graph(text: str) -> Iterator[tuple]:
    """source, target, type, line: what defines, inherits and calls what, by name within the file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def dotted(n: ast.AST) -> str:
        return n.id if isinstance(n, ast.Name) else f"{dotted(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else ""

    def walk(node: ast.AST, owner: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{child.name}" if owner else child.name
                yield owner, name, "defines", child.lineno
                if isinstance(child, ast.ClassDef):
                    yield from ((name, dotted(b), "inherits", child.lineno) for b in child.bases if dotted(b))
                yield from walk(child, name)
            else:
                if isinstance(child, ast.Call) and dotted(child.func):
                    yield owner, dotted(child.func), "calls", child.lineno
                yield from walk(child, owner)

    yield from walk(tree, "")


MUTATORS = frozenset("append add pop popitem remove discard clear update setdefault insert extend appendleft popleft".split())


def unguarded_checks(text: str) -> Iterator[tuple]:
    """function, name, line: tests of shared state that a function then changes with no lock held, once an if.

    Shared is what a method keeps on its object or a function declares global; a `with` over something named like a lock guards.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    if not re.search(r"\b(threading|concurrent\.futures|asyncio|multiprocessing)\b", text):
        return

    def name(n: ast.AST) -> str:
        return n.id if isinstance(n, ast.Name) else f"{name(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else name(n.value) if isinstance(n, ast.Subscript) else ""

    def changed(n: ast.AST) -> str:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in MUTATORS:
            return name(n.func.value)
        target = n.target if isinstance(n, ast.AugAssign) else n.targets[0] if isinstance(n, (ast.Assign, ast.Delete)) else None
        return name(target) if target is not None else ""

    def visit(node: ast.AST, function: str, shared: set[str], locked: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield from visit(child, child.name, {g for n in ast.walk(child) if isinstance(n, ast.Global) for g in n.names}, False)
                continue
            held = locked or isinstance(child, (ast.With, ast.AsyncWith)) and any("lock" in ast.unparse(i.context_expr).lower() for i in child.items)
            if isinstance(child, ast.If) and function and not held:
                tested = {name(n) for n in ast.walk(child.test)} - {""}
                for n in (n for s in child.body for n in ast.walk(s)):
                    what = changed(n)
                    if what in tested and (what.startswith("self.") or what in shared):
                        yield function, what, child.lineno
                        break
            yield from visit(child, function, shared, held)

    yield from visit(tree, "", set(), False)


#: An instruction with the lines that continue it; comments between them don't end it.
_CONTINUED = re.compile(r"\\[ \t]*\n(?:[ \t]*#[^\n]*\n)*")
_INSTRUCTION = re.compile(rf"(?m)^(?:[^\n]*?{_CONTINUED.pattern})*[^\n]*$")
_VARIABLE = re.compile(r"\$\{(?P<long>\w+)(?::(?P<how>[-+])(?P<word>[^}]*))?\}|\$(?P<short>\w+)")


@dataclass
class Instruction:
    """One instruction of a Dockerfile: where it begins, its word, its --flags and the operands after them."""

    line: int
    word: str
    flags: dict[str, str]
    operands: list[str]


def instructions(text: str) -> Iterator[Instruction]:
    line = at = 0
    for m in _INSTRUCTION.finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        body = _CONTINUED.sub(" ", m[0]).strip()
        if not body or body.startswith("#"):
            continue
        try:
            words = shlex.split(body)
        except ValueError:  # an open quote
            words = body.split()
        flags = {k: v for k, _, v in (w[2:].partition("=") for w in words[1:] if w.startswith("--"))}
        yield Instruction(line + 1, words[0].upper() if words else "", flags, [w for w in words[1:] if not w.startswith("--")])


def _filled(word: str, arguments: dict[str, str]) -> str | None:
    """The word with its variables put in; None if one has no value."""

    def put(m: re.Match) -> str:
        value = arguments.get(m["long"] or m["short"], "")
        if m["how"] == "+":
            return m["word"] if value else ""
        return value or (m["word"] if m["how"] else "\0")

    out = _VARIABLE.sub(put, word)
    return None if "\0" in out else out


def dockerfile_images(text: str) -> Iterator[tuple]:
    """line, image, instruction of each image a Dockerfile pulls; its own stages and arguments without a value don't count."""
    every = list(instructions(text))
    begins = next((k for k, i in enumerate(every) if i.word == "FROM"), len(every))
    arguments = {k: v for i in every[:begins] if i.word == "ARG" for k, _, v in (o.partition("=") for o in i.operands) if v}
    stages: dict[str, int] = {}
    for k, i in enumerate(every):
        if i.word == "FROM" and len(i.operands) > 2 and i.operands[1].lower() == "as":
            stages.setdefault(i.operands[2].lower(), k)
    for k, i in enumerate(every):
        source = i.operands[0] if i.word == "FROM" and i.operands else i.flags.get("from", "") if i.word in ("COPY", "ADD") else ""
        image = _filled(source, arguments) if source and not source.isdigit() else None
        if image and stages.get(image.lower(), k) >= k and (i.word == "FROM" or re.search("[/:@]", image)):
            yield i.line, image, "FROM" if i.word == "FROM" else f"{i.word} --from"


TOKEN = re.compile(r'\s+|#[^\n]*|//[^\n]*|/\*.*?\*/|(?P<here><<-?\s*(?P<tag>\w+)\n.*?\n\s*(?P=tag)\b)|(?P<text>"(?:\\.|\$\{[^}]*\}|[^"\\])*")|(?P<word>[A-Za-z_][\w.-]*(?:\[[^\]\n]*\][\w.]*)*)|(?P<number>-?\d[\w.]*)|(?P<mark>[{}\[\]()=,:?]|[^\s\w])', re.S)


def hcl_resources(text: str) -> Iterator[tuple]:
    """type, name, properties (JSON) of each resource block; repeated blocks become lists, expressions stay as text."""
    import json

    tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(text) if m.lastgroup and m.lastgroup != "tag" or m["here"]]
    at = 0

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) else ""

    def value():
        nonlocal at
        if at >= len(tokens):
            return None
        kind, word = tokens[at]
        if word == "{":
            at += 1
            return body()
        if word == "[":
            at += 1
            out = []
            while peek() not in ("]", ""):
                out.append(value())
                if peek() == ",":
                    at += 1
            at += 1
            return out
        at += 1
        if kind == "text":
            return word[1:-1]
        rest = [word]
        while peek() in ("(", ".", "?", ":", "[") or rest[-1] in (".", "?", ":"):
            depth = 0
            while at < len(tokens):
                w = tokens[at][1]
                depth += (w in "([{") - (w in ")]}") if len(w) == 1 else 0
                rest.append(w)
                at += 1
                if depth <= 0:
                    break
        word = "".join(rest)
        return True if word == "true" else False if word == "false" else int(word) if re.fullmatch(r"-?\d+", word) else word

    def body() -> dict:
        nonlocal at
        out: dict = {}
        while at < len(tokens) and peek() != "}":
            key = tokens[at][1].strip('"')
            at += 1
            if peek() in ("=", ":"):
                at += 1
                out[key] = value()
            else:
                while at < len(tokens) and tokens[at][0] in ("text", "word"):
                    at += 1
                if peek() == "{":
                    at += 1
                    block = body()
                    out[key] = block if key not in out else [*(out[key] if isinstance(out[key], list) else [out[key]]), block]
            if peek() == ",":
                at += 1
        at += 1
        return out

    while at < len(tokens):
        word = tokens[at][1]
        if word == "resource" and at + 3 < len(tokens) and tokens[at + 3][1] == "{":
            kind, name = tokens[at + 1][1].strip('"'), tokens[at + 2][1].strip('"')
            at += 4
            yield kind, name, json.dumps(body(), sort_keys=True)
        else:
            at += 1


def sql_tables(text: str) -> Iterator[tuple]:
    """ord, table, column, what (add, drop, drop table) of migrations in order."""
    number = 0
    for statement in re.split(r";\s*(?:\n|$)", re.sub(r"--[^\n]*", "", text)):
        s = " ".join(statement.split())
        if m := re.match(r'create table (?:if not exists )?["`]?([\w.]+)["`]? ?\((.*)\)', s, re.I):
            depth, start, parts = 0, 0, []
            for i, c in enumerate(m[2] + ","):
                depth += (c == "(") - (c == ")")
                if c == "," and not depth:
                    parts.append(m[2][start:i].strip())
                    start = i + 1
            for p in parts:
                if p and not re.match(r"(primary|foreign|unique|constraint|check|key|index)\b", p, re.I):
                    number += 1
                    yield number, m[1].lower(), p.split()[0].strip('"`').lower(), "add"
        elif m := re.match(r'alter table ["`]?([\w.]+)["`]? (add|drop)(?: column)?(?: if (?:not )?exists)? ["`]?(\w+)', s, re.I):
            number += 1
            yield number, m[1].lower(), m[3].lower(), m[2].lower()
        elif m := re.match(r'drop table (?:if exists )?["`]?([\w.]+)', s, re.I):
            number += 1
            yield number, m[1].lower(), "", "drop table"
