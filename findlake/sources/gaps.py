"""What Python code leaves out: functions that do no work yet, stores that only grow. Parsers for `parsers.parse`."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

# fixed values: names that decide what is allowed or genuine, marks of unfinished work, names and words of classes and methods made to be overridden
SENSITIVE = r"(?i)(verify|validate|authenticate|authorize|check_?auth|is_?valid|is_?allowed|has_?permission|decrypt|encrypt|sign|sanitiz|escape|audit|permit|access)"
UNFINISHED = r"(?i)\b(?:todo|fixme|xxx|hack|stub|placeholder|implement|for now|temporar)"
PROVISIONAL = r"(?i)#\s*(?:TODO|FIXME|stub|placeholder|for now|temporary)"
HOOK = r"^_?(?:on|before|after)_[a-z]"
BASE_NAME = r"^(?:Base|Abstract)[A-Z_]|(?:Base|Mixin|Interface|Protocol|ABC)$"
BASES = {"ABC", "ABCMeta", "Protocol"}
TO_OVERRIDE = r"(?i)\b(?:subclass(?:es)?|child classes|implementations?|backends?)\s+(?:must|should|need to|may)|\b(?:must|should|to)\s+be\s+(?:implemented|overridden)|\boverride\s+(?:this|in)\b|\babstract\b"
BODY_LINES = 8
# fixed values: what makes fresh ids, what says that entries leave again
FRESH = r"\buuid4\b|\buuid1\b|\buuid7\b|\bnanoid\b|\bulid\b|\btoken_hex\b|\btoken_urlsafe\b|\bcuid\b"
LIFETIME = r"(?i:\b\w*(?:evict|expire|expiry|prune|sweep|purge|cleanup|clean_up|reap|retention)\w*\s*\()|(?<![A-Za-z])(?:ttl|TTL)(?![a-z])|\bcachetools\b|\bTTLCache\b|\bLRUCache\b|\blru_cache\b"
REMOVERS = {"pop", "popitem", "clear"}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _last(node: ast.AST) -> str:
    """The last name of a dotted one, whatever it is called with or indexed by."""
    while isinstance(node, (ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _idle(statement: ast.stmt, line: str) -> str:
    """none: it works; provisional: a constant that is marked as one; empty: it passes or raises that nothing is implemented."""
    if isinstance(statement, ast.Pass) or isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Constant) and statement.value.value is Ellipsis:
        return "empty"
    if isinstance(statement, ast.Raise) and statement.exc is not None and _last(statement.exc) == "NotImplementedError":
        return "told" if isinstance(statement.exc, ast.Call) and statement.exc.args else "empty"
    value = statement.value if isinstance(statement, ast.Return) else None
    constant = isinstance(value, ast.Constant) and value.value in (True, False, None, 0, "") or isinstance(value, (ast.List, ast.Dict)) and not (value.elts if isinstance(value, ast.List) else value.keys)
    return "provisional" if constant and re.search(PROVISIONAL, line) else "none"


def python_stubs(text: str) -> Iterator[tuple]:
    """name, line, sensitive of each function whose first lines do no work, unless it is made to be overridden or says why it is empty.

    A marked constant is never excused. Made to be overridden: hooks, abstract methods, methods of base classes, protocols and classes
    that the file derives from, and bodies whose error or docstring says so.
    """
    if (tree := _tree(text)) is None:
        return
    lines = text.splitlines()
    derived = {_last(b) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for b in c.bases}

    def by_design(f: ast.AST, owner: ast.ClassDef | None, sensitive: bool) -> bool:
        comments = [c for at in range(f.body[0].lineno - 1, f.end_lineno) for c in re.findall(r"#\s*(\S.*)", lines[at])] if f.end_lineno <= len(lines) else []
        said = any(len(c) >= 5 and not re.search(UNFINISHED, c) for c in comments)
        hook = re.search(HOOK, f.name) and not sensitive
        abstract = any(_last(d).startswith("abstract") for d in f.decorator_list) or re.search(TO_OVERRIDE, ast.get_docstring(f) or "")
        base = owner is not None and (re.search(BASE_NAME, owner.name) or owner.name in derived or BASES & {_last(b) for b in [*owner.bases, *(k.value for k in owner.keywords)]})
        return bool(said or hook or abstract or base)

    def visit(node: ast.AST, owner: ast.ClassDef | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, FUNCTIONS):
                near = [s for s in child.body if s.lineno <= child.body[0].lineno + BODY_LINES - 1]
                states = {_idle(s, lines[s.lineno - 1] if s.lineno <= len(lines) else "") for s in near}
                sensitive = bool(re.search(SENSITIVE, child.name))
                if "provisional" in states or "empty" in states and "told" not in states and not by_design(child, owner, sensitive):
                    yield child.name, child.lineno, sensitive
            yield from visit(child, child if isinstance(child, ast.ClassDef) else None if isinstance(child, FUNCTIONS) else owner)

    yield from visit(tree, None)


def python_growing_stores(text: str) -> Iterator[tuple]:
    """field, line of each dict of an object that gains an entry by a fresh id and that no other function empties or bounds."""
    if not re.search(FRESH, text) or re.search(LIFETIME, text) or (tree := _tree(text)) is None:
        return

    def own(node: ast.AST) -> str:
        return node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self" else ""

    made, bounded, filled, emptied = set(), set(), {}, {}
    # a line belongs to its innermost function, so outer ones come first and are overwritten
    home: dict[int, ast.AST] = {}
    for f in sorted((n for n in ast.walk(tree) if isinstance(n, FUNCTIONS)), key=lambda f: (f.lineno, -f.end_lineno)):
        home.update(dict.fromkeys(range(f.lineno, f.end_lineno + 1), f))
    for n in ast.walk(tree):
        if isinstance(n, (ast.Assign, ast.AnnAssign)):
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                empty = isinstance(n.value, ast.Dict) and not n.value.keys or isinstance(n.value, ast.Call) and _last(n.value) in ("dict", "OrderedDict", "defaultdict")
                if own(target):
                    emptied.setdefault(own(target), []).append(n.lineno)
                    made |= {own(target)} if empty else set()
                elif isinstance(target, ast.Subscript) and own(target.value) and isinstance(target.slice, ast.Attribute) and isinstance(target.slice.value, ast.Name) and target.slice.attr in ("id", "ID", "uuid"):
                    filled.setdefault(own(target.value), n.lineno)
        elif isinstance(n, ast.Delete):
            for target in n.targets:
                if isinstance(target, ast.Subscript) and own(target.value):
                    emptied.setdefault(own(target.value), []).append(n.lineno)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in REMOVERS and own(n.func.value):
            emptied.setdefault(own(n.func.value), []).append(n.lineno)
        elif isinstance(n, ast.Compare) and isinstance(n.left, ast.Call) and _last(n.left) == "len" and n.left.args and isinstance(n.ops[0], (ast.Gt, ast.GtE, ast.Eq)):
            bounded.add(own(n.left.args[0]))
    for field, line in filled.items():
        leaves = [x for x in emptied.get(field, []) if home.get(x) is not home.get(line) and getattr(home.get(x), "name", "") not in ("__init__", "reset_for_test", "reset_for_tests")]
        if field in made and field not in bounded and not leaves:
            yield field, line
