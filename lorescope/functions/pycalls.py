"""Library calls in Python source, resolved through its imports."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from typing import NamedTuple


class Call(NamedTuple):
    library: str
    function: str
    positional: list[str]
    keywords: list[tuple[str, str]]


def _source_order(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes as they are written, parents before children."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def _dotted(node: ast.expr) -> list[str]:
    """['a', 'b', 'c'] for a.b.c, [] for anything that is not a plain dotted name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return []
    return [node.id, *reversed(names)]


class _Imports:
    """What names in a piece of code stand for, as far as it has been read."""

    def __init__(self) -> None:
        self.aliases: dict[str, str] = {}
        self.modules: set[str] = set()
        self.members: dict[str, tuple[str, str]] = {}  # local name -> (module, member)

    def read(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for name in node.names:
                self.modules.add(name.name)
                if name.asname:
                    self.aliases[name.asname] = name.name
        elif isinstance(node, ast.ImportFrom) and node.module:
            for name in node.names:
                self.members[name.asname or name.name] = (node.module, name.name)

    def resolve(self, names: list[str]) -> tuple[str, str] | None:
        """(module, canonical name) of a called name, or None if no import explains it."""
        head, rest = names[0], names[1:]
        if rest and head in self.aliases:
            module = self.aliases[head]
            return module, ".".join([module, *rest])
        if rest and head in self.modules:
            return head, ".".join(names)
        if head in self.members:
            module, member = self.members[head]
            return module, ".".join([module, member, *rest])
        return None


def library_calls(code: str) -> list[Call]:
    """Resolved calls in source order. Raises SyntaxError or ValueError on unreadable code."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        tree = ast.parse(code)
    imports, calls = _Imports(), []
    for node in _source_order(tree):
        imports.read(node)
        if not isinstance(node, ast.Call):
            continue
        names = _dotted(node.func)
        known = imports.resolve(names) if names else None
        if known is None:
            continue
        module, function = known
        named = {k.arg: ast.unparse(k.value) for k in node.keywords if k.arg is not None}
        spread = {f"**{ast.unparse(k.value)}": "" for k in node.keywords if k.arg is None}
        calls.append(
            Call(module.split(".")[0], function, [ast.unparse(a) for a in node.args], list({**named, **spread}.items()))
        )
    return calls
