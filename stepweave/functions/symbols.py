"""Symbols and imports of source text: exact for Python, by line patterns for other languages."""

from __future__ import annotations

import ast
import re

# What begins a definition or names an import, by file extension.
DEFINITIONS = {
    "js": r"^\s*(?:export\s+)?(?:async\s+)?(?:function\*?|class)\s+([A-Za-z_$][\w$]*)",
    "ts": r"^\s*(?:export\s+)?(?:abstract\s+|async\s+)?(?:function\*?|class|interface|enum)\s+([A-Za-z_$][\w$]*)",
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|^\s*type\s+([A-Za-z_]\w*)",
    "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|mod)\s+([A-Za-z_]\w*)",
    "sh": r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{",
}
IMPORTS = {"js": r"""from\s+['"]([^'"]+)['"]|require\(['"]([^'"]+)['"]\)""", "ts": r"""from\s+['"]([^'"]+)['"]""", "go": r"""^\s*(?:import\s+)?"([^"]+)"$""", "rs": r"^\s*use\s+([\w:]+)", "sh": r"^\s*(?:source|\.)\s+(\S+)"}
ALIKE = {"tsx": "ts", "jsx": "js", "mjs": "js", "bash": "sh"}


def _python(text: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    symbols, imports = [], []

    def visit(node: ast.AST, outer: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{outer}.{child.name}" if outer else child.name
                symbols.append((name, child.lineno, child.end_lineno))
                visit(child, name)
            else:
                if isinstance(child, ast.Import):
                    imports.extend(a.name for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    imports.append("." * child.level + (child.module or ""))
                visit(child, outer)

    visit(ast.parse(text), "")
    return symbols, imports


def parse(text: str, extension: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(name, first line, last line) of the symbols, and the imports; nothing for unknown or broken sources."""
    if extension in ("py", "pyi"):
        try:
            return _python(text)
        except (SyntaxError, ValueError):
            return [], []
    kind = ALIKE.get(extension, extension)
    if kind not in DEFINITIONS:
        return [], []
    lines = text.split("\n")
    found = [(next(g for g in m.groups() if g), i) for i, line in enumerate(lines, 1) if (m := re.search(DEFINITIONS[kind], line))]
    symbols = [(name, i, _closing(lines, i)) for name, i in found]
    return symbols, [next(g for g in m.groups() if g) for line in lines if (m := re.search(IMPORTS[kind], line))]


def _closing(lines: list[str], first: int) -> int:
    """The line that closes the braces opened from line `first` on; the line itself if there are none."""
    depth, opened = 0, False
    for i in range(first - 1, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened |= "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
    return first if not opened else len(lines)


def closest(key: str, known: list[str], n: int = 2) -> list[str]:
    """The n known keys most alike to a mistyped one."""
    from difflib import get_close_matches

    return get_close_matches(key, known, n=n, cutoff=0.0)
