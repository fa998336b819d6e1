"""Facts about code, read in tasks: Python by its own parser, scripts and shells by patterns."""

from __future__ import annotations

import ast
import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = "path string, kind string, name string, line int, end_line int, detail string"


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def python_facts(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, line, end line, detail): imports, definitions, calls and variables of the environment that a module has."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError) as error:
        line = getattr(error, "lineno", None) or 1
        return [("error", type(error).__name__, line, line, "")]
    out = []
    for node in ast.walk(module):
        at = (getattr(node, "lineno", 1), getattr(node, "end_lineno", 1))
        if isinstance(node, ast.Import):
            out += [("import", a.name, *at, a.asname or "") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("from", "." * node.level + (node.module or ""), *at, a.name) for a in node.names]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", node.name, *at, ",".join(_name(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list)))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, *at, ",".join(filter(None, map(_name, node.bases)))))
            if any(isinstance(n, ast.Assign) and getattr(n.targets[0], "id", "") == "__tablename__" for n in node.body) or _is_table(node):
                out.append(("table", node.name, *at, ""))
        elif isinstance(node, ast.Call) and (called := _name(node.func)):
            first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) else ""
            out.append(("environ" if called in ("os.getenv", "os.environ.get") else "call", str(first) if called in ("os.getenv", "os.environ.get") else called, *at, str(first)[:200]))
        elif isinstance(node, ast.Subscript) and _name(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            out.append(("environ", str(node.slice.value), *at, ""))
    if not out and not any(isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Call)) for n in ast.walk(module)):
        out.append(("empty", "", 1, 1, ""))
    return sorted(out, key=lambda f: (f[2], f[0], f[1]))


def _is_table(node: ast.ClassDef) -> bool:
    """Whether a class is declared as a table: class A(SQLModel, table=True)."""
    declared = any(k.arg == "table" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
    return declared and any(_name(b).rsplit(".", 1)[-1] == "SQLModel" for b in node.bases)


def read_python(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, text), a row each."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *f) for p, t in zip(batch["path"], batch["text"], strict=True) for f in python_facts(t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "end_line", "detail"])

    return files.select("path", "text").mapInPandas(read, FACTS)


_IMPORT = r"(?:import|export)\s+(?:type\s+)?(?:[\w*{}\s,$]+\s+from\s+)?[\"']([^\"'\n]+)[\"']|(?:require|import)\(\s*[\"']([^\"'\n]+)[\"']\s*\)"


def script_imports(text: Column) -> Column:
    """Specifiers that a script imports, requires or re-exports (by pattern: a subset of the language)."""
    both = F.concat(F.regexp_extract_all(text, F.lit(_IMPORT), 1), F.regexp_extract_all(text, F.lit(_IMPORT), 2))
    return F.array_distinct(F.filter(both, lambda s: s != ""))


def script_exports(text: Column) -> Column:
    """Names that a script exports where it declares them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|type|interface|enum)\s+([A-Za-z_$][\w$]*)"), 1))


def env_reads(text: Column) -> Column:
    """Variables of the environment that a script reads."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:process\.env|import\.meta\.env)\.([A-Za-z_][A-Za-z0-9_]*)"), 1))


def count_tests(path: Column, text: Column) -> Column:
    """Tests that a file declares."""
    python = F.regexp_count(text, F.lit(r"(?m)^\s*(?:async\s+)?def\s+test\w*\s*\("))
    script = F.regexp_count(text, F.lit(r"(?<![\w.$])(?:it|test)(?:\.(?:only|concurrent|each\([^)]*\)))?\s*\(\s*[`'\"]"))
    return F.when(path.endswith(".py"), python).otherwise(script)


# A requirement is a name, extras in brackets, versions or an address, and markers after a semicolon (PEP 508).
_PACKAGE = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"


def requirements(text: Column) -> Column:
    """map of package name (as PEP 503 normalises it) to version in a requirements file; of several lines the last counts."""
    def entry(line: Column) -> Column:
        name = F.regexp_extract(line, _PACKAGE, 0)
        rest = F.trim(F.substring_index(F.substring(line, F.length(name) + 1, F.length(line)), ";", 1))
        after_extras = F.trim(F.when(rest.startswith("["), F.substring(rest, F.locate("]", rest) + 1, F.length(rest))).otherwise(rest))
        return F.struct(F.lower(F.regexp_replace(name, "[-_.]+", "-")).alias("name"), F.when(after_extras == "", "*").otherwise(after_extras).alias("version"))

    plain = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s#.*$", "")))
    found = F.transform(F.filter(plain, lambda x: x.rlike(_PACKAGE)), entry)
    names = F.array_distinct(F.transform(found, lambda e: e["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.element_at(F.filter(found, lambda e: e["name"] == n), -1)))


def package_dependencies(text: Column) -> Column:
    """map of package name to version in a package.json: of several sections the first wins."""
    kind = "map<string,string>"
    sections = [F.from_json(F.get_json_object(text, f"$.{s}"), kind) for s in ("dependencies", "optionalDependencies", "peerDependencies", "devDependencies")]
    out = F.coalesce(sections[0], F.create_map().cast(kind))
    for s in sections[1:]:
        more = F.coalesce(s, F.create_map().cast(kind))
        out = _joined(out, more)
    return out


def _joined(first: Column, more: Column) -> Column:
    """first with the entries of more whose keys it hasn't."""
    new = F.filter(F.map_entries(more), lambda e: ~F.map_contains_key(first, e["key"]))
    return F.map_from_entries(F.concat(F.map_entries(first), new))


# Words before a command that say nothing by themselves.
_PREFIXES = frozenset("time timeout nohup sudo env do then else".split())
_HEREDOC = re.compile(r"<<-?\s*(['\"]?)(\w+)\1[^\n]*\n.*?^\s*\2\s*$", re.DOTALL | re.MULTILINE)


def shell_commands(line: str | None) -> list[list[str]]:
    """The commands of a shell line as words: without here-documents, redirections, assignments and empty prefixes."""
    text = _HEREDOC.sub(" ", line or "")
    lexer = shlex.shlex(text.replace("\n", " ; "), posix=True, punctuation_chars="();<>|&")
    lexer.whitespace_split = True
    lexer.commenters = ""
    try:
        words = list(lexer)
    except ValueError:
        words = text.split()
    out: list[list[str]] = [[]]
    skip = False
    for word in words:
        if skip:
            skip = False
        elif set(word) <= set("<>&") and word:
            skip = ">" in word or "<" in word
            if not skip:
                out.append([])
        elif set(word) <= set("();|&") and word:
            out.append([])
        elif not out[-1] and (re.fullmatch(r"[A-Za-z_]\w*=.*", word) or word in _PREFIXES):
            continue
        else:
            out[-1].append(word)
    return [c for c in out if c]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def commands(lines: pd.Series) -> pd.Series:
    """shell_commands() of a column."""
    return lines.map(shell_commands)


def sql_statements(text: str | None) -> list[tuple[int, str]]:
    """(line, statement) of a script: cut at semicolons outside of texts, comments and dollar-quoted bodies."""
    pattern = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|(\$\w*\$).*?\1|;", re.DOTALL)
    out, at, kept, begin = [], 0, [], 0
    source = text or ""

    def close(end: int) -> None:
        body = "".join([*kept, source[at:end]])
        if body.strip():
            lead = len(source[begin:end]) - len(source[begin:end].lstrip())
            out.append((source.count("\n", 0, begin + lead) + 1, body.strip()))

    for m in pattern.finditer(source):
        if m[0] == ";":
            close(m.start())
            at, kept, begin = m.end(), [], m.end()
        elif m[0].startswith(("--", "/*")):
            kept.append(source[at : m.start()] + " ")
            at = m.end()
            if not "".join(kept).strip():
                begin = at
    close(len(source))
    return out


_HEADER = re.compile(r"(?:\s*|╭─+ )Traceback \(most recent call last\)")
_PLAIN_FRAME = re.compile(r'\s*File "(?P<file>[^"]+)", line (?P<line>[0-9]+)')
_BOXED = re.compile(r"│ (?P<inner>.*?)\s*│$")
_BOXED_FRAME = re.compile(r"(?P<file>/.+):(?P<line>[0-9]+) in \S+")
_EXCEPTION = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*(?:: .*)?$", re.DOTALL)


def _frames(lines: list[str]) -> Iterator[tuple[int, str, int]]:
    """(place, file, line) of the frames in lines; in a box a long path may stand on a line of its own before its frame."""
    before = ""
    for at, line in enumerate(lines):
        box = _BOXED.match(line)
        if not box:
            if found := _PLAIN_FRAME.match(line):
                yield at, found["file"], int(found["line"])
            continue
        whole = before + box["inner"]
        found = _BOXED_FRAME.fullmatch(whole)
        if found:
            yield at, found["file"], int(found["line"])
        before = box["inner"] if not found and box["inner"].startswith("/") else ""


def traceback_error(lines: list[str]) -> tuple[str | None, list[tuple[str, int]]]:
    """(error, frames) of the last Python traceback in lines, plain or boxed; the error is the first unindented name after a frame."""
    begin = max((k for k, line in enumerate(lines) if _HEADER.match(line)), default=None)
    if begin is None:
        return None, []
    body = lines[begin + 1 :]
    frames = list(_frames(body))
    first = frames[0][0] if frames else len(body)
    end = next((k for k in range(first + 1, len(body)) if _EXCEPTION.match(body[k])), None)
    kept = [(file, line) for at, file, line in frames if end is None or at < end]
    return (None if end is None else body[end].strip()), kept
