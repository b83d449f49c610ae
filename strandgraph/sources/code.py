"""Source files: declarations, annotations in comments, and what binds them.

Python files are read with the standard library's own parser and are exact.
Go, JavaScript, TypeScript, C++ and Java are read by a scanner that knows
strings, comments and braces and recognises declarations outside bodies; a
file whose braces or strings do not close is reported and gives no
declarations, as a syntax error does.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import ids
from ..schemas import ANNOTATIONS, DECLARATIONS, PARSE_ERRORS

# Extensions, and the marks of annotations, longest first.
LANGUAGES = {"py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "java": "java"}
MARKS = {"@test-contract": "test-contract", "@implement": "implement", "@test": "test"}
JAVA_TESTS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate")
IGNORE_ONE, IGNORE_START, IGNORE_END = ("@ignore",), ("@ignore-start", "@ignore start"), ("@ignore-end", "@ignore end")


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def is_test_path(path: str) -> bool:
    name = path.rsplit("/", 1)[-1].lower()
    return bool(re.search(r"(^|/)tests?/", path.lower()) or re.search(r"(_test|\.test|\.spec|tests?)\.[a-z]+$", name) or name.startswith("test_"))


def _is_contract(path: str) -> bool:
    return "contract" in path.rsplit("/", 1)[-1].lower()


def scan(text: str) -> tuple[str, list[tuple[int, int, str]], str | None]:
    """The text with strings and comments blanked, the comments (start, end, text), and what is wrong."""
    out, comments, i, n = list(text), [], 0, len(text)
    blank = lambda a, b: [out.__setitem__(k, " ") for k in range(a, b) if out[k] != "\n"]
    while i < n:
        c = text[i]
        if text.startswith("//", i) or text.startswith("/*", i):
            end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i + 2)
            if end < 0 and text[i + 1] == "*":
                return "".join(out), comments, "a comment is not closed"
            end = n if end < 0 else end + (2 if text[i + 1] == "*" else 0)
            comments.append((i, end, text[i:end]))
            blank(i, end)
            i = end
        elif c in "\"'`":
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            if j >= n or text[j] != c:
                if c != "'":
                    return "".join(out), comments, "a string is not closed"
                j = i
            blank(i, j + 1)
            i = j + 1
        else:
            i += 1
    depth = 0
    for c in out:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return "".join(out), comments, "a brace closes that was not opened"
    return "".join(out), comments, "a brace is not closed" if depth else None


CONTAINERS = {
    "go": r"(?!)",
    "javascript": r"(?P<export>\bexport\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)[^{;]*\{",
    "typescript": r"(?P<export>\bexport\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface|namespace)\s+(?P<name>\w+)[^{;]*\{",
    "cpp": r"(?:namespace\s*(?P<space>\w*)|(?P<kind>class|struct)\s+(?P<name>\w+)[^{;()]*)\s*\{|extern\s*\{",
    "java": r"(?P<public>\bpublic\s+)?(?:(?:abstract|final|static|sealed)\s+)*(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)[^{;]*\{",
}
MEMBERS = {
    "go": r"^func\s+(?:\(\s*\w*\s*\*?(?P<receiver>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*[\[(][^{]*\{|^type\s+(?P<type>\w+)\s+(?:struct|interface)\s*\{",
    "javascript": r"(?P<export>\bexport\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*\([^{]*\{|(?P<export2>\bexport\s+)?(?:const|let|var)\s+(?P<name2>\w+)[^=\n;]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^={;]*=>|\w+\s*=>)|(?P<test>\b(?:test|it)\s*\()|(?P<mods>(?:(?:private|protected|public|static|async|get|set)\s+)*)(?P<method>#?\w+)\s*\([^(){};]*\)[^{};=]*\{",
    "cpp": r"(?P<mods>(?:(?:static|inline|virtual|constexpr|explicit|template\s*<[^>]*>)\s+)*)[\w:<>,&*\s~]*?(?P<name>[\w~]+(?:::[\w~]+)*)\s*\([^;{}]*\)[^;{}]*\{",
    "java": r"(?P<mods>(?:@\w+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<name>\w+)\s*\([^;{}]*\)[^;{}]*[{;]",
}
CONTAINERS["tsx"], MEMBERS["typescript"] = CONTAINERS["typescript"], MEMBERS["javascript"]
NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "sizeof", "throw", "function", "constructor", "synchronized", "await"}


def _brace_end(code: str, open_at: int) -> int:
    depth = 0
    for i in range(open_at, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if depth == 0:
            return i
    return len(code)


def _members(path: str, language: str, text: str, code: str) -> list[tuple]:
    """(name, kind, start, end, public, test kind) of declarations outside bodies."""
    found: list[tuple] = []
    tests = is_test_path(path)
    contract = "contract" if _is_contract(path) else "behavior"

    def visit(a: int, b: int, shown: bool, container: str) -> None:
        at = a
        inside, members = re.compile(CONTAINERS[language], re.M), re.compile(MEMBERS[language], re.M)
        while at < b:
            c, m = inside.search(code, at, b), members.search(code, at, b)
            brace = code.find("{", at, b)
            first = min((x for x in (c, m) if x), key=lambda x: x.start(), default=None)
            if first is None or (0 <= brace < first.start()):
                if brace < 0:
                    return
                at = _brace_end(code, brace) + 1
                continue
            g = first.groupdict()
            start = first.start() + len(first.group()) - len(first.group().lstrip())
            if first is c:
                end = _brace_end(code, c.end() - 1)
                name = g.get("name")
                public = bool(g.get("export") or g.get("public") or language == "cpp") and shown
                if language == "cpp" and g.get("kind") is None:
                    visit(c.end(), end, shown and not (c.group().startswith("namespace") and not g.get("space")), "")
                else:
                    found.append((name, "type", start, end, public, None))
                    visit(c.end(), end, public or language == "java", "interface" if g.get("kind") == "interface" or "interface" in c.group() else "class")
                at = end + 1
                continue
            if g.get("test"):
                close = code.find(";", m.end(), b)
                close = close if close >= 0 else b
                body = code.find("{", m.end(), b)
                end = max(close, _brace_end(code, body)) if body >= 0 else close
                label = re.match(r"\s*([\"'`])(.*?)\1", text[m.end() : end])
                found.append((label[2] if label else "test", "test", start, end, False, contract if tests else None))
                at = end + 1
                continue
            name = g.get("name") or g.get("name2") or g.get("method") or g.get("type")
            body = m.end() - 1 if code[m.end() - 1] == "{" else code.find("{", m.end(), b) if g.get("name2") else -1
            end = _brace_end(code, body) if body >= 0 else m.end()
            at = end + 1
            if name in NO_NAMES or (g.get("method") and not container) or (language == "java" and (not container or not g.get("mods") and container == "class" and "{" not in m.group())):
                continue
            mods, test = g.get("mods") or "", None
            if language == "go":
                public = name[0].isupper() and (not g.get("receiver") or g["receiver"][0].isupper())
                test = contract if path.endswith("_test.go") and re.match(r"(Test|Benchmark|Fuzz|Example)", name) else None
            elif language in ("javascript", "typescript"):
                public = bool(g.get("export") or g.get("export2")) or (bool(container) and shown and not re.search(r"private|protected", mods) and not name.startswith("#"))
            elif language == "java":
                public = shown and ("public" in mods or (container == "interface" and "private" not in mods))
                test = contract if any(f"@{t}" in re.findall(r"@\w+", mods) for t in JAVA_TESTS) else None
            else:
                access = re.findall(r"\b(public|private|protected)\s*:", code[a : m.start()])
                public = shown and "static" not in mods and ((access[-1] == "public") if access else container != "class")
            found.append((name, "method" if container or g.get("receiver") else "function", start, end, public and not (tests and test), test))

    visit(0, len(code), True, "")
    return found


def _python(path: str, text: str) -> tuple[list[tuple], list[tuple[int, int, str]]]:
    tree, starts = ast.parse(text), [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    tests, contract = is_test_path(path), "contract" if _is_contract(path) else "behavior"
    found: list[tuple] = []

    def visit(body: list, shown: bool, kind: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                public = shown and not node.name.startswith("_")
                is_class = isinstance(node, ast.ClassDef)
                test = contract if not is_class and node.name.startswith("test_") and tests else None
                end = starts[node.end_lineno] - 1
                found.append((node.name, "type" if is_class else kind, starts[first - 1] + node.col_offset, end, public and test is None, test))
                if is_class:
                    visit(node.body, public, "method")

    visit(tree.body, True, "function")
    comments = []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            a = starts[t.start[0] - 1] + t.start[1]
            comments.append((a, a + len(t.string), t.string))
    return found, comments


def marks_of(configured: dict[str, str] | None) -> dict[str, str]:
    """Marks and their kinds, longest first, from those of a configuration."""
    kinds = {"implement": "implement", "test": "test", "test_contract": "test-contract"}
    found = {mark: kinds[name] for name, mark in configured.items()} if configured else MARKS
    return dict(sorted(found.items(), key=lambda m: -len(m[0])))


def analyse(path: str, text: str, marks: dict[str, str] | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """Declarations, annotations and errors of one file. Marks and directives have any case."""
    marks = marks or MARKS
    language = language_of(path)
    error = lambda message, line=0: [{"path": path, "line": line, "message": message}]
    if language is None:
        return [], [], error("the extension is not supported")
    try:
        if language == "python":
            members, comments = _python(path, text)
        else:
            code, comments, wrong = scan(text)
            if wrong:
                return [], [], error(wrong)
            members = _members(path, language, text, code)
    except (SyntaxError, tokenize.TokenError, IndentationError) as e:
        return [], [], error(str(e).split("\n")[0], getattr(e, "lineno", 0) or 0)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    line_of = lambda at: bisect.bisect_left(breaks, at) + 1
    marked: list[tuple[int, int, int, str]] = []
    for a, b, body in comments:
        for offset, line in enumerate(body.split("\n")):
            marked.append((a, b, line_of(a) + offset, re.sub(r"^\s*(?://+|/\*+|\*+/?|#+)?\s?|\s*\*/\s*$", "", line).strip()))
    spans, start = [], None
    for _, _, line, body in marked:
        directive = body.lower()
        if directive in IGNORE_ONE:
            spans.append((line, line))
        elif directive in IGNORE_START and start is None:
            start = line
        elif directive in IGNORE_END and start is not None:
            spans.append((start, line))
            start = None
    if start is not None:
        spans.append((start, len(breaks) + 1))
    ignored = lambda line: any(x <= line <= y for x, y in spans)
    members.sort(key=lambda m: m[2])
    declarations = [
        {"path": path, "language": language, "name": n, "kind": k, "line": line_of(a), "end_line": line_of(b), "public": p, "test_kind": t, "ignored": ignored(line_of(a)), "binding_start": a}
        for n, k, a, b, p, t in members
    ]
    begins, ends = [m[2] for m in members], sorted((a, b) for a, b, _ in comments)
    annotations = []
    for a, b, line, body in marked:
        low, mark, rest = body.lower(), None, ""
        for m, kind in marks.items():
            tail = body[len(m) :]
            due = "SPEC-" if kind == "implement" else "TEST-"
            if low.startswith(m.lower()) and (tail == "" or tail[0] in " \t" or tail.upper().startswith(due)):
                mark, rest = m, tail
                break
        if mark is None:
            continue
        k = bisect.bisect_left(begins, b)
        while k < len(begins) and declarations[k]["ignored"]:
            k += 1
        attached = False
        if k < len(begins):
            gap, last = text[b : begins[k]], b
            for x, y in ends:
                if b <= x and y <= begins[k]:
                    gap, last = gap.replace(text[x:y], "", 1), y
            attached = not gap.strip() and text[last : begins[k]].count("\n") <= 2
        owner = declarations[k] if attached else None
        annotations.append(
            {
                "path": path, "kind": marks[mark], "prefix": mark, "refs": [r for r in (x.strip() for x in rest.split(",")) if r], "line": line, "raw": body,
                "attached": attached and not ignored(line), "declaration": owner["name"] if owner else None, "declaration_line": owner["line"] if owner else None,
                "has_separator": rest == "" or rest[0].isspace(), "ignored": ignored(line), "comment_end": b,
            }
        )
    return declarations, annotations, []


def _structs(schema: str) -> str:
    return "array<struct<" + ", ".join(f"{c.strip().split(' ')[0]}: {c.strip().split(' ', 1)[1]}" for c in schema.split(", ")) + ">>"


def parsed(found: DataFrame, marks: dict[str, str] | None = None) -> DataFrame:
    """One row a file (path, content): declarations, annotations and errors, each file parsed once."""
    chosen = marks_of(marks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [analyse(p, c or "", chosen) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{"path": p, "declarations": d, "annotations": a, "errors": e} for p, (d, a, e) in zip(batch.column("path").to_pylist(), parts, strict=True)], schema=kinds)

    schema = f"path string, declarations {_structs(DECLARATIONS)}, annotations {_structs(ANNOTATIONS)}, errors {_structs(PARSE_ERRORS)}"
    kinds = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)
    return found.select("path", "content").mapInArrow(read, schema)


def _part(found: DataFrame, part: str) -> DataFrame:
    rows = found if part in found.columns else parsed(found)
    return rows.select(F.explode(part).alias("x")).select("x.*")


def declarations(found: DataFrame) -> DataFrame:
    """The declarations of files (path, content), or of files that ``parsed`` has read."""
    return _part(found, "declarations")


def annotations(found: DataFrame) -> DataFrame:
    return _part(found, "annotations")


def parse_errors(found: DataFrame) -> DataFrame:
    return _part(found, "errors")


def identifiers(found: DataFrame) -> DataFrame:
    """Observations in code: well-formed references of attached annotations; of the wrong type they are left out."""
    each = found.filter("attached AND NOT ignored").select("*", F.posexplode("refs").alias("pos", "ref"))
    kind = ids.type_of(F.col("ref"))
    fits = ids.well_formed(F.col("ref")) & F.when(F.col("kind") == "implement", kind == "SPEC").otherwise(kind == "TEST")
    none = F.lit(None).cast("string")
    return each.filter(fits).select(
        F.col("ref").alias("id"), kind.alias("type"), F.col("declaration").alias("title"), none.alias("describe"), F.col("path").alias("source"), "line",
        F.col("raw").alias("raw_ref"), F.array().cast("array<string>").alias("links"),
        F.array().cast("array<struct<ref:string,type:string,source:string,line:int,field:string,record_id:string>>").alias("typed_links"),
        F.lit("code").alias("origin"), none.alias("namespace"), none.alias("status"), none.alias("document_role"),
        F.when(F.col("kind") == "test", "behavior").when(F.col("kind") == "test-contract", "contract").alias("kind"),
        F.lit(False).alias("derived"), F.col("pos").cast("long").alias("seq"),
    )
