"""Lexing of C sources into relations: one pass per file gives functions, globals, prototypes, macros, types and calls.

The lexer is the leaf that needs Python: comments and literals are blanked without moving anything, then one scan over
braces, parentheses and semicolons cuts the text into top-level statements. Everything after it is relational.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that look like calls or types but are part of the language (fixed values).
KEYWORDS = {
    "if", "else", "for", "while", "do", "switch", "case", "return", "sizeof", "goto", "default", "break", "continue", "typedef", "struct", "union", "enum",
}
#: Tags of functions that a header declares, and of others (fixed values).
EXPORTED, INTERNAL = "对外接口", "内部函数"
#: Longest text kept of a type.
TYPE_CHARS = 400

NOISE = re.compile(r"""//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S)
DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:\\\r?\n|[^\n])*")
DEFINE = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)((?:\\\r?\n|[^\n])*)")
CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
GLOBAL = re.compile(r"(?:(?:static|const|volatile|unsigned|signed|struct|enum|union|register)\s+)*[A-Za-z_]\w*[\s*]+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=.*)?", re.S)
LAST_NAME = re.compile(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?\Z")

ROW = "struct<name:string,line:int,end_line:int,text:string>"
LEXED = (
    f"functions array<{ROW}>, globals array<{ROW}>, declarations array<{ROW}>, macros array<{ROW}>, types array<{ROW}>, "
    "calls array<struct<caller:string,caller_line:int,callee:string,line:int>>, names array<string>"
)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def strip_noise(text: str) -> str:
    """Comments, strings and character literals as blanks; length and line breaks stay."""
    return NOISE.sub(_blank, text)


def _name_before(header: str) -> tuple[str, int] | None:
    """Name whose parameter list ends the header, and its offset."""
    end = len(header.rstrip())
    if not end or header[end - 1] != ")":
        return None
    depth = 0
    for i in range(end - 1, -1, -1):
        depth += (header[i] == ")") - (header[i] == "(")
        if not depth:
            m = re.search(r"([A-Za-z_]\w*)\s*\Z", header[:i])
            return (m[1], m.start(1)) if m and m[1] not in KEYWORDS else None
    return None


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def lex_text(text: str | None) -> dict[str, list]:
    """All relations of one file."""
    raw = (text or "").replace("\r\n", "\n")
    clean = strip_noise(raw)
    starts = [m.end() for m in re.finditer("\n", raw)]

    def line(at: int) -> int:
        return bisect_right(starts, at) + 1

    out: dict[str, list] = {k: [] for k in ("functions", "globals", "declarations", "macros", "types", "calls", "names")}

    def row(name: str, at: int, end: int, what: str) -> dict:
        return {"name": name, "line": line(at), "end_line": line(end), "text": what}

    for m in DEFINE.finditer(raw):
        if clean[m.start(1) : m.end(1)] == m[1]:  # not inside a comment
            out["macros"].append(row(m[1], m.start(1), m.end(), _squeezed(f"#define {m[1]}{m[2]}".replace("\\\n", " "))))
    code = DIRECTIVE.sub(_blank, clean)
    bounds = {m.start() for m in DIRECTIVE.finditer(clean)}
    begin, depth, opened, function = 0, 0, 0, None
    for m in re.finditer(r"[{};]|(?m:^[ \t]*#)", clean):
        mark, at = m[0], m.start()
        if mark not in "{};":
            if not depth and at in bounds:
                begin = m.end()  # a directive ends a top-level statement
            continue
        if code[at] != mark:
            continue
        if mark == "{":
            if not depth:
                opened, function = at, _name_before(code[begin:at])
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
            if not depth and function:
                name, offset = function
                out["functions"].append(row(name, begin + offset, at, _squeezed(code[begin:opened])))
                for c in CALL.finditer(code, opened, at):
                    before = code[max(0, c.start(1) - 80) : c.start(1)].rstrip()[-2:]
                    if c[1] not in KEYWORDS and not before.endswith(".") and before != "->":
                        out["calls"].append({"caller": name, "caller_line": line(begin + offset), "callee": c[1], "line": line(c.start(1))})
                begin, function = at + 1, None
        elif not depth:
            _statement(out, row, code, raw, begin, at)
            begin = at + 1
    out["calls"] = list({(c["caller"], c["caller_line"], c["callee"], c["line"]): c for c in out["calls"]}.values())
    out["names"] = sorted(set(re.findall(r"[A-Za-z_]\w*", raw, re.A)))
    return out


def _statement(out: dict[str, list], row, code: str, raw: str, begin: int, end: int) -> None:
    """One top-level statement that ends in a semicolon: a type, a prototype or a global."""
    body = code[begin:end]
    lead = len(body) - len(body.lstrip())
    head = body.strip()
    kind = re.match(r"(typedef\s+)?(?:(?:struct|union|enum)\b\s*([A-Za-z_]\w*)?\s*(\{)?)?", head)
    text = _squeezed(raw[begin + lead : end])[:TYPE_CHARS]
    if kind[1] or kind[3]:
        tail = LAST_NAME.search(head)
        name = tail[1] if kind[1] and tail else kind[2]
        if name:
            out["types"].append(row(name, begin + lead, end, text))
        return
    if head.startswith(("extern", "return")) and "(" not in head:
        return
    found = _name_before(head)
    if found and "=" not in head[: found[1]] and head[: found[1]].strip():
        out["declarations"].append(row(found[0], begin + lead + found[1], end, _squeezed(head) + ";"))
    elif "(" not in head.split("=")[0] and "{" not in head and (m := GLOBAL.fullmatch(head)) and not head.startswith(("extern", "goto")):
        out["globals"].append(row(m[1], begin + lead + m.start(1), end, _squeezed(head)))


def lexed(files: DataFrame) -> DataFrame:
    """(module_id, file, lex): every file lexed once; callers write it before reading it several times."""
    lex = F.pandas_udf(_lex, f"struct<{LEXED.replace(' array', ':array')}>")
    return files.select("module_id", "file", lex("text").alias("lex"))


def _lex(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lex_text(t) for t in text], columns=["functions", "globals", "declarations", "macros", "types", "calls", "names"])


def relation(lexed_files: DataFrame, name: str) -> DataFrame:
    """One relation: (module_id, file, its columns)."""
    return lexed_files.select("module_id", "file", F.inline(F.col(f"lex.{name}")))


def exported(kind: Column) -> Column:
    """Tag of a function by whether a header declares it."""
    return F.when(kind, EXPORTED).otherwise(INTERNAL)
