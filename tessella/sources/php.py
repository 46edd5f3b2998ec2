"""PHP source files as token rows.

A file is tokenized in one pass of a Python worker; each token carries what a later rule would otherwise have to search
for: the scopes around it (conditions, outermost first), its own scope, the declared name, the modifiers before it,
whether it stands in parentheses of its scope, and the function whose parameter list it is in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.schemas import TOKENS, UNITS

KEYWORDS = {
    w: "T_" + w.upper()
    for w in "abstract as break case catch class clone const continue declare default do echo else elseif empty enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new print private protected public readonly require require_once return static switch throw trait try unset use var while yield".split()
} | {"exit": "T_EXIT", "die": "T_EXIT", "and": "T_LOGICAL_AND", "or": "T_LOGICAL_OR", "xor": "T_LOGICAL_XOR", "array": "T_ARRAY", "callable": "T_CALLABLE", "self": "T_SELF", "parent": "T_PARENT", "null": "T_NULL", "true": "T_TRUE", "false": "T_FALSE"}
SYMBOLS = {
    "{": "T_OPEN_CURLY_BRACKET", "}": "T_CLOSE_CURLY_BRACKET", "(": "T_OPEN_PARENTHESIS", ")": "T_CLOSE_PARENTHESIS", "[": "T_OPEN_SQUARE_BRACKET", "]": "T_CLOSE_SQUARE_BRACKET",
    ";": "T_SEMICOLON", ",": "T_COMMA", ":": "T_COLON", "::": "T_DOUBLE_COLON", "->": "T_OBJECT_OPERATOR", "?->": "T_NULLSAFE_OBJECT_OPERATOR", "=>": "T_DOUBLE_ARROW", "=": "T_EQUAL", "#[": "T_ATTRIBUTE", "\\": "T_NS_SEPARATOR",
}
EMPTY = frozenset(("T_WHITESPACE", "T_COMMENT", "T_DOC_COMMENT"))
MODIFIERS = frozenset(("T_ABSTRACT", "T_FINAL", "T_PRIVATE", "T_PROTECTED", "T_PUBLIC", "T_READONLY", "T_STATIC", "T_VAR"))
CLASS_LIKE = frozenset(("T_CLASS", "T_ANON_CLASS", "T_INTERFACE", "T_TRAIT", "T_ENUM"))
#: Keywords whose block is a scope.
SCOPED = CLASS_LIKE | frozenset("T_FUNCTION T_CLOSURE T_IF T_ELSE T_ELSEIF T_FOR T_FOREACH T_WHILE T_DO T_SWITCH T_MATCH T_TRY T_CATCH T_FINALLY T_NAMESPACE T_DECLARE".split())

#: A word that neither a quote nor a backslash follows, and a bracket or separator, can be nothing else: they come first.
LEXEMES = re.compile(
    r"""(?P<ws>\s+)
    |(?P<plain>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*+(?![\\'"]))
    |(?P<mark>[(){}\[\];,])
    |(?P<doc>/\*\*(?=\s).*?(?:\*/|\Z))
    |(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z))
    |(?P<close>\?>\n?)
    |(?P<variable>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)
    |(?P<heredoc><<<[ \t]*(?P<q>["']?)(?P<label>[A-Za-z_]\w*)(?P=q)\n.*?\n?[ \t]*(?P=label)\b)
    |(?P<single>[bB]?'(?:[^'\\]|\\.)*(?:'|\Z))
    |(?P<double>[bB]?"(?:[^"\\]|\\.)*(?:"|\Z))
    |(?P<back>`(?:[^`\\]|\\.)*(?:`|\Z))
    |(?P<number>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?))
    |(?P<full>\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)
    |(?P<qualified>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)+)
    |(?P<word>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)
    |(?P<symbol>\?->|::|->|=>|\#\[|<=>|===|!==|\*\*=|\?\?=|<<=|>>=|\.\.\.|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|<<|>>|[-+*/.%&|^]=|.)""",
    re.X | re.S,
)


OPEN = re.compile(r"<\?(?:php(?:\s|\Z)|=)", re.I)
_OF_KIND = {"ws": "T_WHITESPACE", "doc": "T_DOC_COMMENT", "comment": "T_COMMENT", "close": "T_CLOSE_TAG", "variable": "T_VARIABLE", "heredoc": "T_HEREDOC", "q": "T_HEREDOC", "label": "T_HEREDOC", "single": "T_CONSTANT_ENCAPSED_STRING", "back": "T_BACKTICK", "number": "T_NUMBER", "full": "T_NAME_FULLY_QUALIFIED", "qualified": "T_NAME_QUALIFIED"}
#: Keywords that stay what they are after function and const.
_NO_NAMES = frozenset(("T_STRING", "T_ARRAY", "T_SELF", "T_STATIC", "T_CALLABLE", "T_PARENT", "T_NULL", "T_FALSE", "T_TRUE"))


def lex(source: str) -> tuple[list[str], list[str]]:
    """The codes and the contents of all tokens; the contents joined are the source."""
    codes: list[str] = []
    contents: list[str] = []
    at = 0
    while at < len(source):
        open_ = OPEN.search(source, at)
        if open_ is None:
            codes.append("T_INLINE_HTML")
            contents.append(source[at:])
            break
        if open_.start() > at:
            codes.append("T_INLINE_HTML")
            contents.append(source[at : open_.start()])
        codes.append("T_OPEN_TAG_WITH_ECHO" if open_.group().endswith("=") else "T_OPEN_TAG")
        contents.append(open_.group())
        at = open_.end()
        before = ""
        for m in LEXEMES.finditer(source, at):
            kind, text = m.lastgroup, m.group()
            code = _OF_KIND.get(kind)
            if code is None:
                if kind == "mark":
                    code = SYMBOLS[text]
                elif kind == "plain" or kind == "word":
                    code = _word(text, before, source, m.end())
                elif kind == "double":
                    code = "T_DOUBLE_QUOTED_STRING" if re.search(r"(?<!\\)(?:\\\\)*\$[A-Za-z_{]|\{\$", text) else "T_CONSTANT_ENCAPSED_STRING"
                else:
                    code = SYMBOLS.get(text, "T_OPERATOR")
            codes.append(code)
            contents.append(text)
            if kind == "close":
                at = m.end()
                break
            if code not in EMPTY:
                before = code
        else:
            break
    return codes, contents


def _word(text: str, before: str, source: str, end: int) -> str:
    """The code of a word after an effective token, by what follows its end."""
    code = KEYWORDS.get(text.lower())
    if code is None or before == "T_OBJECT_OPERATOR" or before == "T_NULLSAFE_OBJECT_OPERATOR" or before == "T_DOUBLE_COLON" and code != "T_CLASS":
        return "T_STRING"
    if (before == "T_FUNCTION" or before == "T_CONST") and code not in _NO_NAMES or before == "T_CASE" and code in ("T_DEFAULT", "T_CLASS"):
        return "T_STRING"
    if code in ("T_ENUM", "T_READONLY", "T_MATCH") and not _is_keyword(code, source[end : end + 80]) or before == "T_USE" and code in ("T_FUNCTION", "T_CONST"):
        return "T_STRING"
    return code


def _is_keyword(code: str, rest: str) -> bool:
    """enum, match and readonly are words of their own only before a name, a parenthesis, or anything but a call."""
    if code == "T_ENUM":
        return re.match(r"\s+(?!extends\b|implements\b)[A-Za-z_]", rest) is not None
    if code == "T_MATCH":
        return re.match(r"\s*\(", rest) is not None
    return re.match(r"\s*\(", rest) is None


_DECLARES = frozenset(("T_CLASS", "T_FUNCTION", "T_VARIABLE", "T_CONST", "T_FN", "T_ENUM", "T_INTERFACE", "T_TRAIT"))
_NAMES = frozenset(("T_STRING", "T_SELF", "T_NULL", "T_ARRAY", "T_STATIC", "T_CALLABLE", "T_PARENT", "T_TRUE", "T_FALSE"))
#: After these, modifiers before them count no more.
_ENDS_MODIFIERS = frozenset(("T_SEMICOLON", "T_OPEN_CURLY_BRACKET", "T_CLOSE_CURLY_BRACKET", "T_COMMA", "T_OPEN_PARENTHESIS", "T_VARIABLE", "T_FUNCTION", "T_CLOSURE", "T_CLASS", "T_ANON_CLASS", "T_CONST", "T_FN", "T_ENUM", "T_EQUAL"))
#: Tokens that neither declare nor open, close or separate anything.
_IDLE = frozenset(("T_STRING", "T_CONSTANT_ENCAPSED_STRING", "T_DOUBLE_QUOTED_STRING", "T_NUMBER", "T_NAME_FULLY_QUALIFIED", "T_NAME_QUALIFIED", "T_OPERATOR", "T_OBJECT_OPERATOR", "T_DOUBLE_COLON", "T_RETURN", "T_COLON"))
NONE: list = []


def columns(source: str) -> tuple[list, ...]:
    """The tokens of one file, a list for each field of _TOKEN. Lists of conditions and modifiers may be shared."""
    codes, contents = lex(source)
    n = len(codes)
    lines, openers, closers, conditions, parents, names, modified, in_parens, owners = [], [None] * n, [None] * n, [], [], [None] * n, [NONE] * n, [], []
    scopes: list[tuple[int, int]] = []  # owner, brace depth inside
    parens: list[tuple[int, int | None]] = []  # number of scopes, function whose parameters these are
    pending: int | None = None
    having: set[int] = set()  # functions whose parameter list has begun
    depth = attribute = 0
    line = 1
    modifiers: list[str] = []
    before = second = None
    # What holds for every token until a scope or a parenthesis opens or closes.
    around, parent, inside, owner = NONE, None, False, None
    moved = False
    for idx in range(n):
        code, content = codes[idx], contents[idx]
        lines.append(line)
        line += content.count("\n")
        if code == "T_CLOSE_CURLY_BRACKET" and scopes and scopes[-1][1] == depth:
            closers[scopes.pop()[0]] = idx
            moved = True
        if moved:
            around = [x[0] for x in scopes]
            parent = around[-1] if around else None
            level = len(scopes)
            inner = [p for p in parens if p[0] == level]
            inside, owner = bool(inner), inner[0][1] if inner else None
            moved = False
        conditions.append(around)
        parents.append(parent)
        in_parens.append(inside)
        owners.append(owner)
        if code in EMPTY:
            continue
        if attribute:
            attribute += (code == "T_OPEN_SQUARE_BRACKET" or code == "T_ATTRIBUTE") - (code == "T_CLOSE_SQUARE_BRACKET")
            before, second = code, before
            continue
        if code in _IDLE:
            before, second = code, before
            continue
        if code == "T_ATTRIBUTE":
            attribute = 1
            before, second = code, before
            continue
        if code in MODIFIERS:
            modifiers.append(content.lower())
        elif code in _DECLARES:
            if modifiers:
                modified[idx] = list(modifiers)
            if code != "T_VARIABLE" and code != "T_FN":
                if code == "T_CLASS" and before == "T_DOUBLE_COLON":
                    code = "T_STRING"
                k = idx + 1
                while k < n and (codes[k] in EMPTY or contents[k] == "&"):
                    k += 1
                named = contents[k] if k < n and codes[k] in _NAMES else None
                if code == "T_FUNCTION" and named is None:
                    code = "T_CLOSURE"
                elif code == "T_CLASS" and (before == "T_NEW" or named is None or modifiers and before == "T_READONLY" and second == "T_NEW"):
                    code = "T_ANON_CLASS"
                elif named is not None:
                    names[idx] = named
                codes[idx] = code
        if code == "T_CASE" and scopes and codes[scopes[-1][0]] == "T_ENUM":
            codes[idx] = code = "T_ENUM_CASE"
        if code in SCOPED:
            pending = idx
        elif code == "T_OPEN_PARENTHESIS":
            mine = pending is not None and codes[pending] in ("T_FUNCTION", "T_CLOSURE") and pending not in having
            if mine:
                having.add(pending)
            parens.append((len(scopes), pending if mine else None))
            moved = True
        elif code == "T_CLOSE_PARENTHESIS":
            if parens:
                parens.pop()
                moved = True
        elif code == "T_OPEN_CURLY_BRACKET":
            depth += 1
            if pending is not None:
                openers[pending] = idx
                scopes.append((pending, depth))
                pending = None
                moved = True
        elif code == "T_CLOSE_CURLY_BRACKET":
            depth -= 1
        elif code == "T_SEMICOLON" and not inside:
            pending = None
        if modifiers and code in _ENDS_MODIFIERS:
            modifiers = []
        before, second = code, before
    return list(range(n)), lines, codes, contents, openers, closers, conditions, parents, names, modified, in_parens, owners


def tokenize(source: str) -> list[dict]:
    """The rows of one file, without its path."""
    names = [field.name for field in _TOKEN]
    return [{k: list(v) if isinstance(v, list) else v for k, v in zip(names, row)} for row in zip(*columns(source))]


_TOKEN = pa.struct(
    [
        ("idx", pa.int32()), ("line", pa.int32()), ("code", pa.string()), ("content", pa.string()), ("scope_opener", pa.int32()), ("scope_closer", pa.int32()),
        ("conditions", pa.list_(pa.int32())), ("parent_idx", pa.int32()), ("name", pa.string()), ("modifiers", pa.list_(pa.string())), ("in_parens", pa.bool_()), ("owner_idx", pa.int32()),
    ]
)


#: Tokens, and characters of sources, that end a batch of files.
MOST_TOKENS, MOST_CHARS = 1 << 15, 1 << 22


def _flat(lists: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(filter(None, lists))), kind))


def _batch(paths: pa.Array, sources: list[tuple[list, ...]]) -> pa.RecordBatch:
    fields = []
    for i, field in enumerate(_TOKEN):
        column = list(chain.from_iterable(x[i] for x in sources))
        fields.append(_flat(column, field.type.value_type) if pa.types.is_list(field.type) else pa.array(column, field.type))
    offsets = pa.array(list(accumulate((len(x[0]) for x in sources), initial=0)), pa.int32())
    return pa.RecordBatch.from_arrays([paths, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_TOKEN)))], ["path", "tokens"])


def units(files: DataFrame) -> DataFrame:
    """(path, tokens): one row for each of files (path, content). A null or empty content has no tokens.

    Files go on together, by column, until they have MOST_TOKENS tokens or MOST_CHARS characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, first, n_tokens, n_chars = [], 0, 0, 0
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py() or ""
                done.append(columns(content))
                n_tokens += len(done[-1][0])
                n_chars += len(content)
                if n_tokens >= MOST_TOKENS or n_chars >= MOST_CHARS:
                    yield _batch(batch.column(0).slice(first, len(done)), done)
                    done, first, n_tokens, n_chars = [], i + 1, 0, 0
            if done:
                yield _batch(batch.column(0).slice(first, len(done)), done)

    return files.select("path", "content").mapInArrow(run, UNITS)


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of files (path, content) as rows, in no order; idx counts them in a file."""
    return units(files).select("path", F.inline("tokens"))


def grouped(source: DataFrame) -> DataFrame:
    """Units from units or from token rows; these are gathered by file."""
    if "tokens" in source.columns:
        return source
    names = [f.name for f in TOKENS if f.name != "path"]
    return source.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("tokens"))
