"""Code bases and documentation that are written from the rows of a table, with the SQL of what the rules must find.

A template is a list of lines. Each line is there or not by a condition over the row's number, and says what is wrong with
it; the line numbers, messages and their order then follow by counting, in SQL, without reading any source. Conditions are
over v and f: a row of number k writes a file of family f = k % families, in the variant v = k / families.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOTS = ["Shop\\Common\\Module\\", "Common\\Module\\", "Shop\\Web\\Module\\", "Shop2\\Common\\Module\\"]
MODULES = ["Cart\\", "Stock\\", "Ledger\\", "Mail9\\", "Cart\\"]
LAYERS = ["Domain\\", "Application\\", "Infrastructure\\", "Integration\\", "Domain\\", "Other\\"]
PATHS = [
    "Entity\\Basket", "Service\\Price\\QuoteServiceInterface", "ValueObject\\AmountVo", "Enum\\State", "Dto\\BasketDto", "UseCase\\Command\\Pay\\PayCommandHandler", "Repository\\BasketRepositoryInterface",
    "Service\\Price\\QuoteService", "UseCase\\Command\\Pay\\PayCommand", "UseCase\\Query\\Show\\ShowQuery", "UseCase\\Query\\Show\\ShowQueryHandler", "Listener\\OnPaid", "Component\\Pdf\\PdfComponent",
    "Component\\Pdf\\Page", "Model\\Row", "Entity\\ValueObject\\SumVo", "Service\\Integration\\PortInterface", "Enum\\KindDto",
]
KINDS = ["USE", "PARAMETER", "INHERIT", "PARAMETER", "STATIC_METHOD"]


@dataclass(frozen=True)
class Found:
    """A message for a line: when it is due, and what it says. {k} stands for the row's number."""

    rule: str
    code: str
    message: str
    when: str = "true"
    fixable: bool = False


@dataclass(frozen=True)
class Line:
    text: str
    when: str = "true"
    found: tuple[Found, ...] = ()
    fixed: str | None = None


@dataclass(frozen=True)
class Family:
    path: str
    lines: tuple[Line, ...]


def _members(rule: str, first: int) -> tuple[Line, ...]:
    """A trait, a constant and a property, each by a bit of v."""
    of = lambda kind: (Found(rule, "ForbiddenMembers", f"{kind} aren't allowed here"),)
    return (
        Line("    use Helps;", f"(v & {first}) > 0", of("traits")),
        Line("    const A = 1, B = 2;", f"(v & {first * 2}) > 0", of("constants")),
        Line("    private ?int $x = null;", f"(v & {first * 4}) > 0", of("properties")),
    )


def _constructor(rule: str, what: str) -> tuple[Line, ...]:
    """By the two lowest bits of v: none, an empty one, one with a comment, one that does something."""
    return (
        Line("    public function __construct(public int $id, #[Tag] private string $s = 'a{b}') {}", "(v & 3) = 1"),
        Line("    public function __construct(public int $id) { /* nothing */ }", "(v & 3) = 2"),
        Line("    public function __construct(public int $id)", "(v & 3) = 3"),
        Line("    {", "(v & 3) = 3"),
        Line("        // not empty", "(v & 3) = 3"),
        Line("        $this->id = $id; $y = fn ($q) => $q;", "(v & 3) = 3", (Found(rule, "ConstructorMustBeEmpty", f"{what}'s constructor does nothing"),)),
        Line("    }", "(v & 3) = 3"),
    )


_DTO, _MSG, _HND, _ENM, _USE, _CLL = "DtoStructure", "MessageStructure", "HandlerStructure", "EnumStructure", "UseCaseNaming", "GlobalCalls"
_NO_CTOR = "(v & 3) = 0"
_FINAL = Found(_DTO, "FinalReadonlyRequired", "a DTO is final and readonly", "(v & 12) > 0")
_BARE = Found(_DTO, "ConstructorRequired", "a DTO has a constructor", _NO_CTOR)
_COMMENT = Line("/** class Nothing { public $x; } */", "(v & 1) = 1")
_METHOD = "    public function show(): string { return new class { public $inner; public function m() { return \"x {$this->inner}\"; } }; }"

FAMILIES: tuple[Family, ...] = (
    Family("lib/Item{k}Dto.php", (
        Line("<?php"), _COMMENT,
        Line("final readonly class Item{k}Dto", "(v & 12) = 0", (_BARE,)),
        Line("final class Item{k}Dto", "(v & 12) = 4", (_BARE, _FINAL)),
        Line("readonly class Item{k}Dto", "(v & 12) = 8", (_BARE, _FINAL)),
        Line("class Item{k}Dto", "(v & 12) = 12", (_BARE, _FINAL)),
        Line("{"), *_members(_DTO, 16), *_constructor(_DTO, "a DTO"),
        Line(_METHOD, "(v & 2) = 2", (Found(_DTO, "ForbiddenMembers", "a DTO has no method but its constructor"),)),
        Line("}"),
    )),
    Family("src/Module/M{k}/Application/UseCase/Command/Pay{k}/Pay{k}Command.php", (
        Line("<?php"), Line("namespace App\\Module\\M{k}\\Application\\UseCase\\Command\\Pay{k};"), Line("", "(v & 4) > 0"),
        Line("final class Pay{k}Command", "true", (Found(_MSG, "ConstructorRequired", "a message has a constructor", _NO_CTOR),)),
        Line("{"), *_members(_MSG, 8), *_constructor(_MSG, "a message"),
        Line("    static function make() {}", "(v & 64) > 0", (Found(_MSG, "OnlyConstructorAllowed", "a message has no method but its constructor"),)),
        Line("}"),
    )),
    Family("src/Module/M{k}/Application/UseCase/Command/Do{k}/Do{k}CommandHandler.php", (
        Line("<?php"), Line("namespace App\\Module\\M{k}\\Application\\UseCase\\Command\\Do{k};"), _COMMENT,
        Line("final class Do{k}CommandHandler", "true", (Found(_HND, "InvokeRequired", "a handler has a public __invoke", "(v & 6) = 0"),)),
        Line("{"),
        Line("    public $open;", "(v & 8) > 0", (Found(_HND, "ForbiddenPublicProperties", "a handler has no public property"),)),
        Line("    private $closed;", "(v & 16) > 0"),
        Line("    public function __construct(private A $a, readonly protected B $b) {}", "(v & 32) = 0"),
        Line("    public function __construct(public A $a) {}", "(v & 32) > 0", (Found(_HND, "ForbiddenPublicProperties", "a handler's dependency isn't a public promoted property"),)),
        Line("    public function __invoke(): void {}", "(v & 6) = 2"), Line("    function __invoke(): void {}", "(v & 6) = 4"),
        Line("    private function __invoke(): void {}", "(v & 6) = 6", (Found(_HND, "ForbiddenPublicMethods", "__invoke is public"),)),
        Line("    function other(): void {}", "(v & 64) > 0", (Found(_HND, "ForbiddenPublicMethods", "a handler has no public method but __invoke"),)),
        Line("    protected function helper(): void {}"), Line("}"),
    )),
    Family("lib/Kind{k}.php", (
        Line("<?php"), Line("# a comment", "(v & 1) > 0"), Line("enum Kind{k}: string"), Line("{"),
        Line("    use T;", "(v & 2) > 0", (Found(_ENM, "ForbiddenMembers", "traits aren't allowed here"),)),
        Line("    const X = 1;", "(v & 4) > 0", (Found(_ENM, "ForbiddenMembers", "constants aren't allowed here"),)),
        Line("    case Upper = 'u';", "(v & 8) > 0", (Found(_ENM, "CaseNameMustBeCamelCase", "a case is in camel case"),)),
        Line("    case under_score = 's';", "(v & 16) > 0", (Found(_ENM, "CaseNameMustBeCamelCase", "a case is in camel case"),)),
        Line("    case goodName{k} = 'g';"),
        Line("    public function label(): string { return 'case Other'; }", "(v & 32) > 0", (Found(_ENM, "ForbiddenMembers", "methods aren't allowed here"),)),
        Line("}"),
    )),
    Family("src/Module/M{k}/Application/UseCase/Query/Find{k}/Find{k}Query.php", (
        Line("<?php"), Line("", "(v & 8) > 0"),
        Line("namespace App\\Module\\M{k}\\Application\\UseCase\\Query\\Find{k};", "(v & 4) = 0"),
        Line("namespace Wrong\\Space;", "(v & 4) > 0", (Found(_USE, "NamespaceMismatch", "the namespace follows the path", "(v & 3) <> 3"),)),
        Line("final class Find{k}Query { public function __construct() {} }", "(v & 3) < 2"),
        Line("final class Seek{k}Query { public function __construct() {} }", "(v & 3) = 2", (Found(_USE, "FilenameMismatch", "the file is named after its class"), Found(_USE, "UseCaseNameMismatch", "the class is named after its directory"))),
        Line("final class Find{k}Command { public function __construct() {} }", "(v & 3) = 3", (Found(_USE, "InvalidUseCaseSuffix", "a class here is a Query or its handler"),)),
    )),
    Family("lib/calls{k}.php", (
        Line("<?php"),
        Line("use function strlen;", "(v & 1) > 0", (Found(_CLL, "GlobalFunctionImport", "not imported but called: strlen", fixable=True),), ""),
        Line("use function \\trim ;", "(v & 2) > 0", (Found(_CLL, "GlobalFunctionImport", "not imported but called: trim", fixable=True),), ""),
        Line("use function A\\b;", "(v & 4) > 0"),
        Line("$a = \\strlen ('x') . \\A\\b() . new \\Date() . $o->x(\\count([]));", "(v & 8) > 0", (Found(_CLL, "FullyQualifiedGlobalFunctionCall", "called without a backslash: strlen", fixable=True), Found(_CLL, "FullyQualifiedGlobalFunctionCall", "called without a backslash: count", fixable=True)), "$a = strlen ('x') . \\A\\b() . new \\Date() . $o->x(count([]));"),
        Line("$f = function () use ($a) { return \\is_null($a); };", "(v & 16) > 0", (Found(_CLL, "FullyQualifiedGlobalFunctionCall", "called without a backslash: is_null", fixable=True),), "$f = function () use ($a) { return is_null($a); };"),
        Line("echo <<<T", "(v & 32) > 0"), Line(" \\strlen(1)", "(v & 32) > 0"), Line("T;", "(v & 32) > 0"), Line("// \\strlen({k})"),
    )),
)

_RULE = "## Общие правила"

#: Documents: an index or a rule each, with a front matter that may lack fields, links and sections.
DOC_LINES: tuple[Line, ...] = (
    Line("---", "(v & 31) <> 31", ()), Line("name: c{k}", "(v & 31) <> 31 AND (v & 1) = 0"),
    Line("# note", "(v & 31) <> 31"), Line("type: \"index\"", "(v & 31) <> 31 AND (v & 6) = 0"), Line("type: rule", "(v & 31) <> 31 AND (v & 2) > 0"),
    Line("type: draft", "(v & 31) <> 31 AND (v & 6) = 4"), Line("description: 'about: {k}'", "(v & 31) <> 31 AND (v & 8) = 0"), Line("---", "(v & 31) <> 31"),
    Line("# Title {k}"), Line(_RULE, "(v & 16) = 0"), Line("## расположение.", "(v & 32) = 0"), Line("### Расположение"), Line("## Чек-лист для проведения ревью кода", "(v & 64) = 0"),
    Line("[next](c{next}.md#part) and [gone](sub/gone{k}.md)"), Line("[self](./../docs/c{k}.md) [web](https://x.y/{k}) [anchor](#a) [mail](mailto:q@x.y)"),
    Line("[up](../other{k}.md)", "(v & 128) > 0"),
)


def _number(text: str) -> list[str]:
    return text.replace("{next}", "{k}").split("{k}")


def _spark(text: str, k: Column) -> Column:
    """A text with the row's number filled in; {next} is one more."""
    parts: list[Column] = []
    for i, piece in enumerate(text.split("{next}")):
        parts += [(k + 1).cast("string")] * (i > 0)
        for j, own in enumerate(piece.split("{k}")):
            parts += [k.cast("string")] * (j > 0) + [F.lit(own)]
    return F.concat(*parts)


def _text(lines: tuple[Line, ...], k: Column, fixed: bool = False) -> Column:
    of = lambda line: _spark(line.fixed if fixed and line.fixed is not None else line.text, k)
    return F.concat(F.array_join(F.filter(F.array(*[F.when(F.expr(line.when), of(line)) for line in lines]), lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def sources(rows: DataFrame, key: str) -> DataFrame:
    """(path, content): one PHP source for each row's key."""
    n = len(FAMILIES)
    numbered = rows.select(F.col(key).alias("k")).withColumns({"f": F.expr(f"k % {n}"), "v": F.expr(f"k div {n}")})
    pick = lambda of: reduce(lambda acc, x: acc.when(F.col("f") == x[0], of(x[1])), enumerate(FAMILIES[1:], 1), F.when(F.col("f") == 0, of(FAMILIES[0])))
    k = F.col("k")
    return numbered.select(pick(lambda x: _spark(x.path, k)).alias("path"), pick(lambda x: _text(x.lines, k)).alias("content"))


def documents(rows: DataFrame, key: str) -> DataFrame:
    """(path, content): one markdown document for each row's key."""
    numbered = rows.select(F.col(key).alias("k")).withColumn("v", F.col("k"))
    return numbered.select(_spark("docs/c{k}.md", F.col("k")).alias("path"), _text(DOC_LINES, F.col("k")).alias("content"))


def entries(docs: DataFrame) -> DataFrame:
    """(path, is_dir, basename, extension) of the documents, with some whose names are wrong, and directories."""
    name = F.regexp_replace("path", "^docs/", "")
    row = lambda path, is_dir: F.struct(path.alias("path"), F.lit(is_dir).alias("is_dir"), F.regexp_replace(path, "^.*/", "").alias("basename"), F.lit("" if is_dir else "md").alias("extension"))
    odd = F.col("path").endswith("7.md")
    more = F.when(odd, F.array(row(F.concat(F.lit("docs/old_"), name), False), row(F.regexp_replace(F.concat(F.lit("docs/dir_"), name), r"\.md$", ""), True))).otherwise(F.array().cast("array<struct<path:string,is_dir:boolean,basename:string,extension:string>>"))
    return docs.select(F.explode(F.concat(F.array(row(F.col("path"), False)), more)).alias("e")).select("e.*")


# --- the same in SQL -----------------------------------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str) -> str:
    return f"replace(replace({_q(text)}, '{{next}}', (k + 1)::VARCHAR), '{{k}}', k::VARCHAR)"


def numbered(table: str, key: str, families: int) -> str:
    return f"(SELECT {key} AS k, {key} % {families} AS f, {key} // {families} AS v FROM {table})"


def _line(lines: tuple[Line, ...], i: int) -> str:
    """The number of line i of a template: the lines up to it that are there."""
    always = sum(x.when == "true" for x in lines[: i + 1])
    return " + ".join([str(always), *[f"({x.when})::INT" for x in lines[: i + 1] if x.when != "true"]])


def found_sql(table: str, key: str, rules: tuple[str, ...] = ()) -> str:
    """A DuckDB table (path, line, rule, code, message, fixable, place) of what is wrong; place orders a file's messages."""
    parts = []
    for f, family in enumerate(FAMILIES):
        for i, line in enumerate(family.lines):
            for j, x in enumerate(line.found):
                if not rules or x.rule in rules:
                    parts.append(f"SELECT {_sql(family.path)} AS path, ({_line(family.lines, i)})::INT AS line, '{x.rule}' AS rule, '{x.code}' AS code, {_sql(x.message)} AS message, {str(x.fixable).lower()} AS fixable, {i * 100 + j} AS place FROM src WHERE f = {f} AND ({line.when}) AND ({x.when})")
    return f"(WITH src AS {numbered(table, key, len(FAMILIES))} " + " UNION ALL ".join(parts) + ")"


def fixed_sql(table: str, key: str) -> str:
    """A DuckDB table (path, content) of all sources as they are once fixed."""
    parts = []
    for f, family in enumerate(FAMILIES):
        texts = ", ".join(f"CASE WHEN {x.when} THEN {_sql(x.text if x.fixed is None else x.fixed)} END" for x in family.lines)
        parts.append(f"SELECT {_sql(family.path)} AS path, array_to_string(list_filter([{texts}], lambda x: x IS NOT NULL), chr(10)) || chr(10) AS content FROM src WHERE f = {f}")
    return f"(WITH src AS {numbered(table, key, len(FAMILIES))} " + " UNION ALL ".join(parts) + ")"


_MATTER = "(v & 31) <> 31"
_IS_RULE = f"{_MATTER} AND (v & 2) > 0"


def doc_errors_sql(table: str, key: str) -> str:
    """A DuckDB table ("check", path, line, detail) of what is wrong with the documents."""
    body = next(i for i, x in enumerate(DOC_LINES) if x.text.startswith("# Title"))
    lines = DOC_LINES[body:]
    at = {x.text: f"({_line(lines, i)})::INT" for i, x in enumerate(lines)}
    # Without a front matter all lines are the body.
    row = lambda check, detail, when, line="NULL::INT", path="docs/c{k}.md": f"SELECT '{check}' AS \"check\", {_sql(path)} AS path, {line} AS line, {_sql(detail)} AS detail FROM src WHERE {when}"
    parts = [
        row("front-matter", "missing", f"NOT ({_MATTER})"),
        row("front-matter", "missing name", f"{_MATTER} AND (v & 1) > 0"),
        row("front-matter", "missing description", f"{_MATTER} AND (v & 8) > 0"),
        row("front-matter", "type draft", f"{_MATTER} AND (v & 6) = 4"),
        row("naming", "file", "k % 10 = 7", path="docs/old_c{k}.md"),
        row("naming", "directory", "k % 10 = 7", path="docs/dir_c{k}"),
        row("link", "c{next}.md#part", f"NOT EXISTS (SELECT 1 FROM {table} n WHERE n.{key} = k + 1)", at[lines[-3].text]),
        row("link", "sub/gone{k}.md", "true", at[lines[-3].text]),
        row("link", "../other{k}.md", "(v & 128) > 0", at[lines[-1].text]),
        row("section", "Общие правила", f"{_IS_RULE} AND (v & 16) > 0"),
        row("section", "Расположение", f"{_IS_RULE} AND (v & 32) > 0"),
        row("section", "Чек-лист для проведения ревью кода", f"{_IS_RULE} AND (v & 64) > 0"),
    ]
    return f"(WITH src AS (SELECT {key} AS k, {key} AS v FROM {table}) " + " UNION ALL ".join(parts) + ")"
