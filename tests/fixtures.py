"""Documents and sources that were written by hand, with what is wrong with them."""

from __future__ import annotations

_RULE = "---\nname: {n}\ntype: rule\ndescription: about {n}\n---\n"
_ALL = "# T\n## Общие правила\n## расположение.\n## Чек-лист ревью\n"

DOCS = [
    ("docs/a.md", _RULE.format(n="a") + _ALL + "[b](b.md#x) and [gone](sub/gone.md)\n[web](https://x.y) [self](#t) [mail](mailto:q@x.y) [tpl]({x}) [tel](tel:1)\n[up](../docs/./b.md) [up](../other.md)\n"),
    ("docs/b.md", "---\nname: b\nname: 'second'\n# note\ntype: \"index\"\nno colon here\ndescription: a: b\n---\n[a](a.md) [dir](sub)\n"),
    ("docs/empty-matter.md", "---\n---\n"),
    ("docs/crlf.md", "---\r\nname: a\r\n---\r\n"),
    ("docs/no-type.md", "---\nname: x\ndescription:   \n---\n"),
    ("docs/odd.md", "---\nname: x\ntype: note\ndescription: d\n---\n"),
    ("docs/sub/rule.md", _RULE.format(n="r") + "## Общие положения\n### Расположение\ntext [x](../a.md) [y](rule.md) [z](//docs/a.md)\n"),
    ("docs/plain.md", "text\n[b](nope.md)\n"),
]
ENTRIES = [(p, False, p.split("/")[-1], "md") for p, _ in DOCS] + [("docs/sub", True, "sub", None), ("docs/bad_dir", True, "bad_dir", None), ("docs/bad_dir/x_y.md", False, "x_y.md", "md"), ("docs/bad_dir/.gitkeep", False, ".gitkeep", "gitkeep")]

FRONT_MATTER_ERRORS = [
    ("docs/empty-matter.md", "missing"),
    ("docs/crlf.md", "missing"),
    ("docs/plain.md", "missing"),
    ("docs/no-type.md", "missing type"),
    ("docs/no-type.md", "missing description"),
    ("docs/no-type.md", "type "),
    ("docs/odd.md", "type note"),
]
NAMING_ERRORS = [("docs/bad_dir", "directory"), ("docs/bad_dir/x_y.md", "file")]
BROKEN_LINKS = [("docs/a.md", 5, "sub/gone.md"), ("docs/a.md", 7, "../other.md"), ("docs/plain.md", 2, "nope.md"), ("docs/sub/rule.md", 3, "//docs/a.md")]
MISSING_SECTIONS = [("docs/sub/rule.md", "Расположение"), ("docs/sub/rule.md", "Чек-лист для проведения ревью кода")]

_UC = "src/Module/Shop/Application/UseCase"

#: path → (source, [(line, rule, code)]).
SOURCES: dict[str, tuple[str, list[tuple[int, str, str]]]] = {
    "lib/WrongDto.php": (
        """<?php

class WrongDto
{
    use Helps;
    const A = 1, B = 2;
    private ?int $x = null;
    /** $doc */
    public function __construct(public int $id, #[Tag] private string $s = 'a{b}')
    {
        // nothing yet
        $this->x = $id; $y = fn ($q) => $q;
    }

    public function show(): string { return new class { public $inner; public function m() { return "x {$this->inner}"; } }; }
}
""",
        [(3, "DtoStructure", "FinalReadonlyRequired"), (5, "DtoStructure", "ForbiddenMembers"), (6, "DtoStructure", "ForbiddenMembers"), (7, "DtoStructure", "ForbiddenMembers"), (12, "DtoStructure", "ConstructorMustBeEmpty"), (15, "DtoStructure", "ForbiddenMembers")],
    ),
    "lib/BareDto.php": ("<?php\nreadonly final class BareDto {}\n", [(2, "DtoStructure", "ConstructorRequired")]),
    "lib/RightDto.php": ("<?php\nfinal readonly class RightDto\n{\n    public function __construct(\n        public string $id,\n        protected int $n = 0,\n    ) {\n        # empty\n    }\n}\n", []),
    f"{_UC}/Command/Pay/PayCommand.php": (
        "<?php\nnamespace App\\Module\\Shop\\Application\\UseCase\\Command\\Pay;\n\nfinal class PayCommand\n{\n    use T;\n    const C = 1;\n    public $p;\n    function __construct(public readonly int $a) { if ($a) { throw new \\Error(); } }\n    static function make() {}\n}\n",
        [(6, "MessageStructure", "ForbiddenMembers"), (7, "MessageStructure", "ForbiddenMembers"), (8, "MessageStructure", "ForbiddenMembers"), (9, "MessageStructure", "ConstructorMustBeEmpty"), (10, "MessageStructure", "OnlyConstructorAllowed")],
    ),
    f"{_UC}/Query/List/ListQuery.php": ("<?php\nnamespace Module\\Shop\\Application\\UseCase\\Query\\List;\nfinal class ListQuery { }\n", [(3, "MessageStructure", "ConstructorRequired")]),
    f"{_UC}/Command/Pay/PayCommandHandler.php": (
        "<?php\nnamespace Module\\Shop\\Application\\UseCase\\Command\\Pay;\nfinal class PayCommandHandler\n{\n    public $open;\n    private $closed;\n    public function __construct(public A $a, private B $b, readonly C $c) {}\n    private function __invoke(): void {}\n    function other(): void {}\n    protected function helper(): void {}\n}\n",
        [(5, "HandlerStructure", "ForbiddenPublicProperties"), (7, "HandlerStructure", "ForbiddenPublicProperties"), (7, "HandlerStructure", "ForbiddenPublicProperties"), (8, "HandlerStructure", "ForbiddenPublicMethods"), (9, "HandlerStructure", "ForbiddenPublicMethods")],
    ),
    "app/tests/Application/NoInvokeCommandHandler.php": ("<?php\nclass NoInvokeCommandHandler { public function run() {} }\n", [(2, "HandlerStructure", "InvokeRequired"), (2, "HandlerStructure", "ForbiddenPublicMethods")]),
    "lib/Kind.php": (
        "<?php\nenum Kind: string\n{\n    use T;\n    const X = 1;\n    case Upper = 'u';\n    case goodName = 'g';\n    public function label(): string\n    {\n        switch ($this) { case self::goodName: return Other; }\n    }\n}\n",
        [(4, "EnumStructure", "ForbiddenMembers"), (5, "EnumStructure", "ForbiddenMembers"), (6, "EnumStructure", "CaseNameMustBeCamelCase"), (8, "EnumStructure", "ForbiddenMembers")],
    ),
    f"{_UC}/Command/Move/MoveQuery.php": ("<?php\nnamespace Wrong\\Space;\nfinal class MoveQuery { public function __construct() {} }\n", [(3, "UseCaseNaming", "InvalidUseCaseSuffix")]),
    f"{_UC}/Query/Find/Other.php": (
        "<?php\nnamespace Wrong\\Space;\nfinal class SeekQuery { public function __construct() {} }\n",
        [(3, "UseCaseNaming", "UseCaseNameMismatch"), (3, "UseCaseNaming", "FilenameMismatch"), (2, "UseCaseNaming", "NamespaceMismatch")],
    ),
    "lib/calls.php": (
        "<?php\nuse function strlen;\nuse function \\trim ;\nuse function A\\b;\n$a = \\strlen ('x') . \\A\\b() . new \\Date() . $o->x(\\count([]));\n$f = function () use ($a) { return \\is_null($a); };\necho <<<T\n \\strlen(1)\nT;\n",
        [(2, "GlobalCalls", "GlobalFunctionImport"), (3, "GlobalCalls", "GlobalFunctionImport"), (5, "GlobalCalls", "FullyQualifiedGlobalFunctionCall"), (5, "GlobalCalls", "FullyQualifiedGlobalFunctionCall"), (6, "GlobalCalls", "FullyQualifiedGlobalFunctionCall")],
    ),
}
FIXED = {"lib/calls.php": "<?php\n\n\nuse function A\\b;\n$a = strlen ('x') . \\A\\b() . new \\Date() . $o->x(count([]));\n$f = function () use ($a) { return is_null($a); };\necho <<<T\n \\strlen(1)\nT;\n", "lib/RightDto.php": SOURCES["lib/RightDto.php"][0]}
