"""Structure, naming and call-style rules over source files. A rule gives rows (path, line, idx, rule, code, message, fixable).

Rules work on one row per file, its tokens an array (see sources.php.units), by higher-order functions: no token leaves
its row, so there is no shuffle, whatever the number of files. Token rows are taken too; they are grouped by file first.
"""

from __future__ import annotations

import os
import runpy
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.names import below_src, bound, ends, expected_namespace, has, parent_name, slashes, starts, stem
from tessella.sources.php import EMPTY, grouped

#: From the tokens and the path to an array of struct(line, idx, code, message, fixable).
Rule = Callable[[Column, Column], Column]
VIOLATION = "array<struct<line:int,idx:int,code:string,message:string,fixable:boolean>>"
Many = Callable[[Column], Column]


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _at(token: Column, code: str, message: str | Column, fixable: bool = False) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(token["line"].alias("line"), token["idx"].alias("idx"), F.lit(code).alias("code"), text.alias("message"), F.lit(fixable).alias("fixable"))


def _each(tokens: Column, condition: Many, code: str, message: str) -> Column:
    """One violation for every token that meets a condition."""
    return F.transform(F.filter(tokens, condition), lambda t: _at(t, code, message))


def _if(condition: Column, token: Column, code: str, message: str | Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_at(token, code, message))).otherwise(_none())


def _first(tokens: Column, condition: Many) -> Column:
    return F.get(F.filter(tokens, condition), 0)


def _last(tokens: Column, condition: Many) -> Column:
    return F.try_element_at(F.filter(tokens, condition), F.lit(-1))


def _over(owners: Column, tokens: Column, check: Callable[[Column, Column], Column]) -> Column:
    """check(owner, its direct children) for each owner, all in one array."""
    return F.flatten(F.transform(owners, lambda o: bound(F.filter(tokens, lambda t: t["parent_idx"] == o["idx"]), lambda kids: check(o, kids))))


def _classes(tokens: Column, code: str = "T_CLASS") -> Column:
    return F.filter(tokens, lambda t: (t["code"] == code) & t["scope_opener"].isNotNull() & t["scope_closer"].isNotNull())


def _named(tokens: Column, *suffixes: str) -> Column:
    return F.filter(_classes(tokens), lambda t: ends(t["name"], *suffixes))


def _is_method(*names: str) -> Many:
    return lambda t: (t["code"] == "T_FUNCTION") & F.lower(t["name"]).isin(*names)


def _is_other_method(*names: str) -> Many:
    return lambda t: (t["code"] == "T_FUNCTION") & ~F.lower(t["name"]).isin(*names)


def _visibility(t: Column) -> Column:
    return F.when(F.array_contains(t["modifiers"], "private"), "private").when(F.array_contains(t["modifiers"], "protected"), "protected").otherwise("public")


def _inside(t: Column, scope: Column) -> Column:
    return (t["idx"] > scope["scope_opener"]) & (t["idx"] < scope["scope_closer"])


def _body(kids: Column, tokens: Column, message: str) -> Column:
    """The first effective token in the body of the last constructor."""
    return bound(
        _last(kids, _is_method("__construct")),
        lambda c: F.transform(F.slice(F.filter(tokens, lambda t: _inside(t, c) & ~t["code"].isin(*sorted(EMPTY))), 1, 1), lambda t: _at(t, "ConstructorMustBeEmpty", message)),
    )


def _members(kids: Column, *kinds: str) -> list[Column]:
    """A promoted parameter stands in parentheses and is no member variable."""
    of: dict[str, Many] = {"properties": lambda t: (t["code"] == "T_VARIABLE") & ~t["in_parens"], "constants": lambda t: t["code"] == "T_CONST", "traits": lambda t: t["code"] == "T_USE", "methods": lambda t: t["code"] == "T_FUNCTION"}
    return [_each(kids, of[k], "ForbiddenMembers", f"{k} aren't allowed here") for k in kinds]


def dto_structure(tokens: Column, path: Column) -> Column:
    """Classes named *Dto: final and readonly, with nothing but an empty constructor."""

    def check(o: Column, kids: Column) -> Column:
        return F.concat(
            _if(~(F.array_contains(o["modifiers"], "final") & F.array_contains(o["modifiers"], "readonly")), o, "FinalReadonlyRequired", "a DTO is final and readonly"),
            _each(kids, _is_other_method("__construct"), "ForbiddenMembers", "a DTO has no method but its constructor"),
            _if(~F.exists(kids, _is_method("__construct")), o, "ConstructorRequired", "a DTO has a constructor"),
            F.coalesce(_body(kids, tokens, "a DTO's constructor does nothing"), _none()),
            *_members(kids, "properties", "constants", "traits"),
        )

    return _over(_named(tokens, "Dto"), tokens, check)


def message_structure(tokens: Column, path: Column) -> Column:
    """Use-case messages (*Command, *Query in their directories): promoted properties and an empty constructor alone."""

    def check(o: Column, kids: Column) -> Column:
        return F.concat(
            _each(kids, _is_other_method("__construct"), "OnlyConstructorAllowed", "a message has no method but its constructor"),
            _if(~F.exists(kids, _is_method("__construct")), o, "ConstructorRequired", "a message has a constructor"),
            F.coalesce(_body(kids, tokens, "a message's constructor does nothing"), _none()),
            *_members(kids, "properties", "constants", "traits"),
        )

    here = has(slashes(path), "/Application/UseCase/Command/", "/Application/UseCase/Query/", "/tests/Application/")
    return F.when(here, _over(_named(tokens, "Command", "Query"), tokens, check)).otherwise(_none())


def handler_structure(tokens: Column, path: Column) -> Column:
    """Command handlers: nothing public but __invoke, which they must have, and the constructor."""

    def promoted(c: Column) -> Column:
        """The public promoted parameters of a constructor."""
        return F.filter(tokens, lambda t: (t["code"] == "T_VARIABLE") & (t["owner_idx"] == c["idx"]) & F.exists(t["modifiers"], lambda m: m.isin("public", "private", "protected", "readonly")) & (_visibility(t) == "public"))

    def check(o: Column, kids: Column) -> Column:
        # The first constructor in the scope, even one of a class within.
        by_param = bound(_first(tokens, lambda t: _inside(t, o) & _is_method("__construct")(t)), lambda c: F.transform(promoted(c), lambda t: _at(c, "ForbiddenPublicProperties", "a handler's dependency isn't a public promoted property")))
        invoke = bound(_last(kids, _is_method("__invoke")), lambda m: _if(_visibility(m) != "public", m, "ForbiddenPublicMethods", "__invoke is public"))
        return F.concat(
            _each(kids, lambda t: (t["code"] == "T_VARIABLE") & ~t["in_parens"] & (_visibility(t) == "public"), "ForbiddenPublicProperties", "a handler has no public property"),
            F.coalesce(by_param, _none()),
            _if(~F.exists(kids, _is_method("__invoke")), o, "InvokeRequired", "a handler has a public __invoke"),
            F.when(F.exists(kids, _is_method("__invoke")), invoke).otherwise(_none()),
            _each(kids, lambda t: _is_other_method("__construct", "__invoke")(t) & (_visibility(t) == "public"), "ForbiddenPublicMethods", "a handler has no public method but __invoke"),
        )

    here = has(slashes(path), "/Application/UseCase/Command/", "/tests/Application/")
    return F.when(here, _over(_named(tokens, "CommandHandler"), tokens, check)).otherwise(_none())


def enum_structure(tokens: Column, path: Column) -> Column:
    """Enums have cases alone, in camel case. Every case in the scope counts, those of a switch in a method too."""

    def check(o: Column, kids: Column) -> Column:
        cases = F.filter(tokens, lambda t: t["code"].isin("T_CASE", "T_ENUM_CASE") & _inside(t, o))
        names = bound(F.filter(tokens, lambda t: (t["code"] == "T_STRING") & _inside(t, o)), lambda s: F.transform(cases, lambda c: _first(s, lambda t: t["idx"] > c["idx"])))
        return F.concat(*_members(kids, "methods", "constants", "traits"), _each(names, lambda t: t.isNotNull() & ~t["content"].rlike("^[a-z][a-zA-Z0-9]*$"), "CaseNameMustBeCamelCase", "a case is in camel case"))

    return _over(_classes(tokens, "T_ENUM"), tokens, check)


def _namespace(tokens: Column) -> Column:
    """struct(token, name) of the first namespace; name is null where it has none."""

    def spelt(n: Column) -> Column:
        end = _first(tokens, lambda t: (t["idx"] > n["idx"]) & t["code"].isin("T_SEMICOLON", "T_OPEN_CURLY_BRACKET"))
        parts = lambda e: F.filter(tokens, lambda t: (t["idx"] > n["idx"]) & (t["idx"] < e["idx"]) & t["code"].isin("T_STRING", "T_NAME_QUALIFIED", "T_NAME_FULLY_QUALIFIED"))
        return F.struct(n.alias("token"), F.nullif(bound(end, lambda e: F.array_join(F.transform(parts(e), lambda t: t["content"]), "")), F.lit("")).alias("name"))

    return bound(_first(tokens, lambda t: t["code"] == "T_NAMESPACE"), spelt)


def use_case_naming(tokens: Column, path: Column) -> Column:
    """Names of use cases follow their directory, file and namespace. A wrong suffix hides the other errors."""
    plain = slashes(path)
    below = below_src(plain)
    kind = F.when(has(below, "/Application/UseCase/Command/"), "Command").when(has(below, "/Application/UseCase/Query/"), "Query")

    def check(o: Column) -> Column:
        suffix = reduce(lambda acc, s: acc.when(ends(o["name"], s), s), ("Command", "QueryHandler", "Query"), F.when(ends(o["name"], "CommandHandler"), "CommandHandler"))

        def judged(s: Column) -> Column:
            wrong = F.regexp_replace(s, "Handler$", "") != kind
            bare = F.substr(o["name"], F.lit(1), F.length(o["name"]) - F.length(s))
            space = bound(_namespace(tokens), lambda n: _if(n["name"].isNotNull() & ~F.endswith(n["name"], expected_namespace(below)), n["token"], "NamespaceMismatch", "the namespace follows the path"))
            others = F.concat(
                _if(~bare.eqNullSafe(parent_name(plain)), o, "UseCaseNameMismatch", "the class is named after its directory"),
                _if(stem(plain) != o["name"], o, "FilenameMismatch", "the file is named after its class"),
                space,
            )
            return F.when(s.isNull(), _none()).when(wrong, _if(wrong, o, "InvalidUseCaseSuffix", F.concat(F.lit("a class here is a "), kind, F.lit(" or its handler")))).otherwise(others)

        return bound(suffix, judged)

    own = F.filter(tokens, lambda t: (t["code"] == "T_CLASS") & t["name"].isNotNull())
    # Most paths are no use case's, which needs no regular expression to tell.
    return F.when(has(plain, "/Application/UseCase/") & starts(below, "src/Module/") & kind.isNotNull(), F.flatten(F.transform(own, check))).otherwise(_none())


NO_CALL_AFTER = ("T_NEW", "T_FUNCTION", "T_FN", "T_USE", "T_CONST", "T_DOUBLE_COLON", "T_OBJECT_OPERATOR", "T_NULLSAFE_OBJECT_OPERATOR", "T_EXTENDS", "T_IMPLEMENTS", "T_INSTANCEOF", "T_ATTRIBUTE")


def global_calls(tokens: Column, path: Column) -> Column:
    """Global functions are neither imported nor called with a leading backslash. Both can be fixed."""
    bare = lambda text: F.ltrim(text, F.lit("\\"))

    def near(e: Column) -> Column:
        return F.transform(e, lambda t, i: F.struct(t.alias("t"), F.get(e, i - 1)["code"].alias("before"), F.get(e, i + 1).alias("next"), F.get(e, i + 2).alias("second"), F.get(e, i + 3)["content"].alias("third")))

    def imported(n: Column) -> Column:
        name = n["second"]["content"]
        kinds = n["second"]["code"].isin("T_STRING", "T_NAME_FULLY_QUALIFIED", "T_NAME_QUALIFIED")
        return (n["t"]["code"] == "T_USE") & n["t"]["parent_idx"].isNull() & ~n["t"]["in_parens"] & (F.lower(n["next"]["content"]) == "function") & kinds & ~bare(name).contains("\\") & ~n["third"].eqNullSafe("{")

    def called(n: Column) -> Column:
        return (n["t"]["code"] == "T_NAME_FULLY_QUALIFIED") & n["t"]["content"].rlike(r"^\\[A-Za-z_][A-Za-z0-9_]*$") & (n["next"]["code"] == "T_OPEN_PARENTHESIS") & ~F.coalesce(n["before"].isin(*NO_CALL_AFTER), F.lit(False))

    def found(all_: Column) -> Column:
        return F.concat(
            F.transform(F.filter(all_, imported), lambda n: _at(n["t"], "GlobalFunctionImport", F.concat(F.lit("not imported but called: "), bare(n["second"]["content"])), True)),
            F.transform(F.filter(all_, called), lambda n: _at(n["t"], "FullyQualifiedGlobalFunctionCall", F.concat(F.lit("called without a backslash: "), bare(n["t"]["content"])), True)),
        )

    effective = F.filter(tokens, lambda t: ~t["code"].isin(*sorted(EMPTY)))
    return bound(effective, lambda e: bound(F.filter(near(e), lambda n: n["t"]["code"].isin("T_USE", "T_NAME_FULLY_QUALIFIED")), found))


#: Rules by name; others may be added.
RULES: dict[str, Rule] = {"DtoStructure": dto_structure, "MessageStructure": message_structure, "HandlerStructure": handler_structure, "EnumStructure": enum_structure, "UseCaseNaming": use_case_naming, "GlobalCalls": global_calls}


def register_rule(name: str, rule: Rule) -> None:
    if name in RULES:
        raise ValueError(f"there is a rule {name}")
    RULES[name] = rule


def register_directory(folder: str) -> list[str]:
    """Register the rules of every Python file of a directory, in the order of their names: each has a dict RULES. The rules' names."""
    names = []
    for file in sorted(os.listdir(folder)):
        if file.endswith(".py") and not file.startswith("_"):
            for name, rule in runpy.run_path(os.path.join(folder, file)).get("RULES", {}).items():
                register_rule(name, rule)
                names.append(name)
    return names


def violations(source: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """All that the rules find in files (units, or token rows). One place may have several violations."""
    files = grouped(source)
    named = [F.struct(F.lit(name).alias("rule"), rule(F.col("tokens"), F.col("path")).cast(VIOLATION).alias("found")) for name, rule in RULES.items() if rules is None or name in rules]
    each = files.select("path", F.explode(F.array(*named)).alias("r")).select("path", "r.rule", F.explode("r.found").alias("v"))
    return each.select("path", "v.line", "v.idx", "rule", "v.code", "v.message", "v.fixable")


def fixed(source: DataFrame) -> DataFrame:
    """(path, content): sources with imports of global functions blanked, through their semicolon, and calls unprefixed."""
    files = grouped(source)
    found = files.select("path", "tokens", global_calls(F.col("tokens"), F.col("path")).alias("found"))
    of = lambda code: F.transform(F.filter("found", lambda v: v["code"] == code), lambda v: v["idx"])
    until = lambda i: F.coalesce(_first(F.col("tokens"), lambda t: (t["idx"] > i) & (t["code"] == "T_SEMICOLON"))["idx"], i)
    cut = found.select("path", "tokens", of("FullyQualifiedGlobalFunctionCall").alias("calls"), F.transform(of("GlobalFunctionImport"), lambda i: F.struct(i.alias("a"), until(i).alias("b"))).alias("cuts"))
    whole = F.transform("tokens", lambda t: t["content"])
    text = F.transform("tokens", lambda t: F.when(F.exists("cuts", lambda c: (t["idx"] >= c["a"]) & (t["idx"] <= c["b"])), "").when(F.array_contains("calls", t["idx"]), F.ltrim(t["content"], F.lit("\\"))).otherwise(t["content"]))
    clean = (F.size("cuts") == 0) & (F.size("calls") == 0)
    return cut.select("path", F.array_join(F.when(clean, whole).otherwise(text), "").alias("content"))
