"""Rules over dependency edges: one projection each, without a shuffle.

The two class names of an edge are matched once, in a generator, below which the optimizer moves no condition; the rules
over their parts are then plain comparisons of columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.names import bound, class_parts, ends, is_true, of_parts, starts
from tessella.plans.layers import CATALOG, ROOT, RULESET, SERVICE_LAYERS, closure

Parts = Mapping[str, Column]
PartsRule = Callable[[Parts, Parts, Column], Column]
EdgeRule = Callable[[Column, Column, Column], Column]


def cross_module(depender: Column, dependent: Column, dep_type: Column) -> Column:
    """Whether an edge leaves its module where it mustn't. Shared data types, entities of entities, command handlers' use of
    foreign repositories and entities, and integration of foreign applications are allowed."""
    return _of_names(_cross_module, depender, dependent, dep_type)


def _of_names(rule: PartsRule, depender: Column, dependent: Column, dep_type: Column) -> Column:
    both = F.struct(class_parts(depender).alias("a"), class_parts(dependent).alias("b"))
    return bound(both, lambda e: rule(of_parts(e["a"]), of_parts(e["b"]), dep_type))


def _cross_module(a: Parts, b: Parts, dep_type: Column) -> Column:
    layers = lambda x, y: (a["layer"] == x) & (b["layer"] == y)
    allowed = (
        starts(b["path"], "ValueObject\\", "Enum\\")
        | ends(b["path"], "Dto")
        | (layers("Domain", "Domain") & starts(a["path"], "Entity\\") & starts(b["path"], "Entity\\"))
        | (layers("Application", "Domain") & starts(a["path"], "UseCase\\Command\\") & starts(b["path"], "Repository\\", "Entity\\"))
        | layers("Integration", "Application")
    )
    return is_true(~dep_type.eqNullSafe("USE") & a["inside"] & b["inside"] & (a["module"] != b["module"]) & ~is_true(allowed))


def service_contract(depender: Column, dependent: Column, dep_type: Column) -> Column:
    """Whether an edge to a service breaks its contract: from outside the modules, from another module, or to an interface
    of a layer that the depending layer may not use (or, for INHERIT, implement)."""
    return _of_names(_service_contract, depender, dependent, dep_type)


def _service_contract(a: Parts, b: Parts, dep_type: Column) -> Column:
    allowed = reduce(lambda x, y: x | y, [(a["layer"] == layer) & b["layer"].isin(targets) for layer, targets in SERVICE_LAYERS.items()])
    interface = ends(b["path"], "Interface")
    broken = ~a["inside"] | is_true(a["module"] != b["module"]) | (interface & ~is_true(allowed))
    return is_true(~dep_type.eqNullSafe("USE") & starts(b["path"], "Service\\") & broken)


def with_parts(edges: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """edges with the parts of depender and dependent, as columns that are computed once whatever is asked of them."""
    both = F.struct(class_parts(F.col("depender")).alias(a), class_parts(F.col("dependent")).alias(b))
    return edges.select("*", F.inline(F.array(both)))


def violating(edges: DataFrame, rule: str) -> DataFrame:
    """The edges that break a rule, by its name."""
    broken, _ = EDGE_RULES[rule]
    if broken not in PARTS_RULES:
        return edges.filter(broken(F.col("depender"), F.col("dependent"), F.col("dep_type")))
    return with_parts(edges).filter(PARTS_RULES[broken](of_parts(F.col("_a")), of_parts(F.col("_b")), F.col("dep_type"))).select(*edges.columns)


def _matches(name: Column, pattern: str) -> Column:
    """name.rlike(pattern), after a cheap test for the layer's directory that the pattern begins with."""
    fixed = re.match(re.escape(ROOT) + r"Common\\\\Module\\\\\.\*\\\\(\w+)\\\\", pattern)
    return name.contains(f"\\{fixed[1]}\\") & name.rlike(pattern) if fixed else name.rlike(pattern)


def layers_of(name: Column) -> Column:
    """array of the layers that a class is in, by name."""
    # What mustn't match is one pattern: planning time grows with the number of expressions.
    none_of = lambda patterns: [~name.rlike("|".join(f"(?:{p})" for p in patterns))] if patterns else []
    of = [F.when(reduce(lambda x, y: x & y, [_matches(name, p) for p in must] + none_of(must_not)), F.lit(layer)) for layer, (must, must_not) in sorted(CATALOG.items())]
    return F.filter(F.array(*of), lambda x: x.isNotNull())  # some hundred patterns are too much for generated code


def classified(names: DataFrame) -> DataFrame:
    """(name, layer) of each distinct name and each layer that it is in."""
    # An outer explode: from an inner one a filter on the layers is inferred, and moved to before the names are distinct.
    every = names.select("name").distinct().select("name", F.explode_outer(layers_of(F.col("name"))).alias("layer"))
    return every.filter(F.col("layer").isNotNull())


def allowed_layers(spark, ruleset: dict[str, list[str]] = RULESET) -> DataFrame:
    """(layer, target): the ruleset with +X expanded. A ruleset is a configuration; its closure is made from constants."""
    return spark.createDataFrame(sorted(closure(ruleset)), "layer string, target string")


def ruleset_violations(edges: DataFrame, ruleset: dict[str, list[str]] = RULESET) -> DataFrame:
    """edges with depender_layer_name and dependent_layer_name, for each pair of layers that the ruleset doesn't allow.

    A class in several layers is judged in each, one in no layer in none; a class may depend on itself. Names are classified
    once each, not once an edge. The closure has at most the square of the catalog's layers as rows, which bounds what is
    broadcast."""
    own = edges.filter("depender <> dependent")
    names = classified(own.select(F.col("depender").alias("name")).union(own.select("dependent")))
    of = lambda column, layer: names.select(F.col("name").alias(column), F.col("layer").alias(layer))
    pairs = own.join(of("depender", "depender_layer_name"), "depender").join(of("dependent", "dependent_layer_name"), "dependent")
    allowed = allowed_layers(edges.sparkSession, ruleset).select(F.col("layer").alias("depender_layer_name"), F.col("target").alias("dependent_layer_name"))
    left = pairs.join(F.broadcast(allowed), ["depender_layer_name", "dependent_layer_name"], "left_anti")
    return left.select(*edges.columns, "depender_layer_name", "dependent_layer_name")


#: Rules by name: a condition, and the layer that a violation names where the edge has none.
EDGE_RULES: dict[str, tuple[EdgeRule, Callable[[Column], Column]]] = {
    "CrossModule": (cross_module, lambda dependent: F.lit("Unknown")),
    "ServiceContract": (service_contract, lambda dependent: bound(class_parts(dependent), lambda x: of_parts(x)["layer"])),
}
#: What rules say over the parts of the names.
PARTS_RULES: dict[EdgeRule, PartsRule] = {cross_module: _cross_module, service_contract: _service_contract}
#: The layer of a violation over the parts of the dependent's name.
PARTS_FALLBACK: dict[EdgeRule, Callable[[Parts], Column]] = {cross_module: lambda b: F.lit("Unknown"), service_contract: lambda b: b["layer"]}


def register_edge_rule(name: str, rule: EdgeRule, fallback: Callable[[Column], Column]) -> None:
    if name in EDGE_RULES:
        raise ValueError(f"there is a rule {name}")
    EDGE_RULES[name] = rule, fallback


def edge_violations(edges: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Every column of edges, rule and layer, one row for each rule that an edge breaks. Edges are read once: the rules
    broken are gathered in an array and exploded."""
    triple = [F.col(c) for c in ("depender", "dependent", "dep_type")]
    first = F.try_element_at(F.col("dependent_layers"), F.lit(1)) if "dependent_layers" in edges.columns else F.lit(None).cast("string")
    a, b = of_parts(F.col("_a")), of_parts(F.col("_b"))
    chosen = {name: x for name, x in EDGE_RULES.items() if rules is None or name in rules}
    broken = []
    for name, (rule, fallback) in chosen.items():
        plain = rule not in PARTS_RULES
        condition = rule(*triple) if plain else PARTS_RULES[rule](a, b, triple[2])
        layer = fallback(triple[1]) if plain else PARTS_FALLBACK[rule](b)
        broken.append(F.when(condition, F.struct(F.lit(name).alias("rule"), F.coalesce(first, layer).alias("layer"))))
    found = with_parts(edges).withColumn("_v", F.explode(F.array(*broken)))
    return found.filter("_v IS NOT NULL").select(*edges.columns, "_v.rule", "_v.layer")
