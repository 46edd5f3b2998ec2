"""Layers of a modular code base, and which may depend on which."""

from __future__ import annotations

ROOT = r"^(?:[A-Za-z_]+\\)?"
ANY = r".*"


def _in(layer: str, tail: str) -> str:
    return ROOT + r"Common\\Module\\" + ANY + r"\\" + layer + r"\\" + tail


def _use_case(kind: str, suffix: str) -> str:
    return _in("Application", rf"UseCase\\{kind}\\{ANY}\\{ANY}{suffix}$")


_DTO = ANY + "Dto$"
_ENUM = r"Enum\\" + ANY
_VO = r"(Entity\\)?ValueObject\\" + ANY + "Vo$"
_CQRS = {f"Application{kind}{tail}": _use_case(kind, kind + tail) for kind in ("Command", "Query") for tail in ("", "Handler")}

#: Layer → (patterns that must all match, patterns of which none may).
CATALOG: dict[str, tuple[list[str], list[str]]] = {
    "Domain": ([_in("Domain", ANY)], [_in("Domain", x) for x in (_VO, _ENUM, _DTO)]),
    "Application": ([_in("Application", ANY)], [_in("Application", _DTO), _in("Application", _ENUM), *_CQRS.values()]),
    "Infrastructure": ([_in("Infrastructure", rf"(?!Model|Listener){ANY}$")], [_in("Infrastructure", x) for x in (_DTO, r"Component\\" + ANY, _ENUM)]),
    "Integration": ([_in("Integration", ANY)], [_in("Integration", r"Listener\\" + ANY), _in("Integration", _DTO), _in("Domain", r"Service\\Integration\\" + ANY)]),
    "IntegrationListener": ([_in("Integration", r"Listener\\" + ANY)], []),
    "InfrastructureComponent": ([_in("Infrastructure", rf"Component\\{ANY}(Component|ComponentInterface)$")], []),
    "Presentation": ([ROOT + rf"(?:Api|Console|Web|Blog|Docs)\\Module\\{ANY}"], []),
    "ApplicationCommonDto": ([ROOT + rf"Common\\Application\\Dto\\{_DTO}"], []),
    "DomainVo": ([_in("Domain", _VO)], []),
    **{f"{layer}Enum": ([_in(layer, _ENUM)], []) for layer in ("Domain", "Application", "Infrastructure")},
    **{f"{layer}Dto": ([_in(layer, _DTO)], []) for layer in ("Domain", "Application", "Infrastructure", "Integration")},
    **{name: ([pattern], []) for name, pattern in _CQRS.items()},
}

_DOMAIN = "Domain DomainDto DomainEnum DomainVo"
_DTOS = "ApplicationDto ApplicationCommonDto ApplicationEnum"
_HANDLERS = "ApplicationCommandHandler ApplicationQueryHandler"
_MESSAGES = "+ApplicationCommand +ApplicationQuery"

#: Layer → layers it may depend on; +X stands for X and all that X may depend on.
RULESET: dict[str, list[str]] = {
    layer: targets.split()
    for layer, targets in {
        "Domain": _DOMAIN,
        "DomainDto": _DOMAIN,
        "DomainVo": "Domain DomainEnum DomainVo",
        "DomainEnum": "DomainEnum",
        "Application": "Application +ApplicationCommandHandler +ApplicationQueryHandler",
        "ApplicationDto": _DTOS,
        "ApplicationCommonDto": "ApplicationCommonDto",
        "ApplicationCommand": f"Application {_DTOS}",
        "ApplicationQuery": f"Application {_DTOS}",
        "ApplicationCommandHandler": f"Application +ApplicationCommand {_DOMAIN}",
        "ApplicationQueryHandler": f"Application +ApplicationQuery {_DOMAIN}",
        "Presentation": f"Application {_MESSAGES} {_HANDLERS}",
        "Integration": f"Integration IntegrationDto Application ApplicationCommand ApplicationQuery {_HANDLERS} {_DTOS} {_DOMAIN}",
        "IntegrationDto": "Integration IntegrationDto",
        "IntegrationListener": f"IntegrationListener Integration IntegrationDto Application {_MESSAGES} {_HANDLERS}",
        "Infrastructure": f"Infrastructure InfrastructureComponent InfrastructureDto InfrastructureEnum {_DOMAIN}",
        "InfrastructureDto": f"{_DOMAIN} Infrastructure InfrastructureComponent InfrastructureDto",
        "InfrastructureEnum": "InfrastructureEnum",
        "InfrastructureComponent": "InfrastructureComponent InfrastructureDto",
    }.items()
}

#: Layer of a class → layers of service interfaces that it may use or implement.
SERVICE_LAYERS = {"Domain": ["Domain"], **{x: ["Domain", x] for x in ("Application", "Infrastructure", "Integration")}}


def closure(ruleset: dict[str, list[str]]) -> set[tuple[str, str]]:
    """(layer, target) with every +X replaced by X and all that X may depend on; layers may expand each other in a cycle."""
    out = {(layer, t.lstrip("+")) for layer, targets in ruleset.items() for t in targets}
    expands = {(layer, t[1:]) for layer, targets in ruleset.items() for t in targets if t.startswith("+")}
    while True:
        deeper = {(layer, far) for layer, near in expands for at, far in expands if at == near} - expands
        if not deeper:
            return out | {(layer, target) for layer, near in expands for at, target in out if at == near}
        expands |= deeper


def merged(base: dict, override: dict) -> dict:
    """A configuration with an importing one laid over it: maps are merged, lists joined, other values replaced."""
    out = dict(base)
    for key, value in override.items():
        there = out.get(key)
        if isinstance(there, dict) and isinstance(value, dict):
            out[key] = merged(there, value)
        elif isinstance(there, list) and isinstance(value, list):
            out[key] = there + [x for x in value if x not in there]
        else:
            out[key] = value
    return out
