"""A user's own features: formulas with parameters over prices, catalogue features and each other.

A formula is SQL text with ``{parameter}`` in it, or a function of the parameters that gives SQL (for the helpers of ``dialect``).
Settings replace a parameter's default and are held within its bounds. Features become levels of column expressions: each
stands above all that it names, and what nothing requested rests on is not planned. Errors are raised before any plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from string import Formatter

from .dialect import BY_SYMBOL
from .features import BLOCK_OF, BLOCKS, INTERACTION_INPUTS, NAMES, NEEDS_VOL

Number = int | float
PRICES = ("symbol", "ts", "open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Parameter:
    """A number with a default and bounds; a setting outside them is moved to the nearer one."""

    name: str
    default: Number
    low: Number | None = None
    high: Number | None = None

    def value(self, settings: Mapping[str, Number]) -> Number:
        x = settings.get(self.name, self.default)
        x = x if self.low is None else max(x, self.low)
        return x if self.high is None else min(x, self.high)


@dataclass(frozen=True)
class Feature:
    """``shift``: how many bars of its symbol the value is held back."""

    name: str
    block: str
    formula: str | Callable[..., str]
    parameters: tuple[Parameter, ...] = ()
    shift: int = 0
    description: str = ""

    def values(self, settings: Mapping[str, Number]) -> dict[str, Number]:
        return {p.name: p.value(settings) for p in self.parameters}

    def sql(self, settings: Mapping[str, Number]) -> str:
        values = self.values(settings)
        return self.formula(**values) if callable(self.formula) else self.formula.format(**values)


def names_in(sql: str) -> set[str]:
    """The identifiers of an expression, without those inside string literals."""
    return set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", sql)))


def with_inputs(names: Iterable[str]) -> list[str]:
    """Catalogue features and those that they cannot be requested without."""
    found, left = set(), list(names)
    while left:
        name = left.pop()
        if name not in found:
            found.add(name)
            left += [*INTERACTION_INPUTS.get(name, ()), *(["realized_vol_1h"] if name in NEEDS_VOL else ())]
    return sorted(found)


@dataclass
class Registry:
    features: dict[str, Feature] = field(default_factory=dict)

    def register(self, *features: Feature) -> Registry:
        """Adds features; names must be new, be plain identifiers and not begin with ``__``, and templates may only use their own parameters."""
        for f in features:
            if not re.fullmatch(r"(?!__)[A-Za-z_]\w*", f.name):
                raise ValueError(f"not a feature name: {f.name!r}")
            if f.name in self.features or f.name in BLOCK_OF or f.name in PRICES:
                raise ValueError(f"{f.name} is taken")
            if f.block in BLOCKS:
                raise ValueError(f"{f.block} is a block of the catalogue")
            own = [p.name for p in f.parameters]
            used = set() if callable(f.formula) else {x for _, x, _, _ in Formatter().parse(f.formula) if x is not None}
            if len(set(own)) < len(own) or used - set(own):
                raise ValueError(f"{f.name}: parameters {', '.join(sorted(used - set(own))) or 'named twice'}")
            if f.shift < 0:
                raise ValueError(f"{f.name} would look ahead")
            self.features[f.name] = f
        return self

    def plan(self, names: Iterable[str], settings: Mapping[str, Number] = {}) -> tuple[list[dict[str, str]], list[str]]:
        """(levels of expressions for the registered among names and what they rest on, catalogue features that all of this needs)."""
        names = set(names)
        if bad := names - set(self.features) - set(NAMES):
            raise ValueError(f"unknown features: {', '.join(sorted(bad))}")
        known = {p.name for f in self.features.values() for p in f.parameters}
        if bad := set(settings) - known:
            raise ValueError(f"unknown parameters: {', '.join(sorted(bad))}")
        own: dict[str, str] = {}
        left = [n for n in names if n in self.features]
        while left:
            name = left.pop()
            if name not in own:
                own[name] = self.features[name].sql(settings)
                left += names_in(own[name]) & set(self.features)
        rests = {n: names_in(sql) & set(own) for n, sql in own.items()}
        out: list[dict[str, str]] = []
        while rests:
            ready = sorted(n for n, on in rests.items() if not on & set(rests))
            if not ready:
                raise ValueError(f"features rest on each other: {', '.join(sorted(rests))}")
            held = {n: self.features[n].shift for n in ready if self.features[n].shift}
            out.append({f"__{n}" if n in held else n: own[n] for n in ready})
            if held:
                out.append({n: f"lag(__{n}, {k}) OVER ({BY_SYMBOL})" for n, k in held.items()})
            rests = {n: on for n, on in rests.items() if n not in ready}
        words = names.union(*(names_in(sql) for sql in own.values()))
        return out, with_inputs(words & set(NAMES))

    def lineage(self, names: Iterable[str] | None = None, settings: Mapping[str, Number] = {}) -> list[dict]:
        """What each registered feature is, by name: template, formula with its parameters, their values, inputs and shift."""
        out = []
        for name in sorted(self.features if names is None else names):
            f, sql = self.features[name], self.features[name].sql(settings)
            words = names_in(sql)
            out.append(
                {
                    "name": name,
                    "block": f.block,
                    "description": f.description,
                    "template": None if callable(f.formula) else f.formula,
                    "formula": sql,
                    "parameters": f.values(settings),
                    "inputs": sorted(words & set(PRICES[2:])),
                    "features": sorted(words & {*NAMES, *self.features}),
                    "shift": f.shift,
                }
            )
        return out
