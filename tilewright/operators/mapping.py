"""Declarative rules that filter features and rewrite their properties, compiled to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.types import GEOM_DDL, LINE_TYPE, POLYGON_TYPE, PROPS_DDL, empty_props, prop, prop_of


@dataclass(frozen=True)
class Rule:
    """A feature matches if it has ``key`` and, unless ``values`` is empty, its value is one of these strings."""

    key: str
    values: tuple[str, ...] = ()
    static: dict[str, object] = field(default_factory=dict)
    #: Output key to (source key, type or None).
    copied: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    #: Output key to source key; an empty string where the source is missing.
    copied_or_empty: dict[str, str] = field(default_factory=dict)
    op: str | None = None


def parse_rules(text: str) -> list[Rule]:
    """Rules of a YAML (or JSON) mapping; unknown keys, types and kinds of value are errors."""
    import yaml

    rules = []
    for m in yaml.safe_load(text) or []:
        _known(m, {"src", "dest", "op"})
        _known(m["src"], {"key", "value"})
        value = m["src"].get("value")
        if isinstance(value, list):
            if not all(isinstance(v, str) for v in value):
                raise ValueError(f"values of source key {m['src']['key']} must be strings")
            values = tuple(value)
        elif isinstance(value, str):
            values = () if value == "*" else (value,)
        else:
            raise ValueError(f"value of source key {m['src']['key']} must be a string or a list of strings")
        static: dict[str, object] = {}
        copied: dict[str, tuple[str, str | None]] = {}
        for out in m.get("dest") or []:
            _known(out, {"key", "value", "type"})
            kind = out.get("type")
            if kind not in (None, "", "int", "string"):
                raise ValueError(f"unknown type {kind}")
            v = out.get("value")
            if isinstance(v, str) and v.startswith("$"):
                copied[out["key"]] = (v[1:], kind or None)
            else:
                static[out["key"]] = v
        rules.append(Rule(m["src"]["key"], values, static, copied, {}, m.get("op")))
    return rules


def _known(m: dict, keys: set[str]) -> None:
    if not isinstance(m, dict) or set(m) - keys:
        raise ValueError(f"expected only {sorted(keys)} in {m}")


def matches(props: Column, rule: Rule) -> Column:
    has = F.coalesce(F.map_contains_key(props, rule.key), F.lit(False))
    if not rule.values:
        return has
    p = props[rule.key]
    return has & F.coalesce((p["t"] == "string") & p["s"].isin(list(rule.values)), F.lit(False))


def to_int(p: Column) -> Column:
    """A property cast to int: decimal text, yes and no; others and failures stay as they are."""
    number = F.when(p["s"] == "yes", F.lit(1)).when(p["s"] == "no", F.lit(0)).when(p["s"].rlike(r"\A[+-]?[0-9]+\z"), p["s"].try_cast("bigint"))
    number = F.when(p["t"] == "string", number)
    return F.when(number.isNotNull(), prop("int", number)).otherwise(p)


def mapped(props: Column, rule: Rule) -> Column:
    """New properties: static ones and copies; a copy of a missing key is left out."""
    out = [(k, prop_of(v)) for k, v in rule.static.items()]
    for k, (source, kind) in rule.copied.items():
        value = to_int(props[source]) if kind == "int" else props[source]
        out.append((k, F.when(F.map_contains_key(props, source), value)))
    for k, source in rule.copied_or_empty.items():
        out.append((k, F.when(F.map_contains_key(props, source), props[source]).otherwise(prop("string", ""))))
    if not out:
        return empty_props()
    made = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in out]), F.array(*[v for _, v in out]))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def apply_rules(features: DataFrame, rules: list[Rule], geometry: str | None = "geom") -> DataFrame:
    """Each feature once per matching rule, in rule order, with the mapped properties; no match drops it, no rules pass all.

    One pass: the rules become an array of structs that is filtered and exploded.
    ``op: lines`` turns a polygon into its rings as lines and drops other types.
    Features with null properties match nothing.
    """
    if not rules:
        return features
    props = F.col("props")
    each = [
        F.when(matches(props, r), F.struct(F.lit(i).alias("rule"), mapped(props, r).cast(PROPS_DDL).alias("props"), F.lit(r.op == "lines").alias("lines")))
        for i, r in enumerate(rules)
    ]
    out = features.withColumn("_m", F.explode(F.array_compact(F.array(*each))))
    out = out.withColumn("props", F.col("_m.props")).withColumn("_lines", F.col("_m.lines")).drop("_m")
    if geometry and any(r.op == "lines" for r in rules):
        g = F.col(geometry)
        rings = F.when(g["typ"] == POLYGON_TYPE, F.transform(g["rings"], lambda ring: F.struct(F.lit(LINE_TYPE).alias("typ"), F.array(ring).alias("rings")).cast(GEOM_DDL)))
        parts = F.when(F.col("_lines"), F.coalesce(rings, F.array().cast(f"array<{GEOM_DDL}>"))).otherwise(F.array(g))
        out = out.withColumn(geometry, F.explode(parts))
    return out.drop("_lines")


def _default() -> list[Rule]:
    # Keys and values of the default rules, in order.
    aeroway = ["aerodrome", "apron", "heliport", "runway", "helipad", "taxiway"]
    highway = ["motorway", "primary", "trunk", "secondary", "tertiary"]
    one = lambda key, value, layer, source: Rule(key, (value,), {"@layer": layer}, {}, {"class": source})
    return [
        *[one("aeroway", v, "aeroway", "aeroway") for v in aeroway],
        *[one("highway", v, "transportation", "highway") for v in highway],
        Rule("building", ("",), {"@layer": "building", "@zoom:min": 14}),
        Rule("landuse", ("forest",), {"__type": "area", "@layer": "landcover", "class": "wood"}),
        one("railway", "rail", "transportation", "highway"),
        one("waterway", "river", "waterway", "waterway"),
    ]


DEFAULT = _default()
