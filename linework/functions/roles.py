"""Column builders for roles, rules, styles and layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.schema import INNER, OUTER, UNKNOWN

SLUG_CHARS = 64
#: Difference of marks, as a share of the whole pattern, beyond which a dashed line is a chain line.
MARK_DIFFERENCE = 0.05
# Colour index by role (consumer: roles that only callers know), colours of the indices, layers by role.
PALETTE = {OUTER: 3, INNER: 2, "trash": 1, "annotation": 7, "consumer": 8}
INDEX_HEX = {1: "#ff0000", 2: "#ffff00", 3: "#00ff00", 4: "#00ffff", 5: "#0000ff", 6: "#ff00ff", 7: "#ffffff", 8: "#808080", 9: "#c0c0c0", 11: "#ff7f7f"}
LAYERS = {OUTER: "OuterContour", INNER: "InnerContour", "annotation": "Annotation", "trash": "Trash"}
COLOR_NAMES = {"red": 1, "yellow": 2, "green": 3, "cyan": 4, "blue": 5, "magenta": 6, "white": 7, "byblock": 0, "bylayer": 256}


def normalize_role(value: Column) -> Column:
    """Slug of a role: lower case, other signs than a-z, 0-9, _ and - become _, at most 64; empty and null are unknown."""
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_-]+", "_"), F.lit("_-")), 1, SLUG_CHARS)
    return F.when(slug.isNull() | (slug == ""), UNKNOWN).otherwise(slug)


def is_structural(role: Column, more: tuple[str, ...] = ()) -> Column:
    return role.isin(OUTER, INNER, *more)


def feature_role(contour_role: Column, item_role: Column) -> Column:
    """The contour's role if a caller gave it one, else the item's."""
    return F.when(contour_role.isNotNull() & ~contour_role.isin(UNKNOWN, OUTER, INNER), contour_role).otherwise(item_role)


@dataclass(frozen=True)
class RoleRule:
    """All conditions that are given must hold; at least one must be given."""

    role: str
    name: str | None = None
    name_contains: str | None = None
    dashed: bool | None = None
    dash: str | None = None
    color: int | str | None = None

    def __post_init__(self):
        if all(v is None for v in (self.name, self.name_contains, self.dashed, self.dash, self.color)):
            raise ValueError("a rule needs a condition")

    def matches(self, name: Column, pattern: Column, color: Column) -> Column:
        low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit(True)
        if self.name is not None:
            out = out & (low == self.name.lower())
        if self.name_contains is not None:
            out = out & F.contains(low, F.lit(self.name_contains.lower()))
        if self.dashed is not None:
            out = out & (is_dashed(pattern) == self.dashed)
        if self.dash is not None:
            out = out & (dash_kind(pattern) == self.dash)
        if self.color is not None:
            out = out & (color == color_index(self.color))
        return F.coalesce(out, F.lit(False))


def resolve_role(rules: list[RoleRule], name: Column, pattern: Column, color: Column) -> Column:
    """Role of the first rule that matches, else unknown."""
    return F.coalesce(*[F.when(r.matches(name, pattern, color), normalize_role(F.lit(r.role))) for r in rules], F.lit(UNKNOWN))


def name_rules(mapping: dict[str, str]) -> list[RoleRule]:
    return [RoleRule(role, name=name) for name, role in mapping.items()]


def color_index(value: int | str) -> int:
    """Index of a colour by number or name; others are an error."""
    if isinstance(value, int):
        return value
    if str(value).isdigit():
        return int(value)
    if str(value).lower() not in COLOR_NAMES:
        raise ValueError(f"unknown colour {value!r}")
    return COLOR_NAMES[str(value).lower()]


def is_dashed(pattern: Column) -> Column:
    """A pattern has a gap, which is a negative element after the first."""
    return F.coalesce(F.exists(F.slice(pattern, 2, F.greatest(F.size(pattern) - 1, F.lit(0))), lambda x: x < 0), F.lit(False))


def dash_kind(pattern: Column) -> Column:
    """continuous, uniform or chain: chain lines have marks that differ."""
    marks = F.filter(pattern, lambda x: x >= 0)
    total = F.aggregate(pattern, F.lit(0.0), lambda a, x: a + F.abs(x))
    chain = F.array_max(marks) - F.array_min(marks) > MARK_DIFFERENCE * total
    return F.when(~is_dashed(pattern), "continuous").when(chain, "chain").otherwise("uniform")


@dataclass(frozen=True)
class RoleStyle:
    """How a role is drawn; None leaves the default. color is red, green and blue, 0 to 255 each."""

    color: tuple[int, int, int] | None = None
    linetype: str | None = None
    lineweight: float | None = None
    layer_name: str | None = None


_registered: dict[str, RoleStyle] = {}


def register_role_style(role: str, style: RoleStyle) -> None:
    """From now on the driver's plans draw the role in this style; one that is given with a call wins."""
    _registered[role] = style


def forget_role_style(role: str) -> None:
    _registered.pop(role, None)


def registered_role_styles() -> dict[str, RoleStyle]:
    return dict(_registered)


def _styles(styles: dict[str, RoleStyle] | None) -> dict[str, RoleStyle]:
    return _registered | (styles or {})


def _lookup(role: Column, values: dict[str, object], default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def _own_or_consumer(role: Column, own: dict[str, int], unknown: str) -> Column:
    known = _lookup(role, own, F.lit(PALETTE["consumer"]))
    return F.when(role.isNull() | (role == "") | (role == unknown), PALETTE["trash"]).otherwise(known)


def role_color(role: Column) -> Column:
    """Colour index: the engine's for its roles, that of consumers for callers' roles, that of trash for unknown."""
    return _own_or_consumer(role, {k: PALETTE[k] for k in (OUTER, INNER)}, UNKNOWN)


def role_hex(role: Column, styles: dict[str, RoleStyle] | None = None, fallback: str = "#ff0000") -> Column:
    """Colour of a style if the role has one, else that of its index."""
    own = {k: "#" + bytes(s.color).hex() for k, s in _styles(styles).items() if s.color is not None}
    return _lookup(role, own, F.coalesce(_lookup(role_color(role), INDEX_HEX, F.lit(None).cast("string")), F.lit(fallback)))


def role_layer(role: Column, styles: dict[str, RoleStyle] | None = None) -> Column:
    """Layer of a role: the engine's, a style's name, else the slug itself; unknown goes to trash."""
    own = {k: s.layer_name for k, s in _styles(styles).items() if s.layer_name}
    slug = normalize_role(role)
    return _lookup(role, own | {k: LAYERS[k] for k in (OUTER, INNER)}, F.when(slug == UNKNOWN, LAYERS["trash"]).otherwise(slug))


def layer_color(layer: Column) -> Column:
    """Colour index of a layer: the engine's, that of consumers for others, that of trash without a name."""
    return _own_or_consumer(layer, {v: PALETTE[k] for k, v in LAYERS.items()}, LAYERS["trash"])
