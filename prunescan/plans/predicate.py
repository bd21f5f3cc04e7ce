"""Predicates: a small tree with JSON and text forms that compiles to Spark columns.

JSON has one key a node: ``{"Comparison": {"column", "op", "value"}}``, ``{"And": [l, r]}``, ``{"Or": [l, r]}``, ``{"Not": e}``,
``{"In": {"column", "values"}}``, ``{"Between": {"column", "low", "high"}}``, ``{"IsNull": {"column"}}``. Values are ``"Null"`` or
one of ``{"Bool"|"Int64"|"Float64"|"Utf8"|"Bytes": v}``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

#: Comparison operators by name, with their text.
OPS = {"Eq": "=", "Ne": "!=", "Lt": "<", "Gt": ">", "Le": "<=", "Ge": ">="}
KINDS = ("Null", "Bool", "Int64", "Float64", "Utf8", "Bytes")


@dataclass(frozen=True)
class Value:
    """A typed literal."""

    kind: str
    value: object = None

    def __str__(self) -> str:
        match self.kind:
            case "Null":
                return "NULL"
            case "Bool":
                return str(self.value).lower()
            case "Utf8":
                return f"'{self.value}'"
            case "Bytes":
                return "0x" + bytes(self.value).hex()
            case _:
                return str(self.value)

    def sql(self) -> str:
        """Text that Spark's and other SQL parsers read back, quotes escaped."""
        if self.kind == "Utf8":
            return "'" + str(self.value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"X'{bytes(self.value).hex()}'" if self.kind == "Bytes" else str(self)

    def encode(self) -> object:
        return "Null" if self.kind == "Null" else {self.kind: list(self.value) if self.kind == "Bytes" else self.value}

    def column(self, kind: T.DataType | None = None) -> Column:
        """A literal; an Int64 against a timestamp or date column counts raw units since the epoch."""
        if self.kind == "Null":
            return F.lit(None)
        if self.kind == "Bytes":
            return F.lit(bytearray(self.value))
        if self.kind == "Int64" and isinstance(kind, T.TimestampType):
            return F.timestamp_micros(F.lit(self.value))
        if self.kind == "Int64" and isinstance(kind, T.TimestampNTZType):
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.lit(self.value).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
        if self.kind == "Int64" and isinstance(kind, T.DateType):
            return F.date_from_unix_date(F.lit(self.value).cast("int"))
        return F.lit(self.value)


def value(x: object) -> Value:
    """A literal from a Python value."""
    match x:
        case Value():
            return x
        case None:
            return Value("Null")
        case bool():
            return Value("Bool", x)
        case int():
            return Value("Int64", x)
        case float():
            return Value("Float64", x)
        case str():
            return Value("Utf8", x)
        case bytes() | bytearray():
            return Value("Bytes", bytes(x))
    raise TypeError(f"no literal for {type(x).__name__}")


@dataclass(frozen=True)
class Predicate:
    """A node: ``kind`` with its operands (columns, values or predicates)."""

    kind: str
    column: str | None = None
    op: str | None = None
    values: tuple[Value, ...] = ()
    parts: tuple["Predicate", ...] = ()

    def __and__(self, other: "Predicate") -> "Predicate":
        return Predicate("And", parts=(self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Predicate("Or", parts=(self, other))

    def __invert__(self) -> "Predicate":
        return Predicate("Not", parts=(self,))

    def __str__(self) -> str:
        return self.text(str)

    def text(self, literal=Value.sql) -> str:
        """The predicate as text; with the default ``literal`` it's a SQL condition."""
        match self.kind:
            case "Comparison":
                return f"{self.column} {OPS[self.op]} {literal(self.values[0])}"
            case "And" | "Or":
                return f"({self.parts[0].text(literal)} {self.kind.upper()} {self.parts[1].text(literal)})"
            case "Not":
                return f"NOT ({self.parts[0].text(literal)})"
            case "In":
                return f"{self.column} IN ({', '.join(map(literal, self.values))})"
            case "Between":
                return f"{self.column} BETWEEN {literal(self.values[0])} AND {literal(self.values[1])}"
            case _:
                return f"{self.column} IS NULL"

    def encode(self) -> dict:
        match self.kind:
            case "Comparison":
                body: object = {"column": self.column, "op": self.op, "value": self.values[0].encode()}
            case "And" | "Or":
                body = [p.encode() for p in self.parts]
            case "Not":
                body = self.parts[0].encode()
            case "In":
                body = {"column": self.column, "values": [v.encode() for v in self.values]}
            case "Between":
                body = {"column": self.column, "low": self.values[0].encode(), "high": self.values[1].encode()}
            case _:
                body = {"column": self.column}
        return {self.kind: body}

    def json(self) -> str:
        """Compact JSON, the same for equal predicates."""
        return json.dumps(self.encode(), separators=(",", ":"), ensure_ascii=False)

    def cache_key(self) -> Column:
        """A 64-bit key of the predicate (XXH64 of its JSON)."""
        return F.xxhash64(F.lit(self.json()))

    def columns(self) -> set[str]:
        """Names of the columns it reads."""
        return set().union({self.column} - {None}, *(p.columns() for p in self.parts))

    def to_column(self, schema: T.StructType | None = None) -> Column:
        """The exact condition. With a schema, integers compare with timestamps and dates as raw units."""
        if self.kind in ("And", "Or"):
            return reduce(lambda a, b: a & b if self.kind == "And" else a | b, (p.to_column(schema) for p in self.parts))
        if self.kind == "Not":
            return ~self.parts[0].to_column(schema)
        c, kind = path_column(self.column), field_type(schema, self.column)
        v = [x.column(kind) for x in self.values]
        match self.kind:
            case "In":
                return c.isin(*v) if v else F.lit(False)
            case "Between":
                return c.between(v[0], v[1])
            case "IsNull":
                return c.isNull()
        return {"Eq": c == v[0], "Ne": c != v[0], "Lt": c < v[0], "Gt": c > v[0], "Le": c <= v[0], "Ge": c >= v[0]}[self.op]


def path_column(path: str) -> Column:
    """Column of a dotted path."""
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def field_type(schema: T.StructType | None, path: str) -> T.DataType | None:
    """Type at a dotted path; None if the schema doesn't have it."""
    kind: T.DataType | None = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def compare(column: str, op: str, v: object) -> Predicate:
    """``column op value``, ``op`` by name (``Eq`` ...) or text (``=`` ...)."""
    name = op if op in OPS else {t: n for n, t in OPS.items()}[op]
    return Predicate("Comparison", column, name, (value(v),))


def is_in(column: str, values: list) -> Predicate:
    """``column IN (values)``; an empty list holds nothing."""
    return Predicate("In", column, values=tuple(map(value, values)))


def between(column: str, low: object, high: object) -> Predicate:
    """``column BETWEEN low AND high``."""
    return Predicate("Between", column, values=(value(low), value(high)))


def is_null(column: str) -> Predicate:
    """``column IS NULL``."""
    return Predicate("IsNull", column)


def _value(x: object) -> Value:
    if x == "Null":
        return Value("Null")
    ((kind, v),) = x.items()
    if kind not in KINDS:
        raise ValueError(f"INVALID_REQUEST: unknown literal {kind}")
    return Value(kind, bytes(v) if kind == "Bytes" else float(v) if kind == "Float64" else v)


def decode(tree: dict) -> Predicate:
    """A predicate from its decoded JSON; unknown nodes and operators raise ValueError."""
    ((kind, body),) = tree.items()
    match kind:
        case "Comparison":
            if body["op"] not in OPS:
                raise ValueError(f"INVALID_REQUEST: unknown operator {body['op']}")
            return Predicate(kind, body["column"], body["op"], (_value(body["value"]),))
        case "And" | "Or":
            return Predicate(kind, parts=tuple(map(decode, body)))
        case "Not":
            return Predicate(kind, parts=(decode(body),))
        case "In":
            return Predicate(kind, body["column"], values=tuple(map(_value, body["values"])))
        case "Between":
            return Predicate(kind, body["column"], values=(_value(body["low"]), _value(body["high"])))
        case "IsNull":
            return Predicate(kind, body["column"])
    raise ValueError(f"INVALID_REQUEST: unknown node {kind}")


def from_json(text: str) -> Predicate:
    """A predicate from its JSON text."""
    return decode(json.loads(text))
