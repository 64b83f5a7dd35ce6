"""Catalyst plans as Python trees; the only module that touches Spark's internals."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Node:
    kind: str
    args: dict[str, Any]
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """This node, those below, and those in its arguments."""
        yield self
        for v in self.args.values():
            for n in _inside(v):
                yield from n.walk()
        for c in self.children:
            yield from c.walk()


def _inside(v: Any) -> Iterator[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, (list, dict)):
        for x in v.values() if isinstance(v, dict) else v:
            yield from _inside(x)


def _is_tree(v: Any) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(x, dict) and "class" in x and "num-children" in x for x in v)


def _build(flat: list[dict]) -> Node:
    at = 0

    def one() -> Node:
        nonlocal at
        raw = flat[at]
        at += 1
        node = Node(raw["class"].rsplit(".", 1)[-1].split("$")[0], {k: _value(v) for k, v in raw.items() if k not in ("class", "num-children")})
        node.children = [one() for _ in range(raw["num-children"])]
        return node

    return one()


def _value(v: Any) -> Any:
    if _is_tree(v):
        return _build(v)
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    return [_value(x) for x in v] if isinstance(v, list) else v


def below(n: Node) -> list[Node]:
    """The nodes next to n: its children and those in its arguments."""
    return [*n.children, *(x for v in n.args.values() for x in _inside(v))]


def parsed(spark: SparkSession, sql: str) -> Node:
    return _build(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON()))


def analyzed(df: DataFrame) -> Node:
    return _build(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
