"""User functions: named, typed, configured, switched on or off, and picked by argument type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tideloom.functions.batches import arrow_schema


@dataclass(frozen=True)
class Method:
    """One body of a function. ``build(config)`` gives a function of Columns, or, for ``arrow``
    methods, of pandas Series: it runs per Arrow batch, never per row."""

    params: tuple[str, ...] | None
    returns: str
    build: Callable
    arrow: bool = False

    def fits(self, types: list[str], widening: bool = False) -> bool:
        if self.params is None:
            return True
        return len(self.params) == len(types) and all(
            p in ("any", t) or (widening and p in _WIDER.get(t, ())) for p, t in zip(self.params, types)
        )


# The types that a value of each type becomes without loss.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp",),
}


@dataclass
class ScalarFunction:
    name: str
    config: dict = field(default_factory=dict)
    enabled: bool = True
    methods: list[Method] = field(default_factory=list)


class FunctionSet:
    """A set of user functions. ``params=None`` accepts any arguments."""

    def __init__(self) -> None:
        self._functions: dict[str, ScalarFunction] = {}

    def define(self, name: str, config: dict | None = None, enabled: bool = True) -> ScalarFunction:
        return self._functions.setdefault(name.lower(), ScalarFunction(name, config or {}, enabled))

    def method(self, name: str, params: tuple[str, ...] | None, returns: str, arrow: bool = False):
        """Decorator: add a body to ``name``; several bodies make it polymorphic."""

        def add(build: Callable) -> Callable:
            self.define(name).methods.append(Method(params, returns, build, arrow))
            return build

        return add

    def _get(self, name: str) -> ScalarFunction:
        found = self._functions.get(name.lower())
        if found is None or not found.enabled:
            raise LookupError(f"no enabled function {name}")
        return found

    @staticmethod
    def _pick(fn: ScalarFunction, types: list[str]) -> Method:
        """The body for these argument types; if none takes them as they are, the first that takes them widened."""
        for widening in (False, True):
            for method in fn.methods:
                if method.fits(types, widening):
                    return method
        raise TypeError(f"{fn.name} takes no ({', '.join(types)})")

    def call(self, df: DataFrame, name: str, *args: Column) -> Column:
        """The body that fits the argument types in ``df``, as an expression over ``args``."""
        fn = self._get(name)
        types = [f.dataType.simpleString() for f in df.select(*args).schema]
        method = self._pick(fn, types)
        if method.params is not None:
            args = tuple(a if p in ("any", t) else a.cast(p) for a, p, t in zip(args, method.params, types))
        body = method.build(fn.config)
        if method.arrow:
            body = F.pandas_udf(body, method.returns)
        return body(*args)

    def register(self, spark: SparkSession) -> list[str]:
        """Make the functions whose bodies are all Arrow functions of one return type callable from SQL text, each body
        picked by the types of the arguments; returns their names."""
        done = []
        for fn in self._functions.values():
            if fn.enabled and fn.methods and all(m.arrow for m in fn.methods) and len({m.returns for m in fn.methods}) == 1:
                spark.udf.register(fn.name, F.arrow_udf(_by_type(fn), fn.methods[0].returns))
                done.append(fn.name)
        return done


def _by_type(fn: ScalarFunction) -> Callable:
    """One Arrow function that picks the body by the types of its arguments."""
    bodies = [m.build(fn.config) for m in fn.methods]
    returns = arrow_schema(f"x {fn.methods[0].returns}").field(0).type

    def run(*arrays: pa.Array) -> pa.Array:
        method = FunctionSet._pick(fn, [from_arrow_type(a.type).simpleString() for a in arrays])
        body = bodies[next(i for i, m in enumerate(fn.methods) if m is method)]
        return pa.array(body(*[a.to_pandas() for a in arrays]), type=returns, from_pandas=True)

    return run
