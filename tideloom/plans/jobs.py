"""Multi-statement ``INSERT INTO sink SELECT ...`` jobs. Spark parses, plans and runs the selects;
here statements are only told apart, given their sources as views and joined up by sink."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.codecs import project_to_schema
from tideloom.functions.scalar import register_sql
from tideloom.operators import tables

_INSERT = re.compile(r"(insert|upsert)\s+into\s+([\w.$`]+)\s*(?:\(([\w\s,`]+)\))?\s*(select\b.*|with\b.*|values\b.*)", re.I | re.S)
_LITERAL = re.compile(r"('(?:[^']|'')*')")
_QUIET = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.S)
KEY, OP = "__key__", "__op__"

_NESTED = re.compile(r"\b(GetNestedField|GetSqlField)\(\s*([\w.`]+)\s*,\s*'([^']+)'\s*\)", re.I)
_FLATTEN = re.compile(r"\bFlatten\s*\(", re.I)
_SIMILAR = re.compile(r"([\w.`]+|\))\s+(NOT\s+)?SIMILAR\s+TO\s+('(?:[^']|'')*')", re.I)
_RECORD = re.compile(r"\bBuildOutputRecord\s*\(", re.I)


def without_comments(text: str) -> str:
    """SQL text without ``-- ...`` and ``/* ... */``, which inside literals are no comments."""
    return _QUIET.sub(lambda m: m[0] if m[0].startswith("'") else " ", text)


def _outside(text: str) -> list[bool]:
    """For each character whether it stands outside of text literals."""
    out = [True] * len(text)
    for m in _LITERAL.finditer(text):
        out[m.start() : m.end()] = [False] * (m.end() - m.start())
    return out


def _closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``."""
    outside, depth = _outside(text), 0
    for i in range(at, len(text)):
        if outside[i] and text[i] in "()":
            depth += 1 if text[i] == "(" else -1
            if depth == 0:
                return i
    raise ValueError(f"no closing parenthesis after {text[:at + 1]!r}")


def _opening(text: str, at: int) -> int:
    """Place where the operand that ends with the parenthesis at ``at`` begins, its function's name included."""
    outside, depth = _outside(text), 0
    for i in range(at, -1, -1):
        if outside[i] and text[i] in "()":
            depth += 1 if text[i] == ")" else -1
            if depth == 0:
                name = re.search(r"[\w.`]+$", text[:i])
                return name.start() if name else i
    raise ValueError(f"no opening parenthesis before {text[at:]!r}")


def in_spark_words(select: str) -> str:
    """Streaming SQL forms that Spark writes differently: nested-field paths, Flatten, SIMILAR TO, records.

    What stands in a text literal stays as it is. The arguments of Flatten and the left side of SIMILAR TO may be calls
    of any depth. RegexMatch, TRUNCATE and convertToString are session functions and need no change.
    """

    def field(match: re.Match) -> str:
        value = match[2]
        for segment in match[3].split("."):
            index = re.search(r"\[\d+\]$", segment)
            value += index[0] if index else f".`{segment}`"
        return f"CAST({value} AS STRING)" if match[1].lower() == "getsqlfield" else value

    def each(pattern: re.Pattern, change, text: str) -> str:
        """``change(text, match)`` gives (start, end, new text) for a match outside of literals."""
        at = 0
        while match := pattern.search(text, at):
            if not _outside(text)[match.start()]:
                at = match.start() + 1
                continue
            start, end, new = change(text, match)
            text, at = text[:start] + new + text[end:], start + 1
        return text

    def flatten(text: str, m: re.Match):
        end = _closing(text, m.end() - 1)
        inner = text[m.end() : end]
        return m.start(), end + 1, f"explode(CASE WHEN {inner} IS NULL THEN array(NULL) ELSE {inner} END)"

    def similar(text: str, m: re.Match):
        start = _opening(text, m.start()) if m[1] == ")" else m.start()
        return start, m.end(), f"{'NOT ' if m[2] else ''}SimilarTo({text[start : m.end(1)]}, {m[3]})"

    text = each(_NESTED, lambda t, m: (m.start(), m.end(), field(m)), select)
    text = each(_SIMILAR, similar, text)
    text = each(_FLATTEN, flatten, text)
    return each(_RECORD, lambda t, m: (m.start(), m.end(), "named_struct("), text)


@dataclass(frozen=True)
class Insert:
    sink: str
    select: str
    columns: tuple[str, ...] = ()
    upsert: bool = False


def split_script(text: str) -> list[str]:
    """Statements of a script: each starts at a line beginning with insert (or upsert). Comments go first."""
    statements: list[list[str]] = []
    for line in without_comments(text).splitlines():
        if not line.strip():
            continue
        if re.match(r"\s*(insert|upsert)\b", line, re.I) or not statements:
            statements.append([])
        statements[-1].append(line.strip())
    return [" ".join(s).rstrip(";").strip() for s in statements]


def read_insert(statement: str) -> Insert:
    match = _INSERT.fullmatch(without_comments(statement).strip().rstrip(";").strip())
    if not match:
        raise ValueError(f"not INSERT INTO sink SELECT ...: {statement[:80]!r}")
    columns = tuple(c.strip(" `") for c in match[3].split(",")) if match[3] else ()
    return Insert(match[2], match[4], columns, match[1].lower() == "upsert")


@dataclass(frozen=True)
class Sink:
    """Where a sink's rows go. With a ``schema`` unknown columns are dropped and missing ones are null."""

    path: str
    fmt: str = "parquet"
    schema: T.StructType | None = None


_JOBS = itertools.count()


class SqlJob:
    """Sources by dotted name, and the statements that run over them.

    ``source("tracking.views", df)`` makes ``tracking.views`` readable in the statements;
    ``source(..., keys=..., order=...)`` also makes ``tracking.views.$table`` the keyed table that the
    stream forms.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._number = spark, next(_JOBS)
        register_sql(spark)
        self._views: dict[str, str] = {}
        self._sinks: dict[str, Sink] = {}

    def source(self, name: str, df: DataFrame, keys: Iterable[str] = (), order: Iterable[str] = ()) -> SqlJob:
        self._add(name, df)
        if keys:
            self._add(f"{name}.$table", tables.materialise(df, list(keys), list(order)))
        return self

    def sink(self, name: str, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> SqlJob:
        self._sinks[name] = Sink(path, fmt, schema)
        return self

    def execute(self, statements: str | Iterable[str | Insert]) -> dict[str, DataFrame]:
        """Run the statements and write every declared sink. A select over live sources runs over all
        input there is, with its checkpoint beside the output. Returns the DataFrames by sink."""
        outputs = self.run(statements)
        for name, sink in self._sinks.items():
            out = outputs[name]
            if sink.schema is not None:
                out = project_to_schema(out, sink.schema)
            if out.isStreaming:
                (
                    out.writeStream.format(sink.fmt)
                    .option("path", sink.path)
                    .option("checkpointLocation", f"{sink.path.rstrip('/')}_checkpoint")
                    .trigger(availableNow=True)
                    .start()
                    .awaitTermination()
                )
            else:
                out.write.format(sink.fmt).mode("append").save(sink.path)
        return outputs

    def _add(self, name: str, df: DataFrame) -> None:
        """A view of its own for each name of each job: no other name and no view of the caller is replaced."""
        view = self._views.setdefault(name.lower(), f"job_{self._number}_{len(self._views)}_" + re.sub(r"\W+", "_", name))
        df.createOrReplaceTempView(view)

    def _names(self, names: Iterable[str]) -> re.Pattern:
        """Names where a relation stands (after FROM, JOIN or a comma between relations) or in front of a column."""
        some = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
        return re.compile(
            rf"(?P<before>\b(?:from|join|table)\s+(?:\(\s*)*)(?P<relation>{some})(?![\w$]|\.[\w$])"
            rf"|(?<![\w.$])(?P<owner>{some})(?=\.(?:\w|\*|`))(?!\.\$)",
            re.I,
        )

    def _resolve(self, text: str, names: dict[str, str]) -> str:
        """Replace source names by view names, outside of text literals and only where they name a source."""
        pattern, listed = self._names(names), self._listed(names)

        def change(m: re.Match) -> str:
            return (m["before"] or "") + names[(m["relation"] or m["owner"]).lower()]

        parts = _LITERAL.split(text)
        for i in range(0, len(parts), 2):
            parts[i] = pattern.sub(change, listed.sub(lambda m: m[1] + names[m[2].lower()], parts[i]))
        return "".join(parts)

    def _listed(self, names: Iterable[str]) -> re.Pattern:
        """Further names of ``FROM a, b c, d``."""
        some = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
        return re.compile(rf"(\bfrom\s+[\w.$`]+(?:\s+(?:as\s+)?(?!join|where|group|on\b)\w+)?(?:\s*,\s*[\w.$`]+(?:\s+(?:as\s+)?\w+)?)*\s*,\s*)({some})(?![\w.$])", re.I)

    def _reads(self, insert: Insert, sink: str) -> bool:
        plain = "".join(_LITERAL.split(insert.select)[::2])
        relation = any(m["relation"] for m in self._names([sink]).finditer(plain))
        return relation or self._listed([sink]).search(plain) is not None

    def run(self, statements: str | Iterable[str | Insert]) -> dict[str, DataFrame]:
        """One DataFrame per sink. Statements with the same sink are merged; a sink that another
        statement reads is made before it, whatever their order in the script."""
        if isinstance(statements, str):
            statements = split_script(statements)
        inserts = [s if isinstance(s, Insert) else read_insert(s) for s in statements]
        waiting: dict[str, list[Insert]] = {}
        for insert in inserts:
            waiting.setdefault(insert.sink, []).append(insert)
        done: dict[str, DataFrame] = {}
        while waiting:
            ready = [
                sink for sink, group in waiting.items()
                if not any(self._reads(i, other) for i in group for other in waiting)
            ]
            if not ready:
                raise ValueError(f"statements read each other: {sorted(waiting)}")
            for sink in ready:
                merged = None
                for insert in waiting.pop(sink):
                    select = in_spark_words(insert.select)
                    part = self._spark.sql(self._resolve(select, self._views) if self._views else select)
                    if insert.columns:
                        part = part.toDF(*insert.columns)
                    merged = part if merged is None else merged.unionByName(part)
                done[sink] = merged
                self._add(sink, merged)
        return done


def apply_to_table(table: DataFrame, output: DataFrame, key: str = KEY) -> DataFrame:
    """Table content after an output with ``__key__`` (one row per key) went into it: rows whose
    ``__op__`` is DELETE remove their key, all others replace it."""
    columns = [c for c in output.columns if c != OP]
    deleted = F.col(OP) == "DELETE" if OP in output.columns else None
    entries = output if deleted is not None else output.select(*columns)
    missing = {c: F.lit(None).cast(table.schema[c].dataType) for c in table.columns if c not in output.columns}
    return tables.put_all(table, entries.withColumns(missing) if missing else entries, [key], deleted)
