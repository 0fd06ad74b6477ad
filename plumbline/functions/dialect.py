"""One query text for two engines.

Operators are written once as SQL over a small set of functions; Spark runs them, and the same text in
DuckDB's words is the check. Patterns keep to what Java and RE2 read alike: no lookaround, no back
references, explicit Unicode classes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

TRIM = r"^[\s]+|[\s]+$"


def in_batches(measure: Callable[[str], Any], form: str, once: bool) -> Any:
    """The function of a text as a function of Arrow batches. For once it counts as non-deterministic, so that the optimizer puts it
    neither into filters nor into several expressions, where it would run again; but then no exchange is used again either."""
    as_arrow = to_arrow_type(_parse_datatype_string(form))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t.as_py() or "") for t in texts], as_arrow)

    made = F.arrow_udf(run, form)
    return made.asNondeterministic() if once else made


class Spark:
    name = "spark"

    def __init__(self, seeds: bool = True, session: SparkSession | None = None):
        #: Whether operators whose name ends in _seeded append their example sentences to the texts.
        self.seeds = seeds
        self.session = session

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.lit(pattern)})"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    def map(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def at(self, a: str, i: int) -> str:
        return f"try_element_at({a}, {i})"

    def cut(self, a: str, first: int) -> str:
        """The array from its element `first`, counted from 1."""
        return f"slice({a}, {first}, greatest(size({a}), 1))"

    def sum(self, a: str) -> str:
        return f"aggregate({a}, 0L, (s, x) -> s + x)"

    def most(self, a: str) -> str:
        """Occurrences of the most frequent element; 0 for none. One pass over the sorted array."""
        start = "named_struct('p', '', 'r', 0, 'm', 0)"
        step = "named_struct('p', x, 'r', if(x = s.p, s.r + 1, 1), 'm', greatest(s.m, if(x = s.p, s.r + 1, 1)))"
        return f"aggregate(sort_array({a}), {start}, (s, x) -> {step}, s -> s.m)"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def array_of(self, items: list[str]) -> str:
        return self.array(*(self.lit(x) for x in items))

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def explode(self, keep: str, table: str, a: str, pos: str = "pos", v: str = "v") -> str:
        """Rows of each element with its place, counted from 0. OUTER keeps the optimizer from adding a
        filter on the array's size, which it would push down as a second evaluation of the array."""
        return f"SELECT {keep}, {pos}, {v} FROM {table} LATERAL VIEW OUTER posexplode({a}) e AS {pos}, {v} WHERE {pos} IS NOT NULL"

    def run(self, a: str, v: str, body: str) -> str:
        """Longest run of elements that satisfy body."""
        step = f"named_struct('r', if({body}, s.r + 1, 0), 'm', greatest(s.m, if({body}, s.r + 1, 0)))"
        return f"aggregate({a}, named_struct('r', 0, 'm', 0), (s, {v}) -> {step}, s -> s.m)"

    def tail(self, x: str, n: int) -> str:
        return f"right({x}, {n})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def starts(self, x: str, prefix: str) -> str:
        return f"startswith({x}, {self.lit(prefix)})"

    def mod(self, a: str, n: int) -> str:
        return f"pmod({a}, {n})"

    def seconds(self, later: str, earlier: str) -> str:
        return f"((unix_micros(cast({later} as timestamp)) - unix_micros(cast({earlier} as timestamp))) / 1000000.0D)"

    def collect(self, x: str, sep: str) -> str:
        """Distinct values in order, joined."""
        return f"array_join(array_sort(collect_set({x})), {self.lit(sep)})"

    def noisy_or(self, w: str) -> str:
        """1 - product of (1 - w) over a group, through logarithms; w = 1 gives 1."""
        return f"(CASE WHEN max({w}) >= 1.0D THEN 1.0D ELSE 1.0D - exp(sum(CASE WHEN {w} < 1.0D THEN ln(1.0D - {w}) END)) END)"

    def values(self, rows: list[tuple], names: list[str]) -> str:
        body = ", ".join("(" + ", ".join(self.lit(v) if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
        return f"(SELECT * FROM VALUES {body} AS t({', '.join(names)}))"

    def measured(self, x: str, name: str, measure: Callable[[str], Any], form: str, once: bool = True) -> str:
        """What the Python function measure finds in each text x, as a value of the type form: evaluated once a row. The function is
        registered in the session under its name."""
        session = self.session or SparkSession.getActiveSession()
        if session is not None:
            session.udf.register(name, in_batches(measure, form, once))
        return f"{name}({x})"

    def part(self, x: str, i: int) -> str:
        """Part i, from 1, of a text cut at |."""
        return f"split_part({x}, '|', {i})"

    def fold(self, a: str, start: str, body: str) -> str:
        """Text s, first start, taken through body for each text x of the array."""
        return f"aggregate({a}, {start}, (s, x) -> {body})"

    def let(self, x: str, v: str, body: str) -> str:
        """body with v for x, which is evaluated once a row, even where body uses it in a lambda."""
        return f"element_at({self.map(self.array(x), v, body)}, 1)"

    def captured(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 1)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})"


class Duck(Spark):
    name = "duckdb"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(pattern)}))"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def split(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.lit(pattern)})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})"

    def map(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    def at(self, a: str, i: int) -> str:
        return f"list_extract({a}, {i})"

    def cut(self, a: str, first: int) -> str:
        return f"list_slice({a}, {first}, len({a}))"

    def sum(self, a: str) -> str:
        return f"coalesce(list_sum({a}), 0)"

    def most(self, a: str) -> str:
        return f"coalesce(list_max(map_values(list_histogram({a}))), 0)"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def explode(self, keep: str, table: str, a: str, pos: str = "pos", v: str = "v") -> str:
        return f"SELECT {keep}, unnest(range(len({a}))) AS {pos}, unnest({a}) AS {v} FROM {table}"

    def run(self, a: str, v: str, body: str) -> str:
        marks = f"array_to_string(list_transform({a}, lambda {v}: CASE WHEN {body} THEN 'y' ELSE 'n' END), '')"
        return f"coalesce(list_max(list_transform(string_split({marks}, 'n'), lambda z: length(z))), 0)"

    def tail(self, x: str, n: int) -> str:
        return f"right({x}, {n})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def starts(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, {self.lit(prefix)})"

    def mod(self, a: str, n: int) -> str:
        return f"((({a}) % {n} + {n}) % {n})"

    def seconds(self, later: str, earlier: str) -> str:
        return f"((epoch_us({later}) - epoch_us({earlier})) / 1000000.0)"

    def collect(self, x: str, sep: str) -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT {x})), {self.lit(sep)}), '')"

    def noisy_or(self, w: str) -> str:
        return super().noisy_or(w).replace("1.0D", "1.0::DOUBLE")

    def values(self, rows: list[tuple], names: list[str]) -> str:
        body = ", ".join("(" + ", ".join(self.lit(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
        return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"

    def let(self, x: str, v: str, body: str) -> str:
        return f"list_extract({self.map(self.array(x), v, body)}, 1)"

    def fold(self, a: str, start: str, body: str) -> str:
        return f"list_reduce(list_concat([{start}], {a}), lambda s, x: {body})"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_disc({x}, {p})"


SPARK, DUCK = Spark(), Duck()
PLAIN_SPARK, PLAIN_DUCK = Spark(seeds=False), Duck(seeds=False)
