"""Nested studies: values made clean by their schema, and rules of a table over them, each in one scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from ..functions.text import once

FINDING = "array<struct<path:string,kind:string,severity:string>>"
_BLANKS = r"[\s\p{Cc}]+"


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "))


def _blank(value: Column, kind: DataType) -> Column:
    """Whether there is nothing in a value: no letter in a text, nothing in any field of a struct or element of an array, else null."""
    if isinstance(kind, StringType):
        return _tidy(value) == ""
    if isinstance(kind, StructType):
        out = F.lit(True)
        for f in kind.fields:
            out = out & _blank(value.getField(f.name), f.dataType)
        return out
    if isinstance(kind, ArrayType):
        return ~F.coalesce(F.exists(value, lambda x: ~_blank(x, kind.elementType)), F.lit(False))
    return value.isNull()


def _told(value: Column, *found: Column) -> Column:
    return F.struct(value.alias("v"), (F.concat(*found) if found else F.array().cast(FINDING)).alias("f"))


def _finding(path: Column, what: str, severity: str) -> Column:
    return F.struct(path.alias("path"), F.lit(what).alias("kind"), F.lit(severity).alias("severity"))


def _some(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(FINDING)


class _Cleaner:
    """Clean values with their findings. What is clean at one depth is put into an array of one before the depth above reads it: written out at each place that
    needs it, it would be computed there again, so the work would be multiplied at each depth."""

    def __init__(self, gaps: dict[str, tuple[object, str]], limits: dict[str, int], unique: set[str]) -> None:
        self.gaps, self.limits, self.unique = gaps, limits, unique

    def clean(self, value: Column, kind: DataType, path: Column, rule: str) -> Column:
        """struct(v: the clean value, f: findings). path: where the value is, as a column; rule: the same without numbers of elements."""
        if isinstance(kind, StringType):
            return once(_tidy(value), lambda tidy: self._text(value, tidy, path, rule))
        if isinstance(kind, StructType):
            names = [f.name for f in kind.fields]
            parts = F.struct(*(self.clean(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}")), f"{rule}.{f.name}").alias(f.name) for f in kind.fields))
            return once(parts, lambda p: _told(F.struct(*(p.getField(n).getField("v").alias(n) for n in names)), *(p.getField(n).getField("f") for n in names)))
        if isinstance(kind, ArrayType):
            return self._array(value, kind.elementType, path, rule)
        if rule in self.gaps:
            default, severity = self.gaps[rule]
            return _told(F.coalesce(value, F.lit(default).cast(kind)), _some(F.when(value.isNull(), _finding(path, "missing", severity))))
        return _told(value)

    def _text(self, value: Column, tidy: Column, path: Column, rule: str) -> Column:
        (default, severity), limit = self.gaps.get(rule, ("", "INFO")), self.limits.get(rule)
        long = F.char_length(tidy) > limit if limit else F.lit(False)
        text = F.when(tidy == "", F.lit(default)).otherwise(F.trim(F.left(tidy, F.lit(limit))) if limit else tidy)
        return _told(text, _some(F.when(tidy == "", _finding(path, "missing", severity)), F.when((tidy != "") & (tidy != value), _finding(path, "trimmed", "INFO")), F.when(long, _finding(path, "shortened", "INFO"))))

    def _array(self, value: Column, kind: DataType, path: Column, rule: str) -> Column:
        every = F.transform(F.coalesce(value, F.array().cast(ArrayType(kind))), lambda x, i: F.struct(x.alias("x"), i.alias("i"), _blank(x, kind).alias("gone")))
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

        def inner(e: Column) -> Column:
            return F.struct(self.clean(e["x"], kind, at(e["i"]), f"{rule}[]").alias("c"), e["i"].alias("i"))

        def parted(every: Column) -> Column:
            gone = F.transform(F.filter(every, lambda e: e["gone"]), lambda e: _finding(at(e["i"]), "dropped", "INFO")).cast(FINDING)
            return F.struct(F.transform(F.filter(every, lambda e: ~e["gone"]), inner).alias("kept"), gone.alias("gone"))

        def joined(p: Column) -> Column:
            kept, out = p["kept"], F.transform(p["kept"], lambda b: b["c"]["v"])
            found = [F.flatten(F.transform(kept, lambda b: b["c"]["f"])), p["gone"]]
            if rule in self.gaps:
                found.append(F.when(F.size(kept) == 0, F.array(_finding(path, "missing", self.gaps[rule][1]))).otherwise(F.array()).cast(FINDING))
            if f"{rule}[].name" not in self.unique:
                return _told(out, *found)

            def named(earlier: Column) -> Column:
                again = F.filter(F.zip_with(kept, earlier, lambda b, n: F.when(n > 0, _finding(F.concat(at(b["i"]), F.lit(".name")), "renamed", "INFO"))), lambda x: x.isNotNull()).cast(FINDING)
                name = lambda x, n: F.when(n > 0, F.concat(x["name"], F.lit(" ("), (n + 1).cast("string"), F.lit(")"))).otherwise(x["name"])
                return _told(F.zip_with(out, earlier, lambda x, n: x.withField("name", name(x, n))), *found, again)

            # how often a name came before, 0 for blank ones
            count = lambda names: F.transform(names, lambda x, i: F.when(x != "", F.size(F.filter(F.slice(names, 1, i), lambda y: y == x))).otherwise(F.lit(0)))
            return once(once(F.transform(kept, lambda b: F.lower(b["c"]["v"]["name"])), count), named)

        return once(once(every, parted), joined)


def sanitize_nested(rows: DataFrame, key: str, gaps: dict[str, tuple[object, str]], limits: dict[str, int] | None = None, unique: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with clean values at every depth, and findings (key, path, kind, severity) for all that was changed. Both come from one plan over rows.

    Texts lose control characters and extra blanks ("trimmed"). A text without anything becomes its default and is "missing"; gaps gives default
    and severity by path, such as "arms[].epochs[].name", and others are "" and INFO. Elements without anything in them are "dropped", and an array that
    is left empty is "missing" if gaps names it. Other kinds of values are missing only where gaps names them and they are null. limits: most letters of
    a text ("shortened"); unique: names of array elements that get " (2)" and so on when repeated ("renamed"). Structs are never null afterwards.
    Paths of findings have the numbers of elements as they came in.
    """
    cleaner = _Cleaner(gaps, limits or {}, set(unique))
    parts = {f.name: cleaner.clean(F.col(f.name), f.dataType, F.lit(f.name), f.name) for f in rows.schema.fields if f.name != key}
    found = [p.getField("f") for p in parts.values()]
    # the generator takes the expression itself: of a column it would be told to leave out empty ones first, in a filter that computes the column again
    return rows.select(key, *(p.getField("v").alias(n) for n, p in parts.items())), rows.select(key, F.inline(F.concat(*found) if found else F.array().cast(FINDING)))


_STEP = re.compile(r"[A-Za-z_]\w*(\[\])?")


def _values(steps: list[str], before: str = "", depth: int = 0) -> str:
    """SQL for the array of all values at a path."""
    step, rest = steps[0], steps[1:]
    if not _STEP.fullmatch(step):
        raise ValueError(f"no step of a path: {step}")
    if not step.endswith("[]"):
        return _values(rest, f"{before}{step}.", depth) if rest else f"array({before}{step})"
    every = f"coalesce({before}{step[:-2]}, array())"
    return f"flatten(transform({every}, v{depth} -> {_values(rest, f'v{depth}.', depth + 1)}))" if rest else every


def compiled(path: str, quantifier: str, predicate: str) -> str:
    """SQL for how many values break a rule.

    quantifier: "all" values at the path satisfy the predicate (a null answer does not), "some" does, "none" does, or the predicate's values are "unique", null apart.
    predicate: SQL over x, one value; columns of the row can be named too.
    """
    values = _values(path.split("."))
    hits = f"filter({values}, x -> coalesce({predicate}, false))"
    if quantifier == "all":
        return f"size({values}) - size({hits})"
    if quantifier == "some":
        return f"CASE WHEN size({hits}) = 0 THEN 1 ELSE 0 END"
    if quantifier == "none":
        return f"size({hits})"
    if quantifier == "unique":
        keys = f"filter(transform({values}, x -> {predicate}), k -> k IS NOT NULL)"
        return f"size({keys}) - size(array_distinct({keys}))"
    raise ValueError(f"all, some, none or unique, not {quantifier}")


def broken_rules(studies: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule, severity, n): the rules that a study breaks, and by how many values; all rules in one scan of the studies.

    rules: rule, path, quantifier, predicate, severity, a table that the driver reads, as its rows become the plan. Rules are trusted as SQL is.
    """
    checks = [F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.expr(compiled(r["path"], r["quantifier"], r["predicate"])).cast("int").alias("n")) for r in rules.orderBy("rule").toLocalIterator()]
    if not checks:
        return studies.sparkSession.createDataFrame([], f"{key} {dict(studies.dtypes)[key]}, rule string, severity string, n int")
    return studies.select(key, F.inline(F.filter(F.array(*checks), lambda c: c["n"] > 0)))


def _open(kind: DataType) -> DataType:
    """The same type with nulls at every depth."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _open(f.dataType), True) for f in kind.fields])
    return ArrayType(_open(kind.elementType), True) if isinstance(kind, ArrayType) else kind


def salvaged(studies: DataFrame, key: str, rules: DataFrame, required: tuple[str, ...] = (), degrade: dict[str, str] | None = None) -> DataFrame:
    """Studies with what can be kept of them: key, parts, ok, statuses, reliance. A part is a column, and a rule of severity ERROR concerns the part that its path begins with.

    A part that breaks no such rule is kept. If all that it breaks is about its field degrade[part], that field is taken out and the rest stays ("degraded"); else the
    part is null ("dropped"). Parts that are null have no status. A study whose required part is dropped, or was never there, is not ok and keeps nothing.
    statuses: map of parts; reliance: kept and degraded parts over those that were there, null without any. All in one scan.
    """
    degrade = degrade or {}
    parts = [f for f in studies.schema.fields if f.name != key]
    own: dict[str, list[Column]] = {f.name: [] for f in parts}
    inner: dict[str, list[Column]] = {f.name: [] for f in parts}
    for r in rules.filter("severity = 'ERROR'").orderBy("rule").toLocalIterator():
        part, *rest = (step.removesuffix("[]") for step in r["path"].split("."))
        side = inner if rest and rest[0] == degrade.get(part) else own
        if part in side:
            side[part].append(F.expr(compiled(r["path"], r["quantifier"], r["predicate"])) > 0)
    broken = lambda checks: F.exists(F.array(*checks), lambda b: b) if checks else F.lit(False)
    status = {f.name: F.when(F.col(f.name).isNull(), None).when(broken(own[f.name]), "dropped").when(broken(inner[f.name]), "degraded").otherwise("kept") for f in parts}
    told = studies.withColumns({f"_s_{n}": c.cast("string") for n, c in status.items()})
    state = {n: F.col(f"_s_{n}") for n in status}
    ok = F.lit(True)
    for n in required:
        ok = ok & F.coalesce(state[n] != "dropped", F.lit(False))

    def kept(f) -> Column:
        value = F.col(f.name)
        if f.name in degrade:
            without = (lambda x: x.withField(degrade[f.name], F.lit(None))) if isinstance(f.dataType, StructType) else None
            less = without(value) if without else F.transform(value, lambda x: x.withField(degrade[f.name], F.lit(None)))
            kind = _open(f.dataType)
            value = F.when(state[f.name] == "degraded", less.cast(kind)).otherwise(value.cast(kind))
        return F.when(ok & (state[f.name] != "dropped"), value).alias(f.name)

    there = F.filter(F.array(*state.values()), lambda x: x.isNotNull())
    produced = F.filter(there, lambda x: x != "dropped")
    reliance = F.when(F.size(there) > 0, F.when(ok, F.size(produced)).otherwise(0) / F.size(there))
    names = F.map_filter(F.create_map(*(x for n, c in state.items() for x in (F.lit(n), c))), lambda _, v: v.isNotNull())
    return told.select(key, *map(kept, parts), ok.alias("ok"), names.alias("statuses"), reliance.alias("reliance"))


def salvage_findings(kept: DataFrame, key: str) -> DataFrame:
    """(key, part, kind, severity) of salvaged studies: parts that were dropped or degraded."""
    rows = kept.select(key, "ok", F.explode("statuses").alias("part", "kind")).filter("kind <> 'kept'")
    return rows.select(key, "part", "kind", F.when(~F.col("ok") | (F.col("kind") == "dropped"), "ERROR").otherwise("WARNING").alias("severity"))
