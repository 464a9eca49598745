"""Nested studies: cleaning and rules against plain walks; route plans against a plain choice."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnwork.plans import nested, routes

SCHEMA = "id long, title string, arms array<struct<name:string,label:string,epochs:array<struct<name:string,days:array<int>,note:struct<text:string>>>>>, tags array<string>, healthy boolean"


def studies(n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " \t", "a", " b  c", "Arm A", "arm a", "x\x01y", "long name of an arm"])
    maybe = lambda f: None if rng.random() < 0.15 else f()
    many = lambda f, k: maybe(lambda: [maybe(f) for _ in range(rng.randrange(k))])
    epoch = lambda: (text(), many(lambda: rng.randrange(9), 4), maybe(lambda: (text(),)))
    return [(i, text(), many(lambda: (text(), text(), many(epoch, 4)), 4), many(text, 4), rng.choice([True, False, None])) for i in range(n)]


GAPS = {"title": ("", "ERROR"), "arms": (None, "ERROR"), "arms[].name": ("unnamed", "WARNING"), "arms[].epochs[].note.text": ("-", "WARNING"), "tags": (None, "INFO"), "healthy": (False, "WARNING")}


def plain_clean(row):
    """The same, row by row. Kinds: str, list of a kind, dict of kinds, or None for others."""
    kinds = {"title": str, "arms": [{"name": str, "label": str, "epochs": [{"name": str, "days": [None], "note": {"text": str}}]}], "tags": [str], "healthy": None}
    found = []
    tidy = lambda t: re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", " ", t or "").strip()

    def blank(v, kind):
        if kind is str:
            return not tidy(v)
        if isinstance(kind, dict):
            return all(blank(None if v is None else v[k], sub) for k, sub in enumerate(kind.values()))
        if isinstance(kind, list):
            return all(blank(x, kind[0]) for x in v or [])
        return v is None

    def clean(v, kind, path, rule):
        if kind is str:
            t, (default, severity) = tidy(v), GAPS.get(rule, ("", "INFO"))
            if not t:
                found.append((path, "missing", severity))
                return default
            if t != v:
                found.append((path, "trimmed", "INFO"))
            if rule == "arms[].label" and len(t) > 6:
                found.append((path, "shortened", "INFO"))
                t = t[:6].strip()
            return t
        if isinstance(kind, dict):
            return tuple(clean(None if v is None else v[k], sub, f"{path}.{name}", f"{rule}.{name}") for k, (name, sub) in enumerate(kind.items()))
        if isinstance(kind, list):
            out, seen = [], []
            for i, x in enumerate(v or []):
                if blank(x, kind[0]):
                    found.append((f"{path}[{i}]", "dropped", "INFO"))
                    continue
                y = clean(x, kind[0], f"{path}[{i}]", f"{rule}[]")
                if rule == "arms":
                    k = seen.count(y[0].lower())
                    seen.append(y[0].lower())
                    if k:
                        found.append((f"{path}[{i}].name", "renamed", "INFO"))
                        y = (f"{y[0]} ({k + 1})", *y[1:])
                out.append(y)
            if not out and rule in GAPS:
                found.append((path, "missing", GAPS[rule][1]))
            return out
        if v is None and rule in GAPS:
            found.append((path, "missing", GAPS[rule][1]))
            return GAPS[rule][0]
        return v

    return (row[0], *(clean(v, kind, name, name) for v, (name, kind) in zip(row[1:], kinds.items(), strict=True))), sorted(found)


def untyped(v):
    return tuple(map(untyped, v)) if isinstance(v, tuple) else [untyped(x) for x in v] if isinstance(v, list) else v


def test_three_levels_are_cleaned(spark):
    rows = studies(150, 1)
    clean, found = nested.sanitize_nested(spark.createDataFrame(rows, SCHEMA), "id", GAPS, {"arms[].label": 6}, ("arms[].name",))
    assert [f.name for f in clean.schema.fields] == ["id", "title", "arms", "tags", "healthy"]
    want = {r[0]: plain_clean(r) for r in rows}
    got = {r.id: untyped(tuple(r)) for r in clean.collect()}
    assert all(got[i] == untyped(want[i][0]) for i in want)
    issues = {}
    for r in found.collect():
        issues.setdefault(r.id, []).append((r.path, r.kind, r.severity))
    assert all(sorted(issues.get(i, [])) == want[i][1] for i in want)
    assert {k for v in issues.values() for _, k, _ in v} == {"missing", "trimmed", "shortened", "dropped", "renamed"}


def flat(v):
    return [x for a in v for x in a]


LIST = lambda v: v or []
ARMS = lambda s: LIST(s[2])
EPOCHS = lambda s: flat(LIST(a and a[2]) for a in ARMS(s))
#: name, path, quantifier, predicate, and the values and predicate in Python; None is a null answer
RULES = [
    ("r01", "title", "all", "trim(x) <> ''", lambda s: [s[1]], lambda x: x is not None and bool(x.strip(" "))),
    ("r02", "title", "none", "x = 'a'", lambda s: [s[1]], lambda x: x == "a"),
    ("r03", "arms[]", "some", "x is not null", ARMS, lambda x: x is not None),
    ("r04", "arms[]", "all", "x.name is not null", ARMS, lambda x: bool(x) and x[0] is not None),
    ("r05", "arms[].name", "unique", "lower(x)", ARMS, lambda x: x and x[0] and x[0].lower() if not (x and x[0] == "") else ""),
    ("r06", "arms[].name", "none", "x like 'arm%'", ARMS, lambda x: bool(x and x[0]) and x[0].startswith("arm")),
    ("r07", "arms[].epochs[]", "some", "true", EPOCHS, lambda x: True),
    ("r08", "arms[].epochs[].name", "all", "x is not null", EPOCHS, lambda x: bool(x) and x[0] is not None),
    ("r09", "arms[].epochs[].days[]", "all", "x < 8", lambda s: flat(LIST(e and e[1]) for e in EPOCHS(s)), lambda x: x is not None and x < 8),
    ("r10", "arms[].epochs[].days[]", "some", "x = 3", lambda s: flat(LIST(e and e[1]) for e in EPOCHS(s)), lambda x: x == 3),
    ("r11", "arms[].epochs[].days[]", "unique", "x", lambda s: flat(LIST(e and e[1]) for e in EPOCHS(s)), lambda x: x),
    ("r12", "arms[].epochs[].note.text", "none", "length(x) = 0", EPOCHS, lambda x: bool(x) and bool(x[2]) and x[2][0] == ""),
    ("r13", "arms[].epochs[].note", "all", "x is not null", EPOCHS, lambda x: bool(x) and x[2] is not None),
    ("r14", "tags[]", "all", "x is not null", lambda s: LIST(s[3]), lambda x: x is not None),
    ("r15", "tags[]", "unique", "x", lambda s: LIST(s[3]), lambda x: x),
    ("r16", "tags[]", "some", "x = 'a' or healthy", lambda s: [(x, s[4]) for x in LIST(s[3])], lambda x: x[0] == "a" or x[1] is True),
    ("r17", "healthy", "all", "x", lambda s: [s[4]], lambda x: x is True),
    ("r18", "arms[]", "all", "size(x.epochs) > 0", ARMS, lambda x: bool(x) and bool(x[2])),
    ("r19", "arms[]", "none", "exists(x.epochs, e -> e.name = 'a')", ARMS, lambda x: bool(x) and any(e and e[0] == "a" for e in LIST(x[2]))),
    ("r20", "arms[].label", "all", "x <> title", lambda s: [(x and x[1], s[1]) for x in ARMS(s)], lambda x: x[0] is not None and x[1] is not None and x[0] != x[1]),
]


def test_twenty_rules_in_one_scan(spark):
    rows = studies(200, 2)
    table = spark.createDataFrame([(n, p, q, pred, "ERROR") for n, p, q, pred, _, _ in RULES], "rule string, path string, quantifier string, predicate string, severity string")
    got = nested.broken_rules(spark.createDataFrame(rows, SCHEMA), "id", table)
    want = set()
    for s in rows:
        for name, _, quantifier, _, values, test in RULES:
            answers = [test(x) for x in values(s)]
            keys = [a for a in answers if a is not None]
            n = {"all": sum(a is not True for a in answers), "none": sum(a is True for a in answers), "some": int(not any(a is True for a in answers)), "unique": len(keys) - len(set(keys))}[quantifier]
            if n:
                want.add((s[0], name, "ERROR", n))
    assert {tuple(r) for r in got.collect()} == want and {w[1] for w in want} == {r[0] for r in RULES}
    assert nested.broken_rules(spark.createDataFrame(rows, SCHEMA), "id", table.limit(0)).count() == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_paths_and_quantifiers_are_checked():
    with pytest.raises(ValueError, match="no step"):
        nested.compiled("arms[].x) or (true", "all", "true")
    with pytest.raises(ValueError, match="not most"):
        nested.compiled("arms[]", "most", "true")


def test_plans_take_the_most_specific_rule(spark):
    rng = random.Random(5)
    families, phases = [None, "a", "b"], [None, "1", "2"]
    rules = [(k, rng.choice(["f", "g"]), rng.choice(routes.ROLES), rng.choice(families), rng.choice(phases), [f"t{k}"], None, None) for k in range(40)]
    some = [(i, f, p) for i, (f, p) in enumerate(itertools.product([None, "a", "b", "c"], [None, "1", "2", "3"]))]
    plans = routes.study_plans(spark.createDataFrame(some, "doc_id long, family string, phase string"), spark.createDataFrame(rules, routes.RULE))
    want = {}
    for i, f, p in some:
        for k, field, role, rf, rp, *_ in rules:
            if (rf is None or rf == f) and (rp is None or rp == p):
                rank = (2 * (rf is not None) + (rp is not None), -k)
                want[i, field, role] = max(want.get((i, field, role), (-1, 0)), rank)
    got = {(r.doc_id, r.field, role): -r[role].rule for r in plans.collect() for role in routes.ROLES if r[role]}
    assert got == {k: v[1] for k, v in want.items()}


def test_sections_by_role(spark):
    rules = [(1, "f", "primary", None, None, ["x"], None, None), (2, "f", "supporting", None, None, ["x", "y"], None, None), (3, "f", "prohibited", None, None, None, ["old"], None), (4, "g", "primary", None, None, ["z"], None, ["s"]), (5, "h", "primary", None, None, None, None, None)]
    plans = routes.study_plans(spark.createDataFrame([(1, "a", None), (2, None, None)], "doc_id long, family string, phase string"), spark.createDataFrame(rules, routes.RULE))
    sections = spark.createDataFrame([(1, 0, "x", None, None), (1, 1, "y", "new", None), (1, 2, "x", "old", None), (1, 3, "z", None, "t"), (1, 4, "z", None, "s"), (2, 0, None, None, None)], "doc_id long, ord int, type string, subtype string, scope string")
    got = routes.routed(plans, sections)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "f", "primary"), (1, 1, "f", "supporting"), (1, 2, "f", "prohibited"), (1, 4, "g", "primary")]
    assert sorted(map(tuple, routes.without_evidence(plans, got).collect())) == [(1, "h"), (2, "f"), (2, "g"), (2, "h")]
    assert got.filter(F.col("role").isNull()).count() == 0


def test_what_can_be_kept_is_kept(spark):
    schema = "id long, head struct<title:string>, aims struct<text:string,estimands:array<string>>, arms array<struct<name:string,note:string>>, extra string"
    rows = [(1, ("t",), ("a", ["e"]), [("n", "x")], "x"), (2, ("t",), ("a", [""]), [("n", "x")], None), (3, ("t",), ("", [""]), [("", "x")], "y"), (4, ("",), ("a", ["e"]), None, None), (5, None, None, None, None), (6, ("t",), None, [("n", None)], None)]
    rules = [("r1", "head.title", "all", "x <> ''", "ERROR"), ("r2", "aims.text", "all", "x <> ''", "ERROR"), ("r3", "aims.estimands[]", "all", "x <> ''", "ERROR"), ("r4", "arms[].name", "all", "x <> ''", "ERROR"), ("r5", "arms[].note", "all", "x is not null", "ERROR"), ("r6", "extra", "all", "x = 'y'", "WARNING")]
    table = spark.createDataFrame(rules, "rule string, path string, quantifier string, predicate string, severity string")
    kept = nested.salvaged(spark.createDataFrame(rows, schema), "id", table, ("head",), {"aims": "estimands", "arms": "note"})
    got = {r.id: (r.ok, dict(r.statuses), untyped(tuple(r.aims)) if r.aims else None, untyped([tuple(a) for a in r.arms]) if r.arms else None, r.reliance) for r in kept.collect()}
    assert got == {
        1: (True, {"head": "kept", "aims": "kept", "arms": "kept", "extra": "kept"}, ("a", ["e"]), [("n", "x")], 1.0),
        2: (True, {"head": "kept", "aims": "degraded", "arms": "kept"}, ("a", None), [("n", "x")], 1.0),
        3: (True, {"head": "kept", "aims": "dropped", "arms": "dropped", "extra": "kept"}, None, None, 0.5),
        4: (False, {"head": "dropped", "aims": "kept"}, None, None, 0.0),
        5: (False, {}, None, None, None),
        6: (True, {"head": "kept", "arms": "degraded"}, None, [("n", None)], 1.0),
    }
    assert sorted(tuple(r) for r in nested.salvage_findings(kept, "id").collect()) == [(2, "aims", "degraded", "WARNING"), (3, "aims", "dropped", "ERROR"), (3, "arms", "dropped", "ERROR"), (4, "head", "dropped", "ERROR"), (6, "arms", "degraded", "WARNING")]
