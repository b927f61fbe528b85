"""JSON leaves and cleaning against Python's own walk."""

from __future__ import annotations

import json
from decimal import Decimal

from evidloom.operators import variants

TEXTS = [
    '{"b": [1, 2.5, {"c": "  x\\n  y ", "d": []}], "a": null, "z": {}, "t": true, "e f": {"g.h": ["", " "]}}',
    '"  a  string "', "7", "[]", "{}", "[[[[1, [2]], 3]], {\"k\": {\"k\": {\"k\": \" deep   down \"}}}]", "null", "not json {", None, "", '{"q": "say \\"hi\\"  \\\\ now", "é": "ü\u00a0\u00a0x"}',
]


def walked(at, x):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from walked(f"{at}.{k}" if at else k, v)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from walked(f"{at}[{i}]", v)
    else:
        yield at, x if isinstance(x, str) or x is None else json.dumps(x)


def cleaned(x):
    if isinstance(x, dict):
        return {k: cleaned(v) for k, v in x.items()}
    if isinstance(x, list):
        return [cleaned(v) for v in x]
    return " ".join(x.split()) if isinstance(x, str) else x


def parsed(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, j string").selectExpr("*", "'x' AS node", "1 AS path0", "2 AS pos").union(spark.createDataFrame([(0, TEXTS[0], "x", 1, 2)], "id int, j string, node string, path0 int, pos int"))


def test_leaves(spark):
    got = sorted(((r.id, r.path, r.value) for r in variants.leaves(table(spark), "j").collect()), key=str)
    want = [(i, p, v) for i, t in [*enumerate(TEXTS), (0, TEXTS[0])] if parsed(t)[0] for p, v in walked("", parsed(t)[1])]
    assert got == sorted(want, key=str) and len(got) > 15
    plan = variants.leaves(table(spark), "j")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_table_of_a_row_a_node_is_broadcast(spark):
    plans = [variants.leaves(table(spark), "j"), variants.leaves(table(spark), "j", keep=["id"]), variants.cleaned_json(table(spark), "j", "c")]
    assert not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert sorted(map(str, plans[0].select("id", "path", "value").collect())) == sorted(map(str, plans[1].collect()))
    assert "Join" not in plans[1]._jdf.queryExecution().toString()


def test_cleaned(spark):
    got = {r.id: r.clean for r in variants.cleaned_json(table(spark), "j", "clean").collect()}
    for i, t in enumerate(TEXTS):
        ok, x = parsed(t)
        if not ok:
            assert got[i] == t
        else:
            assert json.loads(got[i], parse_float=Decimal) == json.loads(json.dumps(cleaned(x)), parse_float=Decimal)
    assert got[0].startswith('{"a":null,"b":[1,2.5,{"c":"x y","d":[]}]')


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, j string")
    assert variants.leaves(none, "j").count() == 0 and variants.cleaned_json(none, "j", "c").columns == ["id", "j", "c"]
